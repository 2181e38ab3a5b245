"""Incremental scoring as a stream (K3 extension, SURVEY 2.12).

New issue texts land as Parquet files in a folder; a file-source stream picks
them up, drops the ones already scored (``left_anti`` against the result
table) and scores the rest against the unit postings of their scope.  The
sink is ``foreachBatch`` appending to the result table; the stream's
checkpoint lives under the session's shared checkpoint folder, so a restart
after a lost driver or executor resumes at the last committed batch, and the
anti-join makes a replayed batch add nothing twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import similarity as sim
from ..session import broadcast_limit, ensure_checkpoint_dir, materialize, path_exists

ISSUE_TEXT_SCHEMA = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("issue_id", T.LongType()),
    T.StructField("text", T.StringType()),
])
DONE_SCHEMA = "scope string, issue_id bigint"
RESULT_SCHEMA = "scope string, issue_id bigint, unit_id string, score double, rank int"


def start_scoring(spark: SparkSession, issues_dir: str, unit_tf: DataFrame, results_dir: str,
                  k: int = 10, name: str = "incremental-scoring",
                  available_now: bool = True, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Start the stream; ``unit_tf(scope, unit_id, term, tf)`` are the unit postings.

    ``available_now`` processes what is there and stops (batch-style runs);
    otherwise the query keeps polling the folder.  A backlog is cut into
    micro-batches of at most ``max_files_per_trigger`` files.
    """
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    stream = (spark.readStream.schema(ISSUE_TEXT_SCHEMA)
              .option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", str(max_files_per_trigger))
              .parquet(issues_dir))
    keys = ["scope", "issue_id"]

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        batch_keys = batch.select(*keys).distinct()
        n_keys = batch_keys.count()
        if n_keys == 0:
            return
        done_dir = f"{results_dir.rstrip('/')}-scored"
        stored = [spark.read.schema(DONE_SCHEMA).parquet(d).select(*keys) for d in (done_dir, results_dir) if path_exists(spark, d)]
        if stored:
            done = reduce(DataFrame.union, stored)
            # Only stored results of this batch's issues matter: the batch's
            # keys (counted above) are broadcast when they fit, so the growing
            # result table is scanned but never shuffled.
            if n_keys * 64 <= broadcast_limit(spark):
                batch_keys = F.broadcast(batch_keys)
            seen = done.join(batch_keys, keys, "left_semi").distinct()
            todo = batch.join(seen, keys, "left_anti")
        else:
            todo = batch
        # Of several texts of one issue the smallest is scored, so that a replayed batch does the same;
        # written, because the mark below must not change what this batch still reads.
        todo = materialize(todo.groupBy(*keys).agg(F.min("text").alias("text")), "stream-batch")
        q_tf = sim.term_counts(todo, "issue_id", scope=["scope"])
        scores = sim.tfidf_pair_scores(q_tf, unit_tf, "issue_id", "unit_id", ["scope"])
        ranked = sim.rank_within(scores.withColumn("score", F.round("score", 6)),
                                 ["scope", "issue_id"], "unit_id", k)
        ranked.select("scope", "issue_id", "unit_id", "score", "rank").write.mode("append").parquet(results_dir)
        # Every scored issue is marked, also one that shares no term with any unit.
        todo.select(*keys).write.mode("append").parquet(done_dir)

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
