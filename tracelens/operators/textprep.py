"""Text preparation with dictionaries.

The reference expands acronyms through a lexical database, lower-cases
all-capital English words and runs every file's text through a frequency
spelling corrector.  Those resources are not shipped; the build takes them as
user tables and does the work as joins:

* ``replace_words`` (C11, I3, I4): texts are cut into word and non-word pieces,
  the pieces are joined to the dictionaries (broadcast when their measured
  size allows, else shuffled) and re-assembled in order.  Replacement is by
  whole word, all at once (SURVEY Q13).
* ``spelling_candidates`` / ``correct_words`` (I5): symmetric-delete search.
  Every word and every dictionary term is expanded into its deletion
  neighbourhood (up to two deleted characters); words and terms sharing a key
  are candidates, verified by edit distance with an adjacent swap counting as
  one edit.  This finds every term within distance two, without comparing
  all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_acronyms, is_all_caps
from ..session import fits_broadcast, materialize, repartition_by_size

# Fixed value: a text is cut into maximal runs of word characters and of
# other characters, so re-joining the pieces restores it exactly.
PIECE_PATTERN = r"(?s)[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
WORD_PIECE = r"^[\p{L}\p{N}_]+$"


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a dictionary only after measuring it."""
    return F.broadcast(df) if fits_broadcast(df) else df


def pieces(texts: DataFrame, key: Sequence[str] | str, text: str = "text") -> DataFrame:
    """Word and non-word pieces with their position: ``(key..., pos, piece)``."""
    k = _cols(key)
    return texts.select(*k, F.posexplode(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE_PATTERN), 0)
    ).alias("pos", "piece"))


def reassemble(parts: DataFrame, key: Sequence[str] | str, piece: str = "piece",
               out: str = "text") -> DataFrame:
    """Concatenate pieces per text in position order.

    Texts should be partitioned by ``key`` upstream (``pieces`` keeps the
    input's partitioning), so the regroup needs no shuffle; each group is one
    text, the same size as the input row it came from.
    """
    k = _cols(key)
    return (parts.groupBy(*k)
                 .agg(F.array_sort(F.collect_list(F.struct("pos", F.col(piece).alias("p")))).alias("__ps"))
                 .select(*k, F.array_join(F.transform("__ps", lambda s: s["p"]), "").alias(out)))


def replace_words(texts: DataFrame, key: Sequence[str] | str, acronyms: DataFrame | None = None,
                  words: DataFrame | None = None, text: str = "text",
                  out: str = "text") -> DataFrame:
    """I3 + I4 via C11.

    ``acronyms(acronym, expansion)``: an all-ASCII-capital word found there is
    replaced by its expansion (``_`` shown as a space).  ``words(word)``: an
    all-capital word whose lower case is listed is lower-cased.  Other pieces
    are kept.  Texts with no pieces come back as ``""``.
    """
    k = _cols(key)
    src = repartition_by_size(texts.select(*k, text), k)
    parts = pieces(src, k, text)
    p = F.col("piece")
    repl = p
    if words is not None:
        w = _maybe_broadcast(words.select(F.col("word").alias("__w")).distinct())
        parts = parts.join(w, F.lower(p) == F.col("__w"), "left")
        repl = F.when(is_all_caps(p) & F.col("__w").isNotNull(), F.lower(p)).otherwise(repl)
    if acronyms is not None:
        a = _maybe_broadcast(acronyms.select(F.col("acronym").alias("__a"),
                                             F.translate("expansion", "_", " ").alias("__x"))
                                     .dropDuplicates(["__a"]))
        parts = parts.join(a, p == F.col("__a"), "left")
        acro = p.rlike(r"^[A-Z]+$") & F.col("__x").isNotNull()
        repl = F.when(acro, F.col("__x")).otherwise(repl)
    done = parts.select(*k, "pos", repl.alias("piece"))
    result = reassemble(done, k, "piece", out)
    return texts.drop(text).join(result, k, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def lexical_expansions(words: DataFrame, senses: DataFrame, hypernyms: DataFrame, lemmas: DataFrame,
                       word: str = "acronym") -> DataFrame:
    """I3 through a lexical graph: ``(acronym, expansion)`` for ``replace_words``.

    A word is looked up in lower case; its expansion is the first lemma of the
    first hypernym of its first sense.  ``senses(word, rank, sense)`` lists the
    senses of a word, ``hypernyms(sense, rank, hypernym)`` what is above a sense,
    ``lemmas(sense, rank, lemma)`` the names of a sense.  First is the smallest
    rank, ties by the other value.  A word without a sense, or whose first sense
    has no hypernym or its hypernym no lemma, has no row: later senses are not tried.

    Each step keeps one row per key by a grouped minimum of the rows that are
    reachable, so neither a word with many senses nor a sense with many names is gathered.
    """
    found = words.select(F.col(word).alias("__w"), F.lower(word).alias("__k")).where(F.col("__w").isNotNull()).distinct()

    def first(edges: DataFrame, key: str, value: str, reached: DataFrame, at: str) -> DataFrame:
        near = edges.select(F.col(key).alias(at), F.col("rank").alias("__r"), F.col(value).alias("__v")).where(
            F.col("__v").isNotNull()).join(_maybe_broadcast(reached.select(at).distinct()), at, "left_semi")
        best = near.groupBy(at).agg(F.min_by("__v", F.struct("__r", "__v")).alias("__next"))
        return reached.join(best, at).drop(at)

    senses = senses.withColumn("word", F.lower("word"))
    at_sense = first(senses, "word", "sense", found, "__k").withColumnRenamed("__next", "__k")
    above = first(hypernyms, "sense", "hypernym", at_sense, "__k").withColumnRenamed("__next", "__k")
    return first(lemmas, "sense", "lemma", above, "__k").select(F.col("__w").alias("acronym"), F.col("__next").alias("expansion"))


def expand_through_graph(texts: DataFrame, key: Sequence[str] | str, senses: DataFrame, hypernyms: DataFrame, lemmas: DataFrame,
                         words: DataFrame | None = None, text: str = "text") -> DataFrame:
    """H11 + I3 (+ I4): every all-capital word of the texts expanded through the graph."""
    used = texts.select(F.explode(find_acronyms(text)).alias("acronym")).distinct()
    found = materialize(lexical_expansions(used, senses, hypernyms, lemmas), "expansions")
    return replace_words(texts, key, acronyms=found, words=words, text=text)


# ---------------------------------------------------------------------------
# Spelling correction
# ---------------------------------------------------------------------------

def deletion_keys(word: Column, max_deletes: int = 2) -> Column:
    """The word and every string made by deleting 1..max_deletes characters."""
    def dels(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                           lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    level = F.array(word)
    keys = level
    for _ in range(max_deletes):
        level = F.array_distinct(F.flatten(F.transform(level, dels)))
        keys = F.array_union(keys, level)
    return keys


def swapped_at(a: Column, i: Column) -> Column:
    """``a`` with the characters at positions ``i`` and ``i + 1`` (1-based) swapped."""
    return F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)),
                    F.substr(a, i, F.lit(1)), F.substr(a, i + 2))


def _positions(a: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))


def swap_equal(a: Column, b: Column) -> Column:
    """True when ``b`` is ``a`` with one pair of adjacent characters swapped."""
    n = F.length(a)
    return (n == F.length(b)) & (n >= 2) & F.exists(_positions(a), lambda i: swapped_at(a, i) == b)


def edit_distance(a: Column, b: Column, max_distance: int | None = None,
                  transpositions: str = "single") -> Column:
    """Levenshtein distance, except that one adjacent swap counts as one edit.

    With ``max_distance`` the bounded Levenshtein is used and pairs beyond it
    get -1.  A swap of two different adjacent letters has Levenshtein
    distance 2, so the (interpreted) swap test runs only on those pairs.

    ``transpositions="any"`` (with ``max_distance=2``) counts a swap as one
    edit also next to another edit, as a corrector that applies edits to
    edits does: a swap plus one more edit (in either order), or two swaps,
    is distance 2.  Swap first: one swap of ``a`` is within one edit (or one
    more swap) of ``b``; edit first: ``a`` is within one edit of one swap of
    ``b`` (a swap is its own inverse).  The test runs only on pairs beyond
    Levenshtein 2.
    """
    lev = F.levenshtein(a, b) if max_distance is None else F.levenshtein(a, b, max_distance)
    d = F.when((lev == 2) & swap_equal(a, b), F.lit(1)).otherwise(lev)
    if transpositions == "single":
        return d
    if transpositions != "any" or max_distance != 2:
        raise ValueError("transpositions='any' is defined for max_distance=2")
    n = F.length(a)
    near = (F.exists(_positions(a), lambda i: (F.levenshtein(swapped_at(a, i), b, 1) >= 0)
                     | swap_equal(swapped_at(a, i), b))
            | F.exists(_positions(b), lambda j: F.levenshtein(a, swapped_at(b, j), 1) >= 0))
    return (F.when(d >= 0, d)
             .when((n >= 2) & (F.abs(n - F.length(b)) <= 1) & near, F.lit(2))
             .otherwise(F.lit(-1)))


def spelling_candidates(words: DataFrame, dictionary: DataFrame, max_distance: int = 2,
                        transpositions: str = "single", within: int | None = None) -> DataFrame:
    """All dictionary terms within ``max_distance`` of each word: ``(word, term, freq, dist)``.

    ``words(word)``; ``dictionary(term, freq)``.  Exact: symmetric deletion
    keys guarantee every pair within the distance shares a key (a swap costs
    one deletion on each side, so ``transpositions="any"`` pairs are found too).
    ``within=1`` finds only the pairs at distance 1, from keys of one deletion.
    """
    deletes = max_distance if within is None else within
    w = words.select("word").distinct().select("word", F.explode(deletion_keys(F.col("word"), deletes)).alias("k"))
    d = dictionary.select("term", "freq",
                          F.explode(deletion_keys(F.col("term"), deletes)).alias("k"))
    # Both sides grow with the vocabulary: a sort-merge join (spills, AQE
    # splits hot keys) rather than a broadcast chosen from an estimate.
    pairs = w.join(d.hint("merge"), "k").select("word", "term", "freq").distinct()
    return (pairs.withColumn("dist", edit_distance(F.col("word"), F.col("term"), max_distance,
                                                   transpositions))
                 .where((F.col("dist") >= 0) & (F.col("dist") <= deletes)))


def _best_candidate(cands: DataFrame) -> DataFrame:
    return (cands.groupBy("word")
                 .agg(F.min_by(F.struct("term", "dist"),
                               F.struct("dist", (-F.col("freq")).alias("nf"), "term")).alias("b"))
                 .select("word", F.col("b.term").alias("correction"), F.col("b.dist").alias("dist")))


def correct_words(words: DataFrame, dictionary: DataFrame, max_distance: int = 2,
                  transpositions: str = "single") -> DataFrame:
    """``(word, correction, dist)``; known words and words with no candidate stay.

    Choice: smallest distance, then highest frequency, then the smaller term.
    As the smallest distance wins, words with a term at distance 1 are settled
    from keys of one deletion; only the rest looks further.
    """
    w = materialize(words.select("word").distinct(), "words")
    dictionary = materialize(dictionary.select("term", "freq"), "dictionary")
    unknown = w.join(dictionary.select(F.col("term").alias("word")), "word", "left_anti")
    best = materialize(_best_candidate(spelling_candidates(unknown, dictionary, 2, "single", within=1)), "corrections-1")
    if max_distance > 1:
        rest = unknown.join(best.select("word"), "word", "left_anti")
        best = best.unionByName(_best_candidate(spelling_candidates(rest, dictionary, max_distance, transpositions)))
    return (w.join(best, "word", "left")
             .withColumn("correction", F.coalesce("correction", "word"))
             .withColumn("dist", F.coalesce("dist", F.lit(0))))


def correct_texts(texts: DataFrame, key: Sequence[str] | str, dictionary: DataFrame,
                  text: str = "text", out: str = "text", max_distance: int = 2,
                  transpositions: str = "single", alphabet: str = "a-zA-Z") -> DataFrame:
    """I5 on whole texts: every word of every text through the corrector.

    Texts are cut into word and non-word pieces (in order, nothing dropped).
    Words made of the dictionary's ``alphabet`` (a character class; ASCII letters
    by default, ``\\\\p{L}`` for every script) are corrected on their lower case by
    ``correct_words`` (run once over the distinct words of all texts, so the
    candidate search is bounded by the vocabulary, not by the text volume);
    an all-capital word comes back in capitals and a capitalised word
    capitalised.  Other pieces are kept.  ``dictionary(term, freq)``.
    """
    k = _cols(key)
    src = repartition_by_size(texts.select(*k, text), k)
    parts = pieces(src, k, text).withColumn("__w", F.lower("piece"))
    is_word = F.col("piece").rlike(f"^[{alphabet}]+$")
    words = parts.where(is_word).select(F.col("__w").alias("word")).distinct()
    fixes = (correct_words(words, dictionary, max_distance, transpositions)
             .where(F.col("correction") != F.col("word"))
             .select(F.col("word").alias("__w"), F.col("correction").alias("__c")))
    # The corrections table is vocabulary-sized; broadcast after measuring it.
    fixes = _maybe_broadcast(materialize(fixes, "corrections"))
    p = F.col("piece")
    fixed = (F.when(F.col("__c").isNull(), p)
              .when(is_all_caps(p) & (F.length(p) > 1), F.upper("__c"))
              .when(F.substring(p, 1, 1) == F.upper(F.substring(p, 1, 1)),
                    F.concat(F.upper(F.substring("__c", 1, 1)), F.substring("__c", 2, 1 << 30)))
              .otherwise(F.col("__c")))
    done = parts.join(fixes, "__w", "left").select(*k, "pos", fixed.alias("piece"))
    result = reassemble(done, k, "piece", out)
    return texts.drop(text).join(result, k, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))
