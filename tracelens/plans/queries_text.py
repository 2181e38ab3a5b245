"""Scalar text and path queries, dictionaries and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links as fl
from ..functions import paths as fp
from ..functions import text as ft
from ..operators import textprep as tp
from ..session import materialize
from . import roles
from .registry import register
from .tables import table

TOKEN_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

# Identifiers built from order rows: a status letter, the priority words in
# lower case, an id part, then one of three tails (capital run, dunder name,
# non-ASCII capital).
IDENT_SQL = """o_orderstatus || replace(lower(substr(o_orderpriority, 3)), ' ', '_') || 'Id'
  || CAST(o_orderkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '_HTTPServer'
  WHEN 1 THEN '__init__' ELSE 'ÉtéTwo' END"""


@register("ident_split", sql=f"""
SELECT o_orderkey, ident,
       array_to_string(list_filter(string_split(regexp_replace(ident, '(\\p{{Lu}})', '_\\1', 'g'), '_'),
                                   lambda s: s <> ''), ' ') AS words
FROM (SELECT o_orderkey, {IDENT_SQL} AS ident FROM orders)
""")
def ident_split(spark, sf_dir):
    """H9: identifiers split into words (capital runs fall apart, as in the reference)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(IDENT_SQL).alias("ident"))
    return o.select("o_orderkey", "ident", ft.split_identifier("ident").alias("words"))


@register("text_clean", sql="""
SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text
FROM conversations
""")
def text_clean(spark, sf_dir):
    """Whitespace runs collapsed to one space, ends trimmed."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ft.collapse_whitespace("text").alias("text"))


URL_PATH_RE = r"^https?://[^/]+(/[^?#]*)"
URL_REST_RE = r"^https?://[^/]+/([^?#]*)"
# DuckDB text: a Windows-style path "./test/repo\<rest with backslashes>".
_WIN_DUCK = "'./test/repo\\' || replace(regexp_extract(url, '" + URL_REST_RE + "', 1), '/', '\\')"
_REL_DUCK = "replace(regexp_extract(" + _WIN_DUCK + r", '^\./test/repo[\\/](.+)$', 1), '\', '/')"
_LINES_DUCK = (r"CAST(len(list_filter(list_transform(string_split(replace(html, chr(13) || chr(10), chr(10)), "
               r"chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS INTEGER)")


@register("path_parts", sql=f"""
SELECT page_id,
       TRY_CAST(string_split(url, '/')[-1] AS BIGINT) AS tail_number,
       string_split(regexp_extract(url, '{URL_PATH_RE}', 1), '/')[-1] AS short_name,
       {_REL_DUCK} AS rel_path,
       {_LINES_DUCK} AS n_lines
FROM pages
""")
def path_parts(spark, sf_dir):
    """H3 + H4 + H7 + H18 on page URLs and bodies.

    ``rel_path`` comes from a Windows-style path built under ``./test/repo``.
    """
    p = table(spark, sf_dir, "pages")
    win = F.concat(F.lit("./test/repo\\"),
                   F.translate(F.regexp_extract("url", URL_REST_RE, 1), "/", "\\"))
    return p.select(
        "page_id",
        fl.number_from_url("url").alias("tail_number"),
        fp.short_repo_name(F.regexp_extract("url", URL_PATH_RE, 1)).alias("short_name"),
        fp.relative_path(win, "./test/repo").alias("rel_path"),
        F.size(ft.lines("html")).alias("n_lines"),
    )


TREE_SQL = f"""tree AS (SELECT CAST(p_size AS BIGINT) AS repo_id,
    CASE WHEN p_type = 'SMALL' THEN p_brand ELSE {roles.FILE_PATH_SQL} END AS path,
    CASE WHEN p_type = 'SMALL' THEN 'dir' ELSE 'file' END AS type, p_brand, p_type
  FROM part)"""


@register("row_filters", sql=f"""
WITH {TREE_SQL}
SELECT repo_id, CAST(count(*) AS BIGINT) AS n_entries,
       CAST(count(*) FILTER (WHERE type <> 'dir') AS BIGINT) AS n_files,
       CAST(count(*) FILTER (WHERE type <> 'dir' AND ends_with(path, '.py')) AS BIGINT) AS n_py,
       CAST(count(*) FILTER (WHERE p_type = 'STANDARD' AND p_brand = 'Brand#1') AS BIGINT) AS n_match
FROM tree GROUP BY repo_id
""")
def row_filters(spark, sf_dir):
    """B5 + B6 + B7 + D4: equality conjunction, suffix and entry-type predicates, counted."""
    p = table(spark, sf_dir, "part")
    is_dir = F.col("p_type") == "SMALL"
    tree = p.select(F.col("p_size").cast("bigint").alias("repo_id"),
                    F.when(is_dir, F.col("p_brand")).otherwise(F.expr(roles.FILE_PATH_SQL)).alias("path"),
                    F.when(is_dir, "dir").otherwise("file").alias("type"), "p_brand", "p_type")
    not_dir = F.col("type") != "dir"

    def n(cond):
        return F.count(F.when(cond, 1))

    return tree.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_entries"),
        n(not_dir).alias("n_files"),
        n(not_dir & F.col("path").endswith(".py")).alias("n_py"),
        n((F.col("p_type") == "STANDARD") & (F.col("p_brand") == "Brand#1")).alias("n_match"))


MAX_TOKENS = 512


@register("overlength", sql=f"""
SELECT doc_id, CAST(len({TOKEN_SQL}) AS INTEGER) AS n_tokens FROM documents
WHERE len({TOKEN_SQL}) > {MAX_TOKENS}
""")
def overlength(spark, sf_dir):
    """B14 (re-aimed): files whose token count exceeds the model's input length."""
    d = table(spark, sf_dir, "documents")
    n = ft.token_count("text")
    return d.where(n > MAX_TOKENS).select("doc_id", n.alias("n_tokens"))


# Dictionaries passed to the acronym query (user tables in the library).
ACRONYMS = [("HTTP", "hypertext_transfer_protocol"), ("API", "application_programming_interface"),
            ("URL", "address"), ("SQL", "query_language")]
ENGLISH = ["user", "system", "ok"]
ACRO_TEXT_SQL = "text || ' ' || upper(role) || ' HTTP API OK, URL: SQLX'"


def _acro_sql() -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{e.replace('_', ' ')}'" for a, e in ACRONYMS)
    words = ", ".join(f"'{w}'" for w in ENGLISH)
    piece = ("CASE WHEN regexp_full_match(p, '[A-Z]+') AND p IN ("
             + ", ".join(f"'{a}'" for a, _ in ACRONYMS) + f") THEN (CASE p {cases} END) "
             f"WHEN upper(p) = p AND lower(p) <> p AND lower(p) IN ({words}) THEN lower(p) ELSE p END")
    return f"""
SELECT conv_id, turn,
       array_to_string(list_transform(
         regexp_extract_all({ACRO_TEXT_SQL}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
         lambda p: {piece}), '') AS text
FROM conversations"""


@register("acronyms", sql=_acro_sql())
def acronyms(spark, sf_dir):
    """I3 + I4 + C11 (+ H11-H13): acronyms expanded, all-capital English words lower-cased."""
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(ACRO_TEXT_SQL).alias("text"))
    acr = spark.createDataFrame(ACRONYMS, "acronym string, expansion string")
    words = spark.createDataFrame([(w,) for w in ENGLISH], "word string")
    return tp.replace_words(c, ["conv_id", "turn"], acronyms=acr, words=words).select(
        "conv_id", "turn", "text")


# A lexical graph: the words of part names have senses (the part's number gives the rank), nations put half of the senses
# below five others, customers name these by their segment.
GRAPH_SQL = {
    "senses": "SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey AS rank, 's' || CAST(p_partkey * 7 % 50 AS STRING) AS sense FROM part",
    "hypernyms": "SELECT 's' || CAST(n_nationkey AS STRING) AS sense, n_regionkey AS rank, 'h' || CAST(n_regionkey AS STRING) AS hypernym FROM nation",
    "lemmas": "SELECT 'h' || CAST(c_custkey % 5 AS STRING) AS sense, c_custkey AS rank, lower(c_mktsegment) || '_trade' AS lemma FROM customer",
}


@register("lexical_graph", sql=f"""
WITH s AS ({GRAPH_SQL['senses']}), h AS ({GRAPH_SQL['hypernyms']}), l AS ({GRAPH_SQL['lemmas']}),
s1 AS (SELECT word, arg_min(sense, (rank, sense)) AS sense FROM s GROUP BY word),
h1 AS (SELECT sense, arg_min(hypernym, (rank, hypernym)) AS hypernym FROM h GROUP BY sense),
l1 AS (SELECT sense, arg_min(lemma, (rank, lemma)) AS lemma FROM l GROUP BY sense),
x AS (SELECT upper(word) AS acronym, replace(lemma, '_', ' ') AS expansion
      FROM s1 JOIN h1 ON s1.sense = h1.sense JOIN l1 ON h1.hypernym = l1.sense),
w AS (SELECT p_partkey, unnest(string_split(upper(p_name) || ' ' || p_type || ' ' || p_name, ' ')) AS word,
             unnest(generate_series(1, len(string_split(upper(p_name) || ' ' || p_type || ' ' || p_name, ' ')))) AS i FROM part)
SELECT p_partkey, string_agg(coalesce(expansion, word), ' ' ORDER BY i) AS text
FROM w LEFT JOIN x ON w.word = x.acronym GROUP BY p_partkey
""")
def lexical_graph(spark, sf_dir):
    """H11 + I3: all-capital words replaced by the first lemma above their first sense."""
    part = table(spark, sf_dir, "part")
    senses = part.select(F.explode(F.split("p_name", " ")).alias("word"), F.col("p_partkey").alias("rank"),
                         F.concat(F.lit("s"), (F.col("p_partkey") * 7 % 50).cast("string")).alias("sense"))
    hypernyms = table(spark, sf_dir, "nation").select(
        F.expr("'s' || CAST(n_nationkey AS STRING)").alias("sense"), F.col("n_regionkey").alias("rank"),
        F.expr("'h' || CAST(n_regionkey AS STRING)").alias("hypernym"))
    lemmas = table(spark, sf_dir, "customer").select(
        F.expr("'h' || CAST(c_custkey % 5 AS STRING)").alias("sense"), F.col("c_custkey").alias("rank"),
        F.expr("lower(c_mktsegment) || '_trade'").alias("lemma"))
    texts = part.select("p_partkey", F.expr("upper(p_name) || ' ' || p_type || ' ' || p_name").alias("text"))
    return tp.expand_through_graph(texts, "p_partkey", senses, hypernyms, lemmas).select("p_partkey", "text")


# Spelling: an English corrector edits with the letters a-z, so the dictionary
# is every corpus term made of a-z; misspellings = every dictionary term with
# the second letter dropped or the second and third letters swapped.


def _corpus_terms(spark, sf_dir):
    """``(term, freq)`` over all documents: one count per term, combined before the shuffle, so no text is shuffled."""
    terms = table(spark, sf_dir, "documents").select(F.explode(ft.tokenize("text")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


# One edit by construction, so that each case is an equi-join: a letter dropped
# on either side, one letter replaced (the rest equal), or two neighbours swapped.
def _cut_sql(x):
    return f"SELECT {x}, unnest(range(1, length({x}) + 1)) AS i"


@register("spell_fix", sql=f"""
WITH tf AS (SELECT term, CAST(count(*) AS BIGINT) AS freq FROM
              (SELECT unnest({TOKEN_SQL}) AS term FROM documents) GROUP BY term),
dict AS (SELECT term, freq FROM tf WHERE regexp_full_match(term, '[a-z]+')),
words AS (SELECT DISTINCT word FROM (
            SELECT substr(term, 1, 1) || substr(term, 3) AS word FROM dict
            UNION ALL
            SELECT substr(term, 1, 1) || substr(term, 3, 1) || substr(term, 2, 1) || substr(term, 4) FROM dict)),
unknown AS (SELECT word FROM words WHERE word NOT IN (SELECT term FROM dict)),
wk AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM ({_cut_sql('word')} FROM unknown)),
dk AS (SELECT term, freq, i, substr(term, 1, i - 1) || substr(term, i + 1) AS k FROM ({_cut_sql('term')}, freq FROM dict)),
ws AS (SELECT word, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) AS k
       FROM ({_cut_sql('word')} FROM unknown) WHERE i < length(word)),
near AS (SELECT word, term, freq FROM wk JOIN dict ON k = term
         UNION ALL SELECT word, term, freq FROM dk JOIN unknown ON k = word
         UNION ALL SELECT word, term, freq FROM wk JOIN dk ON wk.i = dk.i AND wk.k = dk.k
         UNION ALL SELECT word, term, freq FROM ws JOIN dict ON k = term),
best AS (SELECT word, arg_min(term, (-freq, term)) AS correction FROM near GROUP BY word)
SELECT w.word, coalesce(b.correction, w.word) AS correction,
       CAST(CASE WHEN b.word IS NULL THEN 0 ELSE 1 END AS INTEGER) AS dist
FROM words w LEFT JOIN best b ON w.word = b.word
""")
def spell_fix(spark, sf_dir):
    """Misspellings corrected against the corpus dictionary (exact, symmetric deletes)."""
    # The words are made of it too: counted once.
    dictionary = materialize(_corpus_terms(spark, sf_dir).where(F.col("term").rlike("^[a-z]+$")), "terms")
    t = F.col("term")
    drop2 = F.concat(F.substr(t, F.lit(1), F.lit(1)), F.substr(t, F.lit(3)))
    swap23 = F.concat(F.substr(t, F.lit(1), F.lit(1)), F.substr(t, F.lit(3), F.lit(1)),
                      F.substr(t, F.lit(2), F.lit(1)), F.substr(t, F.lit(4)))
    words = dictionary.select(F.explode(F.array(drop2, swap23)).alias("word")).distinct()
    return tp.correct_words(words, dictionary).select("word", "correction", "dist")


# No oracle SQL: the all-words candidate search is too slow in DuckDB on whole
# tables; tests check ``correct_texts`` against a brute-force search instead.
@register("comment_spell_fix")
def comment_spell_fix(spark, sf_dir):
    """I5 on whole texts: every comment's words corrected against the corpus dictionary."""
    dictionary = _corpus_terms(spark, sf_dir).where(F.col("term").rlike("^[a-z]+$"))
    comments = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return tp.correct_texts(comments, ["conv_id", "turn"], dictionary).select("conv_id", "turn", "text")
