"""Dictionary replacement (C11, I3, I4) and spelling correction."""

from pyspark.sql import functions as F

from tracelens.operators import textprep as tp


def test_spelling_goldens(spark):
    dictionary = spark.createDataFrame(
        [("button", 30), ("receive", 50), ("relieve", 20), ("the", 100)], "term string, freq long")
    words = spark.createDataFrame([("buton",), ("recieve",), ("zzzz",), ("the",)], "word string")
    got = {r.word: (r.correction, r.dist) for r in tp.correct_words(words, dictionary).collect()}
    assert got == {"buton": ("button", 1), "recieve": ("receive", 1), "zzzz": ("zzzz", 0),
                   "the": ("the", 0)}


def test_symmetric_delete_is_exact(spark):
    import itertools
    vocab = ["abcde", "abdce", "xbcde", "abc", "abcdefg", "bcd", "acbde", "aabcde"]
    words = ["abcde", "abced", "bcde", "abcdx", "zz", "abcdef"]
    dictionary = spark.createDataFrame([(v, 1) for v in vocab], "term string, freq long")
    wdf = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.term): r.dist for r in tp.spelling_candidates(wdf, dictionary).collect()}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, cb in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
        return d[len(b)]

    def dist(a, b):
        if len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2:] == b for i in range(len(a) - 1)):
            return 1
        return lev(a, b)

    want = {(w, v): dist(w, v) for w, v in itertools.product(words, vocab) if dist(w, v) <= 2}
    assert got == want


def test_replace_words(spark):
    texts = spark.createDataFrame([(1, "The HTTP API is OK, USER! HTTPS stays."), (2, None)],
                                  "id long, text string")
    acr = spark.createDataFrame([("HTTP", "hypertext_transfer_protocol"), ("API", "interface")],
                                "acronym string, expansion string")
    words = spark.createDataFrame([("user",), ("ok",)], "word string")
    got = {r.id: r.text for r in tp.replace_words(texts, "id", acr, words).collect()}
    assert got[1] == "The hypertext transfer protocol interface is ok, user! HTTPS stays."
    assert got[2] == ""


def test_correct_texts_against_brute_force(spark):
    """Whole texts: each ASCII word corrected as a brute-force search over the dictionary would."""
    import re

    dict_rows = [("receive", 50), ("relieve", 80), ("report", 40), ("export", 30), ("the", 500),
                 ("handler", 20), ("login", 25), ("user", 60), ("users", 10)]
    dictionary = spark.createDataFrame(dict_rows, "term string, freq long")
    texts = ["Teh user cant recieve the REPROT.", "loggin handlr fails for usres; déjà vu",
             "", "EXPORT expotr exprot", "qqqqqq zz", "x1 recieve_it Usre"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text for r in tp.correct_texts(df, "id", dictionary).collect()}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    def dist(a, b):
        swapped = any(a[:i] + a[i + 1] + a[i] + a[i + 2:] == b for i in range(len(a) - 1))
        return 1 if len(a) == len(b) and swapped else lev(a, b)

    terms = dict(dict_rows)

    def fix_word(w):
        lw = w.lower()
        if lw in terms:
            return w
        cands = [(dist(lw, t), -f, t) for t, f in terms.items() if dist(lw, t) <= 2]
        if not cands:
            return w
        c = min(cands)[2]
        if w.isupper() and len(w) > 1:
            return c.upper()
        return c[0].upper() + c[1:] if w[0].isupper() else c

    for i, t in enumerate(texts):
        # pieces: runs of word characters and runs of other characters; only
        # pieces made of ASCII letters go through the corrector
        want = "".join(fix_word(p) if re.fullmatch(r"[A-Za-z]+", p) else p
                       for p in re.findall(r"\w+|\W+", t))
        assert got[i] == want, (t, got[i], want)


def test_transpositions_any_against_brute_force(spark):
    """Opt-in distance: adjacent swaps count as one edit anywhere (edits of edits, <= 2)."""
    import random

    def edits1(w, alphabet):
        splits = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        out = {l + r[1:] for l, r in splits if r}
        out |= {l + r[1] + r[0] + r[2:] for l, r in splits if len(r) > 1}
        out |= {l + c + r[1:] for l, r in splits if r for c in alphabet}
        out |= {l + c + r for l, r in splits for c in alphabet}
        return out

    def osa(a, b):  # edits-of-edits distance as a corrector counts it, capped at 3
        if a == b:
            return 0
        alphabet = set(a + b)
        one = edits1(a, alphabet)
        if b in one:
            return 1
        return 2 if any(b in edits1(x, alphabet) for x in one) else 3

    rnd = random.Random(7)
    terms = ["receive", "relieve", "report", "export", "handler", "login", "address", "believe", "seize"]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def mutate(w):
        for _ in range(2):
            i = rnd.randrange(max(len(w) - 1, 1))
            op = rnd.choice(["swap", "sub", "del", "ins"])
            if op == "swap" and len(w) > 1:
                w = w[:i] + w[i + 1] + w[i] + w[i + 2:]
            elif op == "sub":
                w = w[:i] + rnd.choice(letters) + w[i + 1:]
            elif op == "del" and len(w) > 2:
                w = w[:i] + w[i + 1:]
            else:
                w = w[:i] + rnd.choice(letters) + w[i:]
        return w

    words = sorted({mutate(t) for t in terms for _ in range(12)} | {"rceeiev", "hnadelr", "lgoin"})
    pairs = spark.createDataFrame([(w, t) for w in words for t in terms], "w string, t string")
    got = {(r.w, r.t): r.d for r in pairs.select("w", "t", tp.edit_distance(
        F.col("w"), F.col("t"), 2, transpositions="any").alias("d")).collect()}
    for (w, t), d in got.items():
        want = osa(w, t)
        assert d == (want if want <= 2 else -1), (w, t, d, want)
    # the candidate search finds every such pair
    dictionary = spark.createDataFrame([(t, 10) for t in terms], "term string, freq long")
    wdf = spark.createDataFrame([(w,) for w in words], "word string")
    cands = {(r.word, r.term) for r in tp.spelling_candidates(wdf, dictionary, 2, "any").collect()}
    assert cands == {(w, t) for w in words for t in terms if osa(w, t) <= 2}


def test_lexical_expansions(spark):
    words = spark.createDataFrame([("CAT",), ("DOG",), ("LONE",), ("NONE",), ("CAT",), (None,)], "acronym string")
    senses = spark.createDataFrame([("cat", 2, "feline2"), ("Cat", 1, "feline1"), ("cat", 1, "zz"), ("dog", 1, "top"), ("dog", 2, "canine"),
                                    ("lone", 5, "single"), (None, 1, "x"), ("cow", 1, None)], "word string, rank int, sense string")
    hypernyms = spark.createDataFrame([("feline1", 3, "pet"), ("feline1", 2, "animal"), ("canine", 1, "animal"), ("single", 1, "unnamed")],
                                      "sense string, rank int, hypernym string")
    lemmas = spark.createDataFrame([("animal", 2, "beast"), ("animal", 1, "living_thing"), ("animal", 1, "being_alive"), ("pet", 1, "pet")],
                                   "sense string, rank int, lemma string")
    got = tp.lexical_expansions(words, senses, hypernyms, lemmas).collect()
    assert [tuple(r) for r in got] == [("CAT", "being_alive")]  # the first sense of dog has nothing above it
    texts = spark.createDataFrame([(1, "A CAT, my DOG and CATS; CAT"), (2, None), (3, "")], "id int, text string")
    out = {r.id: r.text for r in tp.expand_through_graph(texts, "id", senses, hypernyms, lemmas).collect()}
    assert out == {1: "A being alive, my DOG and CATS; being alive", 2: "", 3: ""}
    none = tp.lexical_expansions(words, senses.where("false"), hypernyms, lemmas)
    assert none.count() == 0


def test_corpus_terms_count_without_shuffling_texts(spark, tmp_dir):
    """Terms of all rows, also of repeated, null and textless ones; only counted terms are shuffled."""
    from tracelens.plans import queries_text as qt

    rows = [(1, "Aa bb aa"), (1, "aa"), (None, "bb cc"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    terms = qt._corpus_terms(spark, tmp_dir)
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" not in plan
    assert {(r.term, r.freq) for r in terms.collect()} == {("aa", 3), ("bb", 2), ("cc", 1)}


def test_pieces_are_partitioned_by_bytes(spark, monkeypatch):
    from tracelens import session

    seen = []
    plain = session.repartition_by_size
    monkeypatch.setattr(tp, "repartition_by_size", lambda df, keys: seen.append(plain(df, keys, 5_000)) or seen[-1])
    texts = spark.range(500).select("id", F.lit("The  buton " + "x " * 40).alias("text"))
    fixed = tp.correct_texts(texts, "id", spark.createDataFrame([("button", 3), ("the", 9)], "term string, freq long"))
    assert {r.text for r in fixed.collect()} == {"The  button " + "x " * 40}
    assert seen[0].rdd.getNumPartitions() > 8
