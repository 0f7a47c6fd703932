"""Forms in Spark against the same rules on one string, pairs against brute force."""

import random
import unicodedata

from billspark.llm import lookalike as L

SAME = [
    ["Clínica fee", "Clínica fee", "Clínica fee", "Clínica fee", "Clí​nica fee", "Сlínісa fee", "Ｃｌíｎｉｃａ　ｆｅｅ", "Clínica﻿fee".replace("﻿", " ﻿")],
    ["off-site ﬁle", "off‑site file", "oﬀ‐site fi­le", "оff-ѕitе file"],
    ["ộ x", "ộ x", "ộ x", "ộ x", "ộ x"],
    ["한글", "한글"],
]
DIFFERENT = ["fee", "Fee", "fée", "fee.", "fee ", "fee\n", "f ee", "1", "l", "I", "0", "O", "x²", "x2", "½", "1/2", "’", "'", "–", "-", "", " "]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as form", "2 as _h", "'k' as ch")


def forms(spark, texts):
    return {r["doc_id"]: r["form"] for r in L.consistent_form(table(spark, list(enumerate(texts)))).collect()}


def test_forms(spark):
    texts = [t for g in SAME for t in g] + DIFFERENT
    got = forms(spark, texts)
    assert len(got) == len(texts) and all(got[i] == L.canonical(t) for i, t in enumerate(texts))
    for g in SAME:
        assert len({got[texts.index(t)] for t in g}) == 1, g
    assert len({got[texts.index(t)] for t in DIFFERENT}) == len(DIFFERENT)
    assert all(unicodedata.is_normalized("NFC", f) for f in got.values())


def test_random_texts_and_pairs(spark):
    r = random.Random(5)
    base = ["Clínica ộ file", "aсé x", "ﬃ y"]

    def worse(t):
        t = "".join(r.choice((c, unicodedata.normalize("NFD", c), c + "‍")) for c in t)
        return t.replace(" ", r.choice((" ", " ", " ")))

    texts = [worse(r.choice(base)) for _ in range(60)] + [None, "", "", "​", base[0], base[0]]
    got = {(x["doc_id_a"], x["doc_id_b"]) for x in L.lookalike_pairs(table(spark, list(enumerate(texts)))).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and L.canonical(a) == L.canonical(b)}
    assert got == want and want


def test_nulls_repeats_empty(spark):
    rows = [(1, "é"), (1, "é"), (2, "é"), (None, "é"), (3, None)]
    t = table(spark, rows)
    assert [tuple(x) for x in L.lookalike_pairs(t).collect()] == [(1, 2)]
    assert L.consistent_form(t).where("doc_id = 3").head()["form"] is None
    assert L.lookalike_pairs(t.limit(0)).count() == 0 and L.consistent_form(t.limit(0)).count() == 0


def test_long_text(spark):
    long = "éﬁ х " * 20_000
    assert forms(spark, [long])[0] == L.canonical(long)


def test_many_copies_and_one_variant(spark):
    """20,000 copies of a text and two variants: the pairs of the variants, nothing of the copies among each other."""
    rows = [(i, "A standard sentence that stands everywhere.") for i in range(20_000)] + [(30_000, "A standard\u00a0sentence that stands everywhere."), (30_001, "\u0410 standard sentence that stands everywhere."), (30_001, "\u0410 standard sentence that stands everywhere."), (30_002, None), (None, "A standard\u00a0sentence that stands everywhere.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = L.lookalike_pairs(df)
    assert pairs.count() == 40_001 and pairs.where("doc_id_a = 7").count() == 2 and pairs.where("doc_id_a >= doc_id_b").count() == 0
    c = {r["doc_id"]: (r["class_id"], r["copies"], r["texts"]) for r in L.lookalike_classes(df).collect()}
    assert len(c) == 20_002 and c[5] == (0, 20_000, 3) and c[30_001] == (0, 1, 3)
    assert L.lookalike_classes(df.limit(0)).count() == 0 and L.lookalike_pairs(df.limit(0)).count() == 0
