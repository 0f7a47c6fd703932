"""Distances against the plain matrix; planted passages, phrases and standard sentences."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from billspark.llm import leakage as L

R = random.Random(11)
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
ITEMS = [(i, " ".join(R.sample(WORDS, 50)) + ". This standard sentence stands in several of the items and says nothing of its own at all.") for i in range(30)]
FILL = "the office may reply within ten days and the page shows the total due on the bill"


def plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.lists(st.integers(0, 3), max_size=70))
def test_myers(a, b):
    assert L.myers(a, b) == plain(a, b)


def worse(words):
    """A word in ten dropped, changed or added; marks and case."""
    out = []
    for w in words:
        x = R.random()
        out += [] if x < 0.03 else ["other"] if x < 0.06 else [w, "indeed"] if x < 0.09 else [f"<b>{w.upper()}</b>"] if x < 0.3 else [w + ","]
    return " ".join(out)


def found(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'k' as item_kind")
    return {(r["doc_id"], r["item_id"]) for r in L.leaked_items(d, i, **kw).collect()}


def test_planted(spark):
    docs, want = [], set()
    for n in range(60):
        i, text = ITEMS[n % 30]
        w = text.split()[:50]
        if n % 3 == 0:
            at = R.randrange(20)
            docs.append((n, f"{FILL}. {worse(w[at : at + 26])} {FILL}"))
            want.add((n, i))
        elif n % 3 == 1:
            docs.append((n, f"{FILL} {' '.join(w[5:17])} {FILL}. This standard sentence stands in several of the items and says nothing of its own at all."))
        else:
            j, other = ITEMS[(n + 7) % 30]
            docs.append((n, f"{' '.join(w[:14])}. {FILL} {FILL}. {' '.join(w[25:39])} {FILL} {' '.join(other.split()[:50])}"))
            want |= {(n, i), (n, j)}
    assert found(spark, docs) == want
    for chars in (2000, 10_000):
        assert found(spark, docs, block_chars=chars) == want


def test_spacing_and_letters(spark):
    w = "Sheet 59251 pairs infusion visit with $2,950.00 since the portal screenshot shows 67127 and her cousin's photo from 2025-01-27 mentions room use"
    items = [(1, w)]
    docs = [(1, w.replace(" ", "  ").replace("a", "а")), (2, w.replace(",", "").replace(".", " ").replace("-", " ")), (3, w.upper()), (4, None), (5, ""), (6, "Sheet 59251 pairs infusion visit")]
    assert found(spark, docs + docs, items) == {(1, 1), (2, 1), (3, 1)}


def test_equal_items_nulls_empty(spark):
    w = ITEMS[0][1]
    items = [(1, w), (2, w.upper()), (3, None), (4, ""), (None, w)]
    assert found(spark, [(9, " ".join(w.split()[:40]))], items) == {(9, 1), (9, 2)}
    assert found(spark, [(9, w)], []) == set() and found(spark, [], ITEMS) == set()


def test_long_document(spark):
    assert found(spark, [(1, f"{FILL} " * 20_000 + " ".join(ITEMS[3][1].split()[:30]))]) == {(1, 3)}


def test_pieces_of_many_items():
    R = random.Random(5)
    a, b, c = (R.sample(WORDS, 20) for _ in range(3))
    both = [f"{a[2 * k]} {a[2 * k + 1]} {b[k]}" for k in range(8)]
    items = [(1, " ".join(both + c))] + [(10 + 8 * j + k, f"x{chr(97 + j)}{chr(97 + k)} {both[k]} y{chr(97 + j)}{chr(97 + k)} " * 8) for j in range(6) for k in range(8)]
    index = L.ItemIndex(items)
    assert index.kept(" ".join(both)).get(1, 0) >= 20
    assert index.kept(" zz zz zz zz zz zz zz zz zz ".join(both)).get(1, 0) < 13


def test_few_is_no_share_of_the_items():
    w = ITEMS[0][1].split()[:30]
    items = [(1, " ".join(w))] + [(10 + k, f"{' '.join(w[3 * k % 27 : 3 * k % 27 + 3])} {' '.join(f'q{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j)}' for j in range(20))}") for k in range(60)]
    assert L.ItemIndex(items).kept(" ".join(w[:9] + ["zz"] * 12 + w[12:21])).get(1, 0) == 18


def test_changed_words_at_the_ends():
    w = ITEMS[4][1].split()[10:30]
    for at in ([2, 5, 8], [3, 6, 9, 12, 15], [1, 3, 16, 18], [2, 4, 9, 14, 17], [1, 4, 7, 10, 13]):
        doc = [f"zz{chr(97 + k)}" if k in at else x for k, x in enumerate(w)]
        assert L.ItemIndex(ITEMS).kept(f"{FILL} {' '.join(doc)} {FILL}").get(4, 0) >= 13, at
    assert L.ItemIndex(ITEMS).kept(f"{FILL} {' '.join(w[:12])} {FILL}").get(4, 0) < 13


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=25))
def test_outward(a, b):
    got = L.outward(a, b, 5)
    want = [min(plain(a[:k], b[:j]) for j in range(len(b) + 1)) for k in range(len(a) + 1)]
    assert [x for x, _ in got] == want[: len(got)] and all(x > 5 for x in want[len(got) :])
    assert all(plain(a[:k], b[:j]) == x for k, (x, j) in enumerate(got))


def test_blocks_of_items_change_nothing(spark):
    """Standard sentences, items of similar wording, equal items and phrases of many items, in one block or in many."""
    R = random.Random(11)
    standard = " ".join(R.sample(WORDS, 16))
    base = [R.sample(WORDS, 45) for _ in range(6)]
    items = [(k, f"{' '.join(base[k % 6][: 20 + k])} {standard} {' '.join(R.sample(WORDS, 30))}") for k in range(18)]
    items += [(100 + k, items[k][1].upper()) for k in range(3)] + [(200 + k, f"{' '.join(base[0][3:8])} {' '.join(R.sample(WORDS, 30))}") for k in range(8)]
    docs = [(1, standard), (2, f"{FILL} {' '.join(base[1][:30])} {standard}"), (3, items[2][1]), (3, items[2][1]), (4, " ".join(items[k][1] for k in (0, 6, 12))), (5, " ".join(base[0][3:8] + ["zz"] + base[0][9:14])), (6, None), (7, items[205 - 200 + 21][1])]
    df, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, *others = ({tuple(r) for r in L.leaked_items(df, t, block_chars=n).collect()} for n in (10**9, 3000, 700))
    assert one and all(x == one for x in others)
    assert not any(d == 1 for d, _, _ in one) and {i for d, i, _ in one if d == 3} >= {2, 102}


def test_few_hits_are_left_out_without_loss():
    """What an item keeps with ``least`` words asked for is what it keeps without, whenever it keeps as many."""
    R = random.Random(21)
    index = L.ItemIndex(ITEMS)
    assert index.enough(13, 8) == 3 and index.enough(1, 8) == 1
    for n in range(400):
        w = ITEMS[n % 30][1].split()
        at, k = R.randrange(30), R.randrange(4, 30)
        part = [x if R.random() > 0.3 else R.choice(WORDS) for x in w[at : at + k]]
        text = f"{FILL} {' '.join(part)} {' '.join(R.sample(WORDS, 10))} {' '.join(ITEMS[(n + 3) % 30][1].split()[2 : 2 + R.randrange(20)])}"
        a, b = ({i: n for i, n in index.kept(text, least=x).items() if n >= 13} for x in (1, 13))
        assert a == b
