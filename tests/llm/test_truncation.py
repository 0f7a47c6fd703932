"""Endings of texts, planted limits and their posterior."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from billspark.llm import truncation as T


@pytest.mark.parametrize(("text", "sibling", "cut"), [
    ("It is paid.", None, False), ('He said "yes."', None, False), ("It is paid…", None, None), ("It is paid. …", None, False), ("Paid by P.O.", None, None), ("When you call,", None, True), (None, None, False), ("  ", None, False), ("N/A", None, False), ("​", None, False),
    ("The total at", "The total at the bottom.", True), ("One. Two", "One. Two\nThree", False), ("One.", "One. Two.", False), ("pays $2", "pays $25.", True), ("It is $2.", "It is $2.50 now.", True), ("The whole text", "The whole text", None),
    ("The rem…", "The remaining share.", True), ("Let me know...", "Let me know...", None),
])
def test_ending(text, sibling, cut):
    e, unit, _ = T.ending(text, sibling, None)
    assert (e > 0 if cut is not None else None) == cut and (unit is not None) == (cut is None)


def test_copy_of_the_prompt_is_no_cut():
    assert T.ending("Can I pay $40 over 8 months", None, "Can I pay $40 over 8 months?")[0] < 0


SENTENCES = ["The counselor can set up monthly payments without adding interest.", "Please keep the explanation next to the statement and compare the two.", "Charges marked as non-covered stay with you unless the plan decides otherwise.", "You can reach the office of the hospital for questions about this account."]
ENDS = ["\n\nHope this helps", "\n- Photo ID", "\n- Fill in the form\n- Request a hold", " Let me know how the call goes...", "\n\nDue date: 01/02/2024", ""]


def rows():
    r = random.Random(4)
    out, want = [], set()
    for i in range(900):
        t = " ".join(r.choice(SENTENCES) for _ in range(r.randrange(2, 12))) + r.choice(ENDS)
        source = ("capped", "free", "marked")[i % 3]
        full, cut = t, False
        if source == "capped" and len(t) > 300:
            t, cut = t[:300], True
        if source == "marked" and len(t) > 350:
            t, cut = t[:350] + "…", True
        if cut and t.rstrip("… \n")[-1:] == "." or full[len(t.rstrip("…")) :].startswith("\n"):
            cut = False
        out.append((i, source, "f", t, None, None))
        want |= {i} if cut else set()
    return out, want


SCHEMA = "id long, source string, field string, text string, sibling string, prompt string"


def test_planted_limits(spark):
    data, want = rows()
    extra = [(5000, None, "f", None, None, None), (5001, "free", "f", "", None, None), data[0], data[0]]
    df = spark.createDataFrame(data + extra, SCHEMA).selectExpr("*", "'x' as said", "1 as len", "2 as shape")
    got = T.truncation_posterior(df).toPandas()
    cut = set(got[got.p_cut > 0.5].id)
    assert len(cut ^ want) <= 0.02 * len(want), (cut - want, want - cut)
    at = got[(got.source == "capped") & (got.len == 300)]
    assert len(at) and (at.posterior > 0.9).all()


def test_many_stems_take_the_join(spark):
    data, _ = rows()
    df = spark.createDataFrame(data, SCHEMA)
    judged = T.judge_endings(df)
    stems = judged.where("stem is not null").select("stem").distinct()
    a, b = ({(r["stem"], r["next"]): (r["goes_on"], r["ends"]) for r in T.continuations(df, stems, n).collect()} for n in (1_000_000, 1))
    assert a == b and a


def test_empty(spark):
    assert T.truncation_posterior(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fit_of_a_censored_sample():
    r = random.Random(9)
    x = [int(math.exp(r.gauss(6, 0.5))) for _ in range(20_000)]
    h = pd.Series([min(v, 600) for v in x]).value_counts()
    pdf = pd.DataFrame({"source": "s", "field": "f", "len": h.index, "n": h.to_numpy(), "cut": [n if v == 600 else 0 for v, n in h.items()]})
    got = T.fit_censoring(pdf).set_index("lim").loc[600]
    assert abs(got["mu"] - 6) < 0.02 and abs(got["sigma"] - 0.5) < 0.02 and got["posterior"] > 0.97


def test_the_posterior_decides(spark):
    """Texts that end alike, with words that go on elsewhere and end an entry elsewhere: cut at the limit, whole off it."""
    r = random.Random(7)
    body = lambda n: " ".join(r.choice(SENTENCES) for _ in range(12))[: n - 25].rstrip(" .") + ".\n"
    out = []
    for i in range(400):
        t = body(r.randrange(150, 700)) + "- Bring two recent pay stubs and the letter of the office\n- Fill in the form."
        out.append((i, "capped", "f", t[:300] if len(t) > 300 else t, None, None))
    entry = "- Bring two recent pay stubs"
    for i in range(3):
        out.append((1000 + i, "free", "f", f"Number {'abc'[i]} of the list.\n" * (9 + i) + entry, None, None))
    head = SENTENCES[1] + " " + SENTENCES[2] + " " + SENTENCES[0]
    at = (head + " " + head)[: 299 - len(entry)].rsplit(".", 1)[0] + "."
    out.append((2000, "capped", "f", at + "\n" * (300 - len(entry) - len(at)) + entry, None, None))
    assert len(out[-1][3]) == 300
    df = spark.createDataFrame(out, SCHEMA)
    got = T.truncation_posterior(df).toPandas().set_index("id")
    assert got.loc[2000, "posterior"] > 0.9 and got.loc[2000, "p_cut"] > 0.5
    assert (got.loc[[1000, 1001, 1002], "p_cut"] < 0.5).all()
    # without the posterior the same evidence calls it whole
    assert got.loc[2000, "evidence"] + T.PRIOR < 0


def test_long_words_and_blanks(spark):
    long = "x" * 300
    rows = [(i, "s", "f", f"It is paid. See {long}yz of the office.", None, None) for i in range(5)] + [(9, "s", "f", f"It is paid. See {long}y", None, None), (10, "s", "f", " \n" * 80, None, None)]
    got = T.truncation_posterior(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("id")
    assert got.loc[9, "p_cut"] > 0.5 and got.loc[10, "p_cut"] < 0.5
    assert T.no_text("\u200b \n" * 90) and not T.no_text("x" * 90)
    texts = [" \n" * 80, "\u200b" * 70, " " * 70 + "N/A", "x" * 70, "n/a", "", "w " * 60]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.is_placeholder(F.col("t"))).collect()] == [T.no_text(t) for t in texts]
