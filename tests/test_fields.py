"""Context of amounts, header fields as scans leave them, stated values, prompts, selections and lines by position."""

from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from billspark.functions import columns as C
from billspark.operators import extract, grounding, history, ocrgrid, quality


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).head()["x"]


def test_context_of_amounts(spark):
    import re

    texts = ["$1.00", "a $1.00 b $2.00 c $1.00", "x" * 60 + "$3.00\n" + "y" * 60, " ".join(f"${k}.00" for k in range(10, 40)), None, "", "no amount", "é" * 50 + " $9.99 " + "ñ" * 50, ("word " * 30 + "$5.00 ") * 300]
    got = {}
    for r in extract.amounts_in_context(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"], r["amount"]] = (r["pos"], r["raw"], r["context"])
    want = {}
    for i, t in enumerate(texts):
        for k, m in enumerate(re.finditer(C.AMOUNT, t or "", re.ASCII)):
            v = D(re.sub(r"[$,()\s]", "", m.group()))
            want.setdefault((i, v), (k, m.group().strip(), t[max(0, m.start() - 40) : m.end() + 40].replace("\n", " ").strip(" ")))
    assert got == want and len(want) > 30


LABELS = [
    ("Patlent Name; ANN B LEE Secondary Insurance: None", {"patient_name": "ANN B LEE"}), ("Patient: Ann Lee  Account #: A-1", {"patient_name": "Ann Lee", "account_number": "A-1"}), ("Servlce Date: June 3, 2021\nmore", {"service_date": "June 3, 2021"}), ("Service Date: 2024-02-09 Service Type:\nHMO", {"service_date": "02/09/2024"}),
    ("List of Services\nDate: 2024-05-06\nService Date: 2024-05-01", {"service_date": "05/01/2024"}), ("Guarantor Name; Bo Ek", {"guarantor_name": "Bo Ek", "patient_name": "Bo Ek"}), ("Guarantar Number: GR-90-1", {"guarantor_number": "GR-90-1"}), ("Account Numb: 70001", {"account_number": "70001"}), ("Account Number: Primary Insurance", {}),
    ("Pay Onllne; pay.care.example/x", {"pay_online": "pay.care.example/x"}), ("Pay by Phoney; 541-555-0146", {"phone": "541-555-0146"}), ("Please call 541-555-0146", {"phone": "541-555-0146"}), ("Monday–Friday, 8am to 5pm PT, closed", {"hours": "Monday–Friday, 8am to 5pm PT"}), ("Send to P.O. Box 4430, Port Vashna, MT 94888.", {"mail": "P.O. Box 4430, Port Vashna, MT 94888"}),
    (" Nørholm Medical Center \nx", {"facility": "Nørholm Medical Center"}), ("Statment Date; 3/4/26", {"statement_date": "03/04/2026"}), ("Due Date: 2026-01-02", {"due_date": "01/02/2026"}), ("ask Patient Services", {"department": "Patient Services"}), (None, {}), ("", {}),
]


def test_labels_that_are_misread(spark):
    t = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LABELS)], "doc_id long, text string")
    got = {r["doc_id"]: {k: v for k, v in r.asDict().items() if k != "doc_id" and v is not None} for r in extract.statement_fields(t).collect()}
    assert [got[i] for i in range(len(LABELS))] == [x[1] for x in LABELS]


@pytest.mark.parametrize(("text", "size", "income"), [
    ("We are a family of 4", 4, None), ("household size is 3", 3, None), ("household: 2", 2, None), ("I have 5 people", 5, None), ("it is just me", 1, None), ("I live alone", 1, None), ("There are 8 of us and we make about $5,417.89 a month", 8, D("5417.89")), ("I make 50k", None, D("50000.00")), ("my income is $96,000.00", None, D("96000.00")), ("we earn about 28,000 a year", None, D("28000.00")), ("none", None, None), (None, None, None), ("", None, None),
])
def test_household_and_income(spark, text, size, income):
    assert one(spark, text, C.household_size) == size and one(spark, text, C.stated_income) == income


@pytest.mark.parametrize(("text", "want"), [("1.005", 101), ("2.675", 268), ("-0.005", -1), ("x", None), (None, None), ("3", 300)])
def test_cents(spark, text, want):
    assert one(spark, text, C.cents) == want


def test_stated_values(spark):
    t = spark.createDataFrame([(1, "I paid 1,200 and owe 40.50; balance due $7 on 3/15/2026 or 2026-03-15 for CPT 99213 and hcpcs j1234"), (2, "bill 12/31 total 5.5.5 code 123456, 12345."), (3, None), (4, "")], "k long, t string")
    got = {k: {(r["kind"], r["value"]) for r in grounding.stated(t, "k", "t").collect() if r["k"] == k} for k in (1, 2, 3, 4)}
    assert got[1] == {("amount", "120000"), ("amount", "4050"), ("amount", "700"), ("date", "3/15/2026"), ("date", "2026-03-15"), ("code", "99213"), ("code", "J1234")}
    assert got[2] == {("code", "12345")} and not got[3] and not got[4]


def test_prompts(spark):
    rows = [(" see a.pdf ", "a.pdf", "u.pdf"), ("[Patient uploads bill: x.pdf] why?", "y.pdf", "u.pdf"), ("why?", None, "u.pdf"), ("why?", "a.pdf", None), (None, None, None), ("[Patient uploads bill: x", "", "u.pdf")]
    got = [r["p"] for r in spark.createDataFrame(rows, "p string, b string, u string").select(history.prompt_for_row(F.col("p"), F.col("b"), F.col("u")).alias("p")).collect()]
    assert got == ["see u.pdf", "[Patient uploads bill: u.pdf] why?", 'I uploaded "u.pdf". why?', "why?", "", 'I uploaded "u.pdf". [Patient uploads bill: x']


def test_selection_and_missing(spark):
    df = spark.createDataFrame([("b", "X"), ("a", "x "), ("c", "y"), (None, "x")], "case_id string, category string")
    assert [r["case_id"] for r in quality.selected(df, equal={"category": "x"}, order=["case_id"], limit=2).collect()] == [None, "a"]
    assert quality.selected(df).count() == 4 and quality.selected(df, ids=["a", "c"]).count() == 2 and quality.selected(df, equal={"category": ""}).count() == 4
    assert [r["column"] for r in quality.missing(df, ["case_id", "z"]).collect()] == ["z"] and quality.missing(df, ["case_id"]).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.integers(0, 30)), min_size=1, max_size=25, unique_by=lambda x: (x[0], x[2])))
def test_lines_by_position(spark, boxes):
    rows = [(1, f"w{i}", x, line * 20 + jitter, 5, 10, 90.0) for i, (line, jitter, x) in enumerate(boxes)]
    t = spark.createDataFrame(rows, "page long, text string, left_pos long, top long, width long, height long, conf double")
    got = {}
    for r in ocrgrid.cluster_rows(t).collect():
        got.setdefault(r["line"], []).append((r["word_no"], r["text"]))
    want = {}
    for i, (line, _, x) in enumerate(boxes):
        want.setdefault(line, []).append((x, f"w{i}"))
    assert [[t for _, t in sorted(got[k])] for k in sorted(got)] == [[t for _, t in sorted(want[k])] for k in sorted(want)]


def test_clean_answer(spark):
    t = "Please do not share sensitive identifiers such as SSNs, MRNs, dates of birth, or full account numbers here. <function.a b>Hi\nI will call the look_up function now.\nThe check_bill function is slow.\n\n\n\n* Payment Balance: [REDACTED:SSN]"
    assert one(spark, t, history.clean_answer) == "Hi\n\n* **Payment Balance:** an SSN" and one(spark, None, history.clean_answer) is None and one(spark, "", history.clean_answer) == ""


def test_unlabelled_codes(spark):
    a = spark.createDataFrame([(1, "99213", "CPT")], "doc_id long, code string, kind string")
    b = spark.createDataFrame([(1, "99213"), (1, "zz"), (1, "zz"), (2, None)], "doc_id long, code string")
    assert {tuple(r) for r in extract.with_unlabelled(a, b).collect()} == {(1, "99213", "CPT"), (1, "zz", "unknown")}


def test_rules_in_one_pass(spark, sf):
    c = spark.read.parquet(f"{sf}/cases.parquet")
    one = quality.violations_in_one_pass(c)
    parts = [quality.blank_required(c), quality.outside_vocabulary(c), quality.blank_safety(c), quality.unclear_flags(c), quality.no_flag_set(c)]
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for p in parts for r in p.select(*one.columns).collect())
    assert quality.violations_in_one_pass(c.select("case_id")).count() == 0 and quality.violations_in_one_pass(c.limit(0)).count() == 0
