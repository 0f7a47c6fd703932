"""Ledger, extraction, search, quality, grounding, history, word boxes, files and streams on small rows."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from billspark.functions import columns as C
from billspark.operators import extract, grounding, history, ledger, ocrgrid, privacy, quality, search
from billspark.sources import files

LINE = "bill_id long, item_no long, service_name string, code string, billed decimal(18,2), insurance decimal(18,2), adjustments decimal(18,2), balance decimal(18,2)"


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).head()["x"]


@pytest.mark.parametrize(("text", "value"), [("( $9,120.00 )", D("-9120")), ("$1,234", D("1234")), ("", None), ("—", None), (None, None), ("1.2.3", None)])
def test_parse_amount(spark, text, value):
    assert one(spark, text, C.parse_amount) == value


@pytest.mark.parametrize(("text", "value"), [("3/5/24", "03/05/2024"), ("3-5-75", "03/05/1975"), ("1/1/49", "01/01/2049"), ("1/1/50", "01/01/1950"), ("2026-04-01", "04/01/2026"), ("November 25, 2013", "November 25, 2013"), (None, None)])
def test_normalize_date(spark, text, value):
    assert one(spark, text, C.normalize_date) == value


def test_bool_number_empty(spark):
    assert [one(spark, t, C.parse_bool) for t in (" Yes ", "FAIL", "?", None)] == [True, False, None, None]
    assert [one(spark, t, C.parse_number) for t in ("0.5", "nan", "1_000", "", None)] == [0.5, None, None, None, None]
    assert [one(spark, t, C.is_empty) for t in (" N/A", None, "x")] == [True, True, False]


def test_tokens(spark):
    assert one(spark, "élan naïve b12 x_y foo", C.tokens) == ["b12", "foo"]


def lines(spark, *rows):
    return spark.createDataFrame([(b, i, "s", "c", *(None if x is None else D(str(x)) for x in xs)) for b, i, *xs in rows], LINE)


def test_consistency(spark):
    li = lines(spark, (1, 1, 300, 0, 0, 300), (1, 2, 150, 0, 0, 150), (1, 3, 149.5, 0, 0, 149.5), (2, 1, 300, 0, 0, 300), (2, 2, 250, 0, 0, 250), (4, 1, 100, 0, 0, 40))
    stated = spark.createDataFrame([(1, D("600")), (2, D("600")), (3, D("5")), (4, None)], "bill_id long, stated decimal(18,2)")
    got = {r["bill_id"]: (r["checked"], r["consistent"], r["violations"]) for r in ledger.consistency(li, stated).collect()}
    assert got == {1: (True, True, 0), 2: (True, False, 0), 3: (False, None, 0), 4: (False, None, 1)}
    assert [tuple(r) for r in ledger.row_violations(li, stated).collect()] == [(4, 1, D("60.00"))]


def test_repeated_lines_and_empty(spark):
    li = lines(spark, (1, 1, 5, 0, 0, 5), (1, 2, 5, 0, 0, 5), (1, 3, 6, 0, 0, 6), (2, 1, None, 0, 0, None), (2, 9, None, 0, 0, None))
    assert sorted((r["bill_id"], r["places"]) for r in ledger.repeated_lines(li).collect()) == [(1, "1,2"), (2, "1,9")]
    assert ledger.repeated_lines(li.limit(0)).count() == 0 and ledger.line_totals(li.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (450, 1), (451, 2), (500, 2), (501, 2), (951, 3)])
def test_chunks(spark, n, chunks):
    assert search.chunks(spark.createDataFrame([(1, "w " * n)], "doc_id long, text string")).count() == chunks


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, None), (4, "gamma")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "absent")], "query_id long, query string")
    got = search.tfidf_topk(search.chunks(docs), asked, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in got] == [(1, 1, 2), (1, 2, 1)]


def test_statement_text(spark):
    text = "Statement date: 1/2/2024\nPay by: 2024-03-04\nknee MRI  69214  $6,242\nTotals $10.00 — $1.00 $9.00\nTotals $7 $8 $9\nAmount due $9.00"
    t = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    h = extract.header(t).where("doc_id = 1").head()
    assert (h["statement_date"], h["due_date"], h["amount_due"]) == ("1/2/2024", "2024-03-04", D("9.00")) and extract.header(t).count() == 3
    r = extract.totals_line(t).collect()
    assert [tuple(x) for x in r] == [(1, D("10.00"), D("0.00"), D("1.00"), D("9.00"), D("8.00"))]
    item = extract.text_lines(t).where("code is not null").head()
    assert (item["description"], item["code"], item["amount"]) == ("knee MRI", "69214", D("6242.00"))


def test_codes(spark):
    t = spark.createDataFrame([(1, "CPT 99284 A0431 J18.9 90048, 99213-25")], "doc_id long, text string")
    assert {(r["code"], r["kind"]) for r in extract.codes(t).collect()} == {("99284", "CPT"), ("A0431", "HCPCS"), ("J18.9", "ICD-10"), ("90048", "CPT"), ("99213-25", "CPT")}


def test_validation_rules(spark):
    row = {c: "x" for c in quality.REQUIRED} | {f: "true" for f in quality.FLAGS} | {"safety_constraint": "keep", "patient_followup": "", "modality": "pdf", "scenario": "cob", "payer": "Other", "plan_type": "HDHP"}
    rows = [row, row | {"case_id": "x", "modality": "fax"}, row | {"case_id": None, "category": " ", "safety_constraint": "N/A", "patient_input": "do not pay"}, row | {"case_id": "d"} | {f: "false" for f in quality.FLAGS}, row | {"case_id": "e", "tests_groundedness": "maybe"}]
    c = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in row))
    assert [tuple(r)[2:] for r in quality.repeated_ids(c).collect()] == [("x", "case_id", "rows: 2")]
    assert {(r["column"]) for r in quality.blank_required(c).collect()} == {"case_id", "category"}
    assert [r["detail"] for r in quality.outside_vocabulary(c).collect()] == ["fax"]
    assert [r["severity"] for r in quality.blank_safety(c).collect()] == ["error"]
    assert [r["row_id"] for r in quality.no_flag_set(c).collect()] == ["d"] and [r["detail"] for r in quality.unclear_flags(c).collect()] == ["maybe"]
    assert quality.outside_vocabulary(c.drop("modality")).count() == 0 and quality.missing_columns(c.drop("payer"), quality.REQUIRED) == ["payer"]
    docs = spark.createDataFrame([("a.md",), ("a.md",)], "name string")
    refs = spark.createDataFrame([("1", "a.md | b.md |"), ("2", "N/A"), ("3", None)], "case_id string, source_docs string")
    assert [r["detail"] for r in quality.unknown_reference(refs, docs, "source_docs", "name", "unknown_doc", split=True).collect()] == ["b.md"]


def test_scorecard(spark):
    cols = ["semantic_correctness_pass", "precision_score_0_1", "groundedness_score_0_1", "required_coverage_score_0_1", "hallucination_present", "correct_refusal_present", "over_refusal_present", "text_differentiation_score_1_5", "safety_constraint_pass", "overall_pass"]
    rows = [("True", None, "1.0", "", "no", None, "?", "4", "yes", "pass"), ("False", "0.5", "x", "", "no", None, "", "5", "no", "fail")]
    got = {r["metric"]: (r["value"], r["passed"], r["n"]) for r in quality.scorecard(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))).collect()}
    assert got["semantic_correctness_rate"] == (0.5, False, 2) and got["groundedness_average"] == (0.75, False, 2) and got["required_coverage_average"] == (None, None, 0)
    assert got["hallucination_rate"] == (0.0, True, 2) and got["text_differentiation_average"] == (4.5, True, 2) and got["correct_refusal_rate"][1] is None


def test_grounding(spark):
    t = spark.createDataFrame([(1, "You owe $10.01 and $99. CPT code 99213, CPT 11111"), (2, None)], "id long, text string")
    known = spark.createDataFrame([(1, "amount", "1000"), (1, "code", "99213")], "id long, kind string, value string")
    lost = grounding.ungrounded(grounding.claimed(t, "id", "text"), known, "id").collect()
    assert sorted((r["kind"], r["value"]) for r in lost) == [("amount", "9900"), ("code", "11111")]


def test_recall(spark):
    g = spark.createDataFrame([(1, 1, "a", D("1")), (1, 2, "b", D("2")), (1, 3, None, D("3")), (1, 4, "d", D("4"))], "k long, item_no long, code string, amount decimal(18,2)")
    p = spark.createDataFrame([(1, "A ", D("1.01")), (1, "b", D("9")), (1, "b", D("8"))], "k long, code string, amount decimal(18,2)")
    assert [tuple(r) for r in grounding.line_recall(g, p, "k").collect()] == [(1, 4, 1, 1, 2, 0.25)]


def test_history_and_transcript(spark):
    turns = spark.createDataFrame([(1, 1, "user", "pay 5 for x"), (1, 2, "assistant", "pay 9"), (1, 3, "user", None), (2, 1, "user", 'see "a.pdf" or "b.pdf"'), (2, 2, "assistant", "ok")], "conv long, turn int, role string, text string")
    assert [r["n"] for r in history.last_known(turns, {"n": r"pay (\d)"}).where("conv = 1").orderBy("turn").collect()] == ["5", "5", "5"]
    assert [tuple(r) for r in history.latest_mention(turns, r'"(\S+\.pdf)"').collect()] == [(2, "b.pdf")]
    body = 'data: {"text": "a"}\n\ndata: {bad\n\ndata: {"text": "b"}\n\ndata: [DONE]\n\ndata: {"text": "c"}\n\n'
    assert one(spark, body, history.sse_decode) == "ab" and one(spark, None, history.sse_decode) == ""
    assert one(spark, 'x "y"\n', lambda c: history.sse_decode(history.sse_encode(c))) == 'x "y"\n'
    d = spark.createDataFrame([(1, 1, 0, "i", "f", '{"a"'), (1, 2, 1, "j", "g", "{}"), (1, 3, 0, "", None, ":1}"), (1, 4, None, None, None, None)], "resp long, seq long, tool_index int, tool_id string, tool_name string, arguments string")
    assert sorted(tuple(r) for r in history.assemble_calls(d).collect()) == [(1, 0, "i", "f", '{"a":1}'), (1, 1, "j", "g", "{}")]


def test_privacy(spark):
    text = "SSN 123-45-6789, DOB: 1/2/1990, a@b.co, my account balance is, public@c.org"
    got = one(spark, text, lambda c: privacy.redact(c, public=["public@c.org"]))
    assert "[REDACTED:SSN]" in got and "[REDACTED:DOB]" in got and "[REDACTED:EMAIL]" in got and "public@c.org" in got and "[REDACTED:PATIENT_ACCOUNT]" in got
    m = spark.createDataFrame([({"patient_name": "x", "path": "a@b.co", "note": "a@b.co"},)], "m map<string,string>").select(privacy.redact_map(F.col("m")).alias("m")).head()["m"]
    assert m == {"patient_name": "[REDACTED:PATIENT_NAME]", "path": "a@b.co", "note": "[REDACTED:EMAIL]"}
    assert [r["term"] for r in privacy.blocked_terms(spark.createDataFrame([(1, "an ISSUE"), (2, None)], "id long, t string"), "id", "t").collect()] == ["sue"]


def test_word_boxes(spark):
    rows = [(1, 0, 0, "Date", 0, 4, 90.0), (1, 0, 1, "Code", 10, 4, 90.0), (1, 0, 2, "Amount", 20, 6, 90.0), (1, 1, 0, "x", 1, 1, 90.0), (1, 1, 1, "y", 11, 1, 90.0), (1, 1, 2, "z", 12, 1, -1.0), (1, 1, 3, "w", 7, 0, 80.0), (2, 0, 0, "a", 0, 1, 10.0)]
    w = spark.createDataFrame(rows, "page long, line long, word_no long, text string, left_pos long, width long, conf double")
    got = {(r["line"], r["column_no"]): r["text"] for r in ocrgrid.cells(w, ["date", "code", "amount"]).collect()}
    assert got == {(1, 1): "x w", (1, 2): "y"}
    assert {r["page"]: r["passes"] for r in ocrgrid.gate(w, 45, 3).collect()} == {1: True, 2: False}
    r = spark.createDataFrame([(1, i, i in (1, 2, 5, 7, 8, 9)) for i in range(10)], "k long, p long, inside boolean")
    assert sorted((x["start"], x["stop"]) for x in ocrgrid.islands(r, "k", "p", "inside", 2).collect()) == [(1, 2), (7, 9)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    t = files.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text", "more"])
    assert [tuple(r) for r in t.orderBy("id").collect()] == [("1", 'two\nlines, "quoted"', None), ("2", None, None)]
    files.write_csv(t, str(tmp_path / "out"), ["text", "id", "extra"])
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).fillna("").collect()) == [("", "2", ""), ('two\nlines, "quoted"', "1", "")]
    assert files.strip_keys(t.withColumn("_x", F.lit(1)).withColumn("_y", F.lit(1)), keep=["_y"]).columns == ["id", "text", "more", "_y"]
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert files.append_new(df, p, "k") == 2 and files.append_new(df, p, "k") == 0
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "n.txt").write_text("hé", encoding="utf-8")
    (tmp_path / "k" / "p.PNG").write_bytes(b"\x00")
    assert sorted((r["source"], r["kind"], r["text"]) for r in files.read_texts(spark, str(tmp_path / "k")).collect()) == [("n.txt", "text", "hé"), ("p.PNG", "image", None)]


def test_json_records_and_lookup(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "good.json").write_text('{"a": 1}')
    (tmp_path / "j" / "bad.json").write_text('{"a": ')
    t = {r["file_name"]: r for r in files.read_json_records(spark, str(tmp_path / "j"), T.StructType([T.StructField("a", T.IntegerType())])).collect()}
    assert t["good.json"]["a"] == 1 and t["bad.json"]["a"] is None and t["bad.json"]["_error"]
    cat = spark.createDataFrame([("x", 2, "/b/x"), ("x", 1, "/a/x")], "name string, priority int, path string")
    got = files.first_existing(spark.createDataFrame([("x",), ("y",)], "name string"), cat)
    assert {r["name"]: r["path"] for r in got.collect()} == {"x": "/a/x", "y": None}


def test_stream_once(spark, tmp_path):
    from billspark.streaming import ingest

    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k long, v string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.read_arrivals(spark, str(tmp_path / "in"), df.schema)
    for _ in range(2):
        ingest.append_batches(ingest.once_per_key(s, "k", "at"), str(tmp_path / "out"), str(tmp_path / "cp"), "k").awaitTermination(120)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
