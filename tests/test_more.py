"""Grids, payers, recall of fields, outcomes, signals and buffered results on small rows."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from billspark.operators import extract, grounding, history, ledger


def test_grid_lines(spark):
    grids = [
        (1, [["Date", "Description", "Code", "Billed", "Ins Pmts", "Adj / Patient Bal"], ["1/2/24", "MRI", "70551", "$10.00", None, "$1.00 $9.00"], [None, " ", None, None, None, None], ["", "Totals", "", "$10.00", "", ""], ["x"]]),
        (2, [["Foo", "Bar"], ["1", "2"]]),
        (3, [["Service", "Charge"]]),
        (4, None),
        (5, [["Charge", "Service"], ["($5.00)", "Credit"]]),
    ]
    t = spark.createDataFrame(grids, "stmt_id long, grid array<array<string>>")
    got = [tuple(r) for r in extract.grid_lines(t).orderBy("stmt_id", "row_no").collect()]
    assert got == [(1, 1, "01/02/2024", "MRI", "70551", D("10.00"), None, D("1.00"), D("9.00")), (5, 1, None, "Credit", None, D("-5.00"), None, None, None)]


@pytest.mark.parametrize(("text", "payer"), [
    ("Northgate Health Plan  Policy #: 12", "Northgate Health Plan"), ("Halcyon (Managed Care – L.A.)", "Halcyon (Managed Care – L.A.)"), ("Bluefern, P.O. Box 99, Town", "Bluefern"), ("Orchard (Ben#@!%efit", "Orchard"), ("Tamarisk (p*#@x) \nsecond line", "Tamarisk"), (" - ", None), ("", None), (None, None),
])
def test_clean_payer(spark, text, payer):
    assert spark.createDataFrame([(text,)], "t string").select(extract.clean_payer(F.col("t")).alias("x")).head()["x"] == payer


def test_payers(spark):
    t = spark.createDataFrame([(1, "Primary Insurance: A Plan\nSecondary Insurance: B Plan"), (2, "Insurance: C"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["primary"], r["secondary"]) for r in extract.payers(t).collect()} == {1: ("A Plan", "B Plan"), 2: ("C", None), 3: (None, None)}


def test_field_recall_and_outcomes(spark):
    g = spark.createDataFrame([(1, "a", None), (2, "b", "y"), (3, "c", None)], "k long, f string, h string")
    p = spark.createDataFrame([(1, "a", "z"), (2, "x", "y")], "k long, f string, h string")
    got = {r["field"]: (r["n"], r["n_equal"], r["recall"]) for r in grounding.field_recall(g, p, "k", ["f", "h"]).collect()}
    assert got == {"f": (3, 1, 0.3333), "h": (1, 1, 1.0)}
    runs = spark.createDataFrame([("a", "ok", 1.0), ("a", "ok", 0.5), ("a", "error", None), ("b", "rejected", None)], "variant string, outcome string, recall double")
    got = {r["variant"]: tuple(r)[1:] for r in grounding.outcomes(runs, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 0, 1, 0.75), "b": (0, 1, 0, None), "c": (0, 0, 0, None)}


def test_buffered_results(spark):
    m = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "tool", "a"), (1, 3, "tool", None), (1, 4, "assistant", "x"), (1, 5, "tool", "b")], "conv long, turn int, role string, text string")
    got = [(r["first_turn"], r["role"], r["texts"]) for r in history.buffer_results(m).orderBy("first_turn").collect()]
    assert got == [(1, "user", ["q"]), (2, "tool", ["a", ""]), (4, "assistant", ["x"]), (5, "tool", ["b"])]


def test_signals(spark):
    b = spark.createDataFrame([(1, ("None on file", None), None), (2, ("A", None), ("x",)), (3, None, None)], "bill_id long, insurance struct<primary:string,secondary:string>, _collections_notice struct<a:string>")
    li = spark.createDataFrame([(1, 1, "Agency assessment", "c", D(1), None, None, D(1)), (1, 2, "Agency assessment", "c", D(1), None, None, D(1))], "bill_id long, item_no long, service_name string, code string, billed decimal(18,2), insurance decimal(18,2), adjustments decimal(18,2), balance decimal(18,2)")
    got = {r["bill_id"]: tuple(r)[1:] for r in ledger.bill_signals(b, li).collect()}
    assert got == {1: (True, True, True, True), 2: (False, True, False, False), 3: (False, False, False, False)}


def test_windowed_counts(spark, tmp_path):
    from billspark.streaming import ingest

    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:05:00"), ("a", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.windowed_counts(ingest.read_arrivals(spark, str(tmp_path / "in"), df.schema), "at", "k")
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("windows").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_every_hundredth_document_is_a_query(spark, sf):
    from pyspark.sql import functions as F

    from billspark.operators import search
    from billspark.plans.search import tfidf_documents

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    got = {tuple(r) for r in tfidf_documents(spark, sf).collect()}
    assert {r[0] for r in got} == {r["query_id"] for r in asked.where("text rlike '[A-Za-z0-9]'").collect()}
    assert got == {tuple(r) for r in search.tfidf_topk(search.chunks(docs), asked).drop("snippet").collect()}


def test_queries_of_any_number_are_not_joined_by_term(spark, sf):
    """Every query shares terms with every chunk, so that rows of (query, chunk, term) would grow with the square."""
    from billspark.plans.search import tfidf_documents

    plan = tfidf_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan, plan


@pytest.mark.parametrize("sizes", [{}, {"head": 4, "slab": 60, "rows": 9, "columns": 3, "light": 0.5, "block_queries": 7}, {"head": 1, "rows": 16, "light": 0, "block_queries": 20}])
def test_best_of_blocks(spark, sizes):
    """The same as all scores, with equal texts, texts without terms, keys of text and terms that one query has alone."""
    import random

    from billspark.functions import columns as C
    from billspark.operators import search

    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(words[min(39, int(r.expovariate(0.12)))] for _ in range(r.randint(1, 30)))
    texts = [text() for _ in range(150)]
    docs = [(f"d{i:03}", t) for i, t in enumerate(texts + texts[:50] * 2 + ["é", "", None, "solo", "solo w0"])]
    chunked = search.chunks(spark.createDataFrame(docs, "source string, text string").repartition(5), key="source", size=12, overlap=3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[::5], "solo", "absent", "", None, "w0 w0 w0", "w39"])], "query_id long, query string")
    terms = asked.select("query_id", F.explode(C.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    rows = lambda df: sorted((q, -s, d, c) for q, d, c, s in df.collect())
    best = {}
    for x in rows(search._joined(chunked, terms, "source")):
        best.setdefault(x[0], []).append(x)
    got = {}
    for x in rows(search.best_of_blocks(chunked, terms, 4, "source", **sizes)):
        got.setdefault(x[0], []).append(x)
    assert {q: x[:4] for q, x in got.items()} == {q: x[:4] for q, x in best.items()} and len(best) == 33


def test_round4():
    import numpy as np

    from billspark.operators.search import _round4

    assert _round4(np.array([0.03125, 0.00005, 2.00015, 1.00004999, 235.61846924, 0.0])).tolist() == [0.0313, 0.0001, 2.0002, 1.0, 235.6185, 0.0]
