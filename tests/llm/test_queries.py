"""Every query of the subpackage runs on the smallest tables with the columns that its readers expect."""

import pytest

from billspark.llm import queries as q

TYPES = {
    "p1_found": "review_id bigint, field_name string", "p4_found": "review_id bigint, pair_name string, defect string", "p5_found": "review_id bigint, field_name string, pii_kind string",
    "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id_a bigint, doc_id_b bigint",
}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_runs(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(rows) > 0 or name == "p8_found"
    if name in TYPES:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == TYPES[name] and len(rows) == len({str(r) for r in rows})


def test_found_values(spark, tmp_path, sf):
    """The named columns hold the names that TESTDATA gives, and each kind is told of its own field."""
    bills = spark.read.parquet(f"{sf}/bills.parquet").limit(50)
    bills.write.parquet(f"{tmp_path}/bills.parquet")
    empty = spark.read.parquet(f"{sf}/reviews.parquet").limit(0)
    given = [(1, "f", "Mail me at ann.lee@mail.test.", "Please call 555-201-7788."), (2, "f", None, ""), (3, "f", "My SSN is 123-45-6789, or ann at mail dot test", "Nothing here.")]
    rows = spark.createDataFrame(given, "review_id long, run_file string, patient_input string, agent_initial_response string")
    empty.unionByName(rows, allowMissingColumns=True).write.parquet(f"{tmp_path}/reviews.parquet")
    got = {tuple(r) for r in q.p5_found(spark, str(tmp_path)).collect()}
    assert got == {(1, "patient_input", "email"), (1, "agent_initial_response", "phone"), (3, "patient_input", "identity_number"), (3, "patient_input", "email")}
    whole = spark.read.parquet(f"{sf}/reviews.parquet")
    for name, column, values in (("p1_found", "field_name", {"agent_final_response", "agent_followup_response"}), ("p4_found", "pair_name", {"initial", "followup"}), ("p4_found", "defect", {"empty", "truncated", "refusal", "copy", "other_language"})):
        assert {r[0] for r in q.QUERIES[name](spark, sf).select(column).distinct().collect()} <= values and whole.count()


def test_reports_agree_with_what_is_found(spark, sf):
    from pyspark.sql import functions as F

    run = lambda name: q.QUERIES[name](spark, sf)
    assert run("p1_rates").agg(F.sum("cut")).head()[0] == run("p1_found").count()
    assert run("p4_defects").agg(F.sum("pairs")).head()[0] == run("p4_found").count()
    assert run("p7_items").agg(F.sum("documents")).head()[0] == run("p7_found").count()
    assert run("p8_classes").count() >= 0 and run("p8_classes").where("texts < 2").count() == 0


def test_masked_texts_hold_nothing_more(spark, sf):
    """Every text with a find has its placeholder, no other text changes, and masked texts hold no e-mail address."""
    masked = {r["review_id"]: r for r in q.p5_masked(spark, sf).collect()}
    kinds = {}
    for r in q.p5_found(spark, sf).collect():
        kinds.setdefault((r["review_id"], r["field_name"]), set()).add(f"[{r['pii_kind'].upper()}]")
    texts = {(r["review_id"], c): r[c] for r in spark.read.parquet(f"{sf}/reviews.parquet").collect() for c in q.PII_FIELDS}
    for (i, c), t in texts.items():
        found = kinds.get((i, c), set())
        assert (masked[i][c] == t) == (not found) and all(k in masked[i][c] for k in found)
        assert "email" not in {k for _, _, k in q.pii.Finder(q.pii.Facilities()).places(masked[i][c], {}.get)} or "-care." in masked[i][c]
