"""Queries of the general data problems: nested records (p2) and drifting schemas (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.operators import drift, nested
from billspark.session import spread, table

#: The consistent table of each kind of record: a column's type and the path that it has by its schema.
TARGETS = {
    "case": {
        "case_id": ("string", "case_id"), "category": ("string", "category"), "modality": ("string", "modality"), "scenario": ("string", "scenario"), "insurance_type": ("string", "insurance_type"), "payer": ("string", "payer"), "document_type": ("string", "document_type"),
        "household_size": ("int", "household_size"), "annual_income_usd": ("decimal(18,2)", "annual_income_usd"), "amount_owed_usd": ("decimal(18,2)", "amount_owed_usd"), "fpl_percentage": ("double", "fpl_percentage"), "bill_doc_file": ("string", "bill_doc_file"),
    },
    "bill": {
        "schema_version": ("string", "_schema_version"), "statement_date": ("string", "statement_date"), "due_date": ("string", "due_date"), "facility_name": ("string", "facility.name"), "facility_npi": ("string", "facility.npi"), "patient_name": ("string", "patient.patient_name"),
        "patient_account_number": ("string", "patient.patient_account_number"), "service_date": ("string", "patient.service_date"), "guarantor_name": ("string", "guarantor.guarantor_name"), "insurance_primary": ("string", "insurance.primary"), "total_amount_due": ("decimal(18,2)", "total_amount_due"),
    },
    "review": {
        "case_id": ("string", "case_id"), "modality": ("string", "modality"), "scenario": ("string", "scenario"), "reviewer": ("string", "reviewer"), "overall_pass": ("boolean", "overall_pass"), "hallucination_present": ("boolean", "hallucination_present"),
        "semantic_correctness_score": ("double", "semantic_correctness_score_0_1"), "text_differentiation_score": ("double", "text_differentiation_score_1_5"), "initial_prompt": ("string", "agent_initial_prompt"), "initial_response": ("string", "agent_initial_response"),
    },
}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all child tables by the ordinals in their keys; bills have arrays of two levels at most."""
    links = nested.object_links(table(spark, d, "bills").drop("loaded_at"), "bill_id")
    below = F.coalesce(F.try_element_at("ordinals", F.lit(2)), F.lit(0).cast("bigint"))
    return links.select("bill_id", "child_path", F.element_at("ordinals", 1).alias("child_no"), below.alias("sub_no"))


def p2_bills(spark: SparkSession, d: str) -> DataFrame:
    """The parent table: what of a bill stands in no array of objects."""
    t = nested.normalize(table(spark, d, "bills").select("bill_id", "loaded_at", "bill_file", "facility", "patient", "guarantor", "insurance", "payment_detail", "total_amount_due"), "bill_id", "loaded_at")[""]
    return t.select("row_key", "bill_id", "bill_file", "facility_name", "facility_npi", "patient_patient_name", "patient_patient_account_number", "guarantor_guarantor_name", "insurance_primary", "payment_detail_denial_reason", F.col("total_amount_due").cast("double").alias("total_amount_due"))


def _payments(spark: SparkSession, d: str, array: str) -> DataFrame:
    t = nested.normalize(table(spark, d, "bills").select("bill_id", "loaded_at", "payment_detail"), "bill_id", "loaded_at")[f"payment_detail.{array}"]
    return t.select("parent_key", "row_key", F.element_at("ordinals", 1).alias("payment_no"), *[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in t.schema.fields if f.name not in nested.KEY_COLUMNS])


def p2_insurance_payments(spark: SparkSession, d: str) -> DataFrame:
    return _payments(spark, d, "insurance_payments")


def p2_adjustments(spark: SparkSession, d: str) -> DataFrame:
    return _payments(spark, d, "adjustments")


def p2_payments_received(spark: SparkSession, d: str) -> DataFrame:
    return _payments(spark, d, "payments_received")


def p2_raw_items(spark: SparkSession, d: str) -> DataFrame:
    """Line items of bill records delivered as JSON, by the schema that is inferred from all of them and merged."""
    raw = spread(table(spark, d, "raw_records").where(F.col("feed").startswith("bill")).select("record_id", "payload"))
    schema = nested.infer_merged_schema(raw, "payload")
    records = raw.select("record_id", F.from_json("payload", schema).alias("r")).where("r is not null").select("record_id", "r.summary_of_services")
    t = nested.normalize(records, "record_id")["summary_of_services.line_items"]
    return t.select("parent_key", "row_key", F.element_at("ordinals", 1).alias("item_no"), "service_name", F.col("billed_amount").cast("double").alias("billed_amount"))


def p2_line_items(spark: SparkSession, d: str) -> DataFrame:
    t = nested.normalize(table(spark, d, "bills").select("bill_id", "loaded_at", "patient", "summary_of_services"), "bill_id", "loaded_at")
    return t["summary_of_services.line_items"].select("parent_key", "row_key", F.element_at("ordinals", 1).alias("item_no"), "service_name", "code_type", "code", F.col("billed_amount").cast("double").alias("billed_amount"))


def p2_components(spark: SparkSession, d: str) -> DataFrame:
    t = nested.normalize(table(spark, d, "bills").select("bill_id", "loaded_at", "summary_of_services"), "bill_id", "loaded_at")
    return t["summary_of_services.line_items.components"].select("parent_key", "row_key", F.element_at("ordinals", 1).alias("item_no"), F.element_at("ordinals", 2).alias("component_no"), "component_name", "code", F.col("amount").cast("double").alias("amount"))


def _changes(raw: DataFrame) -> DataFrame:
    return drift.schema_changes(spread(raw.select("feed", "file_no", "record_id", "payload")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(table(spark, d, "raw_records"))


def consistent_target(raw: DataFrame, kind: str) -> dict:
    """The target of one kind of record, with the names that its fields went under in these records."""
    return drift.with_aliases(TARGETS[kind], drift.rename_groups(_changes(raw)))


def _consistent(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The records of one kind in one table, under whatever names their fields came."""
    raw = table(spark, d, "raw_records").where(F.col("feed").startswith(kind))
    return drift.rescue_ingest(spread(raw), consistent_target(raw, kind), keep=["record_id", "feed", "file_no"])


def p3_cases(spark: SparkSession, d: str) -> DataFrame:
    """Case records; ``plan_type`` is approved and promoted from what was rescued."""
    return drift.promote(_consistent(spark, d, "case"), "plan_type", "string", "plan_type")


def p3_bills(spark: SparkSession, d: str) -> DataFrame:
    return _consistent(spark, d, "bill")


def p3_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _consistent(spark, d, "review")


def p3_case_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the case records' consistent table whose names stay, whatever types they came as."""
    t = _consistent(spark, d, "case")
    return t.select("record_id", "scenario", "payer", "household_size", F.col("amount_owed_usd").cast("double").alias("amount_owed_usd"), F.col("_valid").alias("valid"))


#: The child table of the line items of bill records: a column's type and its path below the array of this path.
LINE_ITEMS = "summary_of_services.line_items"
LINE_ITEM_FIELDS = {"service_name": "string", "code_type": "string", "code": "string", "quantity": "int", "unit": "string", "billed_amount": "decimal(18,2)", "insurance_payments": "decimal(18,2)", "adjustments": "decimal(18,2)", "patient_balance": "decimal(18,2)"}


def p3_bill_items(spark: SparkSession, d: str) -> DataFrame:
    """The line items of bill records, promoted from what was rescued to a child table of their own."""
    raw = table(spark, d, "raw_records").where(F.col("feed").startswith("bill"))
    groups = drift.rename_groups(_changes(raw))
    target = drift.with_aliases({c: (kind, f"{LINE_ITEMS}[].{c}") for c, kind in LINE_ITEM_FIELDS.items()}, groups)
    arrays = {LINE_ITEMS: None} | {p.split("[].")[0]: None for _, paths in target.values() for p in paths if p.count("[].") == 1}
    below = {c: (kind, list(dict.fromkeys(p.split("[].")[1] for p in paths if p.count("[].") == 1))) for c, (kind, paths) in target.items()}
    bills = drift.rescue_ingest(spread(raw), drift.with_aliases(TARGETS["bill"], groups), keep=["record_id"])
    return drift.promote_children(bills, list(arrays), below, ["record_id"])


QUERIES = {"p2_found": p2_found, "p2_line_items": p2_line_items, "p2_components": p2_components, "p2_bills": p2_bills, "p2_insurance_payments": p2_insurance_payments, "p2_adjustments": p2_adjustments, "p2_payments_received": p2_payments_received, "p2_raw_items": p2_raw_items, "p3_found": p3_found, "p3_cases": p3_cases, "p3_bills": p3_bills, "p3_reviews": p3_reviews, "p3_bill_items": p3_bill_items, "p3_case_columns": p3_case_columns}

_BILLS = "(SELECT * FROM bills QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY loaded_at DESC NULLS LAST) = 1)"


def _taken(kind: str, *paths: str) -> str:
    """The first of the paths whose value is a scalar that can be cast."""
    one = lambda p: f"CASE WHEN json_type(j, '$.{p}') NOT IN ('OBJECT', 'ARRAY') THEN try_cast(json_extract_string(j, '$.{p}') AS {kind}) END"
    return f"coalesce({', '.join(map(one, paths))})"


def _array(path: str, array: str) -> str:
    return f"""SELECT bill_id, '{path}' AS child_path, child_no, 0::BIGINT AS sub_no FROM (
      SELECT bill_id, unnest({array}) AS x, unnest(range(1, len({array}) + 1)) AS child_no FROM {_BILLS}) WHERE x IS NOT NULL"""


SQL = {
    "p2_found": " UNION ALL ".join([
        _array("summary_of_services.line_items", "summary_of_services.line_items"),
        *[_array(f"payment_detail.{a}", f"payment_detail.{a}") for a in ("insurance_payments", "adjustments", "payments_received")],
        f"""SELECT bill_id, 'summary_of_services.line_items.components' AS child_path, child_no, sub_no FROM (
          SELECT bill_id, child_no, unnest(x.components) AS y, unnest(range(1, len(x.components) + 1)) AS sub_no FROM (
            SELECT bill_id, unnest(summary_of_services.line_items) AS x, unnest(range(1, len(summary_of_services.line_items) + 1)) AS child_no FROM {_BILLS})) WHERE y IS NOT NULL""",
    ]),
    "p2_line_items": f"""SELECT bill_id::VARCHAR AS parent_key, bill_id::VARCHAR || '/' || item_no AS row_key, item_no, x.service_name, x.code_type, x.code, x.billed_amount::DOUBLE AS billed_amount FROM (
        SELECT bill_id, unnest(summary_of_services.line_items) AS x, unnest(range(1, len(summary_of_services.line_items) + 1)) AS item_no FROM {_BILLS}) WHERE x IS NOT NULL""",
    "p2_components": f"""SELECT bill_id::VARCHAR || '/' || item_no AS parent_key, bill_id::VARCHAR || '/' || item_no || '/' || component_no AS row_key, item_no, component_no, y.component_name, y.code, y.amount::DOUBLE AS amount FROM (
        SELECT bill_id, item_no, unnest(x.components) AS y, unnest(range(1, len(x.components) + 1)) AS component_no FROM (
          SELECT bill_id, unnest(summary_of_services.line_items) AS x, unnest(range(1, len(summary_of_services.line_items) + 1)) AS item_no FROM {_BILLS})) WHERE y IS NOT NULL""",
    "p2_bills": f"""SELECT bill_id::VARCHAR AS row_key, bill_id, bill_file, facility.name AS facility_name, facility.npi AS facility_npi, patient.patient_name AS patient_patient_name, patient.patient_account_number AS patient_patient_account_number,
        guarantor.guarantor_name AS guarantor_guarantor_name, insurance.primary AS insurance_primary, payment_detail.denial_reason AS payment_detail_denial_reason, total_amount_due::DOUBLE AS total_amount_due FROM {_BILLS}""",
    **{f"p2_{array}": f"""SELECT bill_id::VARCHAR AS parent_key, bill_id::VARCHAR || '/' || payment_no AS row_key, payment_no, {columns} FROM (
        SELECT bill_id, unnest(payment_detail.{array}) AS x, unnest(range(1, len(payment_detail.{array}) + 1)) AS payment_no FROM {_BILLS}) WHERE x IS NOT NULL""" for array, columns in {
        "insurance_payments": "x.payer_name, x.payment_amount::DOUBLE AS payment_amount, x.payment_date, x.check_or_ref_number",
        "adjustments": "x.description, x.amount::DOUBLE AS amount, x.adjustment_date, x.reference",
        "payments_received": "x.description, x.total_paid::DOUBLE AS total_paid, x.last_payment_date, x.plan_ref",
    }.items()},
    "p2_raw_items": """SELECT record_id::VARCHAR AS parent_key, record_id::VARCHAR || '/' || item_no AS row_key, item_no, x->>'service_name' AS service_name, (x->>'billed_amount')::DOUBLE AS billed_amount FROM (
        SELECT record_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS item_no FROM (
          SELECT record_id, (payload::JSON->'summary_of_services'->'line_items')::JSON[] AS a FROM raw_records WHERE feed LIKE 'bill%' AND json_valid(payload))) WHERE json_type(x) = 'OBJECT'""",
    "p3_case_columns": f"""SELECT record_id, {_taken("VARCHAR", "scenario")} AS scenario, {_taken("VARCHAR", "payer")} AS payer, {_taken("INTEGER", "household_size")} AS household_size,
        {_taken("DECIMAL(18,2)", "amount_owed_usd")}::DOUBLE AS amount_owed_usd, j IS NOT NULL AS valid
        FROM (SELECT record_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS j FROM raw_records WHERE feed LIKE 'case%')""",
}
