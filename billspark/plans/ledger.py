"""Queries of ledger reconciliation, over the bills and over orders with their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions import columns as C
from billspark.operators import ledger, nested
from billspark.session import spread, table


def bills(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "bills")
    return nested.latest_delivery(t.select("bill_id", "loaded_at", *columns) if columns else t, "bill_id", "loaded_at")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ledger.bill_lines(bills(spark, d, "summary_of_services"))


def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    t = ledger.line_totals(_lines(spark, d))
    return t.select("bill_id", "n_lines", *[F.col(f"sum_{c}").cast("double").alias(f"sum_{c}") for c in ledger.FOUR])


def _stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = bills(spark, d, "summary_of_services", "total_amount_due")
    return ledger.bill_lines(b), b.select("bill_id", F.col("total_amount_due").alias("stated"))


def ledger_consistency(spark: SparkSession, d: str) -> DataFrame:
    return ledger.consistency(*_stated(spark, d))


def ledger_row_violations(spark: SparkSession, d: str) -> DataFrame:
    return ledger.row_violations(*_stated(spark, d)).withColumn("gap", F.col("gap").cast("double"))


def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    return ledger.repeated_lines(_lines(spark, d))


def provenance_long(spark: SparkSession, d: str) -> DataFrame:
    return ledger.provenance(bills(spark, d, "summary_of_services", "total_amount_due"), ledger_consistency(spark, d))


def totals_audit(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d, "summary_of_services")
    return ledger.totals_audit(b, ledger.bill_lines(b))


def amount_owed(spark: SparkSession, d: str) -> DataFrame:
    """The first amount that is there: stated balance, sum of the lines, stated total; and as it is printed."""
    b = bills(spark, d, "summary_of_services", "total_amount_due")
    sums = ledger.line_totals(ledger.bill_lines(b)).select("bill_id", "sum_balance")
    owed = C.first_truthy(F.col("summary_of_services.totals.patient_balance"), F.col("sum_balance"), F.col("total_amount_due")).cast("decimal(18,2)")
    return b.join(sums, "bill_id", "left").select("bill_id", owed.cast("double").alias("owed"), C.money(owed).alias("shown"))


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"))
    billed = F.col("l_extendedprice").cast("decimal(18,2)")
    part = lambda c: (billed * F.col(c).cast("decimal(4,2)")).cast("decimal(18,2)")
    lines = li.select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").cast("bigint").alias("item_no"), billed.alias("billed"), part("l_discount").alias("insurance"), part("l_tax").alias("adjustments"))
    lines = lines.withColumn("balance", (F.col("billed") - F.col("insurance") - F.col("adjustments")).cast("decimal(18,2)"))
    return lines, table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("stated"))


def order_ledger_consistency(spark: SparkSession, d: str) -> DataFrame:
    return ledger.consistency(*_orders(spark, d))


def order_ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    t = ledger.line_totals(_orders(spark, d)[0])
    return t.select("bill_id", "n_lines", *[F.col(f"sum_{c}").cast("double").alias(f"sum_{c}") for c in ledger.FOUR])


QUERIES = {f.__name__: f for f in (ledger_totals, ledger_consistency, ledger_row_violations, duplicate_lines, provenance_long, totals_audit, amount_owed, order_ledger_totals, order_ledger_consistency)}

BILLS = "(SELECT * FROM bills QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
LINES = f"""(SELECT bill_id, item_no, x.service_name, x.code_type, x.code, x.billed_amount AS billed, x.insurance_payments AS insurance, x.adjustments AS adjustments, x.patient_balance AS balance
  FROM (SELECT bill_id, unnest(summary_of_services.line_items) AS x, unnest(range(1, len(summary_of_services.line_items) + 1)) AS item_no FROM {BILLS}) WHERE x IS NOT NULL)"""
ORDER_LINES = """(SELECT *, CAST(billed - insurance - adjustments AS DECIMAL(18,2)) AS balance FROM (
  SELECT l_orderkey AS bill_id, l_linenumber::BIGINT AS item_no, CAST(l_extendedprice AS DECIMAL(18,2)) AS billed,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS insurance,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS adjustments FROM lineitem))"""
_SUMS = "count(*) AS n_lines, sum(billed) AS sum_billed, sum(insurance) AS sum_insurance, sum(adjustments) AS sum_adjustments, sum(balance) AS sum_balance"


def _totals(lines: str) -> str:
    return f"SELECT bill_id, n_lines, sum_billed::DOUBLE AS sum_billed, sum_insurance::DOUBLE AS sum_insurance, sum_adjustments::DOUBLE AS sum_adjustments, sum_balance::DOUBLE AS sum_balance FROM (SELECT bill_id, {_SUMS} FROM {lines} GROUP BY 1)"


def _consistency(lines: str, stated: str) -> str:
    return f"""WITH l AS (SELECT * FROM {lines}), s AS (SELECT * FROM {stated}),
  g AS (SELECT bill_id, {_SUMS} FROM l GROUP BY 1),
  t AS (SELECT s.bill_id, stated, coalesce(sum_balance, sum_billed) AS summed, g.* EXCLUDE (bill_id), greatest(coalesce(nullif(stated, 0), nullif(coalesce(sum_balance, sum_billed), 0), 1) * 0.02, 0.01) AS tol FROM s LEFT JOIN g USING (bill_id)),
  v AS (SELECT l.bill_id, count(*) AS violations FROM l JOIN t USING (bill_id) WHERE abs(billed - insurance - adjustments - balance) > tol GROUP BY 1)
  SELECT t.bill_id, coalesce(n_lines, 0) AS n_lines, stated::DOUBLE AS stated, summed::DOUBLE AS summed, (stated - summed)::DOUBLE AS difference, coalesce(violations, 0) AS violations,
    stated IS NOT NULL AND summed IS NOT NULL AS checked,
    CASE WHEN stated IS NOT NULL AND summed IS NOT NULL THEN abs(stated - summed) <= greatest(stated * 0.02, 0.01) AND coalesce(abs(sum_billed - sum_insurance - sum_adjustments - sum_balance) <= greatest(stated * 0.02, 0.01), true) AND coalesce(violations, 0) = 0 END AS consistent
  FROM t LEFT JOIN v USING (bill_id)"""


_STATED = f"(SELECT bill_id, total_amount_due AS stated FROM {BILLS})"
_FIELDS = [("total_billed", "sum_billed"), ("total_insurance_payments", "sum_insurance"), ("total_adjustments", "sum_adjustments"), ("patient_balance", "sum_balance")]
SQL = {
    "ledger_totals": _totals(LINES),
    "ledger_consistency": _consistency(LINES, _STATED),
    "ledger_row_violations": f"""WITH l AS (SELECT * FROM {LINES}), t AS (SELECT s.bill_id, greatest(coalesce(nullif(stated, 0), nullif(summed, 0), 1) * 0.02, 0.01) AS tol FROM {_STATED} s JOIN (SELECT bill_id, sum(balance) AS summed FROM l GROUP BY 1) USING (bill_id))
  SELECT bill_id, item_no, (billed - insurance - adjustments - balance)::DOUBLE AS gap FROM l JOIN t USING (bill_id) WHERE abs(billed - insurance - adjustments - balance) > tol""",
    "duplicate_lines": f"""SELECT bill_id, code, description, billed::DOUBLE AS billed, balance::DOUBLE AS balance, count(*) AS occurrences, string_agg(item_no, ',' ORDER BY item_no) AS places
  FROM (SELECT *, lower(trim(coalesce(service_name, ''))) AS description FROM {LINES}) WHERE description <> '' OR coalesce(code, '') <> '' GROUP BY bill_id, code, description, billed, balance HAVING count(*) > 1""",
    "provenance_long": f"""WITH c AS ({_consistency(LINES, _STATED)}), f AS ({" UNION ALL ".join(f"SELECT bill_id, '{f}' AS field, {'' if f == 'total_amount_due' else 'summary_of_services.totals.'}{f}::DOUBLE AS value FROM {BILLS}" for f in ledger.TRACKED)})
  SELECT bill_id, field, value, CASE WHEN NOT consistent THEN 'fails_total_reconciliation' END AS warning FROM f LEFT JOIN c USING (bill_id) WHERE value IS NOT NULL""",
    "totals_audit": f"""WITH g AS (SELECT bill_id, {_SUMS} FROM {LINES} GROUP BY 1), b AS (SELECT bill_id, summary_of_services.totals AS t FROM {BILLS}), u AS ({" UNION ALL ".join(f"SELECT bill_id, '{f}' AS field, t.{f} AS stated, {s} AS summed FROM b JOIN g USING (bill_id)" for f, s in _FIELDS)})
  SELECT bill_id, field, stated::DOUBLE AS stated, summed::DOUBLE AS summed FROM u WHERE abs(stated - summed) > 0.02""",
    "amount_owed": f"""WITH g AS (SELECT bill_id, {_SUMS} FROM {LINES} GROUP BY 1), o AS (SELECT b.bill_id, CAST(coalesce(nullif(b.summary_of_services.totals.patient_balance, 0), nullif(sum_balance, 0), nullif(total_amount_due, 0)) AS DECIMAL(18,2)) AS owed FROM {BILLS} b LEFT JOIN g USING (bill_id))
  SELECT bill_id, owed::DOUBLE AS owed, CASE WHEN owed < 0 THEN '($' || format('{{:,.2f}}', -owed::DOUBLE) || ')' ELSE '$' || format('{{:,.2f}}', owed::DOUBLE) END AS shown FROM o""",
    "order_ledger_totals": _totals(ORDER_LINES),
    "order_ledger_consistency": _consistency(ORDER_LINES, "(SELECT o_orderkey AS bill_id, CAST(o_totalprice AS DECIMAL(18,2)) AS stated FROM orders)"),
}
