"""Reconciliation of line items with stated totals, repeated lines, and where a total comes from.

Lines are rows (bill_id, item_no, service_name, code, billed, insurance, adjustments, balance) in decimal(18,2).
Null amounts are left out of sums; a bill without lines or without a stated total is not checked (null, not false).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
FOUR = ("billed", "insurance", "adjustments", "balance")


def bill_lines(bills: DataFrame) -> DataFrame:
    """One row for each non-null line item of each bill; ``bills`` has one row per bill."""
    lines = bills.select("bill_id", F.posexplode("summary_of_services.line_items").alias("i", "x")).where("x is not null")
    return lines.select("bill_id", (F.col("i") + 1).cast("bigint").alias("item_no"), "x.service_name", "x.code_type", "x.code", F.col("x.billed_amount").alias("billed"), F.col("x.insurance_payments").alias("insurance"), "x.adjustments", F.col("x.patient_balance").alias("balance"))


def line_totals(lines: DataFrame, key: str = "bill_id") -> DataFrame:
    """Number of lines and the four sums of each bill; a sum without values is null."""
    return lines.groupBy(key).agg(F.count("*").alias("n_lines"), *[F.sum(c).cast(MONEY).alias(f"sum_{c}") for c in FOUR])


def tolerance(stated: Column, summed: Column, share: float = 0.02, least: str = "0.01") -> Column:
    """A share of the first of the two that is neither null nor zero, and ``least`` at least."""
    base = F.coalesce(F.nullif(stated, F.lit(0).cast(MONEY)), F.nullif(summed, F.lit(0).cast(MONEY)), F.lit(1).cast(MONEY))
    return F.greatest(base * F.lit(str(share)).cast("decimal(4,2)"), F.lit(least).cast("decimal(4,2)"))


def row_violations(lines: DataFrame, stated: DataFrame, key: str = "bill_id") -> DataFrame:
    """Lines whose four amounts are all there and don't add up within the tolerance of their bill."""
    sums = lines.groupBy(key).agg(F.sum("balance").cast(MONEY).alias("summed"))
    t = lines.join(sums, key).join(stated.select(key, "stated"), key, "left")
    gap = F.col("billed") - F.col("insurance") - F.col("adjustments") - F.col("balance")
    return t.withColumn("gap", gap.cast(MONEY)).where(F.abs(gap) > tolerance(F.col("stated"), F.col("summed"))).select(key, "item_no", "gap")


def consistency(lines: DataFrame, stated: DataFrame, key: str = "bill_id") -> DataFrame:
    """The stated total of each bill against the sums of its lines.

    The sums are one hash aggregate; only lines with a gap at all, commonly few, go on to be held against the
    tolerance of their bill, for which the aggregate's shuffle is used again.
    """
    sums = line_totals(lines, key)
    t = stated.select(key, "stated").join(sums, key, "left")
    t = t.withColumn("summed", F.coalesce("sum_balance", "sum_billed")).withColumn("tol", tolerance(F.col("stated"), F.col("summed")))
    gap = F.abs(F.col("billed") - F.col("insurance") - F.col("adjustments") - F.col("balance"))
    gaps = lines.select(key, gap.alias("gap")).where(F.col("gap") > F.lit("0.01").cast("decimal(4,2)"))
    bad = gaps.join(t.select(key, "tol"), key).where("gap > tol").groupBy(key).agg(F.count("*").alias("violations"))
    t = t.join(bad, key, "left").withColumn("violations", F.coalesce("violations", F.lit(0))).withColumn("checked", F.col("stated").isNotNull() & F.col("summed").isNotNull())
    own = F.greatest(F.col("stated") * F.lit("0.02").cast("decimal(4,2)"), F.lit("0.01").cast("decimal(4,2)"))
    parts = F.col("sum_billed") - F.col("sum_insurance") - F.col("sum_adjustments")
    ok = (F.abs(F.col("stated") - F.col("summed")) <= own) & F.coalesce(F.abs(parts - F.col("sum_balance")) <= own, F.lit(True)) & (F.col("violations") == 0)
    return t.select(key, F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.col("stated").cast("double").alias("stated"), F.col("summed").cast("double").alias("summed"), F.when(F.col("checked"), (F.col("stated") - F.col("summed")).cast("double")).alias("difference"), F.col("violations").cast("bigint").alias("violations"), "checked", F.when(F.col("checked"), ok).alias("consistent"))


def repeated_lines(lines: DataFrame, key: str = "bill_id") -> DataFrame:
    """Lines of one bill with the same code, description, billed amount and balance, with the places of all of them.

    Lines with neither code nor description don't count.
    """
    name = F.lower(F.trim(F.coalesce("service_name", F.lit(""))))
    k = lines.withColumn("description", name).where((F.col("description") != "") | (F.coalesce("code", F.lit("")) != ""))
    g = k.groupBy(key, "code", "description", "billed", "balance").agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_list("item_no")), ",").alias("places"))
    return g.where("occurrences > 1").select(key, "code", "description", F.col("billed").cast("double").alias("billed"), F.col("balance").cast("double").alias("balance"), "occurrences", "places")


TRACKED = ("total_billed", "total_insurance_payments", "total_adjustments", "outstanding_balance", "patient_balance", "total_amount_due")


def provenance(bills: DataFrame, checks: DataFrame, key: str = "bill_id") -> DataFrame:
    """(bill_id, field, value, warning) of each stated total; the warning tells of a failed reconciliation."""
    totals = F.col("summary_of_services.totals")
    value = lambda f: F.col("total_amount_due") if f == "total_amount_due" else totals.getField(f)
    long = bills.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(f).cast("double").alias("value")) for f in TRACKED])).alias("x")).select(key, "x.field", "x.value").where("value is not null")
    return long.join(checks.select(key, "consistent"), key, "left").select(key, "field", "value", F.when(~F.col("consistent"), "fails_total_reconciliation").alias("warning"))


def provenance_warnings(bills: DataFrame, checks: DataFrame, lines: DataFrame, key: str = "bill_id") -> DataFrame:
    """(bill_id, warnings): the different warnings of a bill's totals, sorted; bills without any have an empty list.

    Warned of are totals that fail the reconciliation, negative ones, ones that are missing, and bills without lines.
    """
    totals = F.col("summary_of_services.totals")
    stated = [F.col("total_amount_due"), *[totals.getField(f) for f in TRACKED if f != "total_amount_due"]]
    negative, absent = F.lit(False), F.lit(False)
    for c in stated:
        negative, absent = negative | F.coalesce(c < 0, F.lit(False)), absent | c.isNull()
    has_lines = lines.select(key).distinct().withColumn("has_lines", F.lit(True))
    t = bills.select(key, negative.alias("negative"), absent.alias("absent")).join(checks.select(key, "consistent"), key, "left").join(has_lines, key, "left")
    told = F.array(F.when(~F.col("consistent"), "fails_total_reconciliation"), F.when(F.col("negative"), "negative_total"), F.when(F.col("absent"), "missing_total"), F.when(F.col("has_lines").isNull(), "no_line_items"))
    return t.select(key, F.array_join(F.array_sort(F.array_distinct(F.filter(told, lambda x: x.isNotNull()))), ", ").alias("warnings"))


def totals_audit(bills: DataFrame, lines: DataFrame, key: str = "bill_id", slack: str = "0.02") -> DataFrame:
    """Stated totals that differ from the sum of the lines by more than ``slack``."""
    pairs = {"total_billed": "sum_billed", "total_insurance_payments": "sum_insurance", "total_adjustments": "sum_adjustments", "patient_balance": "sum_balance"}
    t = bills.select(key, "summary_of_services.totals").join(line_totals(lines, key), key)
    long = t.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("totals").getField(f).alias("stated"), F.col(s).alias("summed")) for f, s in pairs.items()])).alias("x")).select(key, "x.*")
    return long.where(F.abs(F.col("stated") - F.col("summed")) > F.lit(slack).cast(MONEY)).select(key, "field", F.col("stated").cast("double").alias("stated"), F.col("summed").cast("double").alias("summed"))


def bill_signals(bills: DataFrame, lines: DataFrame, key: str = "bill_id") -> DataFrame:
    """(bill_id, no_insurance, collections, collections_fee, repeated) of each bill, false where nothing tells."""
    primary = F.lower(F.trim(F.coalesce(F.col("insurance.primary"), F.lit(""))))
    fee = F.lower(F.coalesce("service_name", F.lit(""))).rlike("collection|agency assessment")
    per = lines.groupBy(key).agg(F.max(fee).alias("fee"))
    twice = repeated_lines(lines, key).select(key).distinct().withColumn("repeated", F.lit(True))
    t = bills.select(key, primary.rlike(r"none on file|self-pay|self pay|no insurance|uninsured").alias("no_insurance"), F.col("_collections_notice").isNotNull().alias("notice"))
    t = t.join(per, key, "left").join(twice, key, "left")
    no = F.lit(False)
    return t.select(key, "no_insurance", (F.col("notice") | F.coalesce("fee", no)).alias("collections"), F.coalesce("fee", no).alias("collections_fee"), F.coalesce("repeated", no).alias("repeated"))
