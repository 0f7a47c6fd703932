"""Claims against evidence: amounts and codes of an answer that its bill and conversation don't hold; recall of lines.

Evidence is a long table (id, kind, value); claims likewise. An amount is grounded by a known amount within the
tolerance, found by an equality join on cents and their neighbours, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import columns as C

CLAIM_AMOUNT = r"\$\s*([\d,]+(?:\.\d{2})?)"
CLAIM_CODE = r"(?:CPT|HCPCS)\s*(?:code\s*)?(\d{5}|[A-Z]\d{4})"


def claimed(texts: DataFrame, key: str, text: str, *carry: str) -> DataFrame:
    """(key, carried columns, kind, value) of amounts and labelled codes in a text, repeats kept; amounts in cents."""
    t = F.coalesce(F.col(text), F.lit(""))
    amounts = F.transform(F.regexp_extract_all(t, F.lit(CLAIM_AMOUNT), F.lit(1)), lambda x: F.struct(F.lit("amount").alias("kind"), (C.parse_amount(x) * 100).cast("bigint").cast("string").alias("value")))
    codes = F.transform(F.regexp_extract_all(t, F.lit(CLAIM_CODE), F.lit(1)), lambda x: F.struct(F.lit("code").alias("kind"), x.alias("value")))
    return texts.select(key, *carry, F.explode(F.concat(amounts, codes)).alias("x")).select(key, *carry, "x.kind", "x.value").where("value is not null")


# Words beside which a number without a dollar sign is an amount.
MONEY_WORDS = "paid|balance|charged?|charges|bill(?:ed)?|due|total|ow(?:e|es|ed)|cost"
NUMERIC_DATES = r"(?<![\w/-])(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})(?![\w/-])"


def stated(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value) of what a text states, once each, as evidence: amounts in cents with a dollar sign or beside a
    word of money, numeric dates, and codes, labelled or any five digits."""
    t = F.coalesce(F.col(text), F.lit(""))

    def values(kind: str, pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        shown = (lambda x: (C.parse_amount(x) * 100).cast("bigint").cast("string")) if kind == "amount" else F.upper
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), shown(x).alias("value")))

    beside = rf"(?i)\b(?:{MONEY_WORDS})\b[:\s]*\$?\s*(\d[\d,]*(?:\.\d{{2}})?)(?![\d/,.-]*[\d/])"
    every = F.concat(values("amount", CLAIM_AMOUNT), values("amount", beside), values("date", NUMERIC_DATES), values("code", f"(?i){CLAIM_CODE}"), values("code", r"(?<![\w$.,/-])(\d{5})(?![\w/-]|[.,]\d)"))
    return texts.select(key, F.explode(every).alias("x")).select(key, "x.kind", "x.value").where("value is not null").distinct()


def known_of_bills(bills: DataFrame, key: str) -> DataFrame:
    """(key, kind, value): all money of a bill in cents and the codes of its lines."""
    cents = lambda c: F.struct(F.lit("amount").alias("kind"), (c * 100).cast("bigint").cast("string").alias("value"))
    code = lambda c: F.struct(F.lit("code").alias("kind"), F.trim(c).alias("value"))
    empty = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    items = F.coalesce(F.flatten(F.transform("summary_of_services.line_items", lambda x: F.coalesce(F.array(cents(x["billed_amount"]), cents(x["insurance_payments"]), cents(x["adjustments"]), cents(x["patient_balance"]), code(x["code"])), empty))), empty)
    totals = F.col("summary_of_services.totals")
    stated = F.array(cents(F.col("total_amount_due")), *[cents(totals.getField(f)) for f in ("total_billed", "total_insurance_payments", "total_adjustments", "outstanding_balance", "patient_balance")])
    return bills.select(key, F.explode(F.concat(items, stated)).alias("x")).select(key, "x.kind", "x.value").where("value is not null").distinct()


def ungrounded(claims: DataFrame, known: DataFrame, key: str, slack_cents: int = 1) -> DataFrame:
    """Claims without evidence under the same key; a band of ``slack_cents`` either side counts for amounts."""
    near = F.when(F.col("kind") == "amount", F.transform(F.sequence(F.lit(-slack_cents), F.lit(slack_cents)), lambda i: (F.col("value").try_cast("bigint") + i).cast("string"))).otherwise(F.array("value"))
    band = known.select(key, "kind", F.explode(near).alias("value")).distinct()
    return claims.join(band, [key, "kind", "value"], "left_anti")


def line_recall(gold: DataFrame, parsed: DataFrame, key: str, slack: str = "0.01") -> DataFrame:
    """Of each key's gold lines (code, amount), how many have a parsed line of the same code, and with the same amount.

    (key, n_gold, n_matched, n_mismatched, n_missing, recall); lines without a code are missing.
    """
    g = gold.select(key, "item_no", F.upper(F.trim("code")).alias("code"), F.col("amount").alias("ga"))
    p = parsed.select(key, F.upper(F.trim("code")).alias("code"), F.col("amount").alias("pa")).distinct()
    met = g.join(p, [key, "code"], "left").groupBy(key, "item_no").agg(F.max(F.col("pa").isNotNull()).alias("found"), F.max(F.coalesce(F.abs(F.col("ga") - F.col("pa")) <= F.lit(slack).cast("decimal(4,2)"), F.lit(False))).alias("equal"))
    return met.groupBy(key).agg(F.count("*").alias("n_gold"), F.count_if("equal").alias("n_matched"), F.count_if(F.col("found") & ~F.col("equal")).alias("n_mismatched"), F.count_if(~F.col("found")).alias("n_missing"), F.round(F.count_if("equal") / F.count("*"), 4).alias("recall"))


def share(c: Column) -> Column:
    return F.round(F.avg(c.cast("int")), 4)


def field_recall(gold: DataFrame, parsed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n, n_equal, recall): of the gold values that are there, how many the parsed side has just so."""
    p = parsed.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields])
    met = gold.select(key, *fields).join(p, key, "left")
    long = met.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("g"), F.col(f"_p_{f}").cast("string").alias("p")) for f in fields])).alias("x")).select("x.*").where("g is not null")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("g").eqNullSafe(F.col("p"))).alias("n_equal"), F.round(F.count_if(F.col("g").eqNullSafe(F.col("p"))) / F.count("*"), 4).alias("recall"))


def outcomes(runs: DataFrame, variants: list[str]) -> DataFrame:
    """(variant, n_ok, n_rejected, n_error, recall) of runs (variant, outcome, recall): every variant has a row, and
    the average recall is that of the runs that went well."""
    spark = runs.sparkSession
    ok = F.col("outcome") == "ok"
    g = runs.groupBy("variant").agg(F.count_if(ok).alias("n_ok"), F.count_if(F.col("outcome") == "rejected").alias("n_rejected"), F.count_if(F.col("outcome") == "error").alias("n_error"), F.round(F.avg(F.when(ok, F.col("recall").cast("decimal(9,4)"))).cast("double"), 4).alias("recall"))
    every = spark.createDataFrame([(v,) for v in variants], "variant string")
    return every.join(g, "variant", "left").fillna(0, ["n_ok", "n_rejected", "n_error"])
