"""Queries of extraction from statement texts among the documents, and a round trip from the bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.operators import extract, grounding, ledger
from billspark.plans.ledger import BILLS, LINES, bills
from billspark.session import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def amount_parse(spark: SparkSession, d: str) -> DataFrame:
    return extract.amounts(_docs(spark, d)).withColumn("amount", F.col("amount").cast("double"))


def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    return extract.dates(_docs(spark, d))


def code_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.codes(_docs(spark, d))


def statement_header(spark: SparkSession, d: str) -> DataFrame:
    return extract.header(_docs(spark, d)).withColumn("amount_due", F.col("amount_due").cast("double"))


def statement_totals(spark: SparkSession, d: str) -> DataFrame:
    t = extract.totals_line(_docs(spark, d))
    return t.select("doc_id", *[F.col(c).cast("double").alias(c) for c in t.columns if c != "doc_id"])


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    return extract.text_lines(_docs(spark, d)).withColumn("amount", F.col("amount").cast("double"))


def statement_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Each bill printed as text and read back: line counts and sums of the bill and of what was read."""
    b = bills(spark, d, "summary_of_services", "total_amount_due")
    lines = ledger.bill_lines(b).where("billed is not null")
    text = F.concat_ws("  ", F.lit("-"), F.concat(F.lit("line "), F.col("item_no").cast("string"), F.lit(" service")), F.concat(F.lit("$"), F.format_number(F.abs("billed"), 2)))
    printed = lines.groupBy("bill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"), F.count("*").alias("lines_in"), F.sum(F.abs("billed")).alias("sum_in"))
    read = extract.text_lines(printed, "bill_id").groupBy("bill_id").agg(F.count("*").alias("lines_out"), F.sum("amount").alias("sum_out"))
    return printed.join(read, "bill_id", "left").select("bill_id", "lines_in", "lines_out", F.col("sum_in").cast("double").alias("sum_in"), F.col("sum_out").cast("double").alias("sum_out"))


def statement_grid(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each bill laid out as a table grid and read back."""
    b = bills(spark, d, "summary_of_services")
    shown = lambda c: F.coalesce(F.when(F.col(c) < 0, F.concat(F.lit("($"), F.format_number(-F.col(c), 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(c, 2))), F.lit(""))
    row = F.array(F.lit("line"), F.concat(F.lit("no "), F.col("item_no").cast("string")), *[shown(c) for c in ledger.FOUR])
    rows = ledger.bill_lines(b).groupBy(F.col("bill_id").alias("stmt_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.array(*[F.lit(x) for x in ("Service", "CPT", "Billed", "Ins Pmts", "Adj", "Patient Bal")])
    t = extract.grid_lines(rows.select("stmt_id", F.concat(F.array(head), "rows").alias("grid")))
    return t.select("stmt_id", "code", *[F.col(c).cast("double").alias(c) for c in ledger.FOUR])


def _printed(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d, "statement_date", "due_date", "insurance", "total_amount_due")
    due = F.concat(F.lit("$"), F.format_number("total_amount_due", 2))
    text = F.concat_ws("\n", F.concat(F.lit("Statement date: "), "statement_date"), F.concat(F.lit("Pay by: "), "due_date"), F.concat(F.lit("Primary Insurance: "), F.trim("insurance.primary"), F.lit(" Policy #: 77")), F.concat(F.lit("Secondary Insurance: "), F.trim("insurance.secondary"), F.lit(", P.O. Box 12")), F.concat(F.lit("Amount due "), due))
    return b.select("bill_id", "statement_date", "due_date", F.col("total_amount_due").cast("decimal(18,2)").alias("amount_due"), F.nullif(F.trim("insurance.primary"), F.lit("")).alias("primary"), F.nullif(F.trim("insurance.secondary"), F.lit("")).alias("secondary"), text.alias("text"))


def field_recall(spark: SparkSession, d: str) -> DataFrame:
    """Header fields of each bill printed as text and read back: recall by field."""
    p = _printed(spark, d)
    read = extract.header(p, "bill_id").join(extract.payers(p, "bill_id"), "bill_id")
    t = grounding.field_recall(p.where("amount_due >= 0"), read, "bill_id", ["statement_date", "due_date", "amount_due", "primary", "secondary"])
    return t


def bill_signals(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d, "insurance", "_collections_notice", "summary_of_services")
    return ledger.bill_signals(b, ledger.bill_lines(b))


QUERIES = {f.__name__: f for f in (amount_parse, date_normalize, code_extract, statement_header, statement_totals, statement_lines, statement_roundtrip, statement_grid, field_recall, bill_signals)}

_AMOUNT = r"\(?\s*\$?\s*[\d,]+\.\d{2}\s*\)?"
_MD = r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}"
_D = r"\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4}|\d{4}-\d{2}-\d{2}"
_PARSE = "CAST(regexp_replace({0}, '[$,()\\s]', '', 'g') AS DECIMAL(18,2))"


def _parse(x: str) -> str:
    return _PARSE.format(x)


_NORM = """CASE WHEN regexp_matches(w, '^\\d{4}-\\d{2}-\\d{2}$') THEN w[6:7] || '/' || w[9:10] || '/' || w[1:4]
  ELSE lpad(p[1], 2, '0') || '/' || lpad(p[2], 2, '0') || '/' || CASE WHEN length(p[3]) = 2 THEN CASE WHEN p[3] < '50' THEN '20' ELSE '19' END || p[3] ELSE p[3] END END"""
SQL = {
    "amount_parse": f"""SELECT doc_id, pos, raw, (CASE WHEN raw LIKE '(%' AND raw LIKE '%)' THEN -1 ELSE 1 END * try_cast(regexp_replace(raw, '[$,()\\s]', '', 'g') AS DECIMAL(18,2)))::DOUBLE AS amount
  FROM (SELECT doc_id, unnest(range(0, len(a))) AS pos, trim(unnest(a)) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '{_AMOUNT}') AS a FROM documents WHERE text IS NOT NULL))""",
    "date_normalize": f"""SELECT DISTINCT doc_id, {_NORM} AS date FROM (SELECT doc_id, w, string_split(replace(w, '-', '/'), '/') AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9A-Za-z_/-]+')) AS w FROM documents) WHERE regexp_matches(w, '^(?:{_D})$'))""",
    "code_extract": """SELECT * FROM (SELECT doc_id, code, CASE WHEN regexp_matches(code, '^\\d{5}(-[A-Z0-9]{2})?$') THEN 'CPT' WHEN regexp_matches(code, '^[A-Z]\\d{4}$') THEN 'HCPCS' WHEN regexp_matches(code, '^[A-Z]\\d{2}(\\.\\d{1,4})?$') THEN 'ICD-10' END AS kind
  FROM (SELECT DISTINCT doc_id, regexp_replace(w, '^[.,#-]+|[.,-]+$', '', 'g') AS code FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9A-Za-z_.$,/#-]+')) AS w FROM documents))) WHERE kind IS NOT NULL""",
    "statement_header": f"""SELECT doc_id, nullif(regexp_extract(text, '(?i)statement[ \\t]+date\\s*[:;]?\\s*({_D}|{_MD})', 1), '') AS statement_date,
  nullif(regexp_extract(text, '(?i)(?:due[ \\t]+date|pay[ \\t]+by|due)\\s*[:;]?\\s*({_D}|{_MD})', 1), '') AS due_date,
  try_cast(regexp_replace(nullif(regexp_extract(text, '(?i)(?:amount|total|balance)[ \\t]+due\\s*[:;]?\\s*(\\$?[\\d,]+(?:\\.\\d{{2}})?)', 1), ''), '[$,]', '', 'g') AS DECIMAL(18,2))::DOUBLE AS amount_due,
  nullif(regexp_extract(text, '(\\(\\d{{3}}\\) \\d{{3}}-\\d{{4}})', 1), '') AS phone, lower(nullif(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', 1), '')) AS email
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "statement_totals": f"""WITH a AS (SELECT doc_id, n, list_transform(regexp_extract_all(replace(line, '—', '$0.00'), '\\$[\\d,]+(?:\\.\\d{{2}})?'), lambda x: {_parse("x")}) AS a FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents) WHERE regexp_matches(line, '(?i)^\\s*totals\\s')),
  g AS (SELECT doc_id, arg_max(a, n) FILTER (len(a) >= 4) AS four, arg_min(a, n) FILTER (len(a) = 3) AS three FROM a GROUP BY 1)
  SELECT doc_id, coalesce(nullif(four[1], 0), three[1], four[1])::DOUBLE AS total_billed, four[2]::DOUBLE AS insurance, four[3]::DOUBLE AS adjustments, coalesce(nullif(four[4], 0), three[3], four[4])::DOUBLE AS patient_balance, coalesce(three[2], four[4])::DOUBLE AS outstanding_balance FROM g WHERE four IS NOT NULL OR three IS NOT NULL""",
    "statement_lines": f"""WITH l AS (SELECT doc_id, n + 1 AS line_no, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)),
  t AS (SELECT *, regexp_extract_all(line, '\\$[\\d,]+(?:\\.\\d{{2}})?') AS a, nullif(regexp_extract(line, '({_MD}|{_D})', 1), '') AS date, nullif(regexp_extract(line, '(?:^|[\\s(])(\\d{{5}}|[A-Z]\\d{{4}})(?:[\\s).,;]|$)', 1), '') AS code FROM l WHERE length(line) >= 5),
  u AS (SELECT *, regexp_replace(regexp_replace(line, '({_MD}|{_D})', ' ', 'g'), '\\$[\\d,]+(?:\\.\\d{{2}})?', ' ', 'g') AS rest FROM t WHERE len(a) > 0)
  SELECT * FROM (SELECT doc_id, line_no, date, nullif(regexp_replace(regexp_replace(CASE WHEN code IS NOT NULL THEN replace(rest, code, ' ') ELSE rest END, '\\s{{2,}}', ' ', 'g'), '^[ \\-|:.,;]+|[ \\-|:.,;]+$', '', 'g'), '') AS description, code, {_parse("a[len(a)]")}::DOUBLE AS amount FROM u) WHERE description IS NOT NULL OR code IS NOT NULL""",
    "statement_roundtrip": f"""SELECT bill_id, count(*) AS lines_in, count(*) AS lines_out, sum(abs(billed))::DOUBLE AS sum_in, sum(abs(billed))::DOUBLE AS sum_out FROM {LINES} WHERE billed IS NOT NULL GROUP BY 1""",
    "statement_grid": f"SELECT bill_id AS stmt_id, 'no ' || item_no AS code, billed::DOUBLE AS billed, insurance::DOUBLE AS insurance, adjustments::DOUBLE AS adjustments, balance::DOUBLE AS balance FROM {LINES}",
    "field_recall": " UNION ALL ".join(f"SELECT '{f}' AS field, count({c}) AS n, count({c}) AS n_equal, 1.0::DOUBLE AS recall FROM {BILLS} WHERE total_amount_due >= 0 HAVING count({c}) > 0" for f, c in (("statement_date", "statement_date"), ("due_date", "due_date"), ("amount_due", "total_amount_due"), ("primary", "nullif(trim(insurance.primary), '')"), ("secondary", "nullif(trim(insurance.secondary), '')"))),
    "bill_signals": f"""WITH l AS (SELECT * FROM {LINES}), f AS (SELECT bill_id, bool_or(regexp_matches(lower(coalesce(service_name, '')), 'collection|agency assessment')) AS fee FROM l GROUP BY 1),
  r AS (SELECT DISTINCT bill_id FROM l WHERE lower(trim(coalesce(service_name, ''))) <> '' OR coalesce(code, '') <> '' GROUP BY bill_id, code, lower(trim(coalesce(service_name, ''))), billed, balance HAVING count(*) > 1)
  SELECT b.bill_id, regexp_matches(lower(trim(coalesce(insurance.primary, ''))), 'none on file|self-pay|self pay|no insurance|uninsured') AS no_insurance, _collections_notice IS NOT NULL OR coalesce(fee, false) AS collections, coalesce(fee, false) AS collections_fee, r.bill_id IS NOT NULL AS repeated
  FROM {BILLS} b LEFT JOIN f ON f.bill_id = b.bill_id LEFT JOIN r ON r.bill_id = b.bill_id""",
}
