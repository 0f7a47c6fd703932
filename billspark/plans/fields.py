"""Queries of stated fields, evidence, prompts and reports: what a text or a row says, where, and how it is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions import columns as C
from billspark.operators import drift, extract, grounding, history, ledger, nested, ocrgrid, quality
from billspark.plans import answers
from billspark.plans import ledger as ledger_plans
from billspark.plans import quality as quality_plans
from billspark.plans.ledger import BILLS, LINES, bills
from billspark.session import spread, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def amount_context(spark: SparkSession, d: str) -> DataFrame:
    """Each different amount of a document where it stands first, with forty characters on both sides."""
    return extract.amounts_in_context(_documents(spark, d)).withColumn("amount", F.col("amount").cast("double"))


def code_lists(spark: SparkSession, d: str) -> DataFrame:
    """The codes of each document in order, as one text."""
    return extract.codes(_documents(spark, d)).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count("*").alias("n"))


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """Bills as a scan might read their headers: labels misread, semicolons for colons, several fields on a line."""
    b = bills(spark, d, "statement_date", "due_date", "patient", "guarantor", "facility", "patient_services")
    odd = F.col("bill_id") % 2 == 1
    line = lambda even, uneven, value: F.concat(F.when(odd, uneven).otherwise(even), F.coalesce(F.trim(value), F.lit("")))
    shown = F.concat_ws(
        "\n",
        F.coalesce(F.trim("facility.name"), F.lit("")),
        F.concat(line("Patient Name: ", "Patlent; ", "patient.patient_name"), F.lit(" DOB: 1/1/1970")),
        F.concat(line("Guarantor Name: ", "Guarantar Namo; ", "guarantor.guarantor_name"), F.lit("   Guarantor #: GU-77")),
        line("Account Number: ", "Acct #: ", "patient.patient_account_number"),
        F.concat(line("Service Date: ", "Servlce Date; ", "patient.service_date"), F.lit(" Service Type: Outpatient")),
        line("Statement Date: ", "Statment Date; ", "statement_date"),
        line("Due Date: ", "Due  Date; ", "due_date"),
        line("Pay Online: ", "Pay Onllne; ", "patient_services.online"),
        line("Pay by Phone: ", "Pay by Phoney; ", "patient_services.phone"),
        F.lit("Patient Financial Services"),
    )
    return b.select("bill_id", shown.alias("text"))


def statement_fields(spark: SparkSession, d: str) -> DataFrame:
    """Header fields of bills printed with uneven labels and read back."""
    t = extract.statement_fields(_printed(spark, d), "bill_id")
    return t.select("bill_id", "patient_name", "guarantor_name", "guarantor_number", "account_number", "service_date", "statement_date", "due_date", "pay_online", "department")


def id_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Account numbers of bills and whether they may be identifiers."""
    return bills(spark, d, "patient").select("bill_id", C.looks_like_id(F.col("patient.patient_account_number")).alias("is_id"), C.looks_like_id(F.col("patient.patient_name")).alias("name_is_id"))


def line_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the bills' printed lines: those told by their shape, and the others as unknown."""
    lines = ledger.bill_lines(bills(spark, d, "summary_of_services")).select("bill_id", F.trim("code").alias("code")).where("code != ''")
    shaped = lines.select("bill_id", "code", C.code_kind(F.col("code")).alias("kind")).where("kind is not null").distinct()
    return extract.with_unlabelled(shaped, lines, "bill_id")


def stated_values(spark: SparkSession, d: str) -> DataFrame:
    """Amounts, dates and codes that patients state, as evidence for what an answer claims."""
    t = answers._reviews(spark, d, "patient_input", "agent_initial_response")
    return grounding.stated(t.select("review_id", F.concat_ws(" ", "patient_input", "agent_initial_response").alias("said")), "review_id", "said")


FINANCES = {"household": C.household_size, "income": C.stated_income}


def history_finances(spark: SparkSession, d: str) -> DataFrame:
    """Household size and income as last stated at each turn of a conversation."""
    return history.last_known(answers._turns(spark, d), FINANCES).withColumn("income", F.col("income").cast("double"))


def agent_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt sent for each case whose bill was uploaded under another name; even cases have no upload."""
    c = table(spark, d, "cases").select("case_id", "patient_input", "bill_doc_file", "modality")
    uploaded = F.when(F.col("modality") != "text", F.concat(F.lit("upload_"), F.coalesce("case_id", F.lit("x")), F.lit(".pdf")))
    return c.select("case_id", "bill_doc_file", history.prompt_for_row(F.col("patient_input"), F.col("bill_doc_file"), uploaded).alias("prompt"))


def case_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty cases of a category and format, by id; the limit is the feature."""
    c = table(spark, d, "cases").select("case_id", "category", "input_format").distinct()
    return quality.selected(c, equal={"category": "financial assistance", "input_format": "TEXT"}, order=["case_id", "category", "input_format"], limit=50)


def clean_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that show placeholders, calls and notices, cleaned for patients."""
    t = answers._reviews(spark, d, "agent_initial_response")
    notice = F.when(F.col("review_id") % 2 == 0, "You do not need to share sensitive identifiers such as your SSN or MRN here. ").otherwise("")
    shown = F.concat(notice, F.lit("<function.lookup x=1>"), F.coalesce("agent_initial_response", F.lit("")), F.lit("\nAlso, I will call the lookup function now.\n\n\n\n- Payment Due Date: soon, [REDACTED:MRN]"))
    return t.select("review_id", history.clean_answer(shown).alias("cleaned"))


def ocr_rows(spark: SparkSession, d: str) -> DataFrame:
    """Words of pages put into lines by where they stand alone, then read line by line."""
    w = answers._words(spark, d).withColumn("top", F.col("line") * 14 + F.col("word_no") % 4).withColumn("height", F.lit(9)).drop("line", "word_no")
    return ocrgrid.lines(ocrgrid.cluster_rows(w))


OUTCOME_VARIANTS = ["pdf", "photo", "text", "fax"]


def variant_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Scored reviews by modality: those with a readable score, with one that can't be read, and without any."""
    r = answers._reviews(spark, d, "modality", "groundedness_score_0_1")
    score = C.parse_number(F.col("groundedness_score_0_1"))
    outcome = F.when(score.isNotNull(), "ok").when(C.is_empty(F.col("groundedness_score_0_1")), "error").otherwise("rejected")
    return grounding.outcomes(r.select(F.col("modality").alias("variant"), outcome.alias("outcome"), score.alias("recall")).where(F.col("variant").isin(OUTCOME_VARIANTS)), OUTCOME_VARIANTS)


def provenance_warnings(spark: SparkSession, d: str) -> DataFrame:
    b = bills(spark, d, "summary_of_services", "total_amount_due")
    lines = ledger.bill_lines(b)
    return ledger.provenance_warnings(b, ledger.consistency(lines, b.select("bill_id", F.col("total_amount_due").alias("stated"))), lines)


def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing(table(spark, d, "cases"), [*quality.REQUIRED, "no_such_column", "loaded_at"])


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The validation report as Markdown, its rows in order."""
    return quality.report(quality_plans.validation_report(spark, d), "Validation", ["severity", "rule", "n", "n_rows"])


#: Cases on which each rule must fire: (case_id, category, scenario, modality, payer, patient_input, safety_constraint, tests_groundedness, bill_doc_file).
PLANTED = [
    ("A", "Safety", "cob", "pdf", "Medicare", "x", "", "true", "no_such.pdf"), ("A", "Billing", "cob", "fax", "Medicare", "x", None, "false", "N/A"), ("B", " ", "COB", "pdf", None, "  ", "kept", "maybe", "b.pdf"), (None, "Billing", None, "text", "Other", "appeal this", "n/a", None, " b.pdf "), ("C", "Billing", "cob", "pdf", "medicare", "x", "kept", " FALSE ", None),
]
_PLANTED_COLUMNS = ["case_id", "category", "scenario", "modality", "payer", "patient_input", "safety_constraint", "tests_groundedness", "bill_doc_file"]


def planted_violations(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(PLANTED, ", ".join(f"{x} string" for x in _PLANTED_COLUMNS))
    known = spark.createDataFrame([("b.pdf",)], "bill_file string")
    v = {k: quality.VOCABULARIES[k] for k in ("modality", "scenario", "payer")}
    flags = ["tests_groundedness"]
    parts = [quality.repeated_ids(c), quality.blank_required(c, ["category", "patient_input"]), quality.outside_vocabulary(c, v), quality.blank_safety(c), quality.unclear_flags(c, flags), quality.no_flag_set(c, flags), quality.unknown_reference(c, known, "bill_doc_file", "bill_file", "unknown_bill")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def payload_paths(spark: SparkSession, d: str) -> DataFrame:
    """The values of delivered JSON records, walked at any depth: how many by feed, file, path and type."""
    facts = drift.flatten_payloads(spread(table(spark, d, "raw_records").select("feed", "file_no", "record_id", "payload")))
    return facts.groupBy("feed", "file_no", "path", "kind").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (amount_context, code_lists, statement_fields, id_shapes, line_codes, stated_values, history_finances, agent_prompts, case_selection, clean_answers, ocr_rows, variant_outcomes, provenance_warnings, missing_columns, report_markdown, planted_violations, payload_paths)
}

_AMOUNT = r"\(?\s*\$?\s*[\d,]+\.\d{2}\s*\)?"
_N = quality_plans._n
_R = answers._R
_CODE_SPLIT = "[^0-9A-Za-z_$.,/-]+"


def _planted_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in PLANTED)
    v = quality_plans._v
    empty = "('', 'n/a', 'na', 'none', 'null')"
    one = f"coalesce(lower({_N('tests_groundedness')}), '')"
    related = f"coalesce(category, '') = 'Safety' OR regexp_matches(concat_ws(' ', category, scenario, patient_input), '{quality.SAFETY_WORDS}')"
    parts = [
        v("'error'", "repeated_id", "'case_id'", "'rows: ' || n", "(SELECT case_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1)"),
        *(v("'error'", "blank_required", f"'{x}'", "''", f"c WHERE {_N(x)} = ''") for x in ("category", "patient_input")),
        *(v("'error'", "outside_vocabulary", f"'{x}'", x, f"c WHERE {_N(x)} <> '' AND {_N(x)} NOT IN ({quality_plans._list(quality.VOCABULARIES[x])})") for x in ("modality", "scenario", "payer")),
        v(f"CASE WHEN {related} THEN 'error' ELSE 'warning' END", "blank_safety", "'safety_constraint'", "''", f"c WHERE lower({_N('safety_constraint')}) IN {empty}"),
        v("'error'", "unclear_flag", "'tests_groundedness'", "coalesce(tests_groundedness, '')", f"c WHERE {one} NOT IN ('true', 'false')"),
        v("'warning'", "no_flag_set", "''", "''", f"c WHERE {one} = 'false'"),
        v("'warning'", "unknown_bill", "'bill_doc_file'", "trim(bill_doc_file)", f"c WHERE lower({_N('bill_doc_file')}) NOT IN {empty} AND trim(bill_doc_file) <> 'b.pdf'"),
    ]
    return f"WITH c({', '.join(_PLANTED_COLUMNS)}) AS (VALUES {rows}) " + " UNION ALL ".join(parts)


_SIZE = "coalesce(try_cast(nullif(regexp_extract(text, '(?i)\\b(?:household|family)\\s*(?:size|of)?\\s*(?:is|:)?\\s*(\\d\\d?)\\b', 1), '') AS INT), try_cast(nullif(regexp_extract(text, '(?i)\\b(\\d\\d?)\\s+(?:people|persons?|members?|of us)\\b', 1), '') AS INT), CASE WHEN regexp_matches(text, '(?i)\\b(?:just (?:me|myself)|(?:i )?live alone)\\b') THEN 1 END)"
_EARN = "(?i)\\b(?:income|make|earn|salary)\\b[^$\\d]{0,80}\\$?\\s*(\\d[\\d,]*(?:\\.\\d\\d)?)(k?)"
_INCOME = f"try_cast(replace(nullif(regexp_extract(text, '{_EARN}', 1), ''), ',', '') AS DOUBLE) * CASE WHEN lower(regexp_extract(text, '{_EARN}', 2)) = 'k' THEN 1000 ELSE 1 END"
_LAST = lambda c: f"last_value(CASE WHEN role = 'user' THEN {c} END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY turn ROWS UNBOUNDED PRECEDING)"
_DATE_PARTS = lambda c: f"CASE WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN trim({c})[6:7] || '/' || trim({c})[9:10] || '/' || trim({c})[1:4] ELSE nullif(trim({c}), '') END"
_STATED = f"(SELECT review_id, concat_ws(' ', patient_input, agent_initial_response) AS t FROM {_R})"
_CENTS = lambda x: f"CAST(try_cast(replace({x}, ',', '') AS DECIMAL(18,2)) * 100 AS BIGINT)::VARCHAR"
SQL = {
    "amount_context": f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_AMOUNT}') AS a, regexp_split_to_array(text, '{_AMOUNT}') AS p FROM documents WHERE regexp_matches(text, '{_AMOUNT}')),
  x AS (SELECT doc_id, text, unnest(range(1, len(a) + 1)) AS i, a, p FROM m),
  y AS (SELECT doc_id, i - 1 AS pos, a[i] AS hit, text, (list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda z: length(z))), 0))::BIGINT AS before FROM x),
  z AS (SELECT doc_id, pos, regexp_replace(hit, '^\\s+|\\s+$', '', 'g') AS raw, (CASE WHEN trim(hit) LIKE '(%' AND trim(hit) LIKE '%)' THEN -1 ELSE 1 END * try_cast(regexp_replace(hit, '[$,()\\s]', '', 'g') AS DECIMAL(18,2)))::DOUBLE AS amount,
    regexp_replace(replace(substring(text, greatest(before - 39, 1), before - greatest(before - 39, 1) + 1 + length(hit) + 40), chr(10), ' '), '^ +| +$', '', 'g') AS context FROM y)
  SELECT doc_id, pos, raw, amount, context FROM z WHERE amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, amount ORDER BY pos) = 1""",
    "code_lists": """SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes, count(*) AS n FROM (SELECT DISTINCT doc_id, regexp_replace(w, '^[.,#-]+|[.,-]+$', '', 'g') AS code FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9A-Za-z_.$,/#-]+')) AS w FROM documents))
  WHERE regexp_matches(code, '^\\d{5}(-[A-Z0-9]{2})?$') OR regexp_matches(code, '^[A-Z]\\d{4}$') OR regexp_matches(code, '^[A-Z]\\d{2}(\\.\\d{1,4})?$') GROUP BY 1""",
    "statement_fields": f"""SELECT bill_id, coalesce(nullif(trim(patient.patient_name), ''), nullif(trim(guarantor.guarantor_name), '')) AS patient_name, nullif(trim(guarantor.guarantor_name), '') AS guarantor_name, 'GU-77' AS guarantor_number,
  CASE WHEN regexp_matches(patient.patient_account_number, '\\d') THEN nullif(trim(patient.patient_account_number), '') END AS account_number, {_DATE_PARTS('patient.service_date')} AS service_date, {_DATE_PARTS('statement_date')} AS statement_date, {_DATE_PARTS('due_date')} AS due_date,
  nullif(trim(patient_services.online), '') AS pay_online, 'Patient Financial Services' AS department FROM {BILLS}""",
    "id_shapes": f"SELECT bill_id, coalesce(regexp_matches(patient.patient_account_number, '[0-9]'), false) AS is_id, coalesce(regexp_matches(patient.patient_name, '[0-9]'), false) AS name_is_id FROM {BILLS}",
    "line_codes": f"SELECT DISTINCT bill_id, trim(code) AS code, CASE WHEN regexp_matches(trim(code), '^\\d{{5}}(-[A-Z0-9]{{2}})?$') THEN 'CPT' WHEN regexp_matches(trim(code), '^[A-Z]\\d{{4}}$') THEN 'HCPCS' WHEN regexp_matches(trim(code), '^[A-Z]\\d{{2}}(\\.\\d{{1,4}})?$') THEN 'ICD-10' ELSE 'unknown' END AS kind FROM {LINES} WHERE trim(code) <> ''",
    "stated_values": f"""SELECT DISTINCT review_id, kind, value FROM (
  SELECT review_id, 'amount' AS kind, {_CENTS("x")} AS value FROM (SELECT review_id, unnest(regexp_extract_all(t, '\\$\\s*([\\d,]+(?:\\.\\d{{2}})?)', 1)) AS x FROM {_STATED})
  UNION ALL SELECT review_id, 'amount', {_CENTS("x")} FROM (SELECT review_id, regexp_replace(unnest(regexp_extract_all(t, '(?i)\\b(?:paid|balance|charged?|charges|bill(?:ed)?|due|total|ow(?:e|es|ed)|cost)\\b[:\\s]*\\$?\\s*(\\d[\\d,./-]*)', 1)), '[.,-]+$', '') AS x FROM {_STATED}) WHERE regexp_full_match(x, '\\d[\\d,]*(\\.\\d{{2}})?')
  UNION ALL SELECT review_id, 'date', w FROM (SELECT review_id, unnest(regexp_split_to_array(t, '[^0-9A-Za-z_/-]+')) AS w FROM {_STATED}) WHERE regexp_full_match(w, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}')
  UNION ALL SELECT review_id, 'code', upper(unnest(regexp_extract_all(t, '(?i)(?:CPT|HCPCS)\\s*(?:code\\s*)?(\\d{{5}}|[A-Z]\\d{{4}})', 1))) FROM {_STATED}
  UNION ALL SELECT review_id, 'code', w FROM (SELECT review_id, regexp_replace(unnest(regexp_split_to_array(t, '{_CODE_SPLIT}')), '[.,]+$', '') AS w FROM {_STATED}) WHERE regexp_full_match(w, '\\d{{5}}')) WHERE value IS NOT NULL""",
    "history_finances": f"SELECT conv, turn, {_LAST(_SIZE)} AS household, {_LAST(_INCOME)} AS income FROM {answers._TURNS}",
    "agent_prompts": f"""SELECT case_id, bill_doc_file, CASE WHEN up IS NULL THEN p WHEN f <> '' AND contains(p, f) THEN replace(p, f, up) WHEN starts_with(p, '[Patient uploads bill:') AND contains(p, ']') THEN '[Patient uploads bill: ' || up || ']' || p[strpos(p, ']') + 1:] ELSE 'I uploaded "' || up || '". ' || p END AS prompt
  FROM (SELECT case_id, bill_doc_file, {_N('patient_input')} AS p, {_N('bill_doc_file')} AS f, CASE WHEN modality <> 'text' THEN 'upload_' || coalesce(case_id, 'x') || '.pdf' END AS up FROM cases)""",
    "case_selection": f"SELECT DISTINCT case_id, category, input_format FROM cases WHERE lower({_N('category')}) = 'financial assistance' AND lower({_N('input_format')}) = 'text' ORDER BY case_id NULLS FIRST, category, input_format LIMIT 50",
    "clean_answers": f"SELECT review_id, regexp_replace(regexp_replace(coalesce(agent_initial_response, '') || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || '- **Payment Due Date:** soon, a sensitive identifier', '\\n{{3,}}', chr(10) || chr(10), 'g'), '^ +| +$', '', 'g') AS cleaned FROM {_R}",
    "ocr_rows": f"SELECT page, (dense_rank() OVER (PARTITION BY page ORDER BY line) - 1)::BIGINT AS line, text FROM (SELECT page, line, string_agg(text, ' ' ORDER BY left_pos) AS text FROM {answers._WORDS} GROUP BY 1, 2)",
    "variant_outcomes": f"""WITH r AS (SELECT modality AS variant, CASE WHEN regexp_matches({_N('groundedness_score_0_1')}, {quality_plans._NUM}) THEN try_cast({_N('groundedness_score_0_1')} AS DOUBLE) END AS recall, lower({_N('groundedness_score_0_1')}) IN ('', 'n/a', 'na', 'none', 'null') AS blank FROM {_R})
  SELECT v AS variant, count(recall) AS n_ok, count(*) FILTER (variant IS NOT NULL AND recall IS NULL AND NOT blank) AS n_rejected, count(*) FILTER (variant IS NOT NULL AND recall IS NULL AND blank) AS n_error, round(avg(recall::DECIMAL(9,4))::DOUBLE, 4) AS recall FROM (VALUES ('pdf'), ('photo'), ('text'), ('fax')) l(v) LEFT JOIN r ON variant = v GROUP BY 1""",
    "missing_columns": "SELECT 'error' AS severity, 'missing_column' AS rule, '' AS row_id, c AS \"column\", '' AS detail FROM (VALUES ('no_such_column'), ('loaded_at')) v(c)",
    "report_markdown": f"""WITH r AS ({quality_plans.SQL['validation_report']}), b AS (SELECT row_number() OVER (ORDER BY severity, rule, n, n_rows) + 4 AS line_no, '| ' || severity || ' | ' || rule || ' | ' || n || ' | ' || n_rows || ' |' AS line FROM r)
  SELECT * FROM b UNION ALL SELECT * FROM (VALUES (1::BIGINT, '# Validation'), (2, ''), (3, '| severity | rule | n | n_rows |'), (4, '|-|-|-|-|')) v(line_no, line)""",
    "planted_violations": _planted_sql(),
    "provenance_warnings": f"""WITH c AS ({ledger_plans.SQL['ledger_consistency']}), t AS (SELECT bill_id, total_amount_due AS due, summary_of_services.totals AS s FROM {BILLS})
  SELECT t.bill_id, array_to_string(list_sort(list_filter([CASE WHEN NOT c.consistent THEN 'fails_total_reconciliation' END, CASE WHEN least(due, s.total_billed, s.total_insurance_payments, s.total_adjustments, s.outstanding_balance, s.patient_balance) < 0 THEN 'negative_total' END,
    CASE WHEN due IS NULL OR s.total_billed IS NULL OR s.total_insurance_payments IS NULL OR s.total_adjustments IS NULL OR s.outstanding_balance IS NULL OR s.patient_balance IS NULL THEN 'missing_total' END, CASE WHEN t.bill_id NOT IN (SELECT bill_id FROM {LINES}) THEN 'no_line_items' END], lambda x: x IS NOT NULL)), ', ') AS warnings
  FROM t LEFT JOIN c USING (bill_id)""",
    "payload_paths": """WITH j AS MATERIALIZED (SELECT feed, file_no, record_id, x.id, x.parent, x.type, x.fullkey FROM raw_records, json_tree(CASE WHEN json_valid(payload) THEN payload END) AS x WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  k AS (SELECT j.*, u.type AS above, EXISTS (SELECT 1 FROM j AS e WHERE e.record_id = j.record_id AND e.parent = j.id AND e.type = 'OBJECT') AS has_objects FROM j LEFT JOIN j AS u ON u.record_id = j.record_id AND u.id = j.parent)
  SELECT feed, file_no, regexp_replace(replace(fullkey[3:], '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' WHEN type = 'NULL' THEN NULL ELSE lower(type) END AS kind, count(*) AS n
  FROM k WHERE type <> 'OBJECT' AND NOT has_objects AND coalesce(above, 'OBJECT') = 'OBJECT' GROUP BY ALL""",
}
