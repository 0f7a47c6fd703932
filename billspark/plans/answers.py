"""Queries over answers and conversations: redaction, blocked terms, grounding, recall, history, transcript, word boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billspark.functions import columns as C
from billspark.operators import grounding, history, ledger, nested, ocrgrid, privacy
from billspark.plans.ledger import BILLS, LINES, bills
from billspark.plans.quality import _n
from billspark.session import spread, table


def _reviews(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nested.latest_delivery(table(spark, d, "reviews").select("review_id", "loaded_at", *columns), "review_id", "loaded_at").drop("loaded_at")


def redact_reviews(spark: SparkSession, d: str) -> DataFrame:
    t = _reviews(spark, d, "patient_input")
    return t.select("review_id", privacy.redact(F.col("patient_input")).alias("redacted"), privacy.has_identifiers(F.col("patient_input")).alias("has_identifiers"))


#: Texts with every kind of identifier, which the tables hold only in part.
NOTES = [
    (1, "My SSN is 123-45-6789, MRN: AB12345 and DOB 1/2/1980."), (2, "patient phone: (541) 555-0146, guarantor cell +1 541.555.0146"), (3, "Account # PA-2024-00001, guarantor account number GU-00321"), (4, '{"patient_name": "Ann Lee", "account_number" : "X1", "note": "date of birth is 1980-02-03"}'),
    (5, '{"guarantor_name":"Bo Ek","guarantor_account_number":"G-9","patient_account_number":""}'), (6, "a.b+c@mail.example or medical record number 00912345"), (7, "my account balance is $40"), (8, ""), (9, None), (10, "Is this charge valid? MRN 1234567"), (11, "[REDACTED:SSN] and MRN#12345"),
]


def redact_notes(spark: SparkSession, d: str) -> DataFrame:
    return privacy.filter_then_redact(spark.createDataFrame(NOTES, "note_id bigint, text string"), "note_id", "text")


def filter_then_redact(spark: SparkSession, d: str) -> DataFrame:
    """What patients write: stopped by the filter, or redacted."""
    return privacy.filter_then_redact(_reviews(spark, d, "patient_input"), "review_id", "patient_input")


def redact_bills(spark: SparkSession, d: str) -> DataFrame:
    """Bills with redacted texts at every depth: who they are for, and their notes."""
    b = bills(spark, d, "patient", "guarantor", "_note", "patient_services")
    r = b.select("bill_id", *[privacy.redact_nested(F.col(c), b.schema[c].dataType).alias(c) for c in ("patient", "guarantor", "_note", "patient_services")])
    return r.select("bill_id", "patient.patient_name", "patient.patient_account_number", "patient.service_date", "guarantor.guarantor_name", F.col("_note").alias("note"), "patient_services.mail")


def content_filter(spark: SparkSession, d: str) -> DataFrame:
    return privacy.blocked_terms(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _reviews(spark, d, "bill_doc_file", "patient_input", "patient_followup", "agent_initial_response", "agent_final_response")
    answer = F.coalesce(*[F.nullif(C.normalized(F.col(c)), F.lit("")) for c in ("agent_final_response", "agent_initial_response")])
    said = [F.when(~C.is_empty(F.col(c)), F.col(c)) for c in ("patient_input", "patient_followup")]
    t = r.select("review_id", F.col("bill_doc_file").alias("bill_file"), answer.alias("answer"), F.concat_ws(" ", *said).alias("said")).where("answer is not null")
    return t, grounding.claimed(t, "review_id", "answer", "bill_file")


def _ungrounded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, claims = _claims(spark, d)
    by_bill = grounding.known_of_bills(bills(spark, d, "bill_file", "summary_of_services", "total_amount_due"), "bill_file")
    rest = grounding.ungrounded(claims, by_bill, "bill_file")
    return t, grounding.ungrounded(rest, grounding.claimed(t, "review_id", "said"), "review_id").select("review_id", "kind", "value")


def grounding_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that neither the bill nor the conversation holds, with how often they are made."""
    return _ungrounded(spark, d)[1].groupBy("review_id", "kind", "value").agg(F.count("*").alias("n"))


def grounding_summary(spark: SparkSession, d: str) -> DataFrame:
    """Answers, grounded answers and ungrounded claims overall."""
    t, lost = _ungrounded(spark, d)
    per = lost.groupBy("review_id").agg(F.count_if(F.col("kind") == "amount").alias("amounts"), F.count_if(F.col("kind") == "code").alias("codes"))
    return t.select("review_id").join(per, "review_id", "left").agg(F.count("*").alias("answers"), F.count_if(F.col("amounts").isNull()).alias("grounded"), F.sum(F.coalesce("amounts", F.lit(0))).alias("amounts"), F.sum(F.coalesce("codes", F.lit(0))).alias("codes"))


VARIANTS = ["clean", "rotate", "blur", "jpeg"]


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return ledger.bill_lines(bills(spark, d, "summary_of_services")).select("bill_id", "item_no", "code", F.col("billed").alias("amount"))


def _parsed(gold: DataFrame, variant: Column) -> DataFrame:
    """Lines as a worse reading would give them: some are missing, some have another amount; variant 0 reads all."""
    kept = gold.where((variant == 0) | ((F.col("bill_id") + F.col("item_no") * 3 + variant) % 7 != 0))
    off = F.when((variant != 0) & ((F.col("bill_id") * 5 + F.col("item_no") + variant) % 11 == 0), 1).otherwise(0)
    return kept.withColumn("amount", (F.col("amount") + off).cast("decimal(18,2)"))


def line_recall(spark: SparkSession, d: str) -> DataFrame:
    g = _gold(spark, d)
    return grounding.line_recall(g, _parsed(g, F.lit(1)), "bill_id")


def variant_recall(spark: SparkSession, d: str) -> DataFrame:
    """Average recall of each way of reading, over the bills with lines; the ways are rows, read in one pass."""
    g = _gold(spark, d).withColumn("variant_no", F.explode(F.sequence(F.lit(0), F.lit(len(VARIANTS) - 1)))).withColumn("run", F.struct("variant_no", "bill_id"))
    r = grounding.line_recall(g, _parsed(g, F.col("variant_no")), "run")
    t = r.groupBy(F.col("run.variant_no").alias("i")).agg(F.count("*").alias("bills"), F.sum("n_matched").alias("matched"), F.round(F.avg(F.col("recall").cast("decimal(9,4)")).cast("double"), 4).alias("recall"))
    return t.select(F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("i") + 1).alias("variant"), "bills", "matched", "recall")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    r = _reviews(spark, d, "agent_initial_prompt", "agent_initial_response", "agent_followup_prompt", "agent_followup_response")
    turn = lambda n, role, c: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text"))
    t = F.array(turn(1, "user", "agent_initial_prompt"), turn(2, "assistant", "agent_initial_response"), turn(3, "user", "agent_followup_prompt"), turn(4, "assistant", "agent_followup_response"))
    return r.select(F.col("review_id").alias("conv"), F.inline(t)).where(C.normalized(F.col("text")) != "")


LAST = {"amount": r"\$([\d,]+(?:\.\d{2})?)", "statement": r"(?:statement|invoice)(?: no\.)? (\d{4}-\d{5})"}


def history_last_known(spark: SparkSession, d: str) -> DataFrame:
    return history.last_known(_turns(spark, d), LAST)


def latest_file_mention(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_mention(_turns(spark, d), r'"([^"\s]+\.pdf)"')


def sse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = _reviews(spark, d, "agent_final_response")
    return t.select("review_id", history.sse_decode(history.sse_encode(F.col("agent_final_response"))).alias("text"))


def tool_call_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Deltas made of events: the user is the response, the event id the order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("resp"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("tool_index"), F.when(F.col("value") >= 50, F.concat(F.lit("call_"), F.col("event_id").cast("string"))).alias("tool_id"), F.when(F.col("value") < 20, F.col("event_type")).alias("tool_name"), F.substring("event_type", 1, 2).alias("arguments"))
    return history.assemble_calls(e)


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", history.clean_text(F.col("text")).alias("cleaned"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The words of all documents as boxes of a page: where each stands on its line, and a confidence made of its places."""
    t = spread(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")).select("page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "l"))
    w = t.select("page", F.col("line").cast("bigint").alias("line"), F.posexplode(F.split("l", " ")).alias("word_no", "text"))
    before = Window.partitionBy("page", "line").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return w.select("page", "line", F.col("word_no").cast("bigint").alias("word_no"), "text", left.cast("bigint").alias("left_pos"), F.length("text").cast("bigint").alias("width"), (20 + (F.col("page") * 7 + F.col("line") * 3 + F.col("word_no")) % 80).cast("double").alias("conf"))


def ocr_gate(spark: SparkSession, d: str) -> DataFrame:
    return ocrgrid.gate(_words(spark, d))


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    return ocrgrid.lines(_words(spark, d))


def ocr_cells(spark: SparkSession, d: str) -> DataFrame:
    return ocrgrid.cells(_words(spark, d), ["statement", "date:", "pay", "by:", "due:", "due"], 2)


def row_islands(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("no"), (F.col("l_quantity") >= 25).alias("inside"))
    return ocrgrid.islands(li, "l_orderkey", "no", "inside", 2)


def agent_copy(spark: SparkSession, d: str) -> DataFrame:
    """Bills without the evaluator's keys, flat: the header of each."""
    b = nested.latest_delivery(table(spark, d, "bills"), "bill_id", "loaded_at")
    flat = nested.normalize(b.drop(*[c for c in b.columns if c.startswith("_")]), "bill_id")[""]
    return flat.select("bill_id", "bill_file", "facility_name", "patient_patient_name", "insurance_primary", F.col("total_amount_due").cast("double").alias("total_amount_due"))


QUERIES = {f.__name__: f for f in (redact_reviews, redact_notes, filter_then_redact, redact_bills, content_filter, grounding_claims, grounding_summary, line_recall, variant_recall, history_last_known, latest_file_mention, sse_roundtrip, tool_call_assembly, clean_texts, ocr_gate, ocr_lines, ocr_cells, row_islands, agent_copy)}

_R = "(SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC NULLS LAST) = 1)"


# The SQL's own wording of the shapes, apart from the operator's tables.
_IDENTIFIERS = [
    ("SSN", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b"), ("MRN", "\\b(mrn|medical record number)\\s*(is|=|:|#|-)?\\s*[a-z0-9-]{5,20}\\b"), ("DOB", "\\b(dob|date of birth)\\s*(is|=|:|#|-)?\\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\\b"),
    ("EMAIL", "[a-z0-9.%+_-]+@[a-z0-9.-]+[.][a-z]{2,}\\b"), ("PATIENT_PHONE", "\\b(patient|guarantor)\\s*(phone|telephone|mobile|cell)[:\\s#-]*([+]?1[-.\\s]?)?[(]?[0-9]{3}[)]?[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4}\\b"),
    ("PATIENT_ACCOUNT", "\\b(patient\\s*)?account(\\s*number|\\s*#)?[:\\s#-]*[a-z0-9-]{5,30}\\b"), ("GUARANTOR_ACCOUNT", "\\bguarantor\\s*(account\\s*)?(number|#)?[:\\s#-]*[a-z0-9-]{5,30}\\b"),
]


def _redact(c: str) -> str:
    for kind, p in _IDENTIFIERS:
        c = f"regexp_replace({c}, '{p}', '[REDACTED:{kind}]', 'gi')"
    for kind, p in (("JSON_PATIENT_NAME", "(patient|guarantor)_name"), ("JSON_ACCOUNT_NUMBER", "((?:patient_|guarantor_)?account_number)")):
        c = f"regexp_replace({c}, '(\"{p.replace('(', '(?:', 1)}\"\\s*:\\s*\")[^\"]+\"', '\\1[REDACTED:{kind}]\"', 'gi')"
    return c


def _quoted(t: str | None) -> str:
    return "NULL" if t is None else "'" + t.replace("'", "''") + "'"


_STOPPED = "NOT (" + " OR ".join(f"contains(lower(coalesce(text, '')), '{t}')" for t in privacy.BLOCKED_TERMS) + ")"
_EMPTY = "('', 'n/a', 'na', 'none', 'null')"
_T = f"""t AS (SELECT review_id, bill_doc_file AS bill_file, coalesce(nullif({_n('agent_final_response')}, ''), nullif({_n('agent_initial_response')}, '')) AS answer,
  concat_ws(' ', CASE WHEN lower({_n('patient_input')}) NOT IN {_EMPTY} THEN patient_input END, CASE WHEN lower({_n('patient_followup')}) NOT IN {_EMPTY} THEN patient_followup END) AS said FROM {_R} WHERE coalesce(nullif({_n('agent_final_response')}, ''), nullif({_n('agent_initial_response')}, '')) IS NOT NULL)"""


def _claimed(c: str) -> str:
    return f"""SELECT review_id, 'amount' AS kind, CAST(try_cast(replace(unnest(regexp_extract_all({c}, '\\$\\s*([\\d,]+(?:\\.\\d{{2}})?)', 1)), ',', '') AS DECIMAL(18,2)) * 100 AS BIGINT)::VARCHAR AS value FROM t
  UNION ALL SELECT review_id, 'code', unnest(regexp_extract_all({c}, '(?:CPT|HCPCS)\\s*(?:code\\s*)?(\\d{{5}}|[A-Z]\\d{{4}})', 1)) FROM t"""


_STATED = ["total_amount_due", *(f"summary_of_services.totals.{f}" for f in ("total_billed", "total_insurance_payments", "total_adjustments", "outstanding_balance", "patient_balance"))]
_LOST = f"""WITH {_T}, c AS (SELECT * FROM ({_claimed("answer")}) WHERE value IS NOT NULL), s AS (SELECT * FROM ({_claimed("said")}) WHERE value IS NOT NULL), b AS (SELECT * FROM {BILLS}),
  li AS (SELECT bill_file, l.* FROM b JOIN {LINES} l USING (bill_id)),
  k AS ({" UNION ALL ".join([*(f"SELECT bill_file, 'amount' AS kind, CAST({c} * 100 AS BIGINT) AS cents, NULL AS code FROM b WHERE {c} IS NOT NULL" for c in _STATED), *(f"SELECT bill_file, 'amount', CAST({c} * 100 AS BIGINT), NULL FROM li WHERE {c} IS NOT NULL" for c in ledger.FOUR), "SELECT bill_file, 'code', NULL, trim(code) FROM li WHERE code IS NOT NULL"])}),
  kb AS (SELECT DISTINCT bill_file, kind, CASE WHEN kind = 'amount' THEN (cents + i)::VARCHAR ELSE code END AS value FROM k, (VALUES (-1), (0), (1)) v(i)),
  ks AS (SELECT DISTINCT review_id, kind, CASE WHEN kind = 'amount' THEN (CASE WHEN kind = 'amount' THEN value END::BIGINT + i)::VARCHAR ELSE value END AS value FROM s, (VALUES (-1), (0), (1)) v(i)),
  lost AS (SELECT c.* FROM c JOIN t USING (review_id) WHERE NOT EXISTS (SELECT 1 FROM kb WHERE kb.bill_file = t.bill_file AND kb.kind = c.kind AND kb.value = c.value) AND NOT EXISTS (SELECT 1 FROM ks WHERE ks.review_id = c.review_id AND ks.kind = c.kind AND ks.value = c.value))"""


def _recall(i: int) -> str:
    where = f"WHERE (bill_id + item_no * 3 + {i}) % 7 <> 0" if i else ""
    off = f"CASE WHEN (bill_id * 5 + item_no + {i}) % 11 = 0 THEN 1 ELSE 0 END" if i else "0"
    return f"""(SELECT bill_id, count(*) AS n_gold, count(*) FILTER (equal) AS n_matched, count(*) FILTER (found AND NOT equal) AS n_mismatched, count(*) FILTER (NOT found) AS n_missing, round(count(*) FILTER (equal) / count(*), 4) AS recall
  FROM (SELECT g.bill_id, g.item_no, bool_or(p.billed IS NOT NULL) AS found, bool_or(coalesce(abs(g.billed - p.billed) <= 0.01, false)) AS equal FROM {LINES} g LEFT JOIN (SELECT bill_id, upper(trim(code)) AS code, billed + {off} AS billed FROM {LINES} {where}) p ON p.bill_id = g.bill_id AND p.code = upper(trim(g.code)) GROUP BY 1, 2) GROUP BY 1)"""


_TURNS = f"(SELECT * FROM ({' UNION ALL '.join(f'SELECT review_id AS conv, {i} AS turn, {chr(39)}{r}{chr(39)} AS role, {c} AS text FROM {_R}' for i, r, c in ((1, 'user', 'agent_initial_prompt'), (2, 'assistant', 'agent_initial_response'), (3, 'user', 'agent_followup_prompt'), (4, 'assistant', 'agent_followup_response')))}) WHERE {_n('text')} <> '')"
_LINES = "(SELECT doc_id AS page, line, string_split(l, ' ') AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents))"
_WORDS = f"""(SELECT page, line, word_no, text, left_pos, length(text) AS width, (20 + (page * 7 + line * 3 + word_no) % 80)::DOUBLE AS conf FROM (
  SELECT page, line, word_no, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY page, line ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_pos FROM (SELECT page, line, unnest(range(0, len(w))) AS word_no, unnest(w) AS text FROM {_LINES})) WHERE trim(text) <> '')"""
_HEAD = "('statement', 'date:', 'pay', 'by:', 'due:', 'due')"
SQL = {
    "redact_reviews": f"SELECT review_id, {_redact('patient_input')} AS redacted, coalesce({_redact('patient_input')} <> patient_input, false) AS has_identifiers FROM {_R}",
    "redact_notes": f"SELECT note_id, {_STOPPED} AS allowed, CASE WHEN {_STOPPED} THEN {_redact('text')} END AS text FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_quoted(t)})" for i, t in NOTES) + ") v(note_id, text)",
    "filter_then_redact": f"SELECT review_id, {_STOPPED} AS allowed, CASE WHEN {_STOPPED} THEN {_redact('text')} END AS patient_input FROM (SELECT review_id, patient_input AS text FROM {_R})",
    "redact_bills": f"""SELECT bill_id, CASE WHEN patient.patient_name IS NOT NULL THEN '[REDACTED:PATIENT_NAME]' END AS patient_name, CASE WHEN patient.patient_account_number IS NOT NULL THEN '[REDACTED:PATIENT_ACCOUNT_NUMBER]' END AS patient_account_number,
  patient.service_date AS service_date, CASE WHEN guarantor.guarantor_name IS NOT NULL THEN '[REDACTED:GUARANTOR_NAME]' END AS guarantor_name, {_redact('_note')} AS note, {_redact('patient_services.mail')} AS mail FROM {BILLS}""",
    "content_filter": " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term FROM documents WHERE contains(lower(text), '{t}')" for t in privacy.BLOCKED_TERMS),
    "grounding_claims": f"{_LOST} SELECT review_id, kind, value, count(*) AS n FROM lost GROUP BY ALL",
    "grounding_summary": f"{_LOST} SELECT count(*) AS answers, count(*) FILTER (a IS NULL) AS grounded, sum(coalesce(a, 0))::BIGINT AS amounts, sum(coalesce(d, 0))::BIGINT AS codes FROM t LEFT JOIN (SELECT review_id, count(*) FILTER (kind = 'amount') AS a, count(*) FILTER (kind = 'code') AS d FROM lost GROUP BY 1) USING (review_id)",
    "line_recall": f"SELECT * FROM {_recall(1)}",
    "variant_recall": " UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) AS bills, sum(n_matched)::BIGINT AS matched, round(avg(recall::DECIMAL(9,4))::DOUBLE, 4) AS recall FROM {_recall(i)}" for i, v in enumerate(VARIANTS)),
    "history_last_known": "SELECT conv, turn, " + ", ".join(f"last_value(CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '{p}', 1), '') END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY turn ROWS UNBOUNDED PRECEDING) AS {k}" for k, p in LAST.items()) + f" FROM {_TURNS}",
    "latest_file_mention": f"""SELECT conv, arg_max(m[len(m)], turn) AS file FROM (SELECT conv, turn, regexp_extract_all(text, '"([^"\\s]+\\.pdf)"', 1) AS m FROM {_TURNS}) WHERE len(m) > 0 GROUP BY 1""",
    "sse_roundtrip": f"SELECT review_id, coalesce(agent_final_response, '') AS text FROM {_R}",
    "tool_call_assembly": """SELECT resp, tool_index, arg_max(tool_id, seq) FILTER (tool_id IS NOT NULL) AS tool_id, arg_max(tool_name, seq) FILTER (tool_name IS NOT NULL) AS tool_name, string_agg(arguments, '' ORDER BY seq) AS arguments
  FROM (SELECT user_id AS resp, event_id AS seq, event_id % 3 AS tool_index, CASE WHEN value >= 50 THEN 'call_' || event_id END AS tool_id, CASE WHEN value < 20 THEN event_type END AS tool_name, left(event_type, 2) AS arguments FROM events) GROUP BY 1, 2""",
    "clean_texts": "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '**', ''), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM documents",
    "ocr_gate": f"SELECT page, mean_conf, n_words, mean_conf >= 45 AND n_words >= 30 AS passes FROM (SELECT page, round(avg(conf::DECIMAL(9,4))::DOUBLE, 4) AS mean_conf, count(*) AS n_words FROM {_WORDS} GROUP BY 1)",
    "ocr_lines": f"SELECT page, line, string_agg(text, ' ' ORDER BY left_pos) AS text FROM {_WORDS} GROUP BY 1, 2",
    "ocr_cells": f"""WITH w AS (SELECT *, left_pos + width / 2 AS centre FROM {_WORDS}), f AS (SELECT page, line, list(centre ORDER BY centre) FILTER (lower(text) IN {_HEAD}) AS anchors FROM w GROUP BY 1, 2 HAVING count(*) FILTER (lower(text) IN {_HEAD}) >= 2), h AS (SELECT page, min(line) AS head_line, arg_min(anchors, line) AS anchors FROM f GROUP BY 1),
  a AS (SELECT w.*, i, abs(anchors[i] - centre) AS dist FROM w JOIN h USING (page), unnest(range(1, 50)) r(i) WHERE line > head_line AND i <= len(anchors)), n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page, line, word_no ORDER BY dist, i) = 1)
  SELECT page, line, i AS column_no, string_agg(text, ' ' ORDER BY left_pos) AS text FROM n GROUP BY 1, 2, 3""",
    "row_islands": "SELECT l_orderkey, min(no) AS start, max(no) AS stop, count(*) AS length FROM (SELECT l_orderkey, l_linenumber::BIGINT AS no, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM lineitem WHERE l_quantity >= 25) GROUP BY l_orderkey, g HAVING count(*) >= 2",
    "agent_copy": f"SELECT bill_id, bill_file, facility.name AS facility_name, patient.patient_name AS patient_patient_name, insurance.primary AS insurance_primary, total_amount_due::DOUBLE AS total_amount_due FROM {BILLS}",
}
