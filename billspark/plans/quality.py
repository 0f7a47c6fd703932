"""Queries of validation, coverage and scorecards over the cases and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.operators import nested, quality
from billspark.session import table


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases")


def _reviews(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nested.latest_delivery(table(spark, d, "reviews").select("review_id", "loaded_at", *columns), "review_id", "loaded_at")


def validate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_ids(_cases(spark, d))


def validate_required(spark: SparkSession, d: str) -> DataFrame:
    return quality.blank_required(_cases(spark, d))


def validate_vocab(spark: SparkSession, d: str) -> DataFrame:
    return quality.outside_vocabulary(_cases(spark, d))


def validate_safety(spark: SparkSession, d: str) -> DataFrame:
    return quality.blank_safety(_cases(spark, d))


def validate_flags(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d)
    return quality.unclear_flags(c).unionByName(quality.no_flag_set(c))


def validate_refs(spark: SparkSession, d: str) -> DataFrame:
    return quality.unknown_reference(_cases(spark, d), table(spark, d, "bills"), "bill_doc_file", "bill_file", "unknown_bill")


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations by rule and severity."""
    every = quality.violations_in_one_pass(_cases(spark, d)).unionByName(validate_duplicates(spark, d)).unionByName(validate_refs(spark, d))
    return every.groupBy("severity", "rule").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_rows"))


def case_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return quality.frequencies(_cases(spark, d), ["category", "document_type", "input_format", "insurance_type", "modality", "scenario", "payer", "plan_type"])


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.true_flags(_cases(spark, d))


def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(_cases(spark, d))


SCORES = ["semantic_correctness_pass", "groundedness_score_0_1", "required_coverage_score_0_1", "hallucination_present", "correct_refusal_present", "over_refusal_present", "text_differentiation_score_1_5", "safety_constraint_pass", "overall_pass"]


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return quality.scorecard(_reviews(spark, d, *SCORES))


def scorecard_by_group(spark: SparkSession, d: str) -> DataFrame:
    return quality.scorecard(_reviews(spark, d, "category", *SCORES), ["category"])


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Cases without a review yet."""
    return _cases(spark, d).join(table(spark, d, "reviews").select("case_id").distinct(), "case_id", "left_anti").select("case_id").distinct()


def case_bill_join(spark: SparkSession, d: str) -> DataFrame:
    """Each case with the amount of its bill; a case without a bill keeps a null amount."""
    b = nested.latest_delivery(table(spark, d, "bills").select("bill_id", "loaded_at", "bill_file", "total_amount_due"), "bill_id", "loaded_at")
    due = b.groupBy("bill_file").agg(F.max("total_amount_due").alias("due"))
    return _cases(spark, d).select("case_id", F.col("bill_doc_file").alias("bill_file")).join(due, "bill_file", "left").select("case_id", "bill_file", F.col("due").cast("double").alias("due"))


def priority_merge(spark: SparkSession, d: str) -> DataFrame:
    """A hundred cases: those of safety first, then photographs, then the rest, by id."""
    c = _cases(spark, d).select("case_id", "category", "modality").where("case_id is not null").distinct()
    safety, photo = F.coalesce(F.col("category") == "Safety", F.lit(False)), F.coalesce(F.col("modality") == "photo", F.lit(False))
    rest = c.where(~safety & ~photo)
    t = quality.priority_merge([c.where(safety), c.where(~safety & photo), rest], "case_id", 100)
    return t.groupBy("source_no").agg(F.count("*").alias("n"), F.min("case_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (validate_duplicates, validate_required, validate_vocab, validate_safety, validate_flags, validate_refs, validation_report, case_frequencies, flag_counts, coverage_matrix, scorecard, scorecard_by_group, resume_antijoin, case_bill_join, priority_merge)}

_WS = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{1C}-\x{1F}\x{85}]"


def _n(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _v(severity: str, rule: str, column: str, detail: str, frm: str) -> str:
    return f"SELECT {severity} AS severity, '{rule}' AS rule, coalesce(case_id, '') AS row_id, {column} AS \"column\", {detail} AS detail FROM {frm}"


_NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _score(c: str) -> str:
    return f"CASE WHEN regexp_matches({_n(c)}, {_NUM}) THEN CAST(try_cast({_n(c)} AS DOUBLE) AS DECIMAL(18,6)) END"


def _flag(c: str) -> str:
    return f"CASE WHEN lower({_n(c)}) IN ('true','yes','y','1','pass','passed') THEN 1.0 WHEN lower({_n(c)}) IN ('false','no','n','0','fail','failed') THEN 0.0 END"


_METRICS = {"semantic_correctness_rate": _flag("semantic_correctness_pass"), "groundedness_average": _score("groundedness_score_0_1"), "required_coverage_average": _score("required_coverage_score_0_1"), "hallucination_rate": _flag("hallucination_present"), "correct_refusal_rate": _flag("correct_refusal_present"), "over_refusal_rate": _flag("over_refusal_present"), "text_differentiation_average": _score("text_differentiation_score_1_5"), "safety_constraint_pass_rate": _flag("safety_constraint_pass"), "overall_pass_rate": _flag("overall_pass")}
_LATEST = "(SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC NULLS LAST) = 1)"


def _card(by: str) -> str:
    g = f"{by}, " if by else ""
    parts = [f"SELECT {g}'{m}' AS metric, {c} AS x, {quality.TARGETS.get(m, 'NULL')}::DOUBLE AS target FROM {_LATEST}" for m, c in _METRICS.items()]
    cmp = "CASE WHEN metric = 'hallucination_rate' THEN value <= target ELSE value >= target END"
    return f"SELECT {g}metric, value, target, {cmp} AS passed, n FROM (SELECT {g}metric, round(sum(x)::DOUBLE / nullif(count(x), 0), 4) AS value, any_value(target) AS target, count(x) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY {g}metric)"


_RULES = {
    "validate_duplicates": _v("'error'", "repeated_id", "'case_id'", "'rows: ' || n", "(SELECT case_id, count(*) AS n FROM cases GROUP BY 1 HAVING count(*) > 1)"),
    "validate_required": " UNION ALL ".join(_v("'error'", "blank_required", f"'{c}'", "''", f"cases WHERE {_n(c)} = ''") for c in quality.REQUIRED),
    "validate_vocab": " UNION ALL ".join(_v("'error'", "outside_vocabulary", f"'{c}'", c, f"cases WHERE {_n(c)} <> '' AND {_n(c)} NOT IN ({_list(v)})") for c, v in quality.VOCABULARIES.items()),
    "validate_safety": _v(f"CASE WHEN coalesce(category, '') = 'Safety' OR regexp_matches(concat_ws(' ', category, scenario, patient_input, patient_followup, expected_next_steps), '{quality.SAFETY_WORDS}') THEN 'error' ELSE 'warning' END", "blank_safety", "'safety_constraint'", "''", f"cases WHERE lower({_n('safety_constraint')}) IN ('', 'n/a', 'na', 'none', 'null')"),
    "validate_flags": " UNION ALL ".join([*(_v("'error'", "unclear_flag", f"'{f}'", f"coalesce({f}, '')", f"cases WHERE lower({_n(f)}) NOT IN ('true', 'false')") for f in quality.FLAGS), _v("'warning'", "no_flag_set", "''", "''", "cases WHERE " + " AND ".join(f"lower({_n(f)}) = 'false'" for f in quality.FLAGS))]),
    "validate_refs": _v("'warning'", "unknown_bill", "'bill_doc_file'", "trim(bill_doc_file)", f"cases WHERE lower({_n('bill_doc_file')}) NOT IN ('', 'n/a', 'na', 'none', 'null') AND trim(bill_doc_file) NOT IN (SELECT trim(bill_file) FROM bills WHERE bill_file IS NOT NULL)"),
}
_FREQ = ["category", "document_type", "input_format", "insurance_type", "modality", "scenario", "payer", "plan_type"]
SQL = _RULES | {
    "validation_report": f"SELECT severity, rule, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM ({' UNION ALL '.join(_RULES.values())}) GROUP BY ALL",
    "case_frequencies": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce({c}, '') AS value, count(*) AS n FROM cases GROUP BY coalesce({c}, '')" for c in _FREQ),
    "flag_counts": " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (lower({_n(f)}) = 'true') AS n_true FROM cases" for f in quality.FLAGS),
    "coverage_matrix": "SELECT modality, scenario, " + ", ".join(f"count(*) FILTER (payer = '{p}') AS {p.lower().replace(' ', '_')}" for p in quality.VOCABULARIES["payer"]) + ", count(*) AS total FROM cases GROUP BY 1, 2",
    "scorecard": _card(""),
    "scorecard_by_group": _card("category"),
    "resume_antijoin": "SELECT DISTINCT case_id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.case_id = c.case_id)",
    "case_bill_join": "SELECT case_id, bill_doc_file AS bill_file, due FROM cases LEFT JOIN (SELECT bill_file, max(total_amount_due)::DOUBLE AS due FROM (SELECT * FROM bills QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY loaded_at DESC NULLS LAST) = 1) GROUP BY 1) b ON bill_doc_file = b.bill_file",
    "priority_merge": """SELECT source_no, count(*) AS n, min(case_id) AS first_id FROM (SELECT *, CASE WHEN category = 'Safety' THEN 0 WHEN modality = 'photo' THEN 1 ELSE 2 END AS source_no FROM (SELECT DISTINCT case_id, category, modality FROM cases WHERE case_id IS NOT NULL) ORDER BY source_no, case_id LIMIT 100) GROUP BY 1""",
}
