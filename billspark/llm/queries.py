"""Queries of the training-data operators on text, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.llm import leakage, lookalike, pairs, pii, tokenizer, truncation
from billspark.session import spread, table


PAIR_FIELDS = ("agent_initial_prompt", "agent_initial_response", "agent_followup_prompt", "agent_followup_response")


def _stored_texts(reviews: DataFrame) -> DataFrame:
    """The two stored answers, each with the field that may hold the same text whole."""
    follow = F.col("agent_followup_response")
    taken = F.when(truncation.is_placeholder(F.coalesce(follow, F.lit(""))), F.col("agent_initial_response")).otherwise(follow)
    prompt = F.concat_ws(" ", "agent_initial_prompt", "agent_followup_prompt")
    entry = lambda c, sibling: F.struct(F.lit(c).alias("field"), F.col(c).alias("text"), sibling.alias("sibling"), prompt.alias("prompt"))
    texts = F.inline(F.array(entry("agent_final_response", taken), entry("agent_followup_response", F.col("agent_final_response"))))
    return reviews.select(F.col("review_id").alias("id"), F.col("run_file").alias("source"), texts)


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_posterior(_stored_texts(spread(table(spark, d, "reviews").select("review_id", "run_file", *PAIR_FIELDS, "agent_final_response"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_texts(spark, d).where("p_cut > 0.5").select(F.col("id").alias("review_id"), F.col("field").alias("field_name")).distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts, by field: texts, cut ones and their share, each review counted once."""
    t = p1_texts(spark, d).where("len > 0").groupBy("id", "source", "field").agg(F.max("p_cut").alias("p"))
    return t.groupBy("source", "field").agg(F.count("*").alias("texts"), F.count_if(F.col("p") > 0.5).alias("cut"), F.round(F.avg((F.col("p") > 0.5).cast("int")), 4).alias("cut_rate"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    reviews = spread(table(spark, d, "reviews").select("review_id", "run_file", *PAIR_FIELDS, "agent_final_response"))
    final, follow = F.col("agent_final_response"), F.col("agent_followup_response")
    no_follow = truncation.is_placeholder(F.coalesce(follow, F.lit("")))
    entry = lambda name, text, sibling, prompt: F.struct(F.lit(name).alias("field"), text.alias("text"), sibling.alias("sibling"), F.col(prompt).alias("prompt"))
    both = F.inline(F.array(entry("initial", F.col("agent_initial_response"), F.when(no_follow, final), "agent_initial_prompt"), entry("followup", follow, final, "agent_followup_prompt")))
    found = pairs.broken_pairs(reviews.select(F.col("review_id").alias("id"), F.col("run_file").alias("source"), both))
    return found.withColumnRenamed("id", "review_id")


def p4_defects(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("pair_name", "defect").agg(F.count("*").alias("pairs"))


#: Bound of the facility directory that the driver reads for p5.
MAX_FACILITIES = 100_000


def pii_context(spark: SparkSession, d: str) -> tuple[pii.Facilities, DataFrame]:
    """Facilities and the name lexicon of the bills. Each facility is one row, whatever the number of its bills."""
    bills = table(spark, d, "bills")
    rows = bills.select("facility.name", "facility.address", "patient_services.phone", "patient_services.online", "patient_services.mail").distinct().limit(MAX_FACILITIES + 1).collect()
    if len(rows) > MAX_FACILITIES:
        raise ValueError(f"more than {MAX_FACILITIES} facilities")
    names = bills.select(F.explode(F.array("patient.patient_name", "guarantor.guarantor_name")).alias("name")).distinct()
    return pii.Facilities.of(rows), pii.lexicon_of(names, "name")


PII_FIELDS = ("patient_input", "agent_initial_response")


def _found_places(spark: SparkSession, d: str, masked: bool = False) -> DataFrame:
    """Places by the names of the bills and those that the texts tell; insurers' words are none."""
    facilities, lexicon = pii_context(spark, d)
    reviews = spread(table(spark, d, "reviews").select("review_id", *PII_FIELDS))
    insurers = table(spark, d, "bills").select(F.explode(F.array("insurance.primary", "insurance.secondary")).alias("name")).select(F.explode(F.split(F.lower("name"), r"[^\p{L}'’-]+")).alias("word"))
    learnt = pii.corpus_names(reviews, PII_FIELDS, facilities, insurers)
    return pii.find_places(reviews, PII_FIELDS, facilities, pii.merged_lexicon(lexicon, learnt), carry=["review_id"], masked=masked)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    places = _found_places(spark, d)

    def named(c: str):
        return lambda x: F.struct(F.lit(c).alias("field_name"), x["kind"].alias("pii_kind"))

    kinds = F.concat(*[F.array_distinct(F.transform(f"{c}_places", named(c))) for c in PII_FIELDS])
    return places.select("review_id", F.explode(kinds).alias("x")).select("review_id", "x.field_name", "x.pii_kind").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders, one row per review."""
    out = _found_places(spark, d, masked=True)
    return out.groupBy("review_id").agg(*[F.max(f"{c}_masked").alias(c) for c in PII_FIELDS])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items, with the number of documents that leak each."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words_kept").alias("most_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document that has a look-alike: its class, the copies of its text and the different texts of the class."""
    return lookalike.lookalike_classes(spread(table(spark, d, "documents").select("doc_id", "text")))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p4_found": p4_found, "p4_defects": p4_defects, "p5_found": p5_found, "p5_masked": p5_masked, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_classes": p8_classes}

# Fixed values of the SQL, apart from the operator's tables: what can't be seen, spaces, and letters by their look.
_UNSEEN = "[\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
_SPACES = "[\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
_LOOKS = "‐‑ёЁїЇаеорсухѕіјһԁԛԝАВЕЅІЈКМНОРСТУХοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_LATIN = "--ëËïÏaeopcyxsijhdqwABESIJKMHOPCTYXoABEZHIKMNOPTYX" + "".join(map(chr, range(0x21, 0x7F)))
_LIGATURES = [("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")]


def _form_sql() -> str:
    seen = f"regexp_replace(regexp_replace(text, '{_UNSEEN}', '', 'g'), '{_SPACES}', ' ', 'g')"
    for a, b in _LIGATURES:
        seen = f"replace({seen}, '{a}', '{b}')"
    quoted = [x.replace("'", "''") for x in (_LOOKS, _LATIN)]
    return f"SELECT doc_id, text, nfc_normalize(translate({seen}, '{quoted[0]}', '{quoted[1]}')) AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"


SQL: dict[str, str] = {
    "p8_found": f"WITH f AS ({_form_sql()}) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text != b.text",
    "p8_classes": f"""WITH f AS ({_form_sql()}), t AS (SELECT form, text, count(DISTINCT doc_id) AS copies, min(doc_id) AS first FROM f GROUP BY ALL),
      l AS (SELECT form, min(first) AS class_id, count(*) AS texts FROM t GROUP BY form HAVING count(*) > 1)
      SELECT doc_id, min(class_id) AS class_id, max(copies) AS copies, max(texts) AS texts FROM f JOIN t USING (form, text) JOIN l USING (form) GROUP BY doc_id""",
}
