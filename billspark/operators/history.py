"""Conversations as turns: values last stated, newest mention of a file, prompts and events of the transcript.

Turns are rows (conv, turn, role, text), ``turn`` ascending in time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billspark.functions import columns as C


def last_known(turns: DataFrame, values: Mapping[str, str | Callable[[Column], Column]], role: str = "user") -> DataFrame:
    """Per turn the value that the role stated last, this turn included; fields apart.

    A value is the first group of a pattern, or what a function makes of the text; null and blank ones state nothing.
    """
    w = Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = {k: v(F.col("text")) if callable(v) else F.nullif(F.regexp_extract("text", v, 1), F.lit("")) for k, v in values.items()}
    return turns.select("conv", "turn", *[F.last(F.when(F.col("role") == role, c), ignorenulls=True).over(w).alias(k) for k, c in said.items()])


def prompt_for_row(prompt: Column, bill_file: Column, uploaded: Column) -> Column:
    """The prompt with the name that a bill was uploaded under: in place of the file's own name, within the mark of an
    upload at its beginning, or before it. Without an upload the prompt as it is, trimmed; null counts as blank."""
    p, own = C.normalized(prompt), C.normalized(bill_file)
    marked = F.regexp_replace(p, r"^\[Patient uploads bill:[^\]]*\]", "")
    return (
        F.when(uploaded.isNull(), p)
        .when((own != "") & F.contains(p, own), F.replace(p, own, uploaded))
        .when(p.startswith("[Patient uploads bill:") & F.contains(p, F.lit("]")), F.concat(F.lit("[Patient uploads bill: "), uploaded, F.lit("]"), marked))
        .otherwise(F.concat(F.lit('I uploaded "'), uploaded, F.lit('". '), p))
    )


def latest_mention(turns: DataFrame, pattern: str, name: str = "file") -> DataFrame:
    """(conv, file): the last match in the newest turn that has one, whoever wrote it; by aggregate, no window."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))
    t = turns.select("conv", "turn", F.try_element_at(found, F.lit(-1)).alias("m")).where("m is not null")
    return t.groupBy("conv").agg(F.max_by("m", "turn").alias(name))


def sse_encode(text: Column) -> Column:
    """The server-sent events of an answer: one data line of JSON and the closing mark."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text"))), F.lit("\n\ndata: [DONE]\n\n"))


def sse_decode(body: Column) -> Column:
    """The texts of the data lines up to the closing mark, joined; lines that are no JSON are skipped; null gives ''."""
    lines = F.transform(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: x.startswith("data: ")), lambda x: F.substring(x, 7, 2**31 - 1))
    done = F.array_position(F.transform(lines, lambda x: F.trim(x)), "[DONE]")
    kept = F.when(done > 0, F.slice(lines, F.lit(1), (done - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(F.transform(kept, lambda x: F.get_json_object(x, "$.text")), lambda x: x.isNotNull()), "")


def assemble_calls(deltas: DataFrame) -> DataFrame:
    """Tool calls of (resp, seq, tool_index, tool_id, tool_name, arguments): the last id and name, arguments joined in order."""
    g = deltas.where("tool_index is not null").groupBy("resp", "tool_index").agg(
        F.max_by("tool_id", F.when(F.coalesce("tool_id", F.lit("")) != "", F.col("seq"))).alias("tool_id"),
        F.max_by("tool_name", F.when(F.coalesce("tool_name", F.lit("")) != "", F.col("seq"))).alias("tool_name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))), lambda x: x["a"]), "").alias("arguments"),
    )
    return g


def clean_text(c: Column) -> Column:
    """Without bold marks, runs of blanks and of more than one blank line, and blanks at line ends."""
    c = F.regexp_replace(c, r"\*\*", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# Labels that an answer shows in bold, and what stands for a redacted value.
BOLD_LABELS = ["Primary Insurance", "Secondary Insurance", "Total Insurance Payments Shown", "Adjustments/Discounts", "Payment Balance", "Payment Due Date"]
REPLACED = {
    "PATIENT_ACCOUNT": "the patient account number shown on the bill", "JSON_ACCOUNT_NUMBER": "the account number shown on the bill", "GUARANTOR_ACCOUNT": "the guarantor account number shown on the bill", "PATIENT_NAME": "the patient name shown on the bill", "JSON_PATIENT_NAME": "the patient name shown on the bill",
    "MRN": "a sensitive identifier", "DOB": "a date of birth", "SSN": "an SSN", "EMAIL": "a private email address", "PATIENT_PHONE": "a private phone number",
}


def clean_answer(c: Column) -> Column:
    """An answer as a patient sees it: without notices about sensitive identifiers at its beginning and traces of
    function calls, placeholders in words, labels in bold, and no more than one blank line."""
    c = F.regexp_replace(c, r"(?i)^\s*(?:you do not need to|please do not) share sensitive identifiers such as [^.\n]*here\.\s*", "")
    c = F.regexp_replace(c, r"(?i)<function\.[^>]*>", "")
    c = F.regexp_replace(c, r"(?im)^[^\S\n]*(?:(?:also,\s*)?i will call the [^\n.]*function[^\n.]*|the [a-z_]+ function is [^\n.]*)\.?[^\S\n]*$", "")
    for kind, words in REPLACED.items():
        c = F.replace(c, F.lit(f"[REDACTED:{kind}]"), F.lit(words))
    c = F.regexp_replace(c, rf"(?m)^([^\S\n]*(?:[-*]\s*)?)({'|'.join(BOLD_LABELS)}):", "$1**$2:**")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def buffer_results(messages: DataFrame, role: str = "tool") -> DataFrame:
    """(conv, first_turn, role, texts): neighbouring messages of ``role`` as one, the others as they are."""
    w = Window.partitionBy("conv").orderBy("turn")
    t = messages.withColumn("_new", F.when((F.col("role") == role) & (F.lag("role").over(w) == role), 0).otherwise(1))
    t = t.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("conv", "_g").agg(F.min("turn").alias("first_turn"), F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    return g.select("conv", "first_turn", "role", F.transform("m", lambda x: x["text"]).alias("texts"))
