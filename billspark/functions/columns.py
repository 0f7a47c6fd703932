"""Scalar expressions on columns: text, amounts, dates, codes. All stay in the JVM.

Each takes null and gives null unless its docstring says otherwise; nothing raises on user text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as empty, true and false in the tables' string columns.
EMPTY_MARKERS = ["", "n/a", "na", "none", "null"]
TRUE_WORDS = ["true", "yes", "y", "1", "pass", "passed"]
FALSE_WORDS = ["false", "no", "n", "0", "fail", "failed"]

AMOUNT = r"\(?\s*\$?\s*[\d,]+\.\d{2}\s*\)?"


def normalized(c: Column) -> Column:
    """Without white space of any kind at the ends; null gives the empty string."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def is_empty(c: Column) -> Column:
    return F.lower(normalized(c)).isin(EMPTY_MARKERS)


def parse_bool(c: Column) -> Column:
    """True, false, or null for anything else."""
    v = F.lower(normalized(c))
    return F.when(v.isin(TRUE_WORDS), True).when(v.isin(FALSE_WORDS), False)


def parse_number(c: Column) -> Column:
    """A double, or null for blank and unparseable text; NaN and infinities are null."""
    v = normalized(c)
    return F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double"))


def parse_amount(c: Column) -> Column:
    """decimal(18,2) of ``$1,234.50``; parentheses make it negative; text that is no amount gives null."""
    v = F.trim(c)
    digits = F.regexp_replace(v, r"[$,()\s]", "")
    number = F.when(digits.rlike(r"^-?\d+(\.\d+)?$"), digits.try_cast("decimal(18,2)"))
    return F.when(v.startswith("(") & v.endswith(")"), -number).otherwise(number)


def normalize_date(c: Column) -> Column:
    """MM/DD/YYYY of a date with slashes or hyphens, year first or last; two-digit years under 50 are of this century.

    Not checked against the calendar; other text comes back unchanged.
    """
    v = F.trim(c)
    p = F.split(F.translate(v, "-", "/"), "/")
    year_first = v.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$")
    year_last = v.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$")
    y = F.try_element_at(p, F.lit(3))
    year = F.when(F.length(y) == 2, F.concat(F.when(y < "50", "20").otherwise("19"), y)).otherwise(y)
    two = lambda x: F.lpad(x, 2, "0")
    return (
        F.when(year_first, F.concat_ws("/", two(F.try_element_at(p, F.lit(2))), two(y), F.try_element_at(p, F.lit(1))))
        .when(year_last, F.concat_ws("/", two(F.try_element_at(p, F.lit(1))), two(F.try_element_at(p, F.lit(2))), year))
        .otherwise(v)
    )


def amounts_in(c: Column) -> Column:
    """Array of the raw amounts with cents in a text, in order, repeats kept; null gives the empty array."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({AMOUNT})"), F.lit(1)), lambda x: F.trim(x))


def tokens(c: Column) -> Column:
    """Words of letters a to z and digits that no other letter, digit or underscore touches, lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"((?<![\p{L}\p{N}_])[a-z0-9]++(?![\p{L}\p{N}_]))"), F.lit(1))


def code_tokens(c: Column) -> Column:
    """Candidate billing codes: runs of letters, digits, points and hyphens, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9A-Za-z_$][0-9A-Za-z_.$,/#-]*)"), F.lit(1))


def code_kind(c: Column) -> Column:
    """CPT, HCPCS or ICD-10 of a whole token, in this order of precedence; null if it is none."""
    return F.when(c.rlike(r"^\d{5}(-[A-Z0-9]{2})?$"), "CPT").when(c.rlike(r"^[A-Z]\d{4}$"), "HCPCS").when(c.rlike(r"^[A-Z]\d{2}(\.\d{1,4})?$"), "ICD-10")


def looks_like_id(c: Column) -> Column:
    """Whether a captured value may be an identifier: it holds a digit. Null is none."""
    return F.coalesce(c.rlike(r"\d"), F.lit(False))


def cents(c: Column) -> Column:
    """Whole cents of a decimal or of its text, halves away from zero; text that is no amount gives null."""
    return (F.round(c.try_cast("decimal(24,6)"), 2) * 100).cast("bigint")


def household_size(c: Column) -> Column:
    """Persons of a household that a text states: after the word, as a count of persons, or one who lives alone."""
    said = F.regexp_extract(c, r"(?i)\b(?:household|family)\s*(?:size|of)?\s*(?:is|:)?\s*(\d\d?)\b", 1)
    counted = F.regexp_extract(c, r"(?i)\b(\d\d?)\s+(?:people|persons?|members?|of us)\b", 1)
    alone = F.when(c.rlike(r"(?i)\b(?:just (?:me|myself)|(?:i )?live alone)\b"), 1)
    return F.coalesce(said.try_cast("int"), counted.try_cast("int"), alone)


def stated_income(c: Column) -> Column:
    """The first number within eighty characters after a word of earning, thousands after a k; decimal(18,2)."""
    found = r"(?i)\b(?:income|make|earn|salary)\b[^$\d]{0,80}\$?\s*(\d[\d,]*(?:\.\d\d)?)(k?)"
    number = F.replace(F.regexp_extract(c, found, 1), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    return F.when(F.lower(F.regexp_extract(c, found, 2)) == "k", (number * 1000).cast("decimal(18,2)")).otherwise(number)


def pipe_list(c: Column) -> Column:
    """Entries between pipes, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def money(c: Column) -> Column:
    """``$1,234.50``, negative amounts in parentheses."""
    shown = F.concat(F.lit("$"), F.format_number(F.abs(c), 2))
    return F.when(c < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def first_truthy(*cs: Column) -> Column:
    """The first that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs])


def longest(terms: Sequence[str], c: Column) -> Column:
    """Whether the text holds any of the terms as a substring, in any case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out
