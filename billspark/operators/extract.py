"""Statement text to fields: amounts, dates, codes, header fields, totals lines and line items.

Texts are rows (doc_id, text). Null and empty texts give no rows in the exploded results and nulls in the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import columns as C

DATE = r"(\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4}|\d{4}-\d{2}-\d{2})"
MONTH_DATE = r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})"
ANY_AMOUNT = r"\$[\d,]+(?:\.\d{2})?"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def amounts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, raw, amount) of each amount with cents, in order."""
    t = texts.select(key, F.posexplode(C.amounts_in(F.col(text))).alias("pos", "raw"))
    return t.select(key, F.col("pos").cast("bigint").alias("pos"), "raw", C.parse_amount(F.col("raw")).alias("amount"))


def amounts_in_context(texts: DataFrame, key: str = "doc_id", text: str = "text", width: int = 40) -> DataFrame:
    """(doc_id, pos, raw, amount, context) of each different amount where it stands first, with ``width`` characters of
    text on both sides, line feeds as blanks."""
    t = F.coalesce(F.col(text), F.lit(""))
    # what stands between the amounts, of which no more than the width on either side is needed; an amount has four
    # characters or more, so that as many neighbours are enough
    cut = texts.select(key, F.regexp_extract_all(t, F.lit(f"({C.AMOUNT})"), F.lit(1)).alias("m"), F.split(t, C.AMOUNT).alias("p")).where("size(m) > 0")
    cut = cut.select(key, "m", F.transform("p", lambda x: F.right(x, F.lit(width))).alias("ends"), F.transform("p", lambda x: F.left(x, F.lit(width))).alias("begins"))
    near = width // 4
    at = lambda c, i: F.element_at(F.col(c), i)

    def around(raw: Column, i: Column) -> Column:
        n = i + 1
        left = F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), n - near), n), lambda j: F.when(j < n, F.array(at("ends", j), at("m", j))).otherwise(F.array(at("ends", j)))))
        right = F.flatten(F.transform(F.sequence(n + 1, F.least(F.size("begins"), n + 1 + near)), lambda j: F.when(j <= F.size("m"), F.array(at("begins", j), at("m", j))).otherwise(F.array(at("begins", j)))))
        return F.struct(i.cast("bigint").alias("pos"), raw.alias("raw"), F.right(F.array_join(left, ""), F.lit(width)).alias("left"), F.left(F.array_join(right, ""), F.lit(width)).alias("right"))

    found = cut.select(key, F.inline_outer(F.transform("m", around)))
    context = F.trim(F.translate(F.concat("left", "raw", "right"), "\n", " "))
    rows = found.select(key, "pos", C.normalized(F.col("raw")).alias("raw"), C.parse_amount(F.col("raw")).alias("amount"), context.alias("context")).where("amount is not null")
    return rows.groupBy(key, "amount").agg(F.min_by(F.struct("pos", "raw", "context"), "pos").alias("x")).select(key, "x.pos", "x.raw", "amount", "x.context")


def with_unlabelled(found: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Codes (key, code, kind) and those of ``lines`` (key, code) that they lack, whose kind is ``unknown``; once each."""
    more = lines.select(key, "code").where("code is not null").distinct().join(found.select(key, "code"), [key, "code"], "left_anti")
    return found.select(key, "code", "kind").unionByName(more.withColumn("kind", F.lit("unknown")))


def dates(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, date) of the different dates with slashes or hyphens, as MM/DD/YYYY.

    Words are cut at what no date holds, so that digits glued to others give none.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[^0-9A-Za-z_/-]+"), lambda w: w.rlike(f"^{DATE}$"))
    return texts.select(key, F.explode(F.array_distinct(F.transform(words, C.normalize_date))).alias("date"))


def codes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code, kind) of the different billing codes: any five digits count as CPT."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[^0-9A-Za-z_.$,/#-]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,#-]+|[.,-]+$", ""))
    return texts.select(key, F.explode(F.array_distinct(bare)).alias("code")).withColumn("kind", C.code_kind(F.col("code"))).where("kind is not null")


def header(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: statement date, due date, stated due amount, phone, e-mail address and pay-by date.

    Labels may be spelled unevenly; the first match counts; missing fields are null.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    value = rf"\s*[:;]?\s*({DATE[1:-1]}|{MONTH_DATE[1:-1]})"
    return texts.select(
        key,
        _first(t, rf"(?i)statement[ \t]+date{value}").alias("statement_date"),
        _first(t, rf"(?i)(?:due[ \t]+date|pay[ \t]+by|due){value}").alias("due_date"),
        C.parse_amount(_first(t, r"(?i)(?:amount|total|balance)[ \t]+due\s*[:;]?\s*(\$?[\d,]+(?:\.\d{2})?)")).alias("amount_due"),
        _first(t, r"(\(\d{3}\) \d{3}-\d{4})").alias("phone"),
        F.lower(_first(t, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})")).alias("email"),
    )


def _spelt(label: str) -> str:
    """The pattern of a label whose words may be misread after their first letters: ``*`` stands for any letters, words
    in brackets may be missing; a colon or semicolon ends it. Its words stand on one line."""
    out = ""
    for w in label.split():
        one = "(?:" + w.strip("[]").replace("*", r"\w*").replace("#", r"\#") + ")"
        gap = r"[ \t]*" if out else ""
        out += f"(?:{gap}{one})?" if w[0] == "[" else gap + one
    return rf"(?i)\b{out}\s*[:;][ \t]*"


# Labels of header fields and the shapes of their values.
NAME, WORD, DATE_VALUE = r"([^\n:;]+?)", r"(\S+)", f"({DATE[1:-1]}|{MONTH_DATE[1:-1]})"
HEADER_LABELS = {
    "patient_name": ("pat*nt [name]", NAME), "guarantor_name": ("guar* nam*", NAME), "guarantor_number": ("guar* #|numb*", WORD), "account_number": ("acc* [#|numb*]", WORD), "service_date": ("serv* date", DATE_VALUE), "statement_date": ("stat* date", DATE_VALUE), "due_date": ("due date", DATE_VALUE), "pay_online": ("pay* on*", WORD), "pay_phone": ("pay* by phon*", r"([\d(][\d() -]+\d)"),
}
#: A name ends where its line does, at wide blanks, or before another label.
_NAME_END = r"(?=\s{2,}|\s*\n|\s*$|[ \t]+(?:DOB|Address|Acc\w*|Serv\w*[ \t]*(?:Date|Type)|Status|Policy|Guar\w*|(?:Primary|Secondary)[ \t]*\w*surance)\b)"
HOURS = r"((?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day ?[–-] ?(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,[^,\n]*)"
POST_BOX = r"(P\.? ?O\.? Box \d+, [A-Z][\w .'-]+, [A-Z]{2} \d{5})"
FACILITY = r"(?mU)^[ \t]*((?:[A-ZÀ-ÖØ-Þ][\w'’-]*[ \t]+)+(?:Hospital|Center|Clinic|Campus))[ \t]*$"
DEPARTMENT = r"(?i)(patient (?:financial )?services)"


def statement_fields(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text with its header fields, labels spelt as evenly as a scan leaves them.

    The first match of a label counts. Numbers of accounts and guarantors hold a digit, otherwise the next label was
    met and the field is null. A patient's name that is missing is the guarantor's. Dates are MM/DD/YYYY where numeric.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    got = {}
    for name, (label, value) in HEADER_LABELS.items():
        c = F.trim(_first(t, _spelt(label) + value + (_NAME_END if value == NAME else "")))
        if name.endswith("number"):
            c = F.when(C.looks_like_id(c), c)
        got[name] = C.normalize_date(c) if name.endswith("date") else F.nullif(c, F.lit(""))
    got["patient_name"] = F.coalesce(got["patient_name"], got["guarantor_name"])
    rest = {"phone": F.coalesce(got.pop("pay_phone"), _first(t, r"(?i)\bcall (\(?\d{3}\)?[ -]?\d{3}-\d{4})")), "hours": F.trim(_first(t, HOURS)), "mail": _first(t, POST_BOX), "facility": _first(t, FACILITY), "department": _first(t, DEPARTMENT)}
    return texts.select(key, *[c.alias(n) for n, c in (got | rest).items()])


def totals_line(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, total_billed, insurance, adjustments, patient_balance, outstanding_balance) from lines that begin with Totals.

    A dash stands for no payment. The last line of four or more amounts and the first one of three count; of three,
    the middle one is the outstanding balance and the others fill in what is missing or zero. Texts without such a
    line have no row.
    """
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line")).where(F.col("line").rlike(r"(?i)^\s*totals\s"))
    found = F.regexp_extract_all(F.regexp_replace("line", "—", r"\$0.00"), F.lit(f"({ANY_AMOUNT})"), F.lit(1))
    a = lines.select(key, "n", F.transform(found, C.parse_amount).alias("a"))
    g = a.groupBy(key).agg(F.max_by("a", F.when(F.size("a") >= 4, F.col("n"))).alias("four"), F.min_by("a", F.when(F.size("a") == 3, F.col("n"))).alias("three"))
    at = lambda c, i: F.try_element_at(F.col(c), F.lit(i))
    return g.where("four is not null or three is not null").select(
        key,
        F.coalesce(F.nullif(at("four", 1), F.lit(0)), at("three", 1), at("four", 1)).alias("total_billed"),
        at("four", 2).alias("insurance"),
        at("four", 3).alias("adjustments"),
        F.coalesce(F.nullif(at("four", 4), F.lit(0)), at("three", 3), at("four", 4)).alias("patient_balance"),
        F.coalesce(at("three", 2), at("four", 4)).alias("outstanding_balance"),
    )


def text_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, date, description, code, amount) of each line with an amount: the last amount, the first date
    and code, and what is left of the line. Lines of under five characters, or with nothing left and no code, give none.
    """
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line")).select(key, (F.col("n") + 1).cast("bigint").alias("line_no"), F.trim("line").alias("line")).where("length(line) >= 5")
    raw = F.regexp_extract_all("line", F.lit(f"({ANY_AMOUNT})"), F.lit(1))
    t = lines.withColumn("raw", F.try_element_at(raw, F.lit(-1))).where("raw is not null")
    any_date = rf"({MONTH_DATE[1:-1]}|{DATE[1:-1]})"
    t = t.withColumn("date", _first(F.col("line"), any_date)).withColumn("code", _first(F.col("line"), r"(?:^|[\s(])(\d{5}|[A-Z]\d{4})(?:[\s).,;]|$)"))
    rest = F.regexp_replace(F.regexp_replace("line", any_date, " "), ANY_AMOUNT, " ")
    rest = F.when(F.col("code").isNotNull(), F.replace(rest, F.col("code"), F.lit(" "))).otherwise(rest)
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s{2,}", " "), r"^[ \-|:.,;]+|[ \-|:.,;]+$", "")
    return t.select(key, "line_no", "date", F.nullif(rest, F.lit("")).alias("description"), "code", C.parse_amount(F.col("raw")).alias("amount")).where("description is not null or code is not null")


# Words of a header cell that name a column, in order of preference.
GRID_COLUMNS = {
    "date": ["date", "dos"],
    "description": ["description", "service", "procedure", "item"],
    "code": ["code", "cpt", "hcpcs"],
    "billed": ["billed", "charge", "amount"],
    "insurance": ["ins pmts", "insurance payments", "insurance paid", "ins. paid", "ins paid", "pmts"],
    "adjustments": ["adjustment", "adj"],
    "balance": ["patient bal", "responsibility", "pt. resp", "pt resp"],
}


def grid_lines(grids: DataFrame, key: str = "stmt_id", grid: str = "grid") -> DataFrame:
    """Line items of table grids (array of rows of cells), the columns told by the words of the first row.

    A column's earlier word wins over the place of a cell. Rows of totals, empty rows and grids without a description
    or code column give nothing. One cell for adjustment and balance together gives both of its amounts.
    """
    head = F.transform(F.try_element_at(F.col(grid), F.lit(1)), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    place = {}
    for name, words in GRID_COLUMNS.items():
        first = lambda w: F.array_position(F.transform("_h", lambda x: F.contains(x, F.lit(w))), True)
        place[name] = F.coalesce(*[F.nullif(first(w), F.lit(0)) for w in words]).cast("int")
    t = grids.where(F.size(grid) > 1).select(key, F.col(grid).alias("_g"), head.alias("_h")).select(key, "_g", F.struct(*[p.alias(n) for n, p in place.items()]).alias("_at"))
    t = t.where("_at.description is not null or _at.code is not null")
    rows = t.select(key, "_at", F.posexplode(F.slice("_g", F.lit(2), F.size("_g"))).alias("i", "_r")).where(F.exists("_r", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    cell = lambda n: F.nullif(F.trim(F.try_element_at(F.col("_r"), F.col(f"_at.{n}"))), F.lit(""))
    money = lambda n: C.parse_amount(cell(n))
    both = F.transform(C.amounts_in(cell("adjustments")), C.parse_amount)
    shared = (F.col("_at.adjustments") == F.col("_at.balance")) & (F.size(both) >= 2)
    out = rows.select(
        key,
        (F.col("i") + 1).cast("bigint").alias("row_no"),
        C.normalize_date(cell("date")).alias("date"),
        cell("description").alias("description"),
        cell("code").alias("code"),
        money("billed").alias("billed"),
        money("insurance").alias("insurance"),
        F.when(shared, F.try_element_at(both, F.lit(1))).otherwise(money("adjustments")).alias("adjustments"),
        F.when(shared, F.try_element_at(both, F.lit(2))).otherwise(money("balance")).alias("balance"),
    )
    return out.where("(description is not null or code is not null or billed is not null) and lower(coalesce(description, '')) not in ('total', 'totals')")


def clean_payer(c: Column) -> Column:
    """A payer's name out of a line of text: what stands before other labels and post boxes, without spoilt brackets."""
    line = F.regexp_replace(F.trim(F.split(F.trim(c), "\n").getItem(0)), r"\s+", " ")
    line = F.regexp_replace(line, r"(?i) (?:secondary insurance|(?:service |due |statement )?date|service type|policy (?:#|number)|status|guarantor|patient|account #) ?:?.*$", "")
    line = F.regexp_replace(line, r"(?i),? ?\(?\bP\.? ?O\.? ?Box\b.*$", "")
    # a bracket that holds more than two odd signs, or never closes
    line = F.regexp_replace(line, r"\((?:[^()]*[^\w\s(),./&+–-]){3,}[^()]*\)|\([^)]*$", "")
    return F.nullif(F.regexp_replace(line, r"^[ \-:|.,]+|[ \-:|.,]+$", ""), F.lit(""))


def payers(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, primary, secondary): the payers after their labels; a bare label of insurance is the primary one."""
    t = F.coalesce(F.col(text), F.lit(""))
    primary = F.coalesce(_first(t, r"(?i)primary insurance:[ \t]*([^\n]+)"), _first(t, r"(?im)^insurance:[ \t]*([^\n]+)"))
    return texts.select(key, clean_payer(primary).alias("primary"), clean_payer(_first(t, r"(?i)secondary insurance:[ \t]*([^\n]+)")).alias("secondary"))
