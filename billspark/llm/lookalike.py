"""Texts of one consistent form, in which visually identical texts are equal strings.

The mapping of code points is built by rule from the Unicode database (widths, joined forms, canonical
decompositions, spaces, invisible characters) and from a list of look-alike letters. Code points whose form is one
character or none are translated in place. What is left, characters with combining marks and joined forms, is
exploded to positioned code points, joined to the broadcast mapping, its marks ordered by class, recomposed through
the broadcast composition table, and put back.

Defined results: a null text has a null form; case, accents, digits, punctuation and blank lines are kept; an
invisible character disappears, also in an emoji sequence; the empty text stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.session import materialize

# Letters of other scripts that look like a Latin letter, as pairs of letter and Latin letter.
LOOKALIKES = {
    "Cyrillic": "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ɡg АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ӀI",
    "Greek": "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ",
    "Armenian": "օo հh ոn սu ցg ՕO ՍU ՏS ԼL",
    "Other": "ıı ʜʜ ᴏo ᴄc ᴠv ᴡw ᴢz ꮯC ꮪS ꓐB ꓑP ꓒd ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
}
# Hyphens, and invisible code points that are not of the category of format characters.
HYPHENS = "‐‑﹣－"
INVISIBLE = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0xFDD0, 0xFDD1]
VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_OPEN, _CLOSE = "﷐", "﷑"


@cache
def lookalikes() -> dict[str, str]:
    return {p[0]: p[1] for group in LOOKALIKES.values() for p in group.split() if p[0] != p[1]}


def _same_look(ch: str) -> str | None:
    """The characters that a width or joined form stands for; None where the look differs."""
    tag, *codes = (unicodedata.decomposition(ch) or "-").split()
    to = "".join(chr(int(c, 16)) for c in codes if not c.startswith("<"))
    if tag in SAME_LOOK:
        return to
    joined = tag == "<compat>" and to[:1] != " " and (len(to) > 1 or unicodedata.category(ch) == "Nl")
    return to if joined else None


@cache
def expand(ch: str) -> str:
    """What one code point becomes before marks are ordered: decomposed, by look, without what can't be seen."""
    code = ord(ch)
    cat = unicodedata.category(ch)
    if code in _invisible() or cat == "Cf" and code not in VISIBLE_FORMATS:
        return ""
    if cat == "Zs" and code != 0x1680:
        return " "
    if ch in HYPHENS:
        return "-"
    to = _same_look(ch)
    if to is not None:
        return "".join(map(expand, to))
    to = lookalikes().get(ch)
    if to:
        return to
    parts = unicodedata.normalize("NFD", ch)
    return parts if parts == ch else "".join(map(expand, parts))


@cache
def _invisible() -> frozenset[int]:
    return frozenset(INVISIBLE)


@cache
def mapping() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(in place, exploded, compositions): one code point to one or none; any to what it expands to; runs to one."""
    single, full, composed = {}, {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0x20000 <= code < 0x2F800 or 0x30000 <= code < 0xE0000 or code >= 0xF0000:
            continue
        ch = chr(code)
        to = expand(ch)
        if to != ch:
            full[ch] = to
        form = unicodedata.normalize("NFC", to)
        if form != ch and len(form) <= 1 and unicodedata.combining(ch) == 0:
            single[ch] = form
        nfd = unicodedata.normalize("NFD", ch)
        if nfd != ch and unicodedata.normalize("NFC", nfd) == ch:
            composed[nfd] = ch
    return single, full, composed


@cache
def joined() -> str:
    """The code points whose form is several characters, such as ligatures."""
    single, full, _ = mapping()
    return "".join(c for c, to in full.items() if c not in single and len(unicodedata.normalize("NFC", to)) > 1)


@cache
def steady() -> str:
    """Code points of Western letters, punctuation, symbols and pictures that are their own form, whatever stands beside them."""
    _, full, _ = mapping()
    near = map(chr, [*range(0x80, 0x250), *range(0x2010, 0x2100), *range(0x1F000, 0x1FB00)])
    return "".join(c for c in near if not unicodedata.combining(c) and unicodedata.category(c) not in ("Mn", "Mc", "Me") and unicodedata.normalize("NFC", full.get(c, c)) == c)


def _class(chars: str) -> str:
    """A character class of a Java pattern, by ranges."""
    out, codes = [], sorted(map(ord, chars))
    start = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = c
        last = c
    return "".join(out)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The mapping and the compositions as tables; both are fixed by Unicode, some 35,000 and 12,000 short rows."""
    import pandas as pd

    _, full, composed = mapping()
    rows = [(ch, k, c, unicodedata.combining(c)) for ch, to in full.items() for k, c in enumerate(to)]
    rows += [(c, 0, c, unicodedata.combining(c)) for c in map(chr, [*range(0x300, 0xD800), *range(0xFB00, 0xFFFE), *range(0x10000, 0x1F000)]) if unicodedata.combining(c) and c not in full]
    m = spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "k", "to", "ccc"]), "ch string, k int, to string, ccc int")
    c = spark.createDataFrame(pd.DataFrame(list(composed.items()), columns=["run", "one"]), "run string, one string")
    return F.broadcast(m), F.broadcast(c)


def consistent_form(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *carry: str) -> DataFrame:
    """(id, text, form, carried columns) of every row.

    Only rows with combining marks or joined forms are exploded, and of these only the characters concerned; one
    shuffle by id brings their pieces together again. Rows of the same id and text have the same form and come out
    once if they took that way.
    """
    spark = df.sparkSession
    single = mapping()[0]
    base = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(f"`{c}`") for c in carry])
    gone = "".join(k for k, v in single.items() if not v)
    kept = "".join(k for k, v in single.items() if v)
    # most texts have no character beyond ASCII, which the lengths in bytes and characters tell
    ascii_ = F.octet_length("_text") == F.char_length("_text")
    # and most of the others have none that changes
    same = ascii_ | ~F.col("_text").rlike(f"[^\\x{{0}}-\\x{{7f}}{_class(steady())}]")
    unchanged = base.where(same | F.col("_text").isNull()).select("_id", "_text", F.col("_text").alias("_form"), *carry)
    # as a generator's output the translated text is computed once, not again for each filter on it
    once = F.inline(F.array(F.struct(F.translate("_text", kept + gone, "".join(single[k] for k in kept)).alias("_t"))))
    t = base.where(~same).select("*", once)
    special = _class(joined())
    marked = F.col("_t").rlike(f"[\\p{{M}}\\x{{1100}}-\\x{{11ff}}{special}]")
    plain = t.where(~marked).select("_id", "_text", F.col("_t").alias("_form"), *carry)

    cluster = f"((?:[{special}]|[^\\p{{M}}])\\p{{M}}+|[{special}]|\\p{{M}}+|[\\x{{1100}}-\\x{{11ff}}]+)"
    held = F.split(F.regexp_replace("_t", cluster, f"{_OPEN}$1{_OPEN}"), _OPEN)
    rows = t.where(marked).withColumn("_h", F.xxhash64("_text"))
    pieces = rows.select("_id", "_h", "_text", *carry, F.posexplode(held).alias("_pos", "_piece"))
    # the parts between clusters are whole; of clusters, the code points
    points = pieces.select("_id", "_h", "_pos", "_piece", F.when(F.col("_pos") % 2 == 0, F.lit(None)).otherwise(F.split("_piece", "")).alias("_chars"), F.when(F.col("_pos") == 0, F.struct("_text", *carry)).alias("_row"))
    points = points.select("_id", "_h", "_pos", "_row", F.when(F.col("_pos") % 2 == 0, F.col("_piece")).alias("_whole"), F.posexplode_outer("_chars").alias("_cpos", "ch"))
    m, c = _tables(spark)
    moved = points.join(m, "ch", "left").select("_id", "_h", "_pos", "_row", "_whole", F.coalesce("_cpos", F.lit(0)).alias("_cpos"), F.coalesce("k", F.lit(0)).alias("_k"), F.coalesce("to", "ch").alias("_to"), F.coalesce("ccc", F.lit(0)).alias("_ccc"))
    moved = moved.repartition("_id").dropDuplicates(["_id", "_h", "_pos", "_cpos", "_k"])
    from pyspark.sql import Window

    # a run begins at each character that no mark or vowel sign of Hangul is
    starts = (F.col("_ccc") == 0) & ~F.col("_to").between("\u1161", "\u11ff")
    run_no = F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy("_id", "_h", "_pos").orderBy("_cpos", "_k"))
    runs = moved.withColumn("_run", run_no).groupBy("_id", "_h", "_pos", "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ccc", "_cpos", "_k", "_to"))), lambda x: x["_to"]), "").alias("run"),
        F.max("_whole").alias("_whole"), F.max_by("_row", F.col("_row").isNotNull()).alias("_row"),
    )
    done = runs.join(c, "run", "left").groupBy("_id", "_h").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_run", F.coalesce("_whole", "one", "run").alias("s")))), lambda x: x["s"]), "").alias("_form"),
        F.max_by("_row", F.col("_row").isNotNull()).alias("_row"),
    )
    exploded = done.select("_id", F.col("_row._text").alias("_text"), "_form", *[F.col("_row").getField(x).alias(x) for x in carry])
    return unchanged.unionByName(plain).unionByName(exploded).select(F.col("_id").alias(id_column), F.col("_text").alias("text"), F.col("_form").alias("form"), *carry)


def _digests(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, f, t): the 128-bit digests of form and text of each row with both, of forms that different texts have.

    Groups whose texts are all equal, however large, fall out by a pre-aggregate.
    """
    f = consistent_form(df, id_column, text_column).where(f"form is not null and `{id_column}` is not null")
    d = materialize(f.select(F.col(id_column).alias("id"), F.md5("form").alias("f"), F.md5("text").alias("t")), "forms")
    mixed = d.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("f")
    return d.join(mixed, "f", "left_semi")


def lookalike_classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, class_id, copies, texts) of each row whose text looks like another one: one row per id.

    ``class_id`` is the smallest id of the same look, ``copies`` the ids of the very same text and ``texts`` the
    different texts of the look. Rows of null text or id, and of texts without a look-alike, are in no class.
    """
    d = _digests(df, id_column, text_column).distinct()
    texts = d.groupBy("f", "t").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    looks = texts.groupBy("f").agg(F.min("first").alias("class_id"), F.count("*").alias("texts"))
    return d.join(texts.select("f", "t", "copies"), ["f", "t"]).join(looks, "f").groupBy(F.col("id").alias(id_column)).agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.max("texts").alias("texts"))


def lookalike_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b) with a < b of texts that look the same and are not the same string.

    Different texts of one form are paired, and only then are the ids of each text put in, so that many copies of a
    text make no pairs but those that are asked for. Rows of null text or id are in no pair.
    """
    d = _digests(df, id_column, text_column)
    texts = d.select("f", "t").distinct()
    pairs = texts.withColumnRenamed("t", "ta").join(texts.withColumnRenamed("t", "tb"), "f").where("ta < tb").select("ta", "tb")
    ids = pairs.join(d.select(F.col("t").alias("ta"), F.col("id").alias("a")), "ta").join(d.select(F.col("t").alias("tb"), F.col("id").alias("b")), "tb").where("a != b")
    return ids.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


@cache
def _changing() -> re.Pattern:
    return re.compile("[^\0-\x7f" + "".join(map(re.escape, steady())) + "]")


def canonical(text: str | None) -> str | None:
    """The form of one string, for tests and for operators that normalise texts in Python."""
    if text is None or text.isascii() or not _changing().search(text):
        return text
    return unicodedata.normalize("NFC", "".join(expand(c) if ord(c) > 127 else c for c in text))
