"""Word boxes of a page to lines and table cells, a confidence gate, and runs of rows.

Words are rows (page, line, word_no, text, left_pos, width, conf).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(words: DataFrame) -> DataFrame:
    """Words with a text and a confidence."""
    return words.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("conf", F.lit(-1.0)) >= 0))


def gate(words: DataFrame, least_conf: float = 45.0, least_words: int = 30) -> DataFrame:
    """(page, mean_conf, n_words, passes): pages whose words are many and sure enough."""
    g = usable(words).groupBy("page").agg(F.round(F.avg(F.col("conf").cast("decimal(9,4)")), 4).cast("double").alias("mean_conf"), F.count("*").alias("n_words"))
    return g.withColumn("passes", (F.col("mean_conf") >= least_conf) & (F.col("n_words") >= least_words))


def cluster_rows(words: DataFrame) -> DataFrame:
    """Words (page, text, left_pos, top, width, height, conf) with ``line`` and ``word_no`` by where they stand.

    From the top downwards, a word whose middle lies below all words before it begins a line, so that words of one line
    overlap in height; within a line they count from the left. Windows over a page's words, no pairs.
    """
    down = Window.partitionBy("page").orderBy("top", "left_pos")
    before = F.max(F.col("top") + F.col("height")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("top") + F.col("height") / 2 > before), 1).otherwise(0)
    t = usable(words).withColumn("_starts", starts)
    t = t.withColumn("line", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    across = Window.partitionBy("page", "line").orderBy("left_pos", "top")
    return t.withColumn("word_no", (F.row_number().over(across) - 1).cast("bigint")).drop("_starts")


def lines(words: DataFrame) -> DataFrame:
    """(page, line, text): words of each line from left to right."""
    g = usable(words).groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("left_pos", "word_no", "text"))).alias("w"))
    return g.select("page", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def cells(words: DataFrame, header_words: list[str], least: int = 3) -> DataFrame:
    """(page, line, column_no, text): words under the first line that holds ``least`` header words, each in the column
    whose header's centre is nearest, the left one if two are.

    The columns of a page are an array on each of its words, so that no pairs are made by a join.
    """
    w = usable(words).withColumn("centre", F.col("left_pos") + F.col("width") / 2)
    is_head = F.lower("text").isin(header_words)
    first = w.groupBy("page", "line").agg(F.count_if(is_head).alias("n"), F.array_sort(F.collect_list(F.when(is_head, F.col("centre")))).alias("anchors")).where(F.col("n") >= least)
    head = first.groupBy("page").agg(F.min_by("anchors", "line").alias("anchors"), F.min("line").alias("head_line"))
    t = w.join(head, "page").where(F.col("line") > F.col("head_line"))
    nearest = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(a - F.col("centre")).alias("d"), i.alias("i"))))
    t = t.withColumn("column_no", (nearest["i"] + 1).cast("bigint"))
    g = t.groupBy("page", "line", "column_no").agg(F.array_sort(F.collect_list(F.struct("left_pos", "word_no", "text"))).alias("w"))
    return g.select("page", "line", "column_no", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def islands(rows: DataFrame, key: str, pos: str, inside: str, least: int = 1) -> DataFrame:
    """(key, start, stop, length) of each run of neighbouring places where ``inside`` holds, of ``least`` places or more."""
    w = Window.partitionBy(key).orderBy(pos)
    t = rows.where(F.col(inside)).select(key, pos).withColumn("_g", F.col(pos) - F.row_number().over(w))
    g = t.groupBy(key, "_g").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("length"))
    return g.where(F.col("length") >= least).drop("_g")
