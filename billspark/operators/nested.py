"""Deeply nested records to related flat tables.

``infer_merged_schema`` merges the shapes of all JSON payloads; ``nested_arrays`` lists the arrays of objects of a
schema at any depth; ``explode_levels`` recursively explodes them to rows that carry their record's key, their path and
their ordinals. ``normalize`` makes of these a child table for each array, whose rows have a surrogate key and the key
of the row they hang from; ``object_links`` takes the keys of all levels.

Defined results: a null struct or array, and an empty array, has no child rows; a null element keeps its ordinal
but has no row; a record without the key has the parent key of its content's hash; a record delivered again counts
once; columns with the names of our key columns keep their values under ``<name>_value``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_COLUMNS = ("parent_key", "row_key", "child_no", "sub_no", "ordinals")


@dataclass(frozen=True)
class ArrayLevel:
    """An array of objects: its dotted path, the paths of the arrays above it, and its element type."""

    path: str
    above: tuple[str, ...]
    element: T.StructType


def infer_merged_schema(payloads: DataFrame, column: str) -> T.StructType:
    """The schema of all valid JSON objects in a string column, merged: fields of any record, widest type.

    A field of different types in different records is a string, which holds the JSON of them all.
    One aggregate row, of the schema's size, comes to the driver.
    """
    ddl = payloads.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).head()["s"]
    if not ddl or not ddl.startswith("OBJECT"):
        return T.StructType([])
    return T._parse_datatype_string(ddl.replace("OBJECT<", "STRUCT<").replace(": VARIANT", ": STRING").replace("<VARIANT>", "<STRING>"))


def nested_arrays(schema: T.StructType, prefix: str = "", above: tuple[str, ...] = ()) -> list[ArrayLevel]:
    out: list[ArrayLevel] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += nested_arrays(f.dataType, path + ".", above)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(ArrayLevel(path, above, f.dataType.elementType))
            out += nested_arrays(f.dataType.elementType, path + ".", (*above, path))
    return out


def _get(base: Column | None, dotted: str) -> Column:
    """A field by its path; names may hold any character but a dot."""
    parts = dotted.split(".")
    c = F.col(f"`{parts[0]}`") if base is None else base.getField(parts[0])
    for p in parts[1:]:
        c = c.getField(p)
    return c


def latest_delivery(df: DataFrame, key: str, loaded_at: str | None = None) -> DataFrame:
    """One row for each key: the last delivery where ``loaded_at`` is given, otherwise any of the equal ones.

    Rows without the key are kept, wholly equal ones once. One scan and an aggregate with partial results before the
    shuffle, so that a key that is delivered very often does not gather in one task.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    order = F.col(f"`{loaded_at}`").cast("string") if loaded_at else F.lit("")
    g = df.groupBy(F.col(f"`{key}`").alias("_k"), F.when(F.col(f"`{key}`").isNull(), row).alias("_lone")).agg(F.max_by(row, F.coalesce(order, F.lit(""))).alias("_r"))
    return g.select(*[F.col("_k").alias(c) if c == key else F.col("_r").getField(c).alias(c) for c in df.columns])


def explode_levels(df: DataFrame, key: str, levels: list[ArrayLevel], content: bool = False) -> DataFrame:
    """(key, child_path, ordinals, content) of each non-null object in the arrays of ``levels``, from one scan.

    An array is gone through with its places; the objects in it become rows, and the arrays inside each object are
    gone through in turn with the places of the objects above. ``ordinals`` holds the places from the outermost array
    inwards, from 1, null elements counted. With ``content`` there is a struct with a field for each level, ``_0``,
    ``_1`` and so on, of which the row's own is filled.
    """
    wanted = {x.path: i for i, x in enumerate(levels)}
    known = {x.path: x for x in nested_arrays(df.schema)}
    fields = [T.StructField("child_path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.LongType()))]
    if content:
        fields.append(T.StructField("content", T.StructType([T.StructField(f"_{i}", x.element) for i, x in enumerate(levels)])))
    empty = F.array().cast(T.ArrayType(T.StructType(fields)))

    def row(path: str, x: Column, places: list[Column]) -> Column:
        fields = [F.lit(path).alias("child_path"), F.array(*places).alias("ordinals")]
        if content:
            fields.append(F.struct(*[(x if i == wanted[path] else F.lit(None)).cast(v.element).alias(f"_{i}") for i, v in enumerate(levels)]).alias("content"))
        return F.struct(*fields)

    def leads(path: str) -> bool:
        return any(w == path or path in known[w].above for w in wanted)

    def below(array: Column, path: str, places: list[Column]) -> Column:
        parts = []
        if path in wanted:
            own = F.transform(array, lambda x, i: F.when(x.isNotNull(), row(path, x, [*places, (i + 1).cast("bigint")])))
            parts.append(F.filter(own, lambda x: x.isNotNull()))
        for inner in known.values():
            if inner.above and inner.above[-1] == path and leads(inner.path):
                step = inner.path[len(path) + 1 :]
                parts.append(F.flatten(F.transform(array, lambda x, i: F.coalesce(below(_get(x, step), inner.path, [*places, (i + 1).cast("bigint")]), empty))))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    tops = [x for x in known.values() if not x.above and leads(x.path)]
    if not tops:
        return df.select(F.col(f"`{key}`").alias(key), F.inline(empty))
    rows = [F.coalesce(below(_get(None, x.path), x.path, []), empty) for x in tops]
    per = df.select(F.col(f"`{key}`").alias(key), (F.concat(*rows) if len(rows) > 1 else rows[0]).alias("_rows"))
    # the outer form, since Spark would otherwise evaluate every row a second time to filter empty arrays first
    return per.select(key, F.inline_outer("_rows")).where("child_path is not null")


def surrogate_key(df: DataFrame, key: str) -> Column:
    """The key of a record as a string, or of one without it the hash of its content."""
    rest = [c for c in df.columns if c != key]
    content = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rest]) if rest else F.lit(0)
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("#"), content.cast("string")))


def _child_key(parent: str, places: Column) -> Column:
    return F.concat_ws("/", F.col(parent), F.transform(places, lambda i: i.cast("string")))


def object_links(df: DataFrame, key: str) -> DataFrame:
    """(key, row_key, child_path, ordinals) of each non-null object in the arrays of objects of ``df``, once each.

    The surrogate keys of the rows of all child tables of ``normalize``, at any depth, from one scan; ``ordinals`` are
    the places from the outermost array inwards. Repeated deliveries fall together in the partial aggregate before
    the one shuffle.
    """
    keyed = df.select(F.struct(F.col(f"`{key}`").alias("key"), surrogate_key(df, key).alias("row")).alias("_key"), *[F.col(f"`{c}`") for c in df.columns if c != key])
    rows = explode_levels(keyed, "_key", nested_arrays(df.schema))
    links = rows.select(F.col("_key.key").alias(key), F.col("_key.row").alias("_row"), "child_path", "ordinals").distinct()
    return links.select(key, _child_key("_row", F.col("ordinals")).alias("row_key"), "child_path", "ordinals")


def normalize(df: DataFrame, key: str, loaded_at: str | None = None) -> dict[str, DataFrame]:
    """Related flat tables by path: ``""`` holds the parents, each array of objects its child rows.

    Every table has ``row_key`` and, but for the parents, ``parent_key``: the path of keys and ordinals that leads to
    the row, such as ``17/3`` for the third line item of record 17. ``ordinals`` holds the places from the outermost
    array inwards. Inner structs of a row become columns joined by ``_``; arrays of plain values stay arrays.
    """
    base = latest_delivery(df, key, loaded_at) if key in df.columns else df
    keyed = base.withColumn("_row_key", surrogate_key(base, key))
    tables = {"": keyed.select(F.col("_row_key").alias("row_key"), *_leaves(df.schema, None))}
    for level in nested_arrays(df.schema):
        rows = explode_levels(keyed, "_row_key", [level], content=True)
        above = F.slice("ordinals", F.lit(1), F.size("ordinals") - 1)
        tables[level.path] = rows.select(_child_key("_row_key", above).alias("parent_key"), _child_key("_row_key", F.col("ordinals")).alias("row_key"), "ordinals", *_leaves(level.element, F.col("content").getField("_0")))
    return tables


def _leaves(schema: T.StructType, base: Column | None, prefix: str = "") -> list[Column]:
    out: list[Column] = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if base is None else base.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, c, f"{prefix}{f.name}_")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            continue
        else:
            name = prefix + f.name
            out.append(c.alias(f"{name}_value" if name in KEY_COLUMNS else name))
    return out
