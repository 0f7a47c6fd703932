"""Schemas that drift between the files of a feed: one consistent table, and every change reported.

``rescue_ingest`` enforces a target schema and keeps in ``_rescued`` what of a payload is unknown, can't be cast or isn't
taken, as the part of the JSON object that is left, with its order and element boundaries; ``restore`` puts payloads
together again. ``promote`` moves an approved field, ``promote_children`` an array of objects, out of ``_rescued`` into
typed columns and replays what was rescued.

``schema_changes`` ingests each file against the fields of the file before as its target, and the file before against
those of the file after: what is rescued is added or retyped one way and removed the other way, and rescued values
replayed over the records that were delivered again tell renames.

Defined results: payloads that are null, not JSON or not an object have no fields; a null value makes the field
exist without a type; an empty array is of type array at its own path unless another record of the file has
objects there; empty objects, and plain values among objects of an array, are no fields; a record delivered twice
counts once for the overlap of values.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import Decimal, InvalidOperation

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billspark.session import materialize

#: JSON types by Python type; whole and decimal numbers are one type.
_KINDS = ((bool, "boolean"), (int, "number"), (float, "number"), (str, "string"), (list, "array"))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_object(payload: str | None) -> dict | None:
    """The object of a payload, or None. NaN and Infinity are not JSON."""
    if not payload:
        return None
    try:
        value = json.loads(payload, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of each value that is not an object, in their order; ``[]`` follows the key of an array of objects."""
    stack: list[tuple[str, object]] = [(prefix, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
            stack += [(at + "[]", x) for x in reversed(v) if isinstance(x, dict)]
        else:
            yield at, v


def canonical(v: object) -> str:
    """A value's content without its format: 12, 12.0 and "12.00" are equal, blanks around a string don't count."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, list):
        return "|".join(canonical(x) for x in v)
    if v is None:
        return ""
    s = str(v).strip()
    try:
        return canonical(float(s.replace(",", "").lstrip("$"))) if s and (s[0].isdigit() or s[0] in "-$.") and "_" not in s else s.lower()
    except (ValueError, OverflowError):
        return s.lower()


def _kind(v: object) -> str | None:
    return next((k for t, k in _KINDS if isinstance(v, t)), None)


FACTS = "feed string, file_no int, record_id bigint, path string, kind string, value string"


def flatten_payloads(df: DataFrame, feed: str = "feed", file_no: str = "file_no", record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """Facts (feed, file_no, record_id, path, kind, value) of all valid payloads; one row per value and record."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for f, n, r, p in zip(b["feed"], b["file_no"], b["record_id"], b["payload"]):
                obj = parse_object(p)
                for path, v in leaves(obj) if obj is not None else ():
                    kind = _kind(v)
                    for c, x in zip(cols, (f, n, r, path, kind, canonical(v))):
                        c.append(x)
            if cols[0]:
                yield pd.DataFrame(dict(zip(("feed", "file_no", "record_id", "path", "kind", "value"), cols)))

    return df.where(F.col(payload).isNotNull() & F.col(file_no).isNotNull()).select(F.col(feed).alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).alias("payload")).mapInPandas(run, FACTS)


def file_fields(df: DataFrame) -> DataFrame:
    """(feed, file_no, path, kinds): the merged schema of each file. ``df`` has feed, file_no and payload.

    One pass over the payloads, from which only the different fields of each batch and file go on.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: set[tuple] = set()
            for f, n, p in zip(b["feed"], b["file_no"], b["payload"]):
                obj = parse_object(p)
                if obj is not None:
                    seen.add((f, n, None, None))
                    seen.update((f, n, path, _kind(v)) for path, v in leaves(obj))
            if seen:
                yield pd.DataFrame(list(seen), columns=["feed", "file_no", "path", "kind"])

    rows = df.select("feed", "file_no", "payload").mapInPandas(run, "feed string, file_no int, path string, kind string")
    return rows.groupBy("feed", "file_no", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def schema_changes(records: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """(feed, file_no, field_path, change_kind, old_path) of each change against the file before.

    ``records`` has feed, file_no, record_id and payload; rows without a file number or feed are left out. Fields per
    file come from one aggregate. Only the payloads of files with both vanished and new fields are gone through again
    for renames: records of the two files are paired by values that stand in just one record of each file, the pair
    with the most such values winning, and a vanished field goes on under the new path with which it shares the
    largest part, ``min_overlap`` at least, of the values of paired records. All of it is keyed by feed, file and
    value, so a large feed is spread over the tasks.
    """
    rows = records.where("payload is not null and file_no is not null and feed is not null").select("feed", F.col("file_no").cast("int").alias("file_no"), F.col("record_id").cast("bigint").alias("record_id"), "payload")
    everything = materialize(file_fields(rows), "fields")
    fields = everything.where("path is not null")
    # a null, or an array without objects, is no field of its own where another record of the file has an object there
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), k), "."), r"\[\]$", ""))
    objects = fields.where(F.size(parts) > 1).select("feed", "file_no", F.explode(above).alias("path")).distinct().withColumn("object_there", F.lit(True))
    plain = fields.join(objects, ["feed", "file_no", "path"], "left")
    plain = plain.where(F.col("object_there").isNull() | (F.size(F.array_except("kinds", F.array(F.lit("array")))) > 0)).drop("object_there")

    by_no = Window.partitionBy("feed").orderBy("file_no")
    steps = everything.where("path is null").select("feed", "file_no", F.lag("file_no").over(by_no).alias("from_no"), F.lead("file_no").over(by_no).alias("next_no"))
    # a field of a file is new to the step into the file and old to the step out of it
    none = F.lit(None)
    into = F.when(F.col("from_no").isNotNull(), F.struct(F.col("file_no").alias("to_no"), F.col("from_no").alias("from_no"), none.cast("array<string>").alias("old"), F.col("kinds").alias("new")))
    out_of = F.when(F.col("next_no").isNotNull(), F.struct(F.col("next_no").alias("to_no"), F.col("file_no").alias("from_no"), F.col("kinds").alias("old"), none.cast("array<string>").alias("new")))
    sides = plain.join(steps, ["feed", "file_no"]).select("feed", "path", F.explode(F.array(into, out_of)).alias("x")).where("x is not null")
    both = sides.groupBy("feed", "x.to_no", "x.from_no", "path").agg(F.max("x.old").alias("old_kinds"), F.max("x.new").alias("new_kinds"))
    # what the targets rescue are few rows, and four later plans read them
    changed = both.where("old_kinds is null or new_kinds is null or old_kinds != new_kinds")
    diff = materialize(changed.select("*", F.when(F.col("old_kinds").isNotNull(), True).alias("in_old"), F.when(F.col("new_kinds").isNotNull(), True).alias("in_new")), "diff")
    gone = diff.where("in_new is null").select("feed", "to_no", "from_no", F.col("path").alias("old_path"))
    come = diff.where("in_old is null").select("feed", "to_no", "from_no", F.col("path").alias("new_path"))
    retyped = diff.where("in_old and in_new and size(old_kinds) > 0 and size(new_kinds) > 0 and old_kinds != new_kinds")

    renamed = materialize(_renames(rows, diff, min_overlap), "renamed")
    key = ["feed", "to_no"]
    added = come.join(renamed.select(*key, "new_path"), [*key, "new_path"], "left_anti")
    removed = gone.join(renamed.select(*key, "old_path"), [*key, "old_path"], "left_anti")

    def out(df: DataFrame, path: str, kind: str, old_path: str | None = None) -> DataFrame:
        return df.select("feed", F.col("to_no").cast("int").alias("file_no"), F.col(path).alias("field_path"), F.lit(kind).alias("change_kind"), (F.col(old_path) if old_path else F.lit("")).alias("old_path"))

    return out(added, "new_path", "added").union(out(removed, "old_path", "removed")).union(out(renamed, "new_path", "renamed", "old_path")).union(out(retyped, "path", "retyped"))


def rescued_values(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(feed, file_no, record_id, vs, forward, backward) of the records of files that ``targets`` names.

    ``targets`` has for a file the paths that its ingestion rescues against the file before (``forward``) and against
    the file after (``backward``). ``vs`` are the hashes of a record's different values, the other two arrays hold
    (path, sorted hashes of its values) of what was rescued. Empty values count nowhere.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for feed, no, rec, p, fwd, bwd in zip(b["feed"], b["file_no"], b["record_id"], b["payload"], b["forward"], b["backward"]):
                obj = parse_object(p)
                if obj is None:
                    continue
                fwd, bwd = set(fwd if fwd is not None else ()), set(bwd if bwd is not None else ())
                vs: set[int] = set()
                kept: dict[str, list[int]] = {}
                for path, v in leaves(obj):
                    text = canonical(v)
                    if text:
                        h = xxhash.xxh64_intdigest(text)
                        h = h - (1 << 64) if h >= 1 << 63 else h
                        vs.add(h)
                        if path in fwd or path in bwd:
                            kept.setdefault(path, []).append(h)
                entries = [{"path": x, "vs": sorted(y)} for x, y in kept.items()]
                out.append((feed, no, rec, list(vs), [e for e in entries if e["path"] in fwd], [e for e in entries if e["path"] in bwd]))
            if out:
                yield pd.DataFrame(out, columns=["feed", "file_no", "record_id", "vs", "forward", "backward"])

    part = "array<struct<path:string,vs:array<bigint>>>"
    return rows.join(targets, ["feed", "file_no"]).select("feed", "file_no", "record_id", "payload", "forward", "backward").mapInPandas(run, f"feed string, file_no int, record_id bigint, vs array<bigint>, forward {part}, backward {part}")


def _renames(rows: DataFrame, diff: DataFrame, min_overlap: float) -> DataFrame:
    come, gone = F.col("in_old").isNull(), F.col("in_new").isNull()
    both = diff.groupBy("feed", "from_no", "to_no").agg(F.collect_set(F.when(come, F.col("path"))).alias("forward"), F.collect_set(F.when(gone, F.col("path"))).alias("backward")).where("size(forward) > 0 and size(backward) > 0")
    none = F.array().cast("array<string>")
    sides = both.select("feed", F.col("to_no").alias("file_no"), "forward", none.alias("backward")).unionByName(both.select("feed", F.col("from_no").alias("file_no"), none.alias("forward"), "backward"))
    targets = sides.groupBy("feed", "file_no").agg(F.flatten(F.collect_list("forward")).alias("forward"), F.flatten(F.collect_list("backward")).alias("backward"))
    seen = materialize(rescued_values(rows, targets), "rescued")
    # values of one record only, by file
    single = seen.select("feed", "file_no", "record_id", F.explode("vs").alias("v")).groupBy("feed", "file_no", "v").agg(F.min("record_id").alias("rec"), F.max("record_id").alias("rec_max")).where("rec = rec_max").select("feed", "file_no", "v", "rec")
    steps = both.select("feed", "from_no", "to_no")
    a = steps.join(single.withColumnsRenamed({"file_no": "from_no", "rec": "old_rec"}), ["feed", "from_no"])
    b = single.withColumnsRenamed({"file_no": "to_no", "rec": "new_rec"})
    votes = a.join(b, ["feed", "to_no", "v"]).groupBy("feed", "from_no", "to_no", "old_rec", "new_rec").agg(F.count("*").alias("n"))
    # of each record the best partner, both ways
    first = votes.groupBy("feed", "from_no", "to_no", "old_rec").agg(F.max(F.struct("n", (-F.col("new_rec")).alias("new_rec"))).alias("x")).select("feed", "from_no", "to_no", "old_rec", (-F.col("x.new_rec")).alias("new_rec"))
    back = votes.groupBy("feed", "to_no", "new_rec").agg(F.max(F.struct("n", (-F.col("old_rec")).alias("old_rec"))).alias("x")).select("feed", "to_no", "new_rec", (-F.col("x.old_rec")).alias("old_rec"))
    pairs = first.join(back, ["feed", "to_no", "new_rec", "old_rec"])

    old = pairs.join(seen.select("feed", F.col("file_no").alias("from_no"), F.col("record_id").alias("old_rec"), "backward"), ["feed", "from_no", "old_rec"])
    met = old.join(seen.select("feed", F.col("file_no").alias("to_no"), F.col("record_id").alias("new_rec"), "forward"), ["feed", "to_no", "new_rec"])
    met = met.select("feed", "to_no", F.explode("backward").alias("o"), "forward").select("feed", "to_no", "o", F.explode("forward").alias("w"))
    same = F.size(F.array_intersect("o.vs", "w.vs")) / F.size(F.array_union("o.vs", "w.vs"))
    scored = met.groupBy("feed", "to_no", F.col("o.path").alias("old_path"), F.col("w.path").alias("new_path")).agg(F.sum(F.when(same >= 0.5, 1).otherwise(0)).alias("hits"), F.count("*").alias("n"))
    scored = scored.where((F.col("hits") >= 1) & (F.col("hits") >= min_overlap * F.col("n")))
    w_old = Window.partitionBy("feed", "to_no", "old_path").orderBy(F.desc(F.col("hits") / F.col("n")), F.desc("hits"), "new_path")
    w_new = Window.partitionBy("feed", "to_no", "new_path").orderBy(F.desc(F.col("hits") / F.col("n")), F.desc("hits"), "old_path")
    return scored.withColumn("i", F.row_number().over(w_old)).withColumn("j", F.row_number().over(w_new)).where("i = 1 and j = 1").select("feed", "to_no", "old_path", "new_path")


def rename_groups(changes: DataFrame, most: int = 10_000) -> list[set[str]]:
    """Paths that renames connect, over all feeds. The different pairs of names, ``most`` at most, come to the driver."""
    pairs = changes.where("change_kind = 'renamed'").select("old_path", "field_path").distinct().limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} different renames")
    group: dict[str, set[str]] = {}
    for old, new in pairs:
        merged = group.get(old, {old}) | group.get(new, {new})
        for p in merged:
            group[p] = merged
    return list({id(g): g for g in group.values()}.values())


def with_aliases(target: dict[str, tuple[str, str]], groups: Iterable[set[str]]) -> dict[str, tuple[str, list[str]]]:
    """A target of (type, path) as one of (type, paths): its own path first, then the names it went under.

    Names that several columns of the target would claim stay with none of them and are rescued.
    """
    names = {c: {p, *(x for g in groups if p in g for x in g)} for c, (_, p) in target.items()}
    own = {p for _, p in target.values()}
    once = {x for c in names for x in names[c] if sum(x in n for n in names.values()) == 1}
    return {c: (kind, [p, *sorted((names[c] & once) - own)]) for c, (kind, p) in target.items()}


_INTEGER = re.compile(r"\s*[+-]?\d+(?:\.0*)?\s*")
_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*")
_TRUTH = {"true": True, "t": True, "yes": True, "y": True, "1": True, "false": False, "f": False, "no": False, "n": False, "0": False}
_RANGE = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def caster(kind: str) -> Callable[[object], object]:
    """A function from a JSON value to one of a Spark type, or to None where it can't be cast. Nulls, objects and arrays can't."""
    decimal = re.fullmatch(r"decimal\((\d+), ?(\d+)\)", kind)

    def string(v):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def integer(v):
        if isinstance(v, bool) or isinstance(v, float) and not v.is_integer() or isinstance(v, str) and not _INTEGER.fullmatch(v):
            return None
        n = int(v) if not isinstance(v, str) else int(v.split(".")[0])
        return n if -(1 << _RANGE[kind]) <= n < 1 << _RANGE[kind] else None

    def number(v):
        return None if isinstance(v, bool) or isinstance(v, str) and not _NUMBER.fullmatch(v) else float(v)

    def money(v):
        if isinstance(v, bool) or isinstance(v, str) and not _NUMBER.fullmatch(v):
            return None
        precision, scale = map(int, decimal.groups())
        try:
            d = Decimal(str(v).strip()).quantize(Decimal(1).scaleb(-scale), rounding="ROUND_HALF_UP")
        except InvalidOperation:
            return None
        return d if len(d.as_tuple().digits) <= precision else None

    def truth(v):
        return v if isinstance(v, bool) else _TRUTH.get(str(v).strip().lower())

    def date(v):
        try:
            return datetime.date.fromisoformat(v.strip()) if isinstance(v, str) else None
        except ValueError:
            return None

    known = {"string": string, "double": number, "boolean": truth, "date": date, **dict.fromkeys(_RANGE, integer)}
    if not decimal and kind not in known:
        raise ValueError(f"no cast to {kind}")
    cast = money if decimal else known[kind]
    return lambda v: None if v is None or isinstance(v, (dict, list)) else cast(v)


def _same_content(kind: str, cast: object, v: object) -> bool:
    """Whether a column holds what the value says; formats don't count."""
    if kind.startswith("decimal"):
        return cast == Decimal(str(v).strip())
    return cast == v if kind == "string" and isinstance(v, str) else canonical(str(cast) if kind == "date" else cast) == canonical(v)


class Target:
    """Columns with their types and the paths, in order of preference, under which they are delivered."""

    def __init__(self, columns: dict[str, tuple[str, Sequence[str]]]):
        self.columns = [(c, kind, caster(kind), [tuple(p.split(".")) for p in paths]) for c, (kind, paths) in columns.items()]

    def take(self, obj: dict) -> tuple[list, dict[str, str]]:
        """The columns' values, taken out of ``obj``, and the paths of those that didn't come under their first one.

        A column takes the first path whose value can be cast. A value stays in ``obj`` as well where the column
        doesn't hold all that it says, such as digits that a type has no room for.
        """
        values, under = [], {}
        for c, kind, cast, paths in self.columns:
            value = None
            for i, path in enumerate(paths):
                chain, at = [obj], obj
                for k in path[:-1]:
                    at = at.get(k)
                    if not isinstance(at, dict):
                        break
                    chain.append(at)
                else:
                    v = at.get(path[-1])
                    value = cast(v)
                    if value is not None:
                        if i:
                            under[c] = ".".join(path)
                        if _same_content(kind, value, v):
                            del at[path[-1]]
                            for d, above, k in zip(chain[:0:-1], chain[-2::-1], path[-2::-1]):
                                if not d:
                                    del above[k]
                        break
            values.append(value)
        return values, under


def _suffixed(keep: Sequence[str], target: Iterable[str]) -> dict[str, str]:
    taken = {*target, "_rescued", "_valid", "_paths", "child_no"}
    return {c: f"{c}_source" if c in taken else c for c in keep}


def rescue_ingest(df: DataFrame, target: dict[str, tuple[str, Sequence[str]]], payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Payloads as typed columns, with what doesn't fit in ``_rescued``.

    ``target`` maps a column to its Spark type and the paths, in order of preference, under which it is delivered; keys
    that hold a dot are met by no path. ``_rescued`` is what is left of the JSON object when the taken values are out:
    unknown fields, nulls, arrays of objects, values that can't be cast or whose column was delivered under a
    preferred name. ``_paths`` maps the columns that came under another than their first path to it. ``_valid`` tells
    whether the payload was a JSON object at all; if not, ``_rescued`` holds it under ``$raw`` and the columns are null.
    ``keep`` are columns carried along; those whose names clash with a target get the suffix ``_source``.
    """
    kept, names = _suffixed(keep, target), list(target)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taker = Target(target)
        for b in batches:
            rows = []
            for p in b["_payload"]:
                obj = parse_object(p)
                if obj is None:
                    rows.append((*[None] * len(names), json.dumps({"$raw": p}), None, False))
                else:
                    values, under = taker.take(obj)
                    rows.append((*values, json.dumps(obj, ensure_ascii=False) if obj else None, under or None, True))
            out = pd.DataFrame(rows, columns=[*names, "_rescued", "_paths", "_valid"], dtype=object)
            for c in kept.values():
                out[c] = b[c].to_numpy()
            yield out

    carried = df.select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()], F.col(payload).alias("_payload"))
    schema = T.StructType([f for f in carried.schema.fields if f.name != "_payload"] + [T.StructField(c, T._parse_datatype_string(kind)) for c, (kind, _) in target.items()])
    return carried.mapInPandas(run, schema.add("_rescued", T.StringType()).add("_paths", T.MapType(T.StringType(), T.StringType())).add("_valid", T.BooleanType()))


def restore(values: dict[str, object], rescued: str | None, paths: dict[str, str] | None, target: dict[str, tuple[str, Sequence[str]]]) -> object:
    """The payload of one ingested row: what was rescued, with the columns' values at the paths that they came under."""
    obj = json.loads(rescued) if rescued else {}
    for c, (_, own) in target.items():
        if values.get(c) is None:
            continue
        at, (*above, last) = obj, ((paths or {}).get(c) or own[0]).split(".")
        for k in above:
            at = at.setdefault(k, {})
        at.setdefault(last, values[c])
    return obj


def promote(df: DataFrame, column: str, kind: str, path: str) -> DataFrame:
    """A typed column from the values rescued under ``path``, replayed over all rows.

    Values that can be cast move to the column and leave ``_rescued``; others stay, as they do where the column has a
    value of its own. A null or empty ``_rescued`` gives null.
    """

    @F.pandas_udf(f"struct<value:{kind},rest:string>")
    def replay(rescued: pd.Series) -> pd.DataFrame:
        taker, out = Target({column: (kind, [path])}), []
        for r in rescued:
            obj = parse_object(r)
            values = taker.take(obj)[0] if obj else [None]
            out.append((values[0], r if values[0] is None else json.dumps(obj, ensure_ascii=False) if obj else None))
        return pd.DataFrame(out, columns=["value", "rest"], dtype=object)

    moved = df.withColumn("_replayed", replay(F.col("_rescued")))
    own = F.col(f"`{column}`") if column in df.columns else F.lit(None).cast(kind)
    return moved.withColumn("_rescued", F.when(own.isNull(), F.col("_replayed.rest")).otherwise(F.col("_rescued"))).withColumn(column, F.coalesce(own, F.col("_replayed.value"))).drop("_replayed")


def promote_children(df: DataFrame, paths: Sequence[str], target: dict[str, tuple[str, Sequence[str]]], keep: Sequence[str]) -> DataFrame:
    """A child table from the arrays of objects rescued under ``paths``: (keep, child_no, target's columns, _rescued, _paths, _valid).

    A row for each element of each array, nulls left out but counted; an element that isn't an object is rescued under
    ``$raw``. The parents stay as they are. What of an element is no column is in its own ``_rescued``, so that arrays
    below it are promoted in the same way.
    """
    kept, names = _suffixed(keep, target), list(target)
    places = [tuple(p.split(".")) for p in paths]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taker = Target(target)
        for b in batches:
            rows, of = [], []
            for i, r in enumerate(b["_rescued"]):
                obj = parse_object(r)
                for path in places if obj else ():
                    at: object = obj
                    for k in path:
                        at = at.get(k) if isinstance(at, dict) else None
                    for n, x in enumerate(at if isinstance(at, list) else (), 1):
                        if x is None:
                            continue
                        of.append(i)
                        if isinstance(x, dict):
                            values, under = taker.take(x)
                            rows.append((n, *values, json.dumps(x, ensure_ascii=False) if x else None, under or None, True))
                        else:
                            rows.append((n, *[None] * len(names), json.dumps({"$raw": x}, ensure_ascii=False), None, False))
            if rows:
                out = pd.DataFrame(rows, columns=["child_no", *names, "_rescued", "_paths", "_valid"], dtype=object)
                for c in kept.values():
                    out[c] = b[f"_k_{c}"].to_numpy()[of]
                yield out

    carried = df.select(*[F.col(f"`{c}`").alias(f"_k_{n}") for c, n in kept.items()], "_rescued")
    schema = T.StructType([T.StructField(f.name[3:], f.dataType) for f in carried.schema.fields if f.name != "_rescued"]).add("child_no", T.LongType())
    for c, (kind, _) in target.items():
        schema = schema.add(c, T._parse_datatype_string(kind))
    return carried.mapInPandas(run, schema.add("_rescued", T.StringType()).add("_paths", T.MapType(T.StringType(), T.StringType())).add("_valid", T.BooleanType()))
