"""Nested records against a brute-force walk, with nulls at every level."""

import json

from pyspark.sql import functions as F

from billspark.operators import nested

SCHEMA = "id long, loaded string, a struct<items:array<struct<name:string,parts:array<struct<p:string>>,row_key:string>>>, b array<struct<x:int>>, plain array<int>, child_path string"
ROWS = [
    (1, "1", {"items": [{"name": "n", "parts": [{"p": "q"}, None], "row_key": "z"}, None, {"name": None, "parts": None, "row_key": None}]}, [{"x": 1}, {"x": None}], [1, 2], "c"),
    (1, "2", {"items": [{"name": "n", "parts": [{"p": "q"}, None], "row_key": "z"}, None, {"name": None, "parts": None, "row_key": None}]}, [{"x": 1}, {"x": None}], [1, 2], "c"),
    (2, None, None, [], None, None),
    (3, "1", {"items": []}, None, [], ""),
    (None, "1", {"items": [{"name": "m", "parts": [], "row_key": None}]}, None, None, None),
]


def brute(rows):
    out = set()
    for i, _, a, b, _, _ in rows:
        for n, x in enumerate((a or {}).get("items") or [], 1):
            if x is not None:
                out.add((i, "a.items", n, 0))
                out |= {(i, "a.items.parts", n, k) for k, y in enumerate(x["parts"] or [], 1) if y is not None}
        out |= {(i, "b", n, 0) for n, x in enumerate(b or [], 1) if x is not None}
    return out


def test_links_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [(r["id"], r["child_path"], r["ordinals"][0], r["ordinals"][-1] if len(r["ordinals"]) > 1 else 0) for r in nested.object_links(df, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS)


def test_normalize_keeps_links_and_clashing_names(spark):
    t = nested.normalize(spark.createDataFrame(ROWS, SCHEMA), "id", "loaded")
    assert set(t) == {"", "a.items", "a.items.parts", "b"}
    items = {r["row_key"]: r for r in t["a.items"].collect()}
    assert items["1/1"]["parent_key"] == "1" and items["1/1"]["row_key_value"] == "z" and items["1/3"]["ordinals"] == [3]
    parts = t["a.items.parts"].collect()
    assert [(p["parent_key"], p["row_key"], p["ordinals"]) for p in parts] == [("1/1", "1/1/1", [1, 1])]
    parents = t[""].collect()
    assert sum(r["id"] == 1 for r in parents) == 1 and {r["loaded"] for r in parents if r["id"] == 1} == {"2"}
    lost = next(r for r in parents if r["id"] is None)
    assert lost["row_key"].startswith("#") and any(r["parent_key"] == lost["row_key"] for r in t["a.items"].collect())


def test_empty_table_and_no_arrays(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nested.object_links(empty, "id").count() == 0
    assert all(x.count() == 0 for x in nested.normalize(empty, "id", "loaded").values())
    assert nested.object_links(spark.range(3), "id").count() == 0


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (None, "c", "1"), (None, "c", "1"), (None, "d", None), (2, None, None)], "k int, v string, t string")
    assert sorted((r["k"] or 0, r["v"]) for r in nested.latest_delivery(df, "k", "t").collect() if r["v"]) == [(0, "c"), (0, "d"), (1, "b")]
    assert nested.latest_delivery(df, "k", "t").where("k = 2").count() == 1


def test_merged_schema(spark):
    df = spark.createDataFrame([(json.dumps({"a": 1, "b": {"c": "x"}}),), (json.dumps({"a": 2.5, "l": [{"d": True}]}),), ("{bad",), (None,)], "p string")
    got = nested.infer_merged_schema(df, "p")
    assert {f.name for f in got.fields} == {"a", "b", "l"} and [x.path for x in nested.nested_arrays(got)] == ["l"]


def test_whole_table_has_all_objects(spark, sf):
    t = spark.read.parquet(f"{sf}/bills.parquet")
    links = nested.object_links(t, "bill_id").groupBy("child_path").count().collect()
    assert {r["child_path"] for r in links} >= {"summary_of_services.line_items", "payment_detail.adjustments"}
    rows = nested.normalize(t.drop("_eval_metadata"), "bill_id", "loaded_at")
    for r in links:
        assert rows[r["child_path"]].count() == r["count"]
    assert rows["summary_of_services.line_items"].agg(F.count_distinct("row_key")).head()[0] == rows["summary_of_services.line_items"].count()


def test_links_of_three_levels_and_records_without_a_key(spark):
    schema = "id long, note string, a array<struct<b:array<struct<c:array<struct<x:int>>>>>>"
    three = [([([(1,), (2,)],), ([(3,)],)],)]
    rows = [(1, "p", three), (None, "p", three), (None, "q", three), (None, "q", three)]
    t = spark.createDataFrame(rows, schema)
    links = [(r["id"], r["row_key"], tuple(r["ordinals"])) for r in nested.object_links(t, "id").where("child_path = 'a.b.c'").collect()]
    assert len(links) == len(set(links)) == 9  # two records without a key are told apart by their content
    assert {o for i, k, o in links if i == 1} == {(1, 1, 1), (1, 1, 2), (1, 2, 1)} and all(k == "1/" + "/".join(map(str, o)) for i, k, o in links if i == 1)
    tables = nested.normalize(t, "id")
    assert {r["row_key"] for r in tables["a.b.c"].collect()} == {k for _, k, _ in links}
    assert {r["parent_key"] for r in tables["a.b.c"].collect()} <= {r["row_key"] for r in tables["a.b"].collect()}


def test_merged_types(spark):
    raw = spark.createDataFrame([('{"a": {"n": 1}, "l": [{"v": 2}]}',), ('{"a": {"n": "x"}, "l": [{"v": "y"}, {"w": true}]}',), ("{",), (None,)], "p string")
    schema = nested.infer_merged_schema(raw, "p")
    got = raw.select(F.from_json("p", schema).alias("r")).select("r.a.n", "r.l.v").collect()
    assert [tuple(r) for r in got[:2]] == [("1", ["2"]), ("x", ["y", None])]
