"""Changes of planted schemas, rescue of what doesn't fit, promotion."""

import json
from decimal import Decimal

import pytest

from billspark.operators import drift

NAMES = [f"person {i}" for i in range(12)]


def _feed():
    rows, n = [], 0

    def add(file_no, payload):
        nonlocal n
        n += 1
        rows.append(("case_x", file_no, n, payload if isinstance(payload, str) or payload is None else json.dumps(payload)))

    for i, p in enumerate(NAMES):
        add(1, {"case_id": f"C{i}", "who": p, "size": i, "old": True, "tags": ["a"], "lines": [{"code": f"9{i}", "n": 1}]})
        add(2, {"caseId": f"C{i}", "who": p, "size": str(i), "fresh": None, "tags": ["a"], "lines": [{"code_no": f"9{i}", "n": 1.5}]})
        add(3, {"caseId": f"C{i}", "who": p, "size": str(i), "fresh": None, "tags": [], "lines": []})
    add(2, '{"broken": 1')
    add(2, "[1, 2]")
    add(2, None)
    add(2, {"caseId": "C1", "who": NAMES[1], "size": "1", "fresh": None, "tags": ["a"], "lines": [{"code_no": "91", "n": 1.5}]})
    return rows


def changes(spark, rows):
    df = spark.createDataFrame(rows, "feed string, file_no int, record_id long, payload string")
    return {tuple(r)[1:] for r in drift.schema_changes(df).collect()}


def test_all_kinds_of_change(spark):
    got = changes(spark, _feed())
    assert {x for x in got if x[0] == 2} == {
        (2, "caseId", "renamed", "case_id"), (2, "lines[].code_no", "renamed", "lines[].code"), (2, "size", "retyped", ""), (2, "old", "removed", ""), (2, "fresh", "added", ""),
    }
    assert {x for x in got if x[0] == 3 and x[2] == "removed"} == {(3, "lines[].code_no", "removed", ""), (3, "lines[].n", "removed", "")}


def test_other_values_are_no_change(spark):
    rows = [("f", k, 10 * k + i, json.dumps({"b": v, "a": i} if k > 1 else {"a": i, "b": 1})) for k, v in ((1, 1), (2, 2.50)) for i in range(4)]
    assert changes(spark, rows) == set()


def test_null_where_others_have_an_object(spark):
    rows = [("f", k, 10 * k + i, json.dumps({"a": i, "o": None if i and k == 1 else {"x": 1}, "l": [] if i and k == 1 else [{"y": 1}]})) for k in (1, 2) for i in range(3)]
    assert changes(spark, rows) == set()


def test_empty_and_unreadable(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("f", 1, 1, "{"), ("f", 2, 2, None)]) == set()


@pytest.mark.parametrize(("a", "b"), [(12, "12.00"), (1234.5, "$1,234.50"), (True, "TRUE"), (" x ", "X")])
def test_canonical(a, b):
    assert drift.canonical(a) == drift.canonical(b)


TARGET = {"case_id": ("string", ["case_id", "caseId"]), "size": ("int", ["size"])}


def test_rescue_and_promote(spark):
    rows = [(1, '{"caseId": "a", "size": 3, "plan": "p", "deep": {"x": 1}}', "k"), (2, '{"case_id": "b", "size": "many"}', None), (3, "{", "k"), (4, None, "k"), (5, '{"case_id": null}', "k")]
    df = spark.createDataFrame(rows, "n int, payload string, size string")
    t = drift.rescue_ingest(df, TARGET, keep=["n", "size"])
    got = {r["n"]: r for r in t.collect()}
    assert got[1]["case_id"] == "a" and got[1]["size"] == 3 and got[1]["size_source"] == "k" and json.loads(got[1]["_rescued"]) == {"plan": "p", "deep": {"x": 1}} and got[1]["_paths"] == {"case_id": "caseId"}
    assert got[2]["size"] is None and json.loads(got[2]["_rescued"]) == {"size": "many"}
    assert not got[3]["_valid"] and json.loads(got[3]["_rescued"]) == {"$raw": "{"} and not got[4]["_valid"] and json.loads(got[5]["_rescued"]) == {"case_id": None}
    p = {r["n"]: r for r in drift.promote(drift.promote(t, "plan", "string", "plan"), "deep_x", "int", "deep.x").collect()}
    assert p[1]["plan"] == "p" and p[1]["deep_x"] == 1 and p[1]["_rescued"] is None and p[2]["plan"] is None and json.loads(p[2]["_rescued"]) == {"size": "many"}
    own = {r["n"]: r for r in drift.promote(t, "case_id", "string", "plan").collect()}
    assert own[1]["case_id"] == "a" and json.loads(own[1]["_rescued"])["plan"] == "p"
    assert drift.promote(t.limit(0), "plan", "string", "plan").count() == 0


def _content(v):
    """A JSON value whose formats don't count: 12 and "12.00" are equal; order and boundaries of elements do."""
    if isinstance(v, dict):
        return {k: _content(x) for k, x in v.items()}
    return [_content(x) for x in v] if isinstance(v, list) else None if v is None else drift.canonical(v)


def _restored(rows, target):
    return [drift.restore(r.asDict(), r["_rescued"], r["_paths"], target) for r in rows]


@pytest.mark.parametrize("payload", [
    {"id": "A", "old_id": "B", "items": [{"x": 1}, {"x": 2, "y": 9}, {"x": 3}, "loose", None, [1, {"z": 2}]], "e": {}, "l": []}, {"n": "12.345", "m": 12.345, "b": "yes", "d": {"t": "2024-01-02"}}, {"n": None, "m": "x", "b": 7, "d": {}}, {}, {"a": {"n": 6}, "a.n": 7, "z": 0}, {"d": {"t": "no date", "u": {"v": [1, "2"]}}}, {"n": 10**30, "m": True, "b": "FALSE", "id": ["s"]}, {"d": [{"t": 1}], "id": 4.0},
])
def test_ingest_and_rescue_rebuild_the_payload(spark, payload):
    target = {"id": ("string", ["id", "old_id"]), "n": ("int", ["n", "a.n"]), "m": ("decimal(18,2)", ["m"]), "b": ("boolean", ["b"]), "t": ("date", ["d.t"])}
    r = drift.rescue_ingest(spark.createDataFrame([(json.dumps(payload),)], "payload string"), target).collect()
    assert _content(_restored(r, target)[0]) == _content(payload)


def test_every_record_is_rebuilt(spark, sf):
    from billspark.plans import general

    raw = spark.read.parquet(f"{sf}/raw_records.parquet")
    for kind in ("case", "bill", "review"):
        part = raw.where(raw.feed.startswith(kind))
        target = general.consistent_target(part, kind)
        rows = drift.rescue_ingest(part, target, keep=["payload"]).where("_valid").collect()
        assert len(rows) > 20
        assert all(_content(x) == _content(json.loads(r["payload"])) for x, r in zip(_restored(rows, target), rows))


def test_children(spark):
    rows = [(1, '{"l": [{"c": "a", "n": "2", "u": 1}, null, "loose", {"k": "b", "s": [{"z": 1}, {"z": 2}]}]}'), (2, '{"m": {"l": [{"c": "x"}]}, "l": 5}'), (3, '{"l": []}'), (4, None)]
    t = drift.rescue_ingest(spark.createDataFrame(rows, "id long, payload string"), {"q": ("int", ["q"])}, keep=["id"])
    kids = drift.promote_children(t, ["l", "m.l"], {"c": ("string", ["c", "k"]), "n": ("int", ["n"])}, ["id"])
    got = sorted((r["id"], r["child_no"], r["c"], r["n"], r["_rescued"], r["_valid"]) for r in kids.collect())
    assert got == [(1, 1, "a", 2, '{"u": 1}', True), (1, 3, None, None, '{"$raw": "loose"}', False), (1, 4, "b", None, '{"s": [{"z": 1}, {"z": 2}]}', True), (2, 1, "x", None, None, True)]
    below = drift.promote_children(kids, ["s"], {"z": ("int", ["z"])}, ["id", "child_no"])
    assert sorted((r["id"], r["child_no_source"], r["child_no"], r["z"]) for r in below.collect()) == [(1, 4, 1, 1), (1, 4, 2, 2)]


@pytest.mark.parametrize(("kind", "value", "want"), [("int", "7", 7), ("int", "7.5", None), ("int", 2**31, None), ("bigint", 2**31, 2**31), ("boolean", "Yes", True), ("boolean", "maybe", None), ("double", "1e3", 1000.0), ("double", "1,000", None), ("string", 5, "5"), ("string", [1], None), ("date", "2024-02-30", None), ("decimal(4,2)", "99.999", None), ("decimal(4,2)", 12.5, Decimal("12.50"))])
def test_casts(kind, value, want):
    assert drift.caster(kind)(value) == want


def test_unknown_cast():
    with pytest.raises(ValueError):
        drift.caster("interval")


def test_aliases_of_renames(spark):
    c = spark.createDataFrame([("f", 2, "b", "renamed", "a"), ("f", 3, "c", "renamed", "b"), ("g", 2, "y", "renamed", "x"), ("g", 3, "y", "renamed", "z"), ("g", 3, "q", "added", "")], "feed string, file_no int, field_path string, change_kind string, old_path string")
    groups = drift.rename_groups(c)
    assert sorted(map(sorted, groups)) == [["a", "b", "c"], ["x", "y", "z"]]
    got = drift.with_aliases({"one": ("int", "a"), "two": ("int", "x"), "three": ("int", "z"), "four": ("int", "new")}, groups)
    assert got == {"one": ("int", ["a", "b", "c"]), "two": ("int", ["x"]), "three": ("int", ["z"]), "four": ("int", ["new"])}
    with pytest.raises(ValueError):
        drift.rename_groups(c, most=1)


def test_queries_keep_every_record(spark, sf):
    from billspark.plans import general

    raw = spark.read.parquet(f"{sf}/raw_records.parquet")
    for name, kind in (("p3_cases", "case"), ("p3_bills", "bill"), ("p3_reviews", "review")):
        t = general.QUERIES[name](spark, sf)
        assert t.count() == raw.where(raw.feed.startswith(kind)).count() and t.where("_valid").count() > 0
        key = "case_id" if kind != "bill" else "statement_date"
        assert t.where(f"_valid and {key} is null").count() <= 0.2 * t.count()


def test_rescue_keeps_what_is_not_taken(spark):
    rows = [(1, '{"n": 1, "old_n": 2}'), (2, '{"old_n": "4", "n": "x"}'), (3, '{"n": "x", "old_n": "y"}'), (4, '{"old_n": 5}')]
    got = drift.rescue_ingest(spark.createDataFrame(rows, "record_id long, payload string"), {"n": ("int", ["n", "old_n"])}, keep=["record_id"])
    out = {r["record_id"]: (r["n"], json.loads(r["_rescued"] or "{}")) for r in got.collect()}
    assert out == {1: (1, {"old_n": 2}), 2: (4, {"n": "x"}), 3: (None, {"n": "x", "old_n": "y"}), 4: (5, {})}


def test_leaves_in_order():
    assert list(drift.leaves({"a": {"b": 1, "c": [{"d": 2}, {"d": 3}]}, "e": [1, 2], "f": None})) == [("a.b", 1), ("a.c[].d", 2), ("a.c[].d", 3), ("e", [1, 2]), ("f", None)]
