"""Caveat expressions, tuple strings, conditions as columns, filters, history and the change feed."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import cel, tuples
from quillon.model import ELLIPSIS, KEY, TUPLES, SchemaError
from quillon.operators import filters, store
from quillon.operators.filters import Filter, SubjectRelation, Subjects
from quillon.sources import files
from quillon.streaming import watch

TRUE = [
    "1 + 2 * 3 == 7", "7 / 2 == 3 && -7 / 2 == -3 && -7 % 3 == -1", "1.5 + 1.5 == 3.0", "'a' + 'b' == 'ab'", "[1] + [2] == [1, 2]", "2u + 3u == 5u", "1 == 1.0 && 1 < 1.5", "size('héllo') == 5", "'abc'.matches('b.$')",
    "[1, 2, 3].all(x, x > 0)", "[1, 2].exists_one(x, x == 2)", "[1, 2].map(x, x * 2) == [2, 4]", "[1, 2, 3].filter(x, x > 1).size() == 2", "{'a': 1}.a == 1 && 'a' in {'a': 1} && has({'a': 1}.a) && !has({'a': 1}.b)",
    "int('12') == 12 && int(3.9) == 3 && string(true) == 'true' && double('1.5') == 1.5 && uint(7) == 7u", "duration('1h30m') == duration('90m') && duration('90m').getHours() == 1",
    "timestamp('2024-02-29T12:30:45.5Z').getMonth() == 1", "timestamp('2024-02-29T23:30:00Z').getDate('+01:00') == 1", "timestamp('2024-03-01T00:00:00Z') - timestamp('2024-02-29T00:00:00Z') == duration('24h')",
    "true || 1 / 0 == 1", "!(false && 1 / 0 == 1)", "1 / 0 == 1 || true", "{'a': {'b': 1}}.isSubtreeOf({'a': {'b': 1, 'c': 2}, 'd': 3})", "optional.of(3).orValue(4) == 3 && optional.none().orValue(4) == 4", "type(1) == int", "b'ab' == bytes('ab')", "1 < 2 ? true : 1 / 0 == 0",
]
ERRORS = ["1 / 0 == 1", "9223372036854775807 + 1 > 0", "1 + 1.0 == 2.0", "'a' < 1", "[1][3] == 1", "{'a': 1}.b == 1", "-(1u) == 1", "int('x') == 1", "nope == 1", "1u - 2u == 0u"]


@pytest.mark.parametrize("text", TRUE)
def test_expressions_hold(text):
    assert cel.evaluate(cel.parse(text), {}) is True


@pytest.mark.parametrize("text", ERRORS)
def test_expressions_fail(text):
    with pytest.raises(cel.CelError):
        cel.evaluate(cel.parse(text), {})


def test_conditions_ask_only_for_what_they_need():
    params = {"a": "int", "b": "bool", "c": "string"}
    assert cel.decide("b || a > 1", params, {"b": True}, {}) == (True, [])
    assert cel.decide("b && a > 1", params, {"b": True}, {}) == (None, ["a"])
    assert cel.decide("b && a > 1", params, {"b": False}, {}) == (False, [])
    assert cel.decide("a > 1", params, {"a": 2}, {"a": 0}) == (True, [])  # what is stored wins
    assert cel.decide("a > 1", params, {"a": None}, {"a": 3}) == (None, ["a"])  # a null takes it away
    assert cel.decide("a > 1", params, {"a": "5", "x": 1}, {}) == (True, [])
    with pytest.raises(cel.CelError):
        cel.decide("a > 1", params, {"a": "x"}, {})
    assert not cel.mentioned("x.a > 1", "a") and cel.mentioned("a.b", "a") and not cel.mentioned("ab", "a")


@pytest.mark.parametrize("ip, cidr, want", [("10.1.2.3", "10.0.0.0/8", True), ("11.1.2.3", "10.0.0.0/8", False), ("::1", "10.0.0.0/8", False), ("2001:db8::5", "2001:db8::/32", True), ("1.2.3.4", "0.0.0.0/0", True)])
def test_cidr(ip, cidr, want):
    assert cel.in_cidr(cel.address(ip), cidr) is want
    for bad in ("1.2.3", "01.2.3.4", "1.2.3.256", "fe80::1%eth0", ":::"):
        with pytest.raises(cel.CelError):
            cel.address(bad)


LINES = ["doc:a#viewer@user:tom", "doc:a/b=c#viewer@group:eng#member", "doc:a#viewer@user:*", 'doc:a#viewer@user:tom[cav:{"a":1}]', "doc:a#viewer@user:tom[cav]", "doc:a#viewer@user:tom[expiration:2024-01-02T03:04:05.5Z]", 'doc:a#viewer@user:tom[cav:{"x":"\\u003C"}][expiration:2024-01-02T03:04:05Z]']


def test_lines_round_trip(spark, tmp_path):
    rows = tuples.parse(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert [r["t"] for r in rows.select(tuples.text().alias("t")).collect()] == LINES
    assert [tuple(r) for r in rows.collect()] == [tuples.parse_line(x) for x in LINES]
    files.write_text(rows, f"{tmp_path}/t")
    assert files.read_text(spark, f"{tmp_path}/t").count() == len(LINES)
    for bad in ("doc:a#viewer", "doc:a@user:b", "doc:*#viewer@user:b", "Doc:a#viewer@user:b", "doc:a#viewer@user:b[cav:{]", "", "doc:a#v@user:b", "doc:a#vw@user:b", "do:a#viewer@user:b", "doc:a#viewer@user:b[cav:{}]", " doc:a#viewer@user:b", "doc:a#viewer@user:b[expiration:2024-01-02T03:04:05+01:00]", "doc:a#viewer@user:b\n\n", f"doc:{1025 * 'a'}#viewer@user:b"):
        assert tuples.parse_line(bad) is None
    assert tuples.parse_line("doc:a#viewer@user:b\n") and tuples.parse_object("doc:a#viewer") == ("doc", "a", "viewer") and not tuples.parse_object("doc:a")
    place = tuples.cursor({"type": "doc", "limit": 2}, ["doc:a#viewer@user:b"])
    assert tuples.parse_cursor(place, {"limit": 2, "type": "doc"}) == ["doc:a#viewer@user:b"]
    for other in ({"type": "team", "limit": 2}, {}):
        with pytest.raises(ValueError):
            tuples.parse_cursor(place, other)
    assert tuples.parse_token(tuples.token("s", 7, "h")) == ("s", 7, "h")


def relation(spark):
    rows = [tuples.parse_line(x) for x in (*LINES[:3], "doc:b#owner@user:amy", "team:x#member@team:y#member", 'doc:c#viewer@user:z[cav:{"a":1}]', "doc:d#viewer@user:z[expiration:2024-01-02T03:04:05Z]")]
    return spark.createDataFrame(rows, TUPLES)


def test_filters(spark):
    rows = relation(spark).cache()
    n = lambda f: filters.query(rows, f).count()
    assert (n(Filter()), n(Filter(type="doc")), n(Filter(prefix="a")), n(Filter(ids=("a", "b"))), n(Filter(caveat="cav")), n(Filter(caveat="")), n(Filter(expires=True))) == (7, 6, 3, 3, 1, 6, 1)
    sub = lambda **k: n(Filter(subjects=(Subjects(relation=SubjectRelation(**k)),)))
    assert (sub(), sub(ellipsis=True), sub(names=("member",)), sub(names=("member",), ellipsis=True), sub(only_other=True)) == (7, 7, 2, 7, 2)
    keys = [tuple(r[c] for c in filters.BY_SUBJECT) for r in filters.page(rows.select(*KEY), filters.BY_SUBJECT).collect()]
    assert keys == sorted(keys)
    got = []
    while page := [tuple(r[c] for c in filters.BY_SUBJECT) for r in filters.page(rows.select(*KEY), filters.BY_SUBJECT, got[-1] if got else None, 2).collect()]:
        got += page
    assert got == keys
    at = tuples.nanos("2024-01-02T03:04:05Z")
    assert filters.unexpired(rows, at).count() == 6 and filters.unexpired(rows, at - 1).count() == 7


def test_commits(spark):
    s = store.Store(spark, "definition user {} caveat cav(a int) { a == 1 } definition doc { relation viewer: user | user with cav } definition team { relation viewer: user }")
    up = lambda op, *lines: spark.createDataFrame([(op, *tuples.parse_line(x)) for x in lines], "op string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TUPLES))
    a, b = "doc:a#viewer@user:tom", "doc:b#viewer@user:tom"
    first, _, _ = s.commit(store.Commit(updates=up("create", a, b)), 100)
    with pytest.raises(store.Conflict):
        s.commit(store.Commit(updates=up("create", a)), 200)
    assert s.commit(store.Commit(updates=up("touch", a)), 200)[0] == 200 and s.rows.count() == 2
    s.commit(store.Commit(updates=up("touch", a + "[cav]")), 150)
    assert s.head == 201 and s.rows.count() == 3 and s.live().count() == 2 and s.live(first).filter("caveat_name is null").count() == 2
    with pytest.raises(store.Conflict):
        s.commit(store.Commit(preconditions=[("gone", Filter(ids=("a",)), False)], updates=up("delete", a)))
    assert s.commit(store.Commit(delete=Filter(type="doc"), delete_limit=2), 300)[1:] == (2, True)
    assert s.live().count() == 0 and s.live(201).count() == 2
    assert {(r["rev"], r["op"]) for r in s.log.collect()} == {(100, "touch"), (201, "touch"), (300, "delete")}
    s.collect_garbage(250)
    assert s.live(250).count() == 2
    with pytest.raises(store.Conflict):
        s.live(100)


def test_revisions():
    assert store.resolve("full", 100, 0) == 100
    assert store.resolve("latency", 100, 57, quantum_ns=10) == 50
    assert store.resolve("fresh", 100, 57, at=70, quantum_ns=10) == 70
    assert store.resolve("exact", 100, 0, at=30) == 30
    for bad in ({"at": 200}, {"at": 3, "floor": 5}):
        with pytest.raises(store.Conflict):
            store.resolve("exact", 100, 0, **bad)


def test_watch(spark, tmp_path):
    s = store.Store(spark, "definition user {} caveat cav(a int) { a == 1 } definition doc { relation viewer: user | user with cav } definition team { relation viewer: user }")
    up = lambda op, *lines: spark.createDataFrame([(op, *tuples.parse_line(x)) for x in lines], "op string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TUPLES))
    s.commit(store.Commit(updates=up("touch", "doc:a#viewer@user:tom")), 10)
    s.commit(store.Commit(updates=up("touch", "team:a#viewer@user:tom")), 20)
    s.commit(store.Commit(updates=up("delete", "doc:a#viewer@user:tom")), 30)
    files.changelog(s.log, f"{tmp_path}/log")
    seen, marks = [], []

    def sink(changes, mark):
        seen.extend((r["rev"], r["op"]) for r in changes.collect())
        marks.extend(r["rev"] for r in mark.collect())

    for _ in range(2):  # the second run finds nothing new
        watch.watch(spark, f"{tmp_path}/log", f"{tmp_path}/cp", sink, after=0, types=("doc",)).awaitTermination()
    assert seen == [(10, "touch"), (30, "delete")] and marks == [30]
    assert watch.changes(s.log, 10).count() == 2
    assert [r["resource_type"] for r in watch.folded(s.log).collect()] == ["team"]
    with pytest.raises(watch.Gone):
        watch.changes(s.log, 5, floor=10)


def test_validation_files():
    text = """
schema: |-
  definition user {}
  definition doc { relation viewer: user }
relationships: |-
  doc:one#viewer@user:tom
  // a comment
assertions:
  assertTrue: ["doc:one#viewer@user:tom"]
  assertFalse: ["doc:one#viewer@user:amy"]
"""
    f = files.load_validation(text)
    assert len(f.relationships) == 1 and [a[2] for a in f.assertions] == ["member", "notMember"]
    for bad in (text + "\nnamespaces: x\n", text.replace("// a comment", "doc:one#viewer@user:tom"), text.replace("viewer@user:tom\n", "viewer\n", 1), "a: [", "- 1"):
        with pytest.raises(SchemaError):
            files.load_validation(bad)


def test_validation_files_with_a_schema_file(tmp_path):
    (tmp_path / "s.zed").write_text("definition user {} definition doc { relation viewer: user }")
    text = "schemaFile: s.zed\nrelationships: |-\n  doc:one#viewer@user:tom\n"
    assert len(files.load_validation(text, str(tmp_path)).relationships) == 1
    for bad, folder in ((text, None), (text + "schema: definition user {}\n", str(tmp_path)), (text.replace("s.zed", "../s.zed"), str(tmp_path / "x")), (text.replace("s.zed", "none"), str(tmp_path))):
        with pytest.raises(SchemaError):
            files.load_validation(bad, folder)


def test_a_check_reads_what_it_needs(spark):
    rows = filters.check_scan(relation(spark), "doc", "viewer", ("user", "tom", ELLIPSIS))
    assert sorted(r["subject_id"] for r in rows.collect()) == ["*", "eng", "tom"]
    assert rows.filter(F.col("subject_id") == "amy").count() == 0
