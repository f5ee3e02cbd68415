"""Expressions, clauses and errors on small graphs."""

import math

import pytest

from quiver.plans.ast import CypherError
from quiver.plans.parser import parse, split_statements
from tests.helpers import empty, one, rows


@pytest.fixture(scope="module")
def tree(spark):
    """A small tree: a root A, four X below it by two types, Y below those."""
    e = empty(spark)
    e.run("CREATE (a:A {name: 'a'}), (b1:X {name: 'b1'}), (b2:X {name: 'b2'}), (c11:X {name: 'c11'}), (c12:Y {name: 'c12'}), (a)-[:KNOWS]->(b1), (a)-[:FOLLOWS]->(b2), (b1)-[:FRIEND]->(c11), (b1)-[:FRIEND]->(c12), (b2)-[:FRIEND {since: 7}]->(c12)")
    return e


@pytest.fixture(scope="module")
def nothing(spark):
    return empty(spark)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1 + 2 * 3 ^ 2", 19.0), ("7 / 2", 3), ("-7 / 2", -3), ("7 % -4", 3), ("7 / 0", None), ("1.0 / 0", math.inf), ("'a' + 1", "a1"), ("[1] + 2", [1, 2]),
        ("1 = 1.0", True), ("1 = 'a'", False), ("1 < 'a'", None), ("null = null", None), ("[1, null] = [1, 2]", None), ("[1, 2] = [1]", False), ("[1] < [2]", True),
        ("0.0 / 0.0 > 1", False), ("1 < 2 < 3", True), ("1 IN []", False), ("null IN []", False), ("null IN [1]", None), ("3 IN [1, null]", None),
        ("true XOR null", None), ("false AND null", False), ("true OR null", True), ("NOT null", None), ("'abc' STARTS WITH 'a'", True), ("1 CONTAINS 'a'", None),
        ("[1, 2, 3][-1]", 3), ("[1, 2, 3][1..]", [2, 3]), ("[1, 2, 3][5]", None), ("{a: 1}.a", 1), ("{a: 1}['b']", None), ("'abc'[1..2]", "b"),
        ("all(x IN [] WHERE x > 1)", True), ("any(x IN [null, 2] WHERE x > 1)", True), ("none(x IN [null] WHERE x > 1)", None), ("single(x IN [1, 2] WHERE x > 1)", True),
        ("[x IN [1, 2, 3] WHERE x > 1 | x * 10]", [20, 30]), ("reduce(a = '', x IN ['p', 'q'] | a + x)", "pq"), ("CASE 3 WHEN 1 THEN 'a' WHEN 3 THEN 'b' END", "b"),
        ("CASE WHEN null THEN 1 ELSE 2 END", 2), ("0x1F + 0o17", 46), ("'\\u0041\\n'", "A\n"), ("coalesce(null, 2)", 2), ("size('äb')", 2), ("range(3, 1)", []), ("range(1, 6, 2)", [1, 3, 5]),
        ("toInteger('3.9')", 3), ("toInteger('x')", None), ("toFloat('1e2')", 100.0), ("toBoolean('tRue')", True), ("toString(1.5)", "1.5"), ("toStringList([1, null])", ["1", None]),
        ("substring('hello', -3)", "llo"), ("split('a.b', '.')", ["a", "b"]), ("btrim('xxaxx', 'x')", "a"), ("round(2.5)", 3.0), ("round(-2.5)", -2.0), ("round(1.249, 1, 'DOWN')", 1.2),
        ("sign(-3)", -1), ("haversin(0.0)", 0.0), ("valueType([1])", "LIST"), ("nullIf(1, 1)", None), ("normalize('e\\u0301', 'NFC')", "é"), ("isEmpty('')", True), ("tail([])", []),
        ("toString(duration({months: 1.5}))", "P1M15DT5H14M33S"), ("toString(date({year: 2020, month: 2}) + duration('P1M'))", "2020-03-01"), ("date('2020-02-30') IS NULL", CypherError),
        ("toString(datetime({year: 2000, hour: 5, timezone: 'Europe/Paris'}))", "2000-01-01T05:00+01:00[Europe/Paris]"), ("localtime('10:11:12.5').millisecond", 500),
        ("toString(duration.inSeconds(localtime('10:00'), localtime('11:30')))", "PT1H30M"), ("date.truncate('week', date('2020-02-29')) = date('2020-02-24')", True),
        ("duration('P1Y2M3W').months", 14), ("toString(date.truncate('year', date('1999-05-06'), {day: 5}))", "1999-01-05"), ("point({x: 1, y: 2}).crs", "cartesian"),
        ("distance(point({x: 0, y: 0}), point({x: 3, y: 4}))", 5.0), ("point({longitude: 190, latitude: 1}).longitude", -170.0), ("vector_distance([1, 2], [3, 4], 'MANHATTAN')", 4.0),
        ("vector.similarity.cosine([1, 0], [0, 1])", 0.5), ("vector_norm([3, 4], 'EUCLIDEAN')", 5.0), ("valueType(vector([1, 2], 2, 'FLOAT32'))", "VECTOR"),
    ],
)
def test_expression(nothing, text, value):
    if value is CypherError:
        with pytest.raises(CypherError):
            one(nothing, text)
        return
    found = one(nothing, text)
    assert found == value or (isinstance(value, float) and found == pytest.approx(value))


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("RETURN x", "UndefinedVariable"), ("MATCH (a) RETURN foo(a)", "UnknownFunction"), ("MATCH (a) WHERE count(a) > 1 RETURN a", "InvalidAggregation"),
        ("MATCH (a) RETURN a.x + count(*)", "AmbiguousAggregationExpression"), ("RETURN count(count(*))", "NestedAggregation"), ("MATCH (a) WITH a.x RETURN 1", "NoExpressionAlias"),
        ("RETURN 1 AS a, 2 AS a", "ColumnNameConflict"), ("MATCH ()-[r]->()-[r]->() RETURN 1", "RelationshipUniquenessViolation"), ("MATCH (a)-[a]->() RETURN 1", "VariableTypeConflict"),
        ("CREATE ()-[:A|B]->()", "NoSingleRelationshipType"), ("CREATE ()-[:A]-()", "RequiresDirectedRelationship"), ("CREATE ()-[:A*2]->()", "CreatingVarLength"),
        ("RETURN 1 LIMIT -1", "NegativeIntegerArgument"), ("RETURN 1 LIMIT 1.5", "InvalidArgumentType"), ("RETURN 9223372036854775808", "IntegerOverflow"), ("RETURN 1e999", "FloatingPointOverflow"),
        ("RETURN 1 AS a UNION RETURN 2 AS b", "DifferentColumnsInUnion"), ("RETURN 1 AS a UNION RETURN 2 AS a UNION ALL RETURN 3 AS a", "InvalidClauseComposition"),
        ("MATCH (a) RETURN", "UnexpectedSyntax"), ("UNWIND [1] AS x UNWIND [2] AS x RETURN x", "VariableAlreadyBound"), ("RETURN percentileCont(1, 2)", "NumberOutOfRange"),
        ("RETURN {a: 1}[1]", "MapElementAccessByNonString"), ("RETURN 'a'.b", "InvalidArgumentTypePropertyAccess"), ("CALL no.such()", "ProcedureNotFound"),
        ("MATCH (a) DELETE 1 + 1", "InvalidArgumentType"), ("MATCH (a) MATCH (b) WHERE (a)-->(c) RETURN a", "UndefinedVariable"), ("RETURN $x", "ParameterMissing"),
    ],
)
def test_error(nothing, text, code):
    with pytest.raises(CypherError) as e:
        nothing.run(text)
    assert e.value.code == code


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("MATCH (a:A)-[:KNOWS|FOLLOWS]->(b) RETURN b.name AS x", ["b1", "b2"]), ("MATCH (a:A)-[*2]->(c) RETURN c.name AS x", ["c11", "c12", "c12"]), ("MATCH (a:A)-[*0..1]->(c) RETURN c.name AS x", ["a", "b1", "b2"]),
        ("MATCH (x)<-[:FRIEND {since: 7}]-(y) RETURN y.name AS x", ["b2"]), ("MATCH (n:X|Y) WHERE NOT (n)-[:FRIEND]->() RETURN n.name AS x", ["c11", "c12"]), ("MATCH (n) WHERE n:X AND (n)--(:A) RETURN n.name AS x", ["b1", "b2"]),
        ("MATCH p = (a:A)-[*]->(y:Y) RETURN [n IN nodes(p) | n.name][1] AS x", ["b1", "b2"]), ("MATCH (c:Y)<-[:FRIEND]-(b)<-[r]-(a) RETURN type(r) AS x", ["FOLLOWS", "KNOWS"]),
        ("MATCH (b:X) OPTIONAL MATCH (b)-[:FRIEND]->(y:Y) RETURN b.name + coalesce(y.name, '-') AS x", ["b1c12", "b2c12", "c11-"]), ("MATCH (a)-[r]-(b:Y) RETURN a.name AS x", ["b1", "b2"]),
        ("MATCH (a:A) RETURN size([(a)-->(b)-->(c) | c.name]) AS x", [3]), ("MATCH (n) WITH n ORDER BY n.name DESC LIMIT 1 RETURN n.name AS x", ["c12"]), ("MATCH (n) WHERE EXISTS { (n)-->(m:X) WHERE m.name = 'c11' } RETURN n.name AS x", ["b1"]),
        ("MATCH (n) RETURN DISTINCT size(labels(n)) AS x", [1]), ("MATCH (a:A), (b:X {name: 'b1'}) RETURN a.name + b.name AS x", ["ab1"]), ("UNWIND ['a', 'zz'] AS k OPTIONAL MATCH (n {name: k}) RETURN n.name AS x", ["a", None]),
    ],
)
def test_match(tree, text, found):
    assert sorted((r[0] for r in rows(tree, text)), key=str) == sorted(found, key=str)


def test_self_loop_once(spark):
    e = empty(spark)
    e.run("CREATE (a:A)-[:LOOP]->(a)")
    assert rows(e, "MATCH (a)-[:LOOP]-(b) RETURN count(*) AS n") == [(1,)]


def test_writes(spark):
    e = empty(spark)
    assert e.run("CREATE (:P {k: 1, v: 'a'})-[:T {w: 2}]->(:P {k: 2})").stats == {"nodes_created": 2, "relationships_created": 1}
    e.run("UNWIND [2, 3, 3] AS k MERGE (p:P {k: k}) ON CREATE SET p.v = 'new' ON MATCH SET p.v = 'old'")
    assert sorted(rows(e, "MATCH (p:P) RETURN p.k AS k, p.v AS v")) == [(1, "a"), (2, "old"), (3, "new")]
    e.run("MATCH (p:P {k: 3}) SET p.v = null, p.z = 1.5, p:Q")
    assert rows(e, "MATCH (q:Q) RETURN q.v AS v, q.z AS z, labels(q) AS l") == [(None, 1.5, ["P", "Q"])]
    e.run("MATCH (q:Q) REMOVE q:Q SET q = {k: 9}")
    assert rows(e, "MATCH (p:P {k: 9}) RETURN p.z AS z, labels(p) AS l") == [(None, ["P"])]
    with pytest.raises(CypherError) as err:
        e.run("MATCH (p:P {k: 1}) DELETE p")
    assert err.value.code == "DeleteConnectedNode"
    e.run("MATCH (p:P {k: 1}) DETACH DELETE p")
    assert rows(e, "MATCH (p:P) RETURN count(p) AS n") == [(2,)]
    assert rows(e, "MATCH ()-[r]->() RETURN count(r) AS n") == [(0,)]
    with pytest.raises(CypherError):
        e.run("CREATE (:P {m: {a: 1}})")


def test_failed_write_changes_nothing(spark):
    e = empty(spark)
    e.run("CREATE (:P)-[:T]->(:P)")
    with pytest.raises(CypherError):
        e.run("CREATE (:Q) WITH 1 AS x MATCH (p:P) DELETE p")
    assert rows(e, "MATCH (q:Q) RETURN count(q) AS n") == [(0,)]


def test_procedures(spark):
    from dataclasses import replace

    from quiver.operators.procedures import Procedure

    e = empty(spark)
    data = spark.createDataFrame([("x", 1, "one"), ("x", 2, "two"), ("y", 1, "uno")], "name string, k bigint, out string")
    e.graph = replace(e.graph, procedures={"my.proc": Procedure((("name", "STRING"), ("k", "INTEGER")), (("out", "STRING"),), data)})
    assert rows(e, "CALL my.proc('x', 2) YIELD out RETURN out AS o") == [("two",)]
    assert rows(e, "UNWIND [1, 2] AS k CALL my.proc('x', k) YIELD out AS o WHERE o <> 'one' RETURN k, o") == [(2, "two")]
    with pytest.raises(CypherError):
        e.run("CALL my.proc(1, 2) YIELD out RETURN out")
    e.run("CREATE (:P {k: 1})-[:T {w: 1}]->(:P)")
    assert rows(e, "CALL db.index.createProperty('P', 'k')") == [(True, 1)]
    assert rows(e, "CALL db.index.createProperty('P', 'k', true)") == [(False, 0)]
    with pytest.raises(CypherError):
        e.run("CALL db.index.createProperty('P', 'k')")
    assert rows(e, "CALL db.index.propertyBuildJobs() YIELD schema, pending, indexedEntities RETURN schema, pending, indexedEntities") == [("P", False, 1)]
    assert rows(e, "CALL db.index.createEdgeProperty('T', 'w')") == [(True, 1)]
    assert rows(e, "CALL db.index.dropEdgeProperty('T', 'w')") == [(True, 1)]
    assert rows(e, "CALL db.index.processEdgeBuildJobs()") == [(0, 0)]


def test_explain_and_batch(spark):
    import json

    e = empty(spark)
    e.batch("CREATE (:P {k: 1}); CREATE (:P {k: 2}); ")
    plan = json.loads(rows(e, "EXPLAIN MATCH (p:P {k: 1}) RETURN count(*) AS n")[0][0])
    assert plan["counts"]["INDEX_SCAN"] == 1 and "MISSING_PROPERTY_INDEX" in plan["warnings"]
    assert json.loads(rows(e, "EXPLAIN CREATE (:P)")[0][0])["warnings"][0] == "WRITE_QUERY_DRY_RUN"
    assert rows(e, "MATCH (p:P) RETURN count(p) AS n") == [(2,)]
    assert json.loads(rows(e, "PROFILE MATCH (p:P) RETURN p.k AS k")[0][0])["profile"]["rows"] == 2


def test_parser():
    assert split_statements("RETURN ';' AS a; RETURN 2 AS b;") == ["RETURN ';' AS a", "RETURN 2 AS b"]
    assert parse("explain return 1 as a").mode == "explain"
    assert parse("MATCH (a)-[:R*..3]->(b) RETURN a").parts[0][0].paths[0].rels[0].high == 3


def test_walks_against_search(spark):
    """Bounded walks on a small random graph against depth-first search without repeated edges."""
    import random

    rng = random.Random(5)
    pairs = [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(12)]
    e = empty(spark)
    e.run("UNWIND range(0, 5) AS k CREATE (:N {k: k})")
    e.run("UNWIND $pairs AS p MATCH (a:N {k: p.a}), (b:N {k: p.b}) CREATE (a)-[:E]->(b)", {"pairs": [{"a": a, "b": b} for a, b in pairs]})

    def walks(at, used, left):
        yield at
        if left:
            for i, (a, b) in enumerate(pairs):
                if a == at and i not in used:
                    yield from walks(b, used | {i}, left - 1)

    want = sorted((a, b) for a in range(6) for b in walks(a, frozenset(), 3))
    assert sorted(rows(e, "MATCH (a:N)-[:E*0..3]->(b) RETURN a.k AS a, b.k AS b")) == want


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("UNWIND [3, 1, 2] AS x WITH x ORDER BY x RETURN collect(x) AS l", [([1, 2, 3],)]), ("UNWIND range(1, 200) AS x WITH x ORDER BY x DESC RETURN head(collect(x)) AS h", [(200,)]),
        ("UNWIND [3, 1, 2] AS x WITH x ORDER BY x DESC RETURN x AS x", [(3,), (2,), (1,)]), ("UNWIND [3, 1, 3, 2] AS x RETURN collect(DISTINCT x) AS l", [([3, 1, 2],)]),
        ("UNWIND [1, '1', 1.0, true, 1] AS x RETURN count(DISTINCT x) AS n", [(3,)]), ("UNWIND [1, '1', 1.0, null] AS x WITH DISTINCT x RETURN collect(valueType(x)) AS l, count(*) AS n", None),
        ("RETURN 1 = '1' AS a, [1, '1'][0] = [1, '1'][1] AS b, 1 IN ['1', 1.0] AS c, 1 IN ['1', 2] AS d", [(False, False, True, False)]),
        ("UNWIND [1, 'a', true, [1], null, 0.5] AS x WITH x ORDER BY x RETURN collect(toString(x)) AS l", [(["[1]", "a", "true", "0.5", "1"],)]),
        ("RETURN 1 AS x UNION RETURN 'a' AS x UNION RETURN 1 AS x", 2),
    ],
)
def test_order_and_mixed_values(nothing, text, found):
    got = rows(nothing, text)
    if isinstance(found, int):
        assert len(got) == found
    elif found is not None:
        assert got == found


def test_set_row_by_row(spark):
    e = empty(spark)
    e.run("CREATE (:C {v: 1}), (:C {v: 100})")
    assert rows(e, "MATCH (a:C) UNWIND [5, 6, 7] AS k SET a.v = a.v + k RETURN count(*) AS n") == [(6,)]
    assert sorted(rows(e, "MATCH (a:C) RETURN a.v AS v")) == [(19,), (118,)]
    e.run("MATCH (a:C) UNWIND [5, 6, 7] AS k WITH a, k ORDER BY k DESC SET a.w = k, a.u = a.v")
    assert sorted(rows(e, "MATCH (a:C) RETURN a.w AS w, a.u AS u")) == [(5, 19), (5, 118)]
    e.run("MATCH (a:C), (b:C) WHERE a.v < b.v SET a.x = b.v, b.x = 0")
    assert sorted(rows(e, "MATCH (a:C) RETURN a.x AS x")) == [(0,), (118,)]
    with pytest.raises(CypherError):
        e.run("MATCH (a:C) UNWIND range(1, 100) AS k SET a.v = a.v + k")


def test_walk_cap_warns(spark):
    e = empty(spark, walk_cap=5)
    e.run("UNWIND range(0, 9) AS k CREATE (:N {k: k})")
    e.run("MATCH (a:N), (b:N) WHERE a.k + 1 = b.k CREATE (a)-[:E]->(b)")
    r = e.run("MATCH (a:N {k: 0})-[:E*]->(b) RETURN count(b) AS n")
    assert r.df.collect()[0].n == 5 and any("WALK_CAP_REACHED" in w for w in r.warnings)
    r = e.run("MATCH (a:N {k: 6})-[:E*]->(b) RETURN count(b) AS n")
    assert r.df.collect()[0].n == 3 and not any("WALK_CAP_REACHED" in w for w in r.warnings)


def test_save_and_load(spark, tmp_path):
    from quiver.engine import Engine
    from quiver.graph import PropertyGraph

    e = empty(spark)
    e.run("CREATE (:P:Q {k: 1, t: date('2020-02-03')})-[:T {w: 1.5}]->(:P {k: 2, l: [1, 2]})")
    e.run("CALL db.index.createProperty('P', 'k')")
    e.graph.save(str(tmp_path / "g"))
    again = Engine(PropertyGraph.load(spark, str(tmp_path / "g")))
    q = "MATCH (a:Q)-[r:T]->(b) RETURN a.k AS k, toString(a.t) AS t, r.w AS w, b.l AS l, labels(a) AS x"
    assert rows(again, q) == rows(e, q) == [(1, "2020-02-03", 1.5, [1, 2], ["P", "Q"])]
    assert again.graph.indexes == e.graph.indexes
    again.run("CREATE (:P {k: 3})")
    assert rows(again, "MATCH (p:P) RETURN count(DISTINCT id(p)) AS n") == [(3,)]
    again.graph.validate()


def test_statistics_and_compaction(spark):
    e = empty(spark)
    for k in range(18):
        e.run("CREATE (:P {k: $k})", {"k": k})
    assert len(e.graph.nodes) == 1 and rows(e, "MATCH (p:P) RETURN count(DISTINCT id(p)) AS n, sum(p.k) AS s") == [(18, 153)]
    p = e.graph.property_stats().collect()
    assert [(r["name"], r["property"], r["present"], r["least"], r["greatest"]) for r in p] == [("P", "k", 18, "0", "17")]


def test_validate_finds_faults(spark):
    from quiver.graph import PropertyGraph

    people = spark.range(3).withColumnRenamed("id", "k")
    good = PropertyGraph(spark).with_nodes("P", people, "k").with_edges("T", people.selectExpr("k", "(k + 1) % 3 as j"), ("P", "k"), ("P", "j"), "k")
    good.validate()
    for bad in (good.with_edges("T", people.selectExpr("k", "k + 7 as j"), ("P", "k"), ("P", "j"), "k"), good.with_nodes("Q", people.union(people), "k"), good.with_nodes("Q", people.selectExpr("k + (1L << 48) as k"), "k")):
        with pytest.raises(ValueError):
            bad.validate()


def test_admin(spark, tmp_path):
    from quiver.admin import Session, scalar, with_indexes, write_rows

    e = empty(spark)
    e.graph = with_indexes(e.graph, '{"property_indexes": [{"tenant": "t", "schema": "P", "property": "k"}], "edge_property_indexes": [{"tenant": "t", "edge_type": "T", "property": "w"}]}')
    assert e.graph.indexes == (("vertex", "P", "k"), ("edge", "T", "w"))
    for bad in ("", "[]", '{"x": []}', '{"property_indexes": [{"schema": "P"}]}'):
        with pytest.raises(CypherError):
            with_indexes(e.graph, bad)
    s = Session(e)
    s.feed("SET k = 4")
    assert s.feed("LIST") == [{"k": 4}]
    s.feed("CREATE (:P {k: $k, z: 1}); MATCH (p:P {z: 1}) SET p.k = p.k + 1")
    (r,) = s.feed("MATCH (p:P {z: 1}) RETURN p.k AS k, [1] AS l")
    write_rows(r.df, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0].asDict() == {"k": "5", "l": "[1]"}
    s.prepare("q", "MATCH (p:P) WHERE p.k > $low RETURN count(p) AS n")
    assert s.execute("q", low=1).df.collect()[0].n == 1
    s.feed("UNSET k")
    with pytest.raises(CypherError):
        s.feed("RETURN $k AS k")
    assert s.metrics.statements["RETURN", "failed"] == 1 and s.metrics.unindexed(5)[0] == ("P", "z", 2)
    assert [scalar(x) for x in ("null", "true", "1.5", "'a b'", "x-y", "-3")] == [None, True, 1.5, "a b", "x-y", -3]


def test_explain_cost(spark):
    import json

    e = empty(spark)
    e.run("CREATE (:P {k: 1})-[:T]->(:P {k: 2})")
    plan = json.loads(rows(e, "EXPLAIN MATCH (p:P {k: $k})-[:T]->(q) RETURN q.k AS k", k=1)[0][0])
    assert plan["cost"]["total"] >= 1 and plan["cardinality"][0]["rows_out"] == 2 and plan["cardinality"][1]["join"] == "broadcast"
    assert {"MISSING_PROPERTY_INDEX", "ESTIMATE_ONLY_INDEX_SIGNAL"} <= set(plan["warnings"])
    assert "OPERATOR_MIXED_DOMAIN_RISK" in json.loads(rows(e, "EXPLAIN RETURN [1, 'a'] AS l")[0][0])["warnings"]
    assert "WRITE_QUERY_DRY_RUN" not in e.run("CREATE (:P)").warnings


def test_bound_relationships_lead(spark):
    """A pattern whose relationships are bound begins at them: no product with all nodes."""
    e = empty(spark)
    e.run("CREATE (a:P {k: 1})-[:T {w: 1}]->(b:P {k: 2})-[:T {w: 2}]->(c:Q {k: 3})-[:T {w: 3}]->(a), (c)-[:T {w: 4}]->(c), (d:P {k: 4})-[:U {w: 5}]->(a)")
    walks = "MATCH (a:P)-[rs:T*2..2]->(b) "
    cases = {
        walks + "MATCH (c)-[rs:T*2..2]->(d) RETURN a.k, b.k, c.k, d.k": [(1, 3, 1, 3), (2, 1, 2, 1), (2, 3, 2, 3)],
        walks + "MATCH (c)-[rs:T*]->(d) RETURN c.k, d.k": [(1, 3), (2, 1), (2, 3)],
        walks + "MATCH (c)-[rs:T*0..3]->(d:Q) RETURN c.k, d.k": [(1, 3), (2, 3)],
        walks + "MATCH (c)<-[rs:T*2..2]-(d) RETURN c.k, d.k": [],
        walks + "MATCH (c)-[rs:T*2..2]-(d) RETURN c.k, d.k": [(1, 3), (2, 1), (2, 3)],
        walks + "MATCH q = (c)-[rs:T*2..2]->(d) RETURN [x IN nodes(q) | x.k], size(rs)": [([1, 2, 3], 2), ([2, 3, 1], 2), ([2, 3, 3], 2)],
        walks + "MATCH (z)-[s]->(c)-[rs:T*2..2]->(d) WHERE z.k = 4 RETURN z.k, c.k, d.k": [(4, 1, 3)],
        "MATCH (d:P {k: 4}) MATCH (a:P {k: 1})-[rs:T*0..1]->(b) MATCH (c)-[rs:T*0..1]->(e) RETURN b.k, c.k, e.k": [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 2)],
        "MATCH (a:P)-[rs:T*1..1]-(b:Q) WITH rs, a MATCH (c)-[rs:T*1..1]-(d) RETURN a.k, c.k, d.k": [(1, 1, 3), (1, 3, 1), (2, 2, 3), (2, 3, 2)],
        "MATCH (a:P)-[r:T]->(b) MATCH (c:P)-[r:T]->(d) RETURN a.k, c.k, d.k": [(1, 1, 2), (2, 2, 3)],
        "MATCH (a:Q)-[r:T]->(b:Q) MATCH (c)-[r]-(d) RETURN c.k, d.k": [(3, 3)],
        "MATCH (a:P {k: 1})-[r:T]->(b) MATCH (c)-[r]-(d)-[s]->(f) RETURN c.k, d.k, f.k": [(1, 2, 3)],
    }
    found = {text: sorted(rows(e, text)) for text in cases}
    assert found == cases
    for text in list(cases)[:2] + list(cases)[9:]:
        plan = e.run(text).df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and not [x for x in plan.splitlines() if "Join Inner" in x and " = " not in x], text


def test_paths_carry_what_is_read(spark):
    e = empty(spark)
    e.run("CREATE (a:P {k: 1, t: 'long text'})-[:T {w: 1, u: 'other text'}]->(b:P {k: 2, t: 'x'})-[:T {w: 2}]->(c:P {k: 3})")
    plan = lambda text: e.run(text).df._jdf.queryExecution().analyzed().toString()
    lists = "RETURN length(p) AS n, [x IN nodes(p) | x.k] AS k, [r IN relationships(p) | r.w] AS w, size(relationships(p)) AS s"
    for pattern in ("p = (a)-[:T*1..2]->(b)", "p = (b)<-[:T*1..2]-(a)"):
        assert ", k, mid@k" in plan(f"MATCH {pattern} {lists}") and ", t, mid@t" not in plan(f"MATCH {pattern} {lists}")
        assert ", t, mid@t" in plan(f"MATCH {pattern} RETURN p")
    assert sorted(rows(e, f"MATCH p = (a)-[:T*1..2]->(b) {lists}")) == [(1, [1, 2], [1], 1), (1, [2, 3], [2], 1), (2, [1, 2, 3], [1, 2], 2)]
    assert sorted(rows(e, f"MATCH (b {{k: 3}}) MATCH p = (a)-[:T*1..2]->(b) {lists}")) == [(1, [2, 3], [2], 1), (2, [1, 2, 3], [1, 2], 2)]
    assert rows(e, f"MATCH p = (a {{k: 1}})-[r:T]->(b) {lists}, r.u AS u") == [(1, [1, 2], [1], 1, "other text")]
    assert rows(e, "MATCH p = (a {k: 1})-[:T]->(b) WITH p AS q, [x IN nodes(p) | x.k] AS k RETURN [x IN nodes(q) | x.t] AS t, k") == [(["long text", "x"], [1, 2])]
    assert rows(e, "MATCH p = (a {k: 1})-[:T]->(b) RETURN [x IN nodes(p) WHERE x.t = 'x' | x.k] AS k, [x IN nodes(p) | properties(x).t] AS t") == [([2], ["long text", "x"])]
