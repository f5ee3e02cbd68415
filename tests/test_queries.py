"""Every registered graph query against its SQL, over whole tables."""

import os

import pytest

from quiver import queries
from tests.helpers import bag, duck, ordered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    df = queries.run(spark, FOLDER, name)
    found = con.sql(queries.QUERIES[name].sql)
    assert sorted(df.columns) == sorted(found.columns)
    got, want = df.collect(), found.fetchall()
    assert bag(df.columns, got) == bag(found.columns, want)
    last = queries.QUERIES[name].text.rsplit("RETURN", 1)[-1]
    if " ORDER BY " in last:
        assert ordered(df.columns, got) == ordered(found.columns, want)


def test_union_mixed(spark, con):
    rows = queries.run(spark, FOLDER, "union_mixed").collect()
    assert len(rows) == con.sql("select count(*) from (select c_nationkey::varchar as x from customer union select s_nationkey::varchar from supplier union select n_name from nation)").fetchall()[0][0]
    assert {type(r.x.toPython()) for r in rows} == {int, str}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hub_hops(spark, con, monkeypatch):
    """Rows that multiply at a hub: tables that can't join aren't read, and each hub's rows go to many tasks."""
    from quiver.engine import Engine
    from quiver.operators import match

    df = queries.run(spark, FOLDER, "suggested_friends")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "customer.parquet" not in plan and "supplier.parquet" in plan
    monkeypatch.setattr(match, "HUB", 2)
    monkeypatch.setattr(match, "PAIRS", 50)
    cases = {
        "MATCH (a:Customer)-[r:LOCATED_IN]->(n)<-[:LOCATED_IN]-(b:Customer) WHERE a.c_acctbal < b.c_acctbal RETURN n.n_name AS n, a.c_custkey AS a, b.c_custkey AS b, r.c_nationkey AS k":
            "select n_name as n, a.c_custkey as a, b.c_custkey as b, n_nationkey as k from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_acctbal < b.c_acctbal join nation on n_nationkey = a.c_nationkey",
        "MATCH p = (a:Customer)-[:LOCATED_IN]->(n)<-[:LOCATED_IN]-(b) RETURN [x IN nodes(p) | labels(x)[0]] AS l, count(*) AS n":
            "select ['Customer', 'Nation', x.l] as l, count(*) as n from customer a join (select 'Customer' as l, c_custkey as k, c_nationkey as j from customer union all select 'Supplier', s_suppkey, s_nationkey from supplier) x on j = c_nationkey and not (x.l = 'Customer' and x.k = c_custkey) group by 1",
        "MATCH (a)-[:LOCATED_IN]->(n:Nation)<-[:LOCATED_IN]-(b:Supplier {s_suppkey: 3}) RETURN labels(a)[0] AS l, count(*) AS n":
            "select l, count(*) as n from (select 'Customer' as l, c_custkey as k, c_nationkey as j from customer union all select 'Supplier', s_suppkey, s_nationkey from supplier where s_suppkey <> 3) join supplier on s_suppkey = 3 and s_nationkey = j group by 1",
    }
    for text, sql in cases.items():
        df, found = Engine(queries.graph_of(spark, FOLDER)).run(text).df, con.sql(sql)
        assert bag(df.columns, df.collect()) == bag(found.columns, found.fetchall()), text
        assert ("REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()) is ("{" not in text)


def test_large_inputs_are_dealt_finely(spark, monkeypatch):
    """Shuffles get partitions by the size of the files; the session's own setting comes back."""
    from quiver.plans import planner

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    small = bag(["o", "p", "n"], queries.run(spark, FOLDER, "pair_multiplicity").collect())
    monkeypatch.setattr(planner, "LARGE", 1)
    monkeypatch.setattr(planner, "INPUT_BYTES", 10_000)
    df = queries.run(spark, FOLDER, "pair_multiplicity")
    n = int(spark.conf.get(name))
    assert n > 4 and f"{n}), ENSURE_REQUIREMENTS" in df._jdf.queryExecution().executedPlan().toString()
    assert bag(["o", "p", "n"], df.collect()) == small
    monkeypatch.undo()
    queries.run(spark, FOLDER, "pair_multiplicity")
    assert spark.conf.get(name, None) is None
