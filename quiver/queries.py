"""The registered graph queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quiver.engine import Engine
from quiver.graph import PropertyGraph
from quiver.sources.tables import commerce


@dataclass
class Entry:
    text: str
    sql: str | None
    params: dict[str, Any] = field(default_factory=dict)


QUERIES: dict[str, Entry] = {}


def add(name: str, text: str, sql: str | None, **params: Any) -> None:
    QUERIES[name] = Entry(text, sql, params)


add("flagship", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' RETURN c.c_mktsegment AS segment, count(o) AS orders, sum(o.o_totalprice) AS revenue ORDER BY revenue DESC LIMIT 5",
    "select c_mktsegment as segment, count(*) as orders, sum(o_totalprice) as revenue from customer join orders on c_custkey = o_custkey where o_orderstatus = 'F' group by 1 order by revenue desc limit 5")
# scans
add("scan_label", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name, c.c_acctbal AS bal", "select c_custkey as k, c_name as name, c_acctbal as bal from customer")
add("scan_all_labels_union", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", "select * from (select 'Customer' as label, count(*) as n from customer union all select 'Supplier', count(*) from supplier union all select 'Part', count(*) from part union all select 'Order', count(*) from orders union all select 'Nation', count(*) from nation union all select 'Region', count(*) from region union all select 'User', count(distinct user_id) from events union all select 'Event', count(*) from events union all select 'Vec', count(*) from embeddings union all select 'Doc', count(*) from documents union all select 'Page', count(*) from pages union all select 'Turn', count(*) from conversations)")
add("label_alternation", "MATCH (n:Customer|Supplier) RETURN n.c_custkey AS c, n.s_suppkey AS s", "select c_custkey as c, null::bigint as s from customer union all select null, s_suppkey from supplier")
add("label_negation", "MATCH (n:!Customer) WHERE n.c_custkey IS NULL AND n.r_regionkey IS NOT NULL RETURN n.r_name AS name", "select r_name as name from region")
add("label_case_insensitive", "MATCH (r:region) RETURN r.r_name AS name", "select r_name as name from region")
add("point_lookup", "MATCH (o:Order {o_orderkey: $k}) RETURN o.o_totalprice AS price", "select o_totalprice as price from orders where o_orderkey = 77", k=77)
add("label_predicate", "MATCH (n:Nation|Region) RETURN n:Nation AS is_nation, count(*) AS n", "select * from (select true as is_nation, count(*) as n from nation union all select false, count(*) from region)")
add("label_histogram", "MATCH (n) UNWIND labels(n) AS label RETURN label, count(*) AS n", QUERIES["scan_all_labels_union"].sql)
add("inline_prop_filter", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_mktsegment = 'BUILDING'")
# predicates
add("where_compare", "MATCH (o:Order) WHERE o.o_totalprice >= 1000 AND o.o_totalprice < 20000 AND o.o_orderstatus <> 'F' RETURN o.o_orderkey AS k", "select o_orderkey as k from orders where o_totalprice >= 1000 and o_totalprice < 20000 and o_orderstatus <> 'F'")
add("where_chained_compare", "MATCH (p:Part) WHERE 5 <= p.p_size < 10 RETURN p.p_partkey AS k", "select p_partkey as k from part where p_size >= 5 and p_size < 10")
add("where_and_or_xor_not", "MATCH (p:Part) WHERE (p.p_size > 40 XOR p.p_retailprice > 1500) AND NOT (p.p_brand = 'Brand#1' OR p.p_size = 45) RETURN p.p_partkey AS k", "select p_partkey as k from part where ((p_size > 40) <> (p_retailprice > 1500)) and not (p_brand = 'Brand#1' or p_size = 45)")
add("where_null_logic", "MATCH (n:Nation|Region) RETURN n.n_regionkey > 2 AS a, n.n_regionkey IS NULL AS b, (n.n_regionkey > 2 OR true) AS c, (n.n_regionkey > 2 AND null) AS d", "select n_regionkey > 2 as a, n_regionkey is null as b, true as c, (n_regionkey > 2 and null) as d from (select n_regionkey from nation union all select null from region)")
add("where_in_list", "MATCH (c:Customer) WHERE c.c_nationkey IN [1, 3, 5] OR c.c_custkey IN $keys RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_nationkey in (1, 3, 5) or c_custkey in (2, 4, 6)", keys=[2, 4, 6])
add("where_string_preds", "MATCH (c:Customer) WHERE c.c_name STARTS WITH 'Customer#0000' AND c.c_name CONTAINS '1' AND NOT c.c_name ENDS WITH '7' RETURN c.c_name AS name", "select c_name as name from customer where starts_with(c_name, 'Customer#0000') and contains(c_name, '1') and not ends_with(c_name, '7')")
add("params", "MATCH (o:Order) WHERE o.o_totalprice > $low AND o.o_orderpriority = $p RETURN count(*) AS n", "select count(*) as n from orders where o_totalprice > 100000 and o_orderpriority = '1-URGENT'", low=100000, p="1-URGENT")
# expansion
add("expand_out", "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_name AS name, o.o_orderkey AS k", "select c_name as name, o_orderkey as k from customer join orders on c_custkey = o_custkey")
add("expand_in", "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.c_acctbal < 0 RETURN o.o_orderkey AS k, c.c_custkey AS c", "select o_orderkey as k, c_custkey as c from orders join customer on c_custkey = o_custkey where c_acctbal < 0")
add("expand_undirected", 'MATCH (a:Part)-[:NEXT]-(b:Part) RETURN a.p_partkey AS a, b.p_partkey AS b', 'select s as a, t as b from (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) union all select t, s from (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1)')
add("expand_type_alternation", "MATCH (a)-[r:LOCATED_IN|PART_OF]->(b) RETURN type(r) AS t, count(*) AS n", "select * from (select 'LOCATED_IN' as t, (select count(*) from customer) + (select count(*) from supplier) as n union all select 'PART_OF', (select count(*) from nation))")
add("expand_edge_props", "MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE l.l_quantity > 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_extendedprice AS price", "select l_orderkey as o, l_partkey as p, l_extendedprice as price from lineitem where l_returnflag = 'R' and l_quantity > 45")
add("edge_between_types", "MATCH (a)-[r]->(b:Nation) RETURN type(r) AS t, count(r) AS n", "select 'LOCATED_IN' as t, (select count(*) from customer) + (select count(*) from supplier) as n")
add("edge_type_scan", "MATCH ()-[r:CONTAINS]->() RETURN count(r) AS n, sum(r.l_quantity) AS q", "select count(*) as n, sum(l_quantity) as q from lineitem")
add("distinct_edge_sources", 'MATCH (o)-[:CONTAINS]->() RETURN count(DISTINCT o) AS sources, count(*) AS edges', 'select count(distinct l_orderkey) as sources, count(*) as edges from lineitem')
add("pair_multiplicity", 'MATCH (o:Order)-[r:CONTAINS]->(p:Part) WITH o, p, count(r) AS n WHERE n > 1 RETURN o.o_orderkey AS o, p.p_partkey AS p, n', 'select l_orderkey as o, l_partkey as p, count(*) as n from lineitem group by 1, 2 having count(*) > 1')
add("undirected_both_bound", 'MATCH (a:Part)-[:NEXT]->(b:Part) MATCH (b)-[r:NEXT]-(a) RETURN a.p_partkey AS a, b.p_partkey AS b, r.next_key AS k', 'select s as a, t as b, t as k from (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1)')
add("two_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.p_size = 7 RETURN c.c_mktsegment AS seg, count(*) AS n, sum(l.l_quantity) AS q", "select c_mktsegment as seg, count(*) as n, sum(l_quantity) as q from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size = 7 group by 1")
add("three_hop_region", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:LOCATED_IN]->(n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, n.n_name AS nation, count(o) AS orders", "select r_name as region, n_name as nation, count(*) as orders from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2")
add("cycle_repeated_var", 'MATCH (o:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(o) RETURN o.o_orderkey AS o, count(*) AS n', 'select l_orderkey as o, sum(n * (n - 1))::bigint as n from (select l_orderkey, l_partkey, count(*) as n from lineitem group by all) group by 1 having sum(n * (n - 1)) > 0')
add("comma_join", "MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:LOCATED_IN]->(n:Nation) WHERE n.n_nationkey = 3 RETURN c.c_custkey AS c, o.o_orderkey AS o", "select c_custkey as c, o_orderkey as o from customer join orders on c_custkey = o_custkey where c_nationkey = 3")
add("cartesian", "MATCH (a:Region), (b:Nation) RETURN a.r_name AS r, b.n_name AS n", "select r_name as r, n_name as n from region, nation")
add("edge_uniqueness", 'MATCH (a:Part)-[:NEXT]-(b)-[:NEXT]-(c) RETURN a.p_partkey AS a, c.p_partkey AS c', 'select x.s as a, y.t as c from (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) x join (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) y on x.t = y.s union all select y.t, x.s from (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) x join (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) y on x.t = y.s')
NEXT_SQL = "(select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1)"
CHAIN_SQL = f"with recursive e as {NEXT_SQL}, " + "w as (select s, t, 1 as n from e union all select w.s, e.t, n + 1 from w join e on w.t = e.s where n < {high}) "
add("varlen_1_3", "MATCH (a:Part)-[:NEXT*1..3]->(b) RETURN a.p_partkey AS a, b.p_partkey AS b", CHAIN_SQL.format(high=3) + "select s as a, t as b from w")
add("varlen_0_2", 'MATCH (a:Part)-[:NEXT*0..2]->(b:Part) RETURN a.p_partkey AS a, b.p_partkey AS b', CHAIN_SQL.format(high=2) + "select s as a, t as b from w union all select p_partkey, p_partkey from part")
add("varlen_exact", 'MATCH (a:Part)-[:NEXT*4]->(b) RETURN a.p_partkey AS a, b.p_partkey AS b', CHAIN_SQL.format(high=4) + "select s as a, t as b from w where n = 4")
add("varlen_unbounded", 'MATCH (a:Turn)-[:REPLIED*]->(b:Turn) RETURN a.conv_id AS c, a.turn AS a, b.turn AS b', 'with recursive e as (select a.conv_id as c, a.turn as s, b.turn as t from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1), w as (select * from e union all select w.c, w.s, e.t from w join e on w.c = e.c and w.t = e.s) select c, s as a, t as b from w')
add("varlen_inverted", 'MATCH (p:Part) OPTIONAL MATCH (p)-[:NEXT*3..1]->(b) RETURN p.p_partkey AS p, count(b) AS n', 'select p_partkey as p, 0::bigint as n from part')
add("varlen_path_length", 'MATCH p = (a:Part)-[:NEXT*1..3]->(b:Part) RETURN length(p) AS n, [x IN nodes(p) | x.p_partkey] AS keys, size(relationships(p)) AS rels', CHAIN_SQL.format(high=3) + "select n::bigint as n, range(s, t + 1) as keys, n::bigint as rels from w")
add("varlen_list_var", 'MATCH (a:Part)-[rs:NEXT*2..2]->(b) RETURN a.p_partkey AS a, [r IN rs | r.next_key] AS keys', CHAIN_SQL.format(high=2) + "select s as a, [s + 1, t] as keys from w where n = 2")
add("varlen_rebound_list", 'MATCH (a:Part)-[rs:NEXT*2..2]->(b) MATCH (c)-[rs:NEXT*2..2]->(d) RETURN c.p_partkey AS c, d.p_partkey AS d', CHAIN_SQL.format(high=2) + "select s as c, t as d from w where n = 2")
add("varlen_undirected", 'MATCH (a:Part)-[:NEXT*1..2]-(b) RETURN a.p_partkey AS a, b.p_partkey AS b', CHAIN_SQL.format(high=2) + "select s as a, t as b from w union all select t, s from w")
add("named_path_nodes", 'MATCH p = (c:Customer)-[:LOCATED_IN]->(n:Nation) RETURN [x IN nodes(p) | labels(x)[0]] AS labels, [r IN relationships(p) | type(r)] AS types, c.c_custkey AS c, n.n_name AS n', "select ['Customer', 'Nation'] as labels, ['LOCATED_IN'] as types, c_custkey as c, n_name as n from customer join nation on n_nationkey = c_nationkey")
# optional, existence
add("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, count(o) AS n", "select c_custkey as c, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
add("optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "select c_custkey as c, o_orderkey as o from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000")
add("optional_two_hop", 'MATCH (p:Part) OPTIONAL MATCH (p)-[:NEXT]->(q)-[:NEXT]->(r) RETURN p.p_partkey AS p, q.p_partkey AS q, r.p_partkey AS r', 'select p_partkey as p, x.t as q, y.t as r from part left join ((select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) x join (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) y on x.t = y.s) on p_partkey = x.s')
add("optional_unmatched_chain", 'MATCH (p:Part) OPTIONAL MATCH (p)-[:NEXT]->(q) OPTIONAL MATCH (q)-[:NEXT]->(r) RETURN p.p_partkey AS p, q.p_partkey AS q, r.p_partkey AS r', 'select p_partkey as p, x.t as q, y.t as r from part left join (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) x on p_partkey = x.s left join (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) y on x.t = y.s')
add("match_from_null", 'MATCH (p:Part) OPTIONAL MATCH (p)-[:NEXT]->(q:Part) WHERE q.p_size > 25 WITH p, q MATCH (q)-[:NEXT]->(r) RETURN p.p_partkey AS p, r.p_partkey AS r', 'select x.s as p, y.t as r from (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) x join part q on q.p_partkey = x.t and q.p_size > 25 join (select a.p_partkey as s, b.p_partkey as t from part a join part b on b.p_partkey = a.p_partkey + 1) y on x.t = y.s')
add("exists_subquery", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 } RETURN c.c_custkey AS c", "select c_custkey as c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
add("exists_full_query", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN n } RETURN c.c_custkey AS c", "select o_custkey as c from orders join customer on c_custkey = o_custkey group by 1 having count(*) > 12")
add("not_exists_subquery", 'MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 } RETURN c.c_custkey AS c', 'select c_custkey as c from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)')
add("pattern_predicate", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS c", "select c_custkey as c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
add("pattern_predicate_or", "MATCH (c:Customer) WHERE c.c_acctbal > 9000 OR (c)-[:PLACED]->(:Order {o_orderpriority: '1-URGENT'}) RETURN c.c_custkey AS c", "select c_custkey as c from customer where c_acctbal > 9000 or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
add("not_pattern_antijoin", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {o_orderpriority: '1-URGENT'}) RETURN c.c_custkey AS c", "select c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
add("anti_probe_two_vars", 'MATCH (a:Nation), (b:Nation) WHERE NOT (a)-[:PART_OF]->(:Region)<-[:PART_OF]-(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b', 'select a.n_nationkey as a, b.n_nationkey as b from nation a, nation b where a.n_regionkey <> b.n_regionkey or a.n_nationkey = b.n_nationkey')
add("theta_join", 'MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND abs(a.n_nationkey - b.n_nationkey) <= 10 AND a.n_nationkey < b.n_nationkey RETURN a.n_name AS a, b.n_name AS b', 'select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and abs(a.n_nationkey - b.n_nationkey) <= 10 and a.n_nationkey < b.n_nationkey')
add("pattern_comprehension_size", "MATCH (c:Customer) RETURN c.c_custkey AS c, size([(c)-[:PLACED]->(o) | 1]) AS n", "select c_custkey as c, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
add("pattern_comprehension_where", "MATCH (r:Region) RETURN r.r_name AS r, size([(r)<-[:PART_OF]-(n:Nation) WHERE n.n_nationkey > 10 | n.n_name]) AS n", "select r_name as r, count(n_nationkey) as n from region left join nation on n_regionkey = r_regionkey and n_nationkey > 10 group by 1")
# projection
add("project_alias", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_retailprice * 2 + 1 AS x, p.p_size % 7 AS m, p.p_size / 4 AS d, -p.p_size AS neg, 2 ^ 3 AS pow", "select p_partkey as k, p_retailprice * 2 + 1 as x, p_size % 7 as m, p_size // 4 as d, -p_size as neg, 8.0::double as pow from part")
add("distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s, c.c_nationkey AS n", "select distinct c_mktsegment as s, c_nationkey as n from customer")
add("distinct_mixed", 'MATCH (c:Customer) UNWIND [c.c_nationkey, toString(c.c_nationkey), 1.0 * c.c_nationkey, c.c_nationkey + 0.5, c.c_nationkey > 3] AS x WITH DISTINCT x RETURN valueType(x) AS t, toString(x) AS s', "select distinct t, s from (select 'INTEGER' as t, c_nationkey::varchar as s from customer union all select 'STRING', c_nationkey::varchar from customer union all select 'FLOAT', (c_nationkey + 0.5)::varchar from customer union all select 'BOOLEAN', (c_nationkey > 3)::varchar from customer)")
add("return_star", 'MATCH (n:Nation) WITH n.n_name AS a, n.n_nationkey AS b RETURN *', 'select n_name as a, n_nationkey as b from nation')
add("unwind_list", 'MATCH (n:Nation) UNWIND [n.n_nationkey, n.n_regionkey, 2, null] AS x RETURN n.n_name AS name, x AS x, x * 10 AS y', 'select n_name as name, x, x * 10 as y from nation, lateral (select unnest([n_nationkey, n_regionkey, 2, null]) as x)')
add("unwind_range", 'MATCH (p:Part) UNWIND range(0, p.p_size, 10) AS x UNWIND [x, x + 1] AS y RETURN p.p_partkey AS k, x AS x, y AS y', 'select k, x, unnest([x, x + 1]) as y from (select p_partkey as k, unnest(range(0, p_size + 1, 10)) as x from part)')
add("unwind_param_match", "UNWIND $rows AS row MATCH (c:Customer {c_custkey: row.k}) RETURN c.c_name AS name, row.tag AS tag", "select c_name as name, tag from customer join (values (1, 'a'), (2, 'b')) t(k, tag) on c_custkey = k", rows=[{"k": 1, "tag": "a"}, {"k": 2, "tag": "b"}])
add("with_having", "MATCH (o:Order) WITH o.o_custkey AS c, count(*) AS n WHERE n > 12 RETURN c, n", "select o_custkey as c, count(*) as n from orders group by 1 having count(*) > 12")
add("with_order_limit_where", "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k LIMIT 10 WHERE k % 2 = 0 RETURN k, b", "select * from (select c_custkey as k, c_acctbal as b from customer order by 2 desc, 1 limit 10) where k % 2 = 0")
add("with_forward_match", "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20 MATCH (c)-[:PLACED]->(o) RETURN c.c_custkey AS c, count(o) AS n", "select c_custkey as c, count(*) as n from (select c_custkey from customer order by c_acctbal desc, c_custkey limit 20) join orders on o_custkey = c_custkey group by 1")
add("with_where_old_scope", "MATCH (c:Customer) WITH c.c_name AS name WHERE c.c_acctbal > 9500 RETURN name", "select c_name as name from customer where c_acctbal > 9500")
add("with_all_aggregate_where", 'MATCH (c:Customer) WITH count(*) AS n WHERE n > 100000000 RETURN n UNION ALL MATCH (s:Supplier) WITH count(*) AS n WHERE n > 0 RETURN n', 'select count(*) as n from supplier')
# aggregation
add("agg_count_star", "MATCH (c:Customer) RETURN count(*) AS n", "select count(*) as n from customer")
add("agg_count_distinct", "MATCH (o:Order) RETURN count(DISTINCT o.o_custkey) AS c, count(DISTINCT o.o_orderpriority) AS p, count(o) AS n", "select count(distinct o_custkey) as c, count(distinct o_orderpriority) as p, count(*) as n from orders")
add("agg_count_distinct_star", 'MATCH (o:Order) WITH o.o_custkey AS c, o.o_orderstatus AS s RETURN count(DISTINCT *) AS n', 'select count(*) as n from (select distinct o_custkey, o_orderstatus from orders)')
add("group_mixed", 'MATCH (p:Part) UNWIND [p.p_size, toString(p.p_size), p.p_brand] AS x RETURN valueType(x) AS t, toString(x) AS s, count(*) AS n, count(DISTINCT x) AS one', "select t, s, count(*) as n, 1::bigint as one from (select 'INTEGER' as t, p_size::varchar as s from part union all select 'STRING', p_size::varchar from part union all select 'STRING', p_brand from part) group by 1, 2")
add("group_mixed_key", 'MATCH (p:Part) UNWIND [p.p_size, toString(p.p_size), p.p_brand] AS x WITH x, count(*) AS n, count(DISTINCT x) AS one RETURN valueType(x) AS t, toString(x) AS s, n, one', "select t, s, count(*) as n, 1::bigint as one from (select 'INTEGER' as t, p_size::varchar as s from part union all select 'STRING', p_size::varchar from part union all select 'STRING', p_brand from part) group by 1, 2")
add("agg_sum_avg_min_max", "MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN l.l_returnflag AS f, l.l_linestatus AS s, sum(l.l_quantity) AS q, avg(l.l_discount) AS d, min(l.l_shipdate) AS lo, max(l.l_extendedprice) AS hi", "select l_returnflag as f, l_linestatus as s, sum(l_quantity) as q, avg(l_discount) as d, min(l_shipdate) as lo, max(l_extendedprice) as hi from lineitem group by 1, 2")
add("agg_sum_distinct", "MATCH (p:Part) RETURN sum(DISTINCT p.p_size) AS s, avg(DISTINCT p.p_size) AS a", "select sum(distinct p_size)::bigint as s, avg(distinct p_size) as a from part")
add("agg_stdev", "MATCH (p:Part) RETURN p.p_brand AS b, stDev(p.p_size) AS s, stDevP(p.p_size) AS sp", "select p_brand as b, stddev_samp(p_size) as s, stddev_pop(p_size) as sp from part group by 1")
add("agg_percentile_cont_disc", "MATCH (o:Order) RETURN o.o_orderpriority AS p, percentileCont(o.o_totalprice, 0.4) AS c, percentileDisc(o.o_totalprice, 0.4) AS d", "select o_orderpriority as p, quantile_cont(o_totalprice, 0.4) as c, quantile_disc(o_totalprice, 0.4) as d from orders group by 1")
add("agg_collect", "MATCH (n:Nation)-[:PART_OF]->(r:Region) WITH r.r_name AS r, collect(n.n_nationkey) AS l UNWIND l AS x WITH r, x ORDER BY x RETURN r, size(collect(DISTINCT x)) AS n, sum(x) AS s", "select r_name as r, count(distinct n_nationkey) as n, sum(n_nationkey)::bigint as s from nation join region on r_regionkey = n_regionkey group by 1")
add("collect_ordered", 'MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey RETURN c.c_mktsegment AS s, collect(c.c_custkey) AS keys, head(collect(c.c_acctbal)) AS top', 'select c_mktsegment as s, list(c_custkey order by c_acctbal desc, c_custkey) as keys, max(c_acctbal) as top from customer group by 1')
add("collect_ordered_distinct", 'MATCH (o:Order) WITH o ORDER BY o.o_orderdate, o.o_orderkey WITH o WHERE o.o_totalprice > 1000 RETURN o.o_orderstatus AS s, last(collect(o.o_orderkey)) AS newest, collect(DISTINCT o.o_orderpriority) AS seen', 'select s, arg_max(k, (d, k)) as newest, (select list(p order by f) from (select o_orderpriority as p, min((o_orderdate, o_orderkey)) as f from orders where o_totalprice > 1000 and o_orderstatus = s group by 1)) as seen from (select o_orderstatus as s, o_orderkey as k, o_orderdate as d from orders where o_totalprice > 1000) group by s')
add("collect_after_match", 'MATCH (c:Customer) WITH c ORDER BY c.c_name DESC MATCH (c)-[:LOCATED_IN]->(n:Nation) RETURN n.n_name AS n, collect(c.c_name) AS names', 'select n_name as n, list(c_name order by c_name desc) as names from customer join nation on n_nationkey = c_nationkey group by 1')
add("agg_nested_expr", "MATCH (o:Order) RETURN o.o_orderstatus AS s, 1.0 * sum(o.o_totalprice) / count(*) AS mean, count(*) + 1 AS n", "select o_orderstatus as s, sum(o_totalprice) / count(*) as mean, count(*) + 1 as n from orders group by 1")
add("agg_empty_input", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, sum(c.c_acctbal) AS s, size(collect(c.c_name)) AS l, max(c.c_name) AS m", "select 0::bigint as n, null::double as s, 0::bigint as l, null::varchar as m")
add("agg_entity_key", "MATCH (n:Nation)<-[:LOCATED_IN]-(c:Customer) WITH n, count(c) AS k RETURN n.n_name AS n, k", "select n_name as n, count(*) as k from nation join customer on c_nationkey = n_nationkey group by 1")
# order, paging
add("order_nulls", 'MATCH (n:Nation|Region) WITH coalesce(n.n_name, n.r_name) AS name, n.n_regionkey AS x ORDER BY x DESC, name LIMIT 9 RETURN collect(name) AS names, collect(x) AS keys', 'select list(name order by x desc nulls first, name) as names, list(x order by x desc nulls first, name) filter (x is not null) as keys from (select * from (select n_name as name, n_regionkey as x from nation union all select r_name, null from region) order by x desc nulls first, name limit 9)')
add("order_multi", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_mktsegment AS s ORDER BY s ASC, c.c_acctbal DESC, k LIMIT 25", "select c_custkey as k, c_mktsegment as s from customer order by s, c_acctbal desc, k limit 25")
add("order_mixed", 'MATCH (n:Nation) UNWIND [n.n_regionkey, n.n_name, n.n_nationkey > 20] AS x WITH DISTINCT x ORDER BY x RETURN collect(toString(x)) AS l', 'select list(s order by r, s) as l from (select distinct r, s from (select 1 as r, n_name as s from nation union all select 2, (n_nationkey > 20)::varchar from nation union all select 3, n_regionkey::varchar from nation))')
add("order_temporal", 'MATCH (o:Order) WITH o ORDER BY date(o.o_orderdate) DESC, o.o_orderkey LIMIT 40 RETURN collect(o.o_orderkey) AS keys', 'select list(o_orderkey order by o_orderdate::date desc, o_orderkey) as keys from (select * from orders order by o_orderdate::date desc, o_orderkey limit 40)')
add("order_lists", 'MATCH (p:Part) WITH p ORDER BY [p.p_size, p.p_partkey] DESC LIMIT 30 RETURN collect(p.p_partkey) AS keys', 'select list(p_partkey order by p_size desc, p_partkey desc) as keys from (select * from part order by p_size desc, p_partkey desc limit 30)')
add("order_by_aggregate", "MATCH (o:Order) RETURN o.o_custkey AS c, count(*) AS n ORDER BY count(*) * 2 DESC, c LIMIT 7", "select o_custkey as c, count(*) as n from orders group by 1 order by n desc, c limit 7")
add("skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY k SKIP 5 LIMIT $n", "select o_orderkey as k from orders order by k limit 10 offset 5", n=10)
add("topk", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "select o_orderkey as k, o_totalprice as p from orders order by p desc, k limit 10")
add("limit_zero", "MATCH (o:Order) RETURN o.o_orderkey AS k LIMIT 0", "select o_orderkey as k from orders limit 0")
# set operations
add("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "select c_nationkey as n from customer union select s_nationkey from supplier")
add("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "select c_nationkey as n from customer union all select s_nationkey from supplier")
add("union_mixed", 'MATCH (c:Customer) RETURN c.c_nationkey AS x UNION MATCH (n:Nation) RETURN n.n_name AS x UNION MATCH (s:Supplier) RETURN s.s_nationkey AS x', None)
# expressions
add("case_simple", "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n", "select case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'part' end as s, count(*) as n from orders group by 1")
add("case_searched", "MATCH (c:Customer) RETURN c.c_custkey AS k, CASE WHEN c.c_acctbal < 0 THEN -1 WHEN c.c_acctbal > 5000 THEN 1.5 END AS x", "select c_custkey as k, case when c_acctbal < 0 then -1.0::double when c_acctbal > 5000 then 1.5::double end as x from customer")
add("list_comprehension", 'MATCH (p:Part) RETURN p.p_partkey AS k, [x IN range(1, p.p_size) WHERE x % 10 = 0 | x * x] AS l', 'select p_partkey as k, list_transform(list_filter(range(1, p_size + 1), lambda x: x % 10 = 0), lambda x: x * x) as l from part')
add("list_quantifiers", "MATCH (p:Part) WITH p, [p.p_size, 10, 20] AS l RETURN p.p_partkey AS k, all(x IN l WHERE x > 5) AS a, any(x IN l WHERE x > 40) AS b, none(x IN l WHERE x = 20) AS c, single(x IN l WHERE x = 10) AS d", "select p_partkey as k, p_size > 5 as a, p_size > 40 as b, false as c, p_size <> 10 as d from part")
add("compare_exact_integers", 'MATCH (p:Part) WHERE p.p_partkey + 9007199254740992 = 9007199254740993 OR p.p_partkey + 9007199254740992 > 9007199254740994 RETURN p.p_partkey AS k', 'select p_partkey as k from part where p_partkey = 1 or p_partkey > 2')
add("compare_nan", 'MATCH (p:Part) WITH p, 0.0 / (p.p_size - p.p_size) AS x RETURN p.p_partkey AS k, x > 1 AS a, x = x AS b, x <> x AS c, isNaN(x) AS d', 'select p_partkey as k, false as a, false as b, true as c, true as d from part')
add("compare_lists", 'MATCH (p:Part) RETURN p.p_partkey AS k, [p.p_size, null] = [7, 2] AS a, [p.p_size, 1] < [20, 0] AS b, [p.p_size] = [p.p_size, 1] AS c, {a: p.p_size, b: null} = {a: 7, b: 1} AS d', 'select p_partkey as k, case when p_size <> 7 then false end as a, p_size < 20 as b, false as c, case when p_size <> 7 then false end as d from part')
add("compare_mixed", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size IN ['7', 8.0, true] AS a, [p.p_size, 'x'][0] = toString(p.p_size) AS b, [p.p_size, 'x'][0] = 1.0 * p.p_size AS c", 'select p_partkey as k, p_size = 8 as a, false as b, true as c from part')
add("list_reduce", 'MATCH (p:Part) RETURN p.p_partkey AS k, reduce(s = 0, x IN range(1, p.p_size) | s + x) AS s', 'select p_partkey as k, (p_size * (p_size + 1)) // 2 as s from part')
add("list_slice_index", 'MATCH (p:Part) WITH p, [p.p_size, 2, 3, 4, p.p_size + 1] AS l RETURN p.p_partkey AS k, l[0] AS a, l[-1] AS b, l[9] AS c, l[1..3] AS d, l[-2..] AS e, l[..2] AS f, [0] + l[..1] + 9 AS g, 3 IN l AS h, 7 IN l AS i', 'select p_partkey as k, p_size as a, p_size + 1 as b, null::int as c, [2, 3] as d, [4, p_size + 1] as e, [p_size, 2] as f, [0, p_size, 9] as g, true as h, p_size in (6, 7) as i from part')
add("map_literal", "MATCH (r:Region) WITH {name: r.r_name, k: r.r_regionkey} AS m RETURN m.name AS a, m['k'] AS b, m.missing AS c, keys(m) AS d", "select r_name as a, r_regionkey as b, null::varchar as c, ['k', 'name'] as d from region")
# functions
add("fn_string", "MATCH (c:Customer) RETURN toUpper(c.c_name) AS a, left(c.c_name, 3) AS b, right(c.c_name, 4) AS c, replace(c.c_name, '0', '-') AS d, substring(c.c_name, 2, 4) AS e, split(c.c_name, '#') AS f, reverse(c.c_name) AS g, size(c.c_name) AS h, trim('  x ') AS i, char_length(c.c_mktsegment) AS j", "select upper(c_name) as a, left(c_name, 3) as b, right(c_name, 4) as c, replace(c_name, '0', '-') as d, substr(c_name, 3, 4) as e, string_split(c_name, '#') as f, reverse(c_name) as g, length(c_name) as h, 'x' as i, length(c_mktsegment) as j from customer")
add("fn_string_more", "MATCH (c:Customer) RETURN c.c_custkey AS k, lower(c.c_name) AS a, upper(c.c_name) AS b, ltrim('  ' + c.c_name) AS c, rtrim(c.c_name + '  ') AS d, character_length(c.c_name) AS e, btrim('##' + c.c_name + '#', '#') AS f, normalize(c.c_name) AS g", 'select c_custkey as k, lower(c_name) as a, upper(c_name) as b, c_name as c, c_name as d, length(c_name) as e, c_name as f, c_name as g from customer')
add("fn_string_docs", "MATCH (d:Doc) RETURN d.doc_id AS k, size(d.text) AS n, toLower(left(d.text, 20)) AS head, size(split(d.text, ' ')) AS words", "select doc_id as k, length(text) as n, lower(left(text, 20)) as head, len(string_split(text, ' ')) as words from documents")
add("fn_math", "MATCH (p:Part) RETURN p.p_partkey AS k, abs(-p.p_size) AS a, ceil(p.p_retailprice) AS b, floor(p.p_retailprice) AS c, round(p.p_retailprice) AS d, round(p.p_retailprice, 1) AS e, sign(p.p_size - 20) AS f, sqrt(p.p_size) AS g, exp(0) AS h, log10(p.p_size + 1) AS i, atan2(p.p_size, 2) AS j, degrees(pi()) AS l", "select p_partkey as k, abs(-p_size) as a, ceil(p_retailprice)::double as b, floor(p_retailprice)::double as c, floor(p_retailprice + 0.5)::double as d, floor(p_retailprice * 10 + 0.5) / 10 as e, sign(p_size - 20)::bigint as f, sqrt(p_size) as g, 1.0::double as h, log10(p_size + 1) as i, atan2(p_size, 2) as j, degrees(pi()) as l from part")
add("fn_trig", 'MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 100.0 AS x RETURN k, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(asin(x), 9) AS d, round(acos(x), 9) AS e, round(atan(x), 9) AS f, round(cot(x + 1), 9) AS g, round(log(x + 1), 9) AS h, round(ln(x + 1), 9) AS i, round(radians(x), 9) AS j, round(haversin(x), 9) AS l', 'select k, floor(sin(x) * 1e9 + 0.5) / 1e9 as a, floor(cos(x) * 1e9 + 0.5) / 1e9 as b, floor(tan(x) * 1e9 + 0.5) / 1e9 as c, floor(asin(x) * 1e9 + 0.5) / 1e9 as d, floor(acos(x) * 1e9 + 0.5) / 1e9 as e, floor(atan(x) * 1e9 + 0.5) / 1e9 as f, floor(cot(x + 1) * 1e9 + 0.5) / 1e9 as g, floor(ln(x + 1) * 1e9 + 0.5) / 1e9 as h, floor(ln(x + 1) * 1e9 + 0.5) / 1e9 as i, floor(radians(x) * 1e9 + 0.5) / 1e9 as j, floor((1 - cos(x)) / 2 * 1e9 + 0.5) / 1e9 as l from (select p_partkey as k, p_size / 100.0::double as x from part)')
add("fn_convert", 'MATCH (c:Customer) WITH c.c_custkey AS k, right(c.c_name, 4) AS s, c.c_mktsegment AS w RETURN k, toInteger(s) AS i, toFloat(s) AS f, toInteger(w) AS n, toBoolean(toString(k % 2 = 0)) AS b, toString(toInteger(s)) AS t, toIntegerOrNull(w) AS o, valueType(s) AS v', "select c_custkey as k, right(c_name, 4)::bigint as i, right(c_name, 4)::double as f, null::bigint as n, c_custkey % 2 = 0 as b, right(c_name, 4)::bigint::varchar as t, null::bigint as o, 'STRING' as v from customer")
add("fn_convert_lists", "MATCH (c:Customer) WITH c, [right(c.c_name, 2), 'x', 'true'] AS l RETURN c.c_custkey AS k, toIntegerList(l) AS a, toFloatList(l) AS b, toBooleanList(l) AS d, toStringOrNull(c.c_custkey) AS e, toFloatOrNull(c.c_mktsegment) AS f, toBooleanOrNull('false') AS g, exists(c.c_name) AS h, exists(c.nothing) AS i, isNaN(c.c_acctbal) AS j", 'select c_custkey as k, [right(c_name, 2)::bigint, null, null] as a, [right(c_name, 2)::double, null, null] as b, [null, null, true] as d, c_custkey::varchar as e, null::double as f, false as g, true as h, false as i, false as j from customer')
add("fn_list", 'MATCH (p:Part) WITH p, [p.p_size, 1, 2] AS l RETURN p.p_partkey AS k, head(l) AS a, last(l) AS b, tail(l) AS c, size(l) AS d, reverse(l) AS e, isEmpty(l) AS f, coalesce(null, l[7], l[0]) AS g, range(p.p_size, 1, -9) AS h, toStringList(l) AS i, nullIf(p.p_size, 7) AS j', "select p_partkey as k, p_size as a, 2 as b, [1, 2] as c, 3 as d, [2, 1, p_size] as e, false as f, p_size as g, range(p_size, 0, -9) as h, [p_size::varchar, '1', '2'] as i, nullif(p_size, 7) as j from part")
add("fn_entity", "MATCH (n:Nation)-[r:PART_OF]->(g:Region) RETURN type(r) AS t, labels(n) AS l, keys(g) AS k, properties(g).r_name AS p, startNode(r).n_name AS s, endNode(r).r_name AS e, elementId(g) = toString(id(g)) AS same", "select 'PART_OF' as t, ['Nation'] as l, ['r_name', 'r_regionkey'] as k, r_name as p, n_name as s, r_name as e, true as same from nation join region on r_regionkey = n_regionkey")
add("fn_temporal_parts", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_orderdate.year AS y, o.o_orderdate.month AS m, o.o_orderdate.day AS d, o.o_orderdate.quarter AS q, o.o_orderdate.week AS w, o.o_orderdate.ordinalDay AS od, o.o_orderdate.weekDay AS wd, toString(date(o.o_orderdate)) AS s", "select o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, weekofyear(o_orderdate) as w, dayofyear(o_orderdate) as od, isodow(o_orderdate) as wd, strftime(o_orderdate, '%Y-%m-%d') as s from orders")
add("fn_temporal_trunc", "MATCH (o:Order) RETURN date.truncate('month', o.o_orderdate) AS m, date.truncate('decade', o.o_orderdate) AS d, count(*) AS n", "select date_trunc('month', o_orderdate)::date as m, make_date(((year(o_orderdate) // 10) * 10)::bigint, 1, 1) as d, count(*) as n from orders group by 1, 2")
add("fn_duration_between", "MATCH (o:Order) WITH o, duration.inDays(o.o_orderdate, localdatetime('1999-01-01')) AS d RETURN o.o_orderkey AS k, d.days AS days, toString(date(o.o_orderdate) + duration('P1M2D')) AS later", "select o_orderkey as k, case when o_orderdate <= timestamp '1999-01-01' then (epoch_us(timestamp '1999-01-01' - o_orderdate) // 86400000000) else -(epoch_us(o_orderdate - timestamp '1999-01-01') // 86400000000) end as days, strftime(o_orderdate::date + interval 1 month + interval 2 day, '%Y-%m-%d') as later from orders")
add("fn_temporal_epoch", "MATCH (o:Order) WITH o.o_orderkey AS k, datetime.fromEpoch(o.o_orderkey * 1000, 0) AS a, datetime.fromEpochMillis(o.o_orderkey * 1000000) AS b, date(o.o_orderdate) AS d RETURN k, a.epochSeconds AS s, b.epochMillis AS m, a = b AS same, duration.inMonths(date('1990-01-15'), d).months AS months, duration_between(date('1990-01-15'), d).months AS whole, toString(local_datetime('2001-02-03T04:05')) AS l, toString(zoned_time('10:00+02:00')) AS z", "select o_orderkey as k, o_orderkey * 1000 as s, o_orderkey * 1000000 as m, true as same, datesub('month', date '1990-01-15', o_orderdate::date) as months, datesub('month', date '1990-01-15', o_orderdate::date) as whole, '2001-02-03T04:05' as l, '10:00+02:00' as z from orders")
add("fn_clock", "MATCH (n:Nation) RETURN n.n_nationkey AS k, date() >= date('2020-01-01') AS a, localdatetime.realtime() > localdatetime('2020-01-01') AS b, timestamp() > 1577836800000 AS c, datetime().epochSeconds > 1577836800 AS d", 'select n_nationkey as k, true as a, true as b, true as c, true as d from nation')
add("fn_temporal_literals", "MATCH (o:Order) WITH o.o_orderkey AS k, o.o_orderdate AS d WITH k, d, date({year: d.year, month: d.month, day: d.day}) AS x RETURN k, toString(x) AS a, toString(date({year: d.year, ordinalDay: d.ordinalDay})) AS b, toString(date(toString(x)) + duration('P14D')) AS c, toString(localdatetime({year: d.year, month: d.month, day: d.day, hour: 7, minute: 5})) AS e, datetime({year: d.year, month: d.month, day: d.day}).epochSeconds AS f, toString(duration({days: d.day, hours: 3})) AS g", "select o_orderkey as k, strftime(o_orderdate, '%Y-%m-%d') as a, strftime(o_orderdate, '%Y-%m-%d') as b, strftime(o_orderdate::date + interval 14 day, '%Y-%m-%d') as c, strftime(o_orderdate, '%Y-%m-%d') || 'T07:05' as e, epoch(o_orderdate::date::timestamp)::bigint as f, 'P' || day(o_orderdate) || 'DT3H' as g from orders")
add("fn_spatial_bbox", "MATCH (p:Part) WITH p, point({x: p.p_size, y: p.p_retailprice / 100}) AS q WHERE point.withinBBox(q, point({x: 10, y: 5}), point({x: 30, y: 15})) RETURN p.p_partkey AS k, distance(q, point({x: 0, y: 0})) AS d", "select p_partkey as k, sqrt(p_size * p_size + (p_retailprice / 100) * (p_retailprice / 100)) as d from part where p_size between 10 and 30 and p_retailprice / 100 between 5 and 15")
add("fn_spatial_alias", 'MATCH (p:Part) WITH p, point({x: p.p_size, y: 2}) AS q RETURN p.p_partkey AS k, point.distance(q, point({x: 0, y: 2})) AS d, q.x AS x, q.crs AS crs, point({x: 1, y: 2, z: p.p_size}).z AS z', "select p_partkey as k, p_size::double as d, p_size::double as x, 'cartesian' as crs, p_size::double as z from part")
add("fn_vector_cosine", "MATCH (a:Vec {vec_id: 0}), (b:Vec) RETURN b.vec_id AS k, round(vector.similarity.cosine(a.embedding, b.embedding), 6) AS s", "with a as (select embedding::double[] e from embeddings where vec_id = 0) select vec_id as k, floor((1 + list_cosine_similarity((select e from a), embedding::double[])) / 2 * 1000000 + 0.5) / 1000000 as s from embeddings")
add("fn_vector_distance", "MATCH (a:Vec {vec_id: 0}), (b:Vec) RETURN b.vec_id AS k, round(vector_distance(a.embedding, b.embedding, 'EUCLIDEAN'), 5) AS e, round(vector_distance(a.embedding, b.embedding, 'DOT'), 5) AS d, round(vector.similarity.euclidean(a.embedding, b.embedding), 5) AS s, vector_dimension_count(b.embedding) AS n", "with a as (select embedding::double[] e from embeddings where vec_id = 0), x as (select vec_id, list_distance((select e from a), embedding::double[]) d, -list_inner_product((select e from a), embedding::double[]) p from embeddings) select vec_id as k, floor(d * 100000 + 0.5) / 100000 as e, case when p < 0 then -floor(-p * 100000 + 0.5) / 100000 else floor(p * 100000 + 0.5) / 100000 end as d, floor(1 / (1 + d * d) * 100000 + 0.5) / 100000 as s, 64 as n from x")
add("fn_vector_norm", "MATCH (b:Vec) RETURN b.vec_id AS k, round(vector_norm(b.embedding, 'EUCLIDEAN'), 5) AS e, round(vector_norm(b.embedding, 'MANHATTAN'), 4) AS m, vector_dimension_count(vector([1, 2, 3], 3, 'FLOAT32')) AS n", 'select vec_id as k, floor(sqrt(list_inner_product(embedding::double[], embedding::double[])) * 100000 + 0.5) / 100000 as e, floor(list_sum(list_transform(embedding::double[], lambda x: abs(x))) * 10000 + 0.5) / 10000 as m, 3 as n from embeddings')
# procedures
add("call_vertex_count", "CALL db.stats.vertexCount('Order') YIELD vertexCount RETURN vertexCount AS n", "select count(*) as n from orders")
add("call_edge_count", "CALL db.stats.edgeCount('Part') YIELD edgeCount AS n WHERE n > 0 RETURN n", "select (select count(*) from lineitem) + (select count(*) - 1 from part) as n")
add("call_in_query", "MATCH (r:Region) CALL db.stats.vertexCount('Nation') YIELD vertexCount AS n RETURN r.r_name AS r, n", "select r_name as r, (select count(*) from nation) as n from region")
add("call_standalone", "CALL db.stats.vertexCount('Customer')", 'select count(*) as "vertexCount" from customer')
add("call_user_procedure", 'MATCH (r:Region) CALL tables.nationsOf(r.r_regionkey) YIELD name, key AS k WHERE k > 3 RETURN r.r_name AS r, name, k', 'select r_name as r, n_name as name, n_nationkey as k from region join nation on n_regionkey = r_regionkey where n_nationkey > 3')
add("call_index", "CALL db.index.createProperty('Customer', 'c_name') YIELD created, indexedEntities AS n RETURN created, n", 'select true as created, count(*) as n from customer')
add("call_labels", 'CALL db.labels() YIELD label RETURN label', "select unnest(['Customer', 'Supplier', 'Part', 'Order', 'Nation', 'Region', 'User', 'Event', 'Vec', 'Doc', 'Page', 'Turn']) as label")
# writes
add("create_then_match", "MATCH (r:Region) CREATE (h:Hub {name: r.r_name, size: r.r_regionkey * 10})-[:HUB_OF {w: 1}]->(r) WITH count(*) AS made MATCH (h:Hub)-[e:HUB_OF]->(r:Region) RETURN h.name AS h, h.size AS s, e.w AS w, r.r_regionkey AS k, made", "select r_name as h, r_regionkey * 10 as s, 1 as w, r_regionkey as k, (select count(*) from region) as made from region")
add("merge_node", "MATCH (c:Customer) WITH c MERGE (s:Segment {name: c.c_mktsegment}) ON CREATE SET s.fresh = true ON MATCH SET s.fresh = false WITH DISTINCT s.name AS name, s.fresh AS fresh MATCH (x:Segment {name: name}) RETURN name, fresh, count(x) AS n", "select distinct c_mktsegment as name, true as fresh, 1::bigint as n from customer")
add("merge_edge", "MATCH (n:Nation)-[:PART_OF]->(r:Region) MERGE (r)-[k:HAS_NATION {src: 'x'}]->(n) WITH count(k) AS made MATCH (r:Region)-[k:HAS_NATION]->(n) RETURN r.r_name AS r, count(k) AS n, made", "select r_name as r, count(*) as n, (select count(*) from nation) as made from region join nation on n_regionkey = r_regionkey group by 1")
add("set_property", "MATCH (r:Region) SET r.tag = toLower(r.r_name), r.r_regionkey = r.r_regionkey + 100 WITH r MATCH (n:Nation)-[:PART_OF]->(r) RETURN r.tag AS tag, r.r_regionkey AS k, count(n) AS n", "select lower(r_name) as tag, r_regionkey + 100 as k, count(*) as n from region join nation on n_regionkey = r_regionkey group by 1, 2")
add("set_row_by_row", 'MATCH (r:Region)<-[:PART_OF]-(n:Nation) WITH r, n ORDER BY n.n_nationkey SET r.total = coalesce(r.total, 0) * 2 + n.n_nationkey WITH count(*) AS rows MATCH (r:Region) RETURN r.r_regionkey AS k, r.total AS t, rows', 'select r as k, sum(key * (1 << (n - i)))::bigint as t, (select count(*) from nation) as rows from (select n_regionkey as r, n_nationkey as key, row_number() over (partition by n_regionkey order by n_nationkey) as i, count(*) over (partition by n_regionkey) as n from nation) group by 1')
add("set_last_row", 'MATCH (n:Nation)<-[:LOCATED_IN]-(c:Customer) WITH n, c ORDER BY c.c_acctbal, c.c_custkey SET n.best = c.c_custkey WITH count(*) AS rows MATCH (n:Nation) RETURN n.n_nationkey AS n, n.best AS best, rows', 'select n_nationkey as n, best, (select count(*) from customer) as rows from nation left join (select c_nationkey as k, arg_max(c_custkey, (c_acctbal, c_custkey)) as best from customer group by 1) on k = n_nationkey')
add("set_map_and_label", "MATCH (r:Region) SET r += {a: 1, b: r.r_name}, r:Area WITH count(*) AS c MATCH (x:Area) RETURN x.a AS a, x.b AS b, x.r_regionkey AS k, c", "select 1 as a, r_name as b, r_regionkey as k, (select count(*) from region) as c from region")
add("remove_property", "MATCH (r:Region) WHERE r.r_regionkey < 2 REMOVE r.r_name WITH count(*) AS c MATCH (x:Region) RETURN x.r_regionkey AS k, x.r_name AS n, c", "select r_regionkey as k, case when r_regionkey >= 2 then r_name end as n, 2 as c from region")
add("detach_delete", "MATCH (n:Nation) WHERE n.n_regionkey = 1 DETACH DELETE n WITH count(*) AS gone MATCH (x:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS r, count(x) AS n, gone", "select r_name as r, count(*) as n, (select count(*) from nation where n_regionkey = 1) as gone from region join nation on n_regionkey = r_regionkey where n_regionkey <> 1 group by 1")
add("delete_relationship", "MATCH (:Part)-[r:NEXT]->(:Part {p_partkey: 10}) DELETE r WITH count(*) AS gone MATCH (:Part)-[r:NEXT]->() RETURN gone, count(r) AS n", "select 1 as gone, count(*) - 2 as n from part")
# scenarios of the baseline
add("rebac_two_hop_count", "MATCH (c:Customer {c_custkey: 5})-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN count(DISTINCT p) AS resources", "select count(distinct l_partkey) as resources from orders join lineitem on l_orderkey = o_orderkey where o_custkey = 5")
add("research_in_degree", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.p_partkey AS p, count(r) AS n ORDER BY n DESC, p LIMIT 100", "select l_partkey as p, count(*) as n from lineitem group by 1 order by n desc, p limit 100")
add("threat_hunt", "MATCH (u:User)-[:DID]->(e:Event) WHERE e.event_type = 'error' WITH u.user_id AS u, count(e) AS n, avg(e.value) AS score WHERE n > 2 RETURN u, n, score ORDER BY score DESC, u LIMIT 50", "select user_id as u, count(*) as n, avg(value) as score from events where event_type = 'error' and user_id is not null group by 1 having count(*) > 2 order by score desc, u limit 50")
add("recommendation", "MATCH (p:Part {p_partkey: 3})<-[:CONTAINS]-(o:Order)-[l:CONTAINS]->(q:Part) WHERE q.p_partkey <> 3 RETURN q.p_partkey AS q, count(DISTINCT o) AS shared, sum(l.l_quantity) AS quantity ORDER BY shared DESC, q LIMIT 20", "select b.l_partkey as q, count(distinct b.l_orderkey) as shared, sum(b.l_quantity) as quantity from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where a.l_partkey = 3 and b.l_partkey <> 3 group by 1 order by shared desc, q limit 20")
add("suggested_friends", "MATCH (a:Supplier)-[:LOCATED_IN]->(n:Nation)<-[:LOCATED_IN]-(b:Supplier) WHERE a.s_suppkey < b.s_suppkey RETURN a.s_suppkey AS a, b.s_suppkey AS b", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
add("turn_chain", "MATCH (a:Turn)-[:REPLIED*2..2]->(b:Turn) WHERE a.role = 'user' RETURN b.role AS role, count(*) AS n", "select c.role as role, count(*) as n from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 join conversations c on c.conv_id = b.conv_id and c.turn = b.turn + 1 where a.role = 'user' group by 1")
# without an oracle
add("fn_rand_uuid", 'MATCH (n:Nation) RETURN n.n_nationkey AS x, rand() < 1.0 AS r, size(randomUUID()) AS n', 'select n_nationkey as x, true as r, 36 as n from nation')
add("explain_json", "EXPLAIN MATCH (c:Customer)-[:PLACED]->(o) WHERE NOT (c)-[:LOCATED_IN]->() RETURN count(*) AS n", None)


#: Graphs by session and folder: only lazy tables, whose schemas needn't be read again.
_GRAPHS: dict[tuple[str, int, str], PropertyGraph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = commerce(spark, sf_dir)
    return _GRAPHS[key]


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    q = QUERIES[name]
    return Engine(graph_of(spark, sf_dir)).run(q.text, q.params).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
