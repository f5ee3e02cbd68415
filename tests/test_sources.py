"""File contracts and the streaming ingest."""

import json

from quiver.engine import Engine
from quiver.sources.tables import access_dataset, dataset, event_log
from quiver.streaming.ingest import read_events, write_edges
from tests.helpers import rows


def put(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def quoted(*fields):
    return ",".join('"' + f.replace('"', '""') + '"' for f in fields)


def test_dataset(spark, tmp_path):
    v = put(tmp_path / "vertices.csv", ["tenant,id,labels_json,properties_json", quoted("t", "a", '["User"]', '{"name": "Ann", "age": 3}'), quoted("t", "b", '["User", "Admin"]', '{"name": "Bo"}'), quoted("u", "a", '["User"]', "{}")])
    e = put(tmp_path / "edges.csv", ["tenant,id,type,src_id,dst_id,properties_json", quoted("t", "e1", "KNOWS", "a", "b", '{"w": 1.5}')])
    engine = Engine(dataset(spark, v, e))
    assert rows(engine, "MATCH (a:User)-[k:KNOWS]->(b:Admin) RETURN a.name AS a, a.age + 1 AS n, k.w AS w, b.id AS b") == [("Ann", 4, 1.5, "b")]
    assert rows(Engine(engine.graph.for_tenant("u")), "MATCH (n) RETURN count(n) AS n") == [(1,)]


def test_access_dataset(spark, tmp_path):
    p = put(tmp_path / "principals.csv", ["tenant,id,properties_json", quoted("t", "u1", '{"k": 1}')])
    r = put(tmp_path / "resources.csv", ["tenant,id,type,properties_json", quoted("t", "r1", "doc", "{}")])
    e = put(tmp_path / "relationships.csv", ["tenant,id,type,src_id,dst_id,properties_json", quoted("t", "x", "CAN_READ", "u1", "r1", "{}")])
    assert rows(Engine(access_dataset(spark, p, r, e)), "MATCH (p:Principal)-[:CAN_READ]->(r:Resource) RETURN p.k AS k, r.type AS t") == [(1, "doc")]


def test_events(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    event = {"tenant": "t", "ts": "2024-01-01T00:00:00Z", "subject": "s", "action": "login", "object": "o", "attributes": {"ip": "1"}}
    put(log / "events.jsonl", [json.dumps(event), json.dumps(event), json.dumps({**event, "object": "p"})])
    assert event_log(spark, str(log)).count() == 3
    write_edges(read_events(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("_type", "attributes").distinct().collect()[0][0] == "LOGIN"
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
