import pytest

from graphspark.errors import InvalidQuery, ParseError, Unsupported
from graphspark.plans.parser import parse
from graphspark.plans.query import Query


@pytest.mark.parametrize("text", [
    "MATCH (a:A|B&!C {k: 1})-[r:T|U*1..3 {w: $w}]->(b)<--(c) WHERE a.x STARTS WITH 'p' RETURN a, count(*) AS c ORDER BY c DESC SKIP 1 LIMIT 2",
    "RETURN [x IN range(1, 3) WHERE x > 1 | x * 2] AS l, {a: 1, `b c`: [1]} AS m, all(x IN [1] WHERE x = 1) AS q, -3 ^ 2 AS p",
    "MATCH p = (a)-[*0..]-(b) RETURN [(a)-->(c) WHERE c.k | c.k] AS l, a {.*, .x, y: 2} AS m, CASE a.k WHEN 1 THEN 'x' END AS c",
    "CREATE (a:A {k: 0x1F})-[:T]->(b) SET a.x = 1, a += {y: 2}, b:L REMOVE a.y FOREACH (i IN [1] | CREATE (:I {i: i})) DETACH DELETE b;",
    "MERGE (a {k: 1}) ON CREATE SET a.m = true ON MATCH SET a.n = 1 RETURN a // end", "RETURN 1 AS x UNION ALL RETURN 2 AS x", "MATCH (shortestPath) RETURN shortestPath AS s",
])
def test_accepts(text):
    parse(text)


@pytest.mark.parametrize("text,kind", [
    ("", ParseError), ("MATCH (a", ParseError), ("RETURN 1 AS", ParseError), ("MATCH (a)", InvalidQuery), ("RETURN 9223372036854775808 AS x", InvalidQuery), ("RETURN 1 AS x UNION RETURN 2 AS x UNION ALL RETURN 3 AS x", InvalidQuery),
    ("RETURN 1 AS x UNION RETURN 2 AS y", InvalidQuery), ("CALL f()", Unsupported), ("RETURN 'a' =~ 'b' AS x", Unsupported), ("MATCH p = shortestPath((a)-[*]->(b)) RETURN p", Unsupported), ("RETURN EXISTS { MATCH (a) } AS x", Unsupported),
    ("MATCH (a WHERE a.k = 1) RETURN a", Unsupported), ("MATCH ((a)-->(b)){1,2} RETURN a", Unsupported), ("RETURN 1 :: INTEGER AS x", ParseError),
])
def test_rejects(text, kind):
    with pytest.raises(kind):
        Query(text)


def test_prepared():
    q = Query("MATCH (n {id: $b}) WHERE n.k = $a RETURN n")
    assert q.is_read_only and q.parameters == ["a", "b"] and not Query("CREATE ()").is_read_only
