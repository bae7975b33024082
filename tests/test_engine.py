import math
import random
import re

import pytest

from graphspark.errors import CypherError, DivisionByZero, InvalidQuery, QueryRuntimeError, TypeMismatch, Unsupported
from graphspark.operators import selection
from graphspark.operators.selection import components, reachable
from graphspark.plans.durable import persisted
from graphspark.sources.graph import NodeTable, PropertyGraph, RelTable
from graphspark.sources.script import to_cypher_create

SCRIPT = "CREATE (a:Person {name:'Alice',age:30})-[:KNOWS {w:1}]->(b:Person {name:'Bob',age:25})-[:KNOWS {w:2}]->(c:Person:Admin {name:'Cy',age:41}), (c)-[:KNOWS {w:3}]->(a), (c)-[:LIKES]->(m:Movie {title:'X'}), (m)-[:SELF]->(m)"


@pytest.fixture(scope="module")
def g(spark):
    return PropertyGraph.from_cypher(spark, SCRIPT)


def rows(g, text, **params):
    return [tuple(r.values()) for r in g.cypher(text, params).rows()]


@pytest.mark.parametrize("text,want", [
    ("MATCH (a:Person)-[r:KNOWS]->(b) RETURN a.name, b.name, r.w ORDER BY a.name", [("Alice", "Bob", 1), ("Bob", "Cy", 2), ("Cy", "Alice", 3)]),
    ("MATCH (a:Person) WHERE a.age > 26 AND NOT (a)-[:LIKES]->() RETURN a.name AS n", [("Alice",)]),
    ("MATCH (a:Person) WHERE a.age > 100 OR (a)-[:LIKES]->() RETURN a.name AS n", [("Cy",)]),
    ("MATCH (a:Person) OPTIONAL MATCH (a)-[:LIKES]->(m) WHERE m.title = 'X' RETURN a.name AS n, m.title AS t ORDER BY n", [("Alice", None), ("Bob", None), ("Cy", "X")]),
    ("MATCH p = (a {name:'Alice'})-[:KNOWS*1..3]->(b) RETURN b.name AS n, length(p) AS l, size(nodes(p)) AS k ORDER BY l", [("Bob", 1, 2), ("Cy", 2, 3), ("Alice", 3, 4)]),
    ("MATCH (a:Person)-[:KNOWS*]->(b) RETURN a.name AS a, count(*) AS c ORDER BY a", [("Alice", 3), ("Bob", 3), ("Cy", 3)]),
    ("MATCH (a {name:'Cy'})<-[rs:KNOWS*2]-(b) RETURN b.name AS n, [r IN rs | r.w] AS w", [("Alice", [2, 1])]),
    ("MATCH (a {name:'Alice'})-[rs:KNOWS*2]->(b) WITH rs MATCH (x)-[rs*1..3]->(y) RETURN x.name AS x, y.name AS y", [("Alice", "Cy")]),
    ("MATCH (a {name:'Alice'})-[rs:KNOWS*2]->(b) WITH rs, b MATCH (b)<-[rs*2]-(y) RETURN y.name AS y", []),
    ("MATCH (a {name:'Alice'})-[rs:KNOWS*2]->(b) WITH rs, b MATCH (y)-[rs*2..]-(b) RETURN y.name AS y", [("Alice",)]),
    ("MATCH (a:Person) RETURN a.name AS n, [(a)-[:KNOWS]->(b) WHERE b.age > 26 | b.name] AS l ORDER BY n", [("Alice", []), ("Bob", ["Cy"]), ("Cy", ["Alice"])]),
    ("MATCH (a:Person)--(b) RETURN a.name AS n, count(b) AS c ORDER BY c DESC, n", [("Cy", 3), ("Alice", 2), ("Bob", 2)]),
    ("MATCH (m:Movie)--(x) RETURN count(*) AS c", [(2,)]),
    ("MATCH (a)-[r1:KNOWS]->(b)-[r2:KNOWS]-(c) RETURN count(*) AS c", [(3,)]),
    ("MATCH (a)-[r1:KNOWS]->(b) MATCH (b)-[r2:KNOWS]-(c) RETURN count(*) AS c", [(6,)]),
    ("MATCH (a:Person)-[r]->(b) WITH r MATCH (x)-[r]->(y:Movie) RETURN x.name AS n", [("Cy",)]),
    ("UNWIND [3,1,null,2] AS x WITH x ORDER BY x DESC RETURN collect(x) AS l, count(*) AS c, sum(x) AS s", [([3, 2, 1], 4, 6)]),
    ("MATCH (a:Person) WITH a, a.age AS age ORDER BY age LIMIT 2 RETURN a.name AS n, age", [("Bob", 25), ("Alice", 30)]),
    ("MATCH (a:Person)-[:KNOWS]->(b) WITH b, count(*) AS k WHERE k = 1 RETURN b.name AS n, k + 1 AS k ORDER BY n", [("Alice", 2), ("Bob", 2), ("Cy", 2)]),
    ("RETURN 1 AS x UNION RETURN 2 AS x UNION RETURN 1 AS x", [(1,), (2,)]),
    ("MATCH (n) RETURN DISTINCT labels(n) AS l ORDER BY size(l), l", [(["Movie"],), (["Person"],), (["Person", "Admin"],)]),
    ("MATCH (n:Nothing) RETURN count(*) AS c, sum(n.x) AS s, max(n.x) AS m", [(0, 0, None)]),
    ("MATCH (a:Person) RETURN a {.name, k: a.age + 1} AS m ORDER BY a.name LIMIT 1", [({"name": "Alice", "k": 31},)]),
    ("MATCH (a:Person {name: $n}) RETURN a.age AS age", [(25,)]),
    ("MATCH (n:Person&!Admin) RETURN n.name AS n ORDER BY n", [("Alice",), ("Bob",)]),
])
def test_reads(g, text, want):
    got = rows(g, text, **({"n": "Bob"} if "$n" in text else {}))
    assert (got if "ORDER" in text else sorted(got)) == want


@pytest.mark.parametrize("text,want", [
    ("MATCH (a)-[r:KNOWS]->(b) RETURN startNode(r).name AS s, labels(endNode(r)) AS l, endNode(r).age AS a, startNode(r) = a AS e", [("Alice", ["Person"], 25, True), ("Bob", ["Person", "Admin"], 41, True), ("Cy", ["Person"], 30, True)]),
    ("MATCH p = (a {name:'Alice'})-[:KNOWS*1..2]->(b) RETURN [n IN nodes(p) | n.name] AS n, [r IN relationships(p) | r.w] AS w", [(["Alice", "Bob"], [1]), (["Alice", "Bob", "Cy"], [1, 2])]),
    ("MATCH p = (a {name:'Alice'})-[*2]->(b) RETURN [r IN relationships(p) | type(r)] AS t, labels(last(nodes(p))) AS l, nodes(p)[1].age AS a", [(["KNOWS", "KNOWS"], ["Person", "Admin"], 25)]),
    ("MATCH p = (m:Movie)-[*0..1]->(x) RETURN [n IN nodes(p) | n.title] AS t", [(["X"],), (["X", "X"],)]),
    ("MATCH p = (a {name:'Alice'})-->(b) WITH p RETURN [n IN nodes(p) | n.name] AS n", [(["Alice", "Bob"],)]),
    ("MATCH p = (a {name:'Alice'})-[*]->(b:Movie) WITH collect(p) AS ps UNWIND ps AS p RETURN [n IN nodes(p) | coalesce(n.name, n.title)] AS n, length(p) AS l", [(["Alice", "Bob", "Cy", "X"], 3), (["Alice", "Bob", "Cy", "X", "X"], 4)]),
    ("MATCH (a {name:'Alice'})-[rs:KNOWS*2]->() UNWIND rs AS r RETURN startNode(r).name AS s, endNode(r).name AS e", [("Alice", "Bob"), ("Bob", "Cy")]),
    ("MATCH p = (a {name:'Alice'})-[:KNOWS*1..2]->(b) RETURN [r IN relationships(p) | startNode(r).name + '-' + endNode(r).name] AS x, all(r IN relationships(p) WHERE endNode(r).age > 20) AS a", [(["Alice-Bob"], True), (["Alice-Bob", "Bob-Cy"], True)]),
    ("MATCH (m:Movie), (p:Admin) RETURN properties(m) AS m, [x IN [m, p] | size(keys(x))] AS k", [({"title": "X"}, [1, 2])]),
    ("OPTIONAL MATCH (a:Nobody)-[r]->() RETURN startNode(r).name AS s, startNode(r) IS NULL AS n", [(None, True)]),
    ("MATCH (a:Person) WITH a, a.age - 10 AS least RETURN a.name AS n, [(a)-[:KNOWS]->(b) WHERE b.age > least | b.age - least] AS l", [("Alice", [5]), ("Bob", [26]), ("Cy", [])]),
    ("MATCH (a:Person) WITH a, a.age AS age RETURN a.name AS n, a.age > 100 OR (a)<-[:KNOWS {w: age / 10 - 1}]-() AS f", [("Alice", False), ("Bob", True), ("Cy", False)]),
    ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE (b)-[:LIKES]->() RETURN a.name AS n, b.name AS b", [("Alice", None), ("Bob", "Cy"), ("Cy", None)]),
    ("MATCH (a:Person) WITH collect(a) AS l UNWIND l AS a MATCH (a)-[:LIKES]->(m) RETURN a.name AS n, m.title AS t", [("Cy", "X")]),
    ("MATCH (a:Person) WITH collect(a) AS l UNWIND l AS a MATCH (a {name: 'Bob'})-->(x) RETURN a.age AS a, x.name AS x", [(25, "Cy")]),
    ("MATCH ()-[r:KNOWS]->() RETURN count(r) AS c, sum(r.w) AS s", [(3, 6)]),
    ("MATCH (x)-[:SELF]->(x) RETURN x.title AS t", [("X",)]),
    ("WITH 1 AS p UNWIND [2.25, 3.75] AS x RETURN x, round(x, p) AS r", [(2.25, 2.3), (3.75, 3.8)]),
    ("RETURN split('a\\\\Eb\\\\Ec', '\\\\E') AS l", [(["a", "b", "c"],)]),
    ("UNWIND [1, 2] AS x RETURN timestamp() = timestamp() AS same", [(True,), (True,)]),
    ("MATCH (a:Person) WITH a.name AS n, a.age AS x WITH 0.5 AS p, x RETURN percentileCont(x, p) AS c, percentileDisc(x, p) AS d", [(30.0, 30)]),
])
def test_parts_of_paths_and_outer_values(g, text, want):
    assert sorted(rows(g, text), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["MATCH p = (a)-[*1..2]->(b) WITH collect(p) AS ps RETURN [p IN ps | nodes(p)[0].name] AS x", "MATCH (a)-[r:KNOWS]->(b) RETURN [l IN [[r]] | [x IN l | startNode(x)]] AS x"])
def test_unknown_parts_are_refused_and_never_null(g, text):
    with pytest.raises(Unsupported):
        g.cypher(text).rows()


@pytest.mark.parametrize("expr,want", [
    ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("2 ^ 3", 8.0), ("-3 ^ 2", 9.0), ("7.0 / 0", math.inf), ("-1 / 0.0", -math.inf), ("'a' + 1", "a1"), ("'x' + 1.0", "x1.0"),
    ("[1,2,3][-1]", 3), ("[1,2,3][5]", None), ("[1,2,3,4][1..3]", [2, 3]), ("[1,2,3][-2..]", [2, 3]), ("[1,2] + 3", [1, 2, 3]), ("0 + [1]", [0, 1]), ("1 = 1.0", True), ("9007199254740993 = 9007199254740992.0", False),
    ("0.0 / 0.0 = 0.0 / 0.0", False), ("1 < 0.0 / 0.0", False), ("'a' = 1", False), ("'a' < 1", None), ("[1, null] = [1, 2]", None), ("[1, null] = [2, null]", False), ("[1] < [1, 2]", True), ("null IN []", False), ("null IN [1]", None), ("1 IN [2, null]", None),
    ("1 < 2 <= 2", True), ("true XOR null", None), ("NOT null", None), ("1 STARTS WITH 'a'", None), ("'abc' CONTAINS 'b'", True),
    ("reduce(s = 0, x IN [1,2,3] | s + x)", 6), ("reduce(s = 0, x IN [1,2] | s + x / 2.0)", 1.5), ("[x IN range(1,4) WHERE x % 2 = 0 | x * x]", [4, 16]), ("any(x IN [null, 1] WHERE x = 1)", True), ("all(x IN [null, 1] WHERE x = 1)", None), ("none(x IN [] WHERE x = 1)", True), ("single(x IN [1, 1] WHERE x = 1)", False),
    ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN null THEN 1 ELSE 2.5 END", 2.5), ("coalesce(null, 3)", 3), ("nullIf(1, 1.0)", None), ("valueType(null)", "NULL"), ("valueType([1])", "LIST<INTEGER NOT NULL> NOT NULL"),
    ("range(3, 1)", []), ("range(5, 1, -2)", [5, 3, 1]), ("substring('hello', 1, 3)", "ell"), ("left('hello', 2)", "he"), ("split('a,b;c', [',', ';'])", ["a", "b", "c"]), ("replace('aba', 'a', '')", "b"), ("trim('\\t x ')", "x"), ("btrim('xxaxx', 'x')", "a"), ("reverse([1,2])", [2, 1]),
    ("toInteger('2.7')", 2), ("toInteger('x')", None), ("toFloat('1e2')", 100.0), ("toBoolean(' TRUE ')", True), ("toString(10000000.0)", "10000000.0"), ("toString(1e20)", "1e20"), ("toStringList([1, null, 2])", ["1", None, "2"]), ("toIntegerOrNull([1])", None),
    ("round(-1.5)", -1.0), ("round(2.5)", 3.0), ("round(2.675, 2)", 2.68), ("round(1.25, 1, 'HALF_EVEN')", 1.2), ("round(1250.0, -2, 'HALF_EVEN')", 1200.0), ("round(1260.0, -2)", 1300.0), ("round(-1.5, 0)", -1.0), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("sign(-3)", -1), ("log(0)", -math.inf), ("abs(-4)", 4), ("size('日本')", 2), ("isEmpty('')", True), ("isNaN(0.0/0.0)", True), ("{a: 1}.a", 1), ("{a: 1}['a']", 1), ("keys({b: 1, a: null})", ["a", "b"]), ("0x1F + 0o17", 46), ("'\\u0041'", "A"),
])
def test_expressions(g, expr, want):
    got = rows(g, f"RETURN {expr} AS v")[0][0]
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("text,kind", [
    ("RETURN 1 / 0 AS x", DivisionByZero), ("RETURN 9223372036854775807 + 1 AS x", QueryRuntimeError), ("RETURN 1 AND true AS x", TypeMismatch), ("MATCH (a) RETURN b", InvalidQuery), ("RETURN count(count(*)) AS x", InvalidQuery), ("RETURN foo(1) AS x", Unsupported), ("RETURN $p AS x", InvalidQuery),
    ("MATCH (a) WITH a.name RETURN 1 AS x", InvalidQuery), ("RETURN 1 AS a, 2 AS a", InvalidQuery), ("MATCH (a)-[r]->()-[r]->() RETURN a", InvalidQuery), ("RETURN 1 AS x LIMIT -1", InvalidQuery), ("CREATE (a)", InvalidQuery), ("RETURN [1, [2]] AS x", Unsupported), ("UNWIND [1, 'a'] AS x RETURN sum(x) AS s", TypeMismatch), ("UNWIND [true, 1] AS x RETURN x * 2 AS s", TypeMismatch), ("RETURN substring('a', -1) AS x", QueryRuntimeError), ("RETURN range(1, 2, 0) AS x", QueryRuntimeError), ("RETURN *", InvalidQuery), ("WITH 1 AS x RETURN percentileCont(x, 2) AS p", InvalidQuery),
])
def test_errors(g, text, kind):
    with pytest.raises(kind):
        g.cypher(text).rows()


def test_updates(g):
    def after(change, text):
        new, _ = g.cypher_mut(change)
        return rows(new, text)

    people = "MATCH (p:Person) RETURN p.name AS n, p.age AS a ORDER BY n"
    assert after("MATCH (p:Person {name:'Bob'}) SET p.age = 42, p.x = 'q'", people)[1] == ("Bob", 42)
    assert after("MATCH (p:Person {name:'Bob'}) SET p = {name: 'Rob'}", people)[2] == ("Rob", None)
    assert after("MATCH (p:Admin) SET p += {age: null, k: [1]}", people)[2] == ("Cy", None)
    assert after("MATCH (p:Person) REMOVE p.age, p:Person SET p:Old", "MATCH (o:Old) RETURN count(*) AS c, count(o.age) AS a") == [(3, 0)]
    assert after("MATCH (c:Admin) DETACH DELETE c", "MATCH (n) OPTIONAL MATCH (n)-[r]->() RETURN count(DISTINCT n) AS n, count(r) AS r") == [(3, 2)]
    assert after("MERGE (p:Person {name:'Zed'}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 2", people)[-1] == ("Zed", 1)
    assert after("MERGE (p:Person {name:'Bob'}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 2", people)[1] == ("Bob", 2)
    assert after("UNWIND [1,1,2] AS i MERGE (k:Key {id:i})", "MATCH (k:Key) RETURN k.id AS i ORDER BY i") == [(1,), (2,)]
    assert after("MATCH (a:Person {name:'Alice'}), (m:Movie) MERGE (a)-[:LIKES]->(m)", "MATCH ()-[:LIKES]->(m) RETURN count(*) AS c") == [(2,)]
    assert after("FOREACH (i IN [1,2,3] | CREATE (:Item {id:i}))", "MATCH (i:Item) RETURN sum(i.id) AS s") == [(6,)]
    assert after("CREATE (:T {k: 1}); MATCH (t:T) SET t.k = t.k + 1", "MATCH (t:T) RETURN t.k AS k") == [(2,)]
    assert g.cypher_mut("CREATE (n:New {k: 1}) RETURN n.k AS k, labels(n) AS l")[1].rows() == [{"k": 1, "l": ["New"]}]
    with pytest.raises(CypherError):
        g.cypher_mut("MATCH (a:Person {name:'Alice'}) DELETE a")
    with pytest.raises(TypeMismatch):
        g.cypher_mut("MATCH (a:Person) SET a.m = {x: 1}")
    assert rows(g, "MATCH (n) RETURN count(*) AS c") == [(4,)]


@pytest.mark.parametrize("start,change,text,want", [
    ("CREATE (:A {x: 0})", "UNWIND [1,2,3] AS i MATCH (a:A) SET a.x = a.x + i", "MATCH (a:A) RETURN a.x AS x", [(6,)]),
    ("CREATE (:A {x: 1})", "UNWIND [1,2,3] AS i MATCH (a:A) SET a.x = a.x * 2 + i, a.y = a.x / 2.0", "MATCH (a:A) RETURN a.x AS x, a.y AS y", [(19, 9.5)]),
    ("CREATE (:A {x: 1})", "UNWIND [3,1,2] AS i MATCH (a:A) SET a.x = i", "MATCH (a:A) RETURN a.x AS x", [(2,)]),
    ("CREATE (:A {x: 1}), (:A {x: 5})", "UNWIND [1,2] AS i MATCH (a:A) SET a += {x: a.x + i, n: coalesce(a.n, '') + toString(i)}", "MATCH (a:A) RETURN a.x AS x, a.n AS n", [(4, "12"), (8, "12")]),
    ("CREATE (:A {x: 1, z: 2})", "UNWIND [1,2] AS i MATCH (a:A) SET a = {x: a.x + i}", "MATCH (a:A) RETURN a.x AS x, a.z AS z", [(4, None)]),
    ("CREATE ()-[:R {w: 1}]->()", "UNWIND [2,3] AS i MATCH ()-[r:R]->() SET r.w = r.w * i", "MATCH ()-[r:R]->() RETURN r.w AS w", [(6,)]),
    ("CREATE ()", "UNWIND [1,1,1] AS i MERGE (k:K {id:i}) ON CREATE SET k.n=1 ON MATCH SET k.n=k.n+1", "MATCH (k:K) RETURN k.n AS n", [(3,)]),
    ("CREATE (:K {id: 1, n: 5})", "UNWIND [1,2,1,2] AS i MERGE (k:K {id:i}) ON CREATE SET k.n=1 ON MATCH SET k.n=k.n+i", "MATCH (k:K) RETURN k.id AS i, k.n AS n", [(1, 7), (2, 3)]),
    ("CREATE (:A {x: 1})-[:R]->(:B {y: 7})", "MATCH (a:A)-[r:R]->(b:B) SET a.x = b.y, b.y = a.x", "MATCH (a:A), (b:B) RETURN a.x AS x, b.y AS y", [(7, 7)]),
    ("CREATE (:A {k: 'p'}), (:A {k: 'q'})", "MATCH (a:A) SET a['is_' + a.k] = true", "MATCH (a:A) RETURN a.is_p AS p, a.is_q AS q", [(None, True), (True, None)]),
    ("CREATE (:A {x: 2})", "MATCH (a:A) FOREACH (i IN [1,2,3] | SET a.x = a.x * i)", "MATCH (a:A) RETURN a.x AS x", [(12,)]),
])
def test_updates_row_by_row(spark, start, change, text, want):
    new, _ = PropertyGraph.from_cypher(spark, start).cypher_mut(change)
    assert sorted(rows(new, text), key=repr) == want


def test_rows_that_depend_on_each_other_are_refused(spark):
    g = PropertyGraph.from_cypher(spark, "CREATE (:A {x: 1})-[:R]->(:A {x: 2})-[:R]->(:A {x: 3})")
    with pytest.raises(Unsupported):
        g.cypher_mut("MATCH (a)-[:R]->(b) SET b.x = a.x")


@pytest.mark.parametrize("text", ["MATCH (n:A) DETACH DELETE n RETURN n.x AS x", "MATCH (n:A) DETACH DELETE n RETURN labels(n) AS x", "MATCH ()-[r:R]->() DELETE r RETURN r.w AS x"])
def test_deleted_elements_have_no_parts(spark, text):
    g = PropertyGraph.from_cypher(spark, "CREATE (:A {x: 1})-[:R {w: 1}]->(:B)")
    with pytest.raises(QueryRuntimeError, match="Deleted"):
        g.cypher_mut(text)
    assert g.cypher_mut("MATCH ()-[r:R]->() DELETE r RETURN type(r) AS t")[1].rows() == [{"t": "R"}]


def test_ids_of_rows_in_several_files(spark, tmp_path):
    spark.range(40).selectExpr("id AS k").write.parquet(f"{tmp_path}/n")
    n = spark.read.parquet(f"{tmp_path}/n")
    for files in (1, 4):
        spark.range(200).selectExpr("id % 40 AS a", "(id * 7) % 40 AS b", "id AS w").repartition(files).write.parquet(f"{tmp_path}/r{files}")
        r = spark.read.parquet(f"{tmp_path}/r{files}")
        assert len(r.inputFiles()) == files
        g = PropertyGraph(spark).with_nodes("N", n, "k").with_rels("R", r, ("N", "a"), ("N", "b"), props=["w"], complete=True)
        assert rows(g, "MATCH ()-[r:R]->() RETURN count(DISTINCT r) AS c, sum(r.w) AS s") == [(200, 19900)]
        assert rows(g, "MATCH (x)-[r:R]->(y) WHERE x.k = 3 RETURN count(*) AS c") == [(5,)]
        out = {}
        for k in range(200):
            out.setdefault(k % 40, []).append((k * 7) % 40)
        pairs = sum(len(out[b]) for ends in out.values() for b in ends) - sum(a == b for a, ends in out.items() for b in ends)
        assert rows(g, "MATCH ()-[:R]->()-[:R]->() RETURN count(*) AS c") == [(pairs,)]


def test_keys_that_do_not_fit_raise(spark):
    g = PropertyGraph(spark).with_nodes("N", spark.createDataFrame([(1 << 44,)], "k long"), "k")
    with pytest.raises(QueryRuntimeError, match="2\\^44"):
        g.cypher("MATCH (n:N) RETURN id(n) AS i").rows()


def test_values_of_several_types(spark):
    g = PropertyGraph.from_cypher(spark, "CREATE (:A {x: 1, y: 1}), (:B {x: 'a', y: 2.5}), (:C {x: true}), (:D {z: 1}), (:D {z: [1]}), (:A {x: 0.5})")
    assert sorted(rows(g, "MATCH (n) WHERE n.y > 0 RETURN n.y AS y")) == [(1.0,), (2.5,)] and rows(g, "MATCH (n:B) RETURN n.x AS x") == [("a",)]
    assert rows(g, "MATCH (n) RETURN n.x AS x ORDER BY x") == [("a",), (True,), (0.5,), (1,), (None,), (None,)]
    assert rows(g, "MATCH (n) WHERE n.x = 'a' OR n.x < 1 RETURN n.x AS x ORDER BY x DESC") == [(0.5,), ("a",)]
    assert rows(g, "MATCH (n) RETURN min(n.x) AS a, max(n.x) AS b, count(n.x) AS c") == [("a", 1, 4)]
    assert rows(g, "MATCH (n) RETURN count(DISTINCT n.x) AS c, size(collect(n.x)) AS s") == [(4, 4)]
    with pytest.raises(Unsupported):
        rows(g, "MATCH (n) RETURN n.z AS z")
    text = to_cypher_create(g.cypher_select("MATCH (n) WHERE n.x IS NOT NULL RETURN n").subgraph(g)[0])
    assert "x: 'a'" in text and "x: true" in text and "x: 0.5" in text


@pytest.mark.parametrize("text,want", [
    ("UNWIND [1, 'a', null, 0.2, 'b', '1', '99'] AS x RETURN max(x) AS a, min(x) AS b", [(1, "1")]),
    ("RETURN [1, 'a', true, 2.5, null] AS l, 'a' IN [1, 'a'] AS i, [1, 'a'] = [1, 'b'] AS e, 3 IN [1, 'a'] AS n", [([1, "a", True, 2.5, None], True, False, False)]),
    ("UNWIND [1, 'a', 2.5] AS x RETURN x + 1 AS y", [(2,), ("a1",), (3.5,)]),
    ("UNWIND [1, '2', 2.9, true, 'x'] AS x RETURN toInteger(x) AS i, toString(x) AS s, valueType(x) AS t", [(1, "1", "INTEGER NOT NULL"), (2, "2", "STRING NOT NULL"), (2, "2.9", "FLOAT NOT NULL"), (1, "true", "BOOLEAN NOT NULL"), (None, "x", "STRING NOT NULL")]),
    ("UNWIND [1, 'ab'] AS x WITH x WHERE x STARTS WITH 'a' RETURN x, size(x) AS n", [("ab", 2)]),
    ("RETURN CASE WHEN true THEN 1 ELSE 'a' END AS x UNION ALL RETURN 'b' AS x UNION ALL RETURN 2.5 AS x", [(1,), ("b",), (2.5,)]),
    ("UNWIND [1, 'a'] AS x WITH x WHERE x < 2 OR x < 'b' RETURN count(x) AS c", [(2,)]),
    ("RETURN coalesce(null, 'a', 1) AS x, reduce(s = '', x IN [1, 'b', true] | s + x) AS y, toStringList([1, 'a', true]) AS z", [("a", "1btrue", ["1", "a", "true"])]),
    ("UNWIND [{k: 1}, {k: 'a'}] AS m RETURN m.k AS k", [(1,), ("a",)]),
])
def test_lists_of_several_types(g, text, want):
    got = rows(g, text)
    assert got == want and repr(got) == repr(want)


def test_foreign_keys_are_no_joins(spark):
    from graphspark.queries import CATALOGUE, graph_of

    g = graph_of(spark, "/root/testdata/sf0.001")
    for name, joins, scans in (("flagship", 3, 4), ("hop1", 1, 2), ("hop3", 3, 4), ("cycle", 4, 5), ("exists_pred", 1, 2), ("pattern_comp", 1, 2), ("optional_match", 1, 2), ("rel_unique", 1, 2)):
        plan = g.cypher(CATALOGUE[name][0]).df._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("Join "), plan.count("Relation [")) == (joins, scans), (name, plan)


@pytest.mark.parametrize("text", [
    "MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation)<-[:SUPPLIER_IN]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SHIPPED_BY]->(s) RETURN n.n_name AS n, count(*) AS c",
    "MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation) MATCH (n)<-[:SUPPLIER_IN]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SHIPPED_BY]->(s) RETURN n.n_name AS n, count(*) AS c",
    "MATCH (n:Nation)<-[:SUPPLIER_IN]-(s:Supplier), (n)<-[:CUSTOMER_IN]-(c:Customer), (c)-[:PLACED]->(o:Order)-[:SHIPPED_BY]->(s) RETURN n.n_name AS n, count(*) AS c",
])
def test_cycles_close_before_their_hubs_multiply(spark, text):
    """No join pairs all customers and suppliers of a nation."""
    from graphspark.queries import CATALOGUE, graph_of

    g = graph_of(spark, "/root/testdata/sf0.001")
    df = g.cypher(text).df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Relation \[(\w+)#", plan)
    assert scans.index("l_orderkey") < max(scans.index("c_custkey"), scans.index("s_suppkey")), plan
    assert sorted(df.collect()) == sorted(g.cypher(CATALOGUE["cycle"][0]).df.collect())


def test_export_reads_back(spark):
    script = "CREATE (a:`odd label` {s: 'it\\'s \\\\ \\n x', f: 1.5, l: [1, 2], b: true}), (b), (a)-[:`my type` {k: -3}]->(b), (c {nan: 0.0 / 0.0, inf: -1.0 / 0.0, low: -9223372036854775808})"
    g = PropertyGraph.from_cypher(spark, script)
    text = to_cypher_create(g)
    assert "`odd label`" in text and to_cypher_create(PropertyGraph.from_cypher(spark, text)) == text


def test_selections_and_algorithms(g):
    s = g.cypher_select("MATCH (p:Person {name:'Alice'})-[r:KNOWS]->(q) RETURN r, [p] AS l")
    assert (s.node_count(), s.edge_count(), s.is_empty()) == (2, 1, False) and s.edges.count() == 1
    some = s.nodes.first().id
    assert s.contains_node(some) and not s.contains_node(-5) and not s.contains_edge(-5)
    assert g.cypher_select("MATCH (n:Nobody) RETURN n").is_empty()
    assert s.induced(g).all_rels().count() == 1 and s.edge_filtered(g).all_nodes().count() == 4
    small, nodes, _ = s.subgraph(g)
    assert sorted(r.id for r in small.all_nodes().collect()) == [0, 1] and nodes.count() == 2
    assert len({r.component for r in components(g).collect()}) == 2
    assert reachable(g, g.cypher("MATCH (m:Movie) RETURN id(m) AS id").df).count() == 1


def _strong(n: int, edges: set) -> list:
    """(node, least node of its component) by plain reachability."""
    reach = [{v} for v in range(n)]
    grows = True
    while grows:
        grows = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                grows = True
    return [(v, min(w for w in reach[v] if v in reach[w])) for v in range(n)]


def _plain_graph(spark, n: int, edges: set) -> PropertyGraph:
    nodes = spark.range(n).selectExpr("id", "array('N') AS labels")
    rels = spark.createDataFrame([(k, a, b, "R") for k, (a, b) in enumerate(sorted(edges))], "id long, src long, dst long, type string")
    return PropertyGraph(spark, (NodeTable(nodes, frozenset(["N"])),), (RelTable(rels, "R"),), next_id=n)


def test_components_of_rings_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(selection, "persisted", lambda *a: made.append(a[1]) or persisted(*a))
    ring = {(v, (v + 1) % 100) for v in range(100)} | {(v, v + 1) for v in range(100, 119)} | {(50, 100)}
    want = [(v, 0 if v < 100 else v) for v in range(120)]
    assert sorted(map(tuple, components(_plain_graph(spark, 120, ring)).collect())) == want and len(made) < 10
    assert sorted(map(tuple, components(_plain_graph(spark, 120, ring), in_task=4).collect())) == want and len(made) < 110


@pytest.mark.parametrize("n,m,seed", [(30, 34, 1), (30, 45, 2), (24, 60, 3)])
def test_components_equal_plain_reachability(spark, n, m, seed):
    """With and without the end in one task; ends that are no nodes join nothing."""
    draw = random.Random(seed)
    edges = {(draw.randrange(n), draw.randrange(n)) for _ in range(m)}
    want = _strong(n, edges)
    for in_task in (0, 1_000_000):
        got = components(_plain_graph(spark, n, edges | {(0, 900), (900, 1), (1, 901), (901, 0)}), in_task)
        assert sorted(map(tuple, got.collect())) == want


def test_plans_push_filters_and_skip_joins(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id % 7 AS city", "cast(id AS string) AS name").write.parquet(f"{tmp_path}/p")
    spark.range(7).selectExpr("id AS c", "'x' AS title").write.parquet(f"{tmp_path}/c")
    p, c = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/c")
    g = PropertyGraph(spark).with_nodes("P", p, "k").with_nodes("C", c, "c").with_rels("IN", p, ("P", "k"), ("C", "city"), "k", complete=True)
    plan = g.cypher("MATCH (a:P)-[:IN]->(c:C) WHERE a.name = '3' RETURN a.k AS k").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,3)" in plan and plan.count("Join") == 0
    plan = g.cypher("MATCH (a:P) RETURN a.city AS city").df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<city:bigint>" in plan
