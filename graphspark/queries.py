"""The registered queries: a property graph over the test tables, and query texts with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.errors import CypherError, DivisionByZero
from graphspark.operators.selection import components, reachable
from graphspark.plans.query import Query
from graphspark.sources.graph import PropertyGraph
from graphspark.sources.script import script_lines

#: label: (table, key)
NODES = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"),
    "Page": ("pages", "page_id"), "BenchItem": ("benchmark", "item_id"), "Conversation": ("conversations", "conv_id"), "Turn": ("conversations", "turn_id"),
}
#: type: (table, (label, column), (label, column), key, properties)
RELS = {
    "IN_REGION": ("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey", ()),
    "CUSTOMER_IN": ("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey", ()),
    "SUPPLIER_IN": ("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey", ()),
    "PLACED": ("orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey", ()),
    "CONTAINS": ("lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), None, ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")),
    "SHIPPED_BY": ("lineitem", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), None, ("l_quantity",)),
    "DID": ("events", ("Customer", "user_id"), ("Event", "event_id"), "event_id", ()),
    "HAS": ("conversations", ("Conversation", "conv_id"), ("Turn", "turn_id"), "turn_id", ()),
    "NEXT": ("conversations", ("Turn", "turn_id"), ("Turn", "next_id"), "turn_id", ()),
}


_opened: dict[tuple[str, str], PropertyGraph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """All tables as one graph, opened once for each session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key in _opened:
        return _opened[key]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {*(t for t, _ in NODES.values()), *(r[0] for r in RELS.values()), "labels"}}
    turns = read["conversations"].withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    frames = read | {"conversations": turns}
    own = {
        "Conversation": turns.select("conv_id").distinct(),
        "Document": read["documents"].join(read["labels"].select("doc_id", "quality", "toxic"), "doc_id", "left"),
        "NEXT": turns.select("turn_id").join(turns.select(F.col("turn_id").alias("next_id")), F.col("next_id") == F.col("turn_id") + 1),
    }
    g = PropertyGraph(spark)
    for label, (name, key_col) in NODES.items():
        g = g.with_nodes(label, own.get(label, frames[name]), key_col)
    for t, (name, src, dst, key_col, props) in RELS.items():
        g = g.with_rels(t, own.get(t, frames[name]), src, dst, key_col, props, complete=True)  # the test tables have no orphans
    _opened[key] = g
    return g


_ALL_NODES = " UNION ALL ".join(f"SELECT '{label}' l, count({'DISTINCT conv_id' if label == 'Conversation' else '*'}) c FROM {name}" for label, (name, _) in NODES.items())
#: name: (query, SQL)
CATALOGUE: dict[str, tuple[str, str]] = {
    "flagship": (
        "MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation)-[:IN_REGION]->(r:Region {r_name:'ASIA'}), (c)-[:PLACED]->(o:Order) RETURN n.n_name AS nation, count(o) AS orders, round(sum(o.o_totalprice),2) AS revenue ORDER BY revenue DESC",
        "SELECT n_name nation, count(*) orders, round(sum(o_totalprice),2) revenue FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey JOIN orders ON o_custkey=c_custkey WHERE r_name='ASIA' GROUP BY 1",
    ),
    "scan_label": ("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name", "SELECT r_regionkey::BIGINT k, r_name \"name\" FROM region"),
    "scan_all": ("MATCH (n) RETURN labels(n)[0] AS l, count(*) AS c", _ALL_NODES),
    "filter_and_or": ("MATCH (c:Customer) WHERE c.c_acctbal > 5000 AND (c.c_mktsegment = 'BUILDING' OR NOT c.c_nationkey < 10) RETURN c.c_custkey AS k", "SELECT c_custkey k FROM customer WHERE c_acctbal>5000 AND (c_mktsegment='BUILDING' OR NOT c_nationkey<10)"),
    "inline_props": ("MATCH (c:Customer {c_mktsegment:'BUILDING'}) RETURN count(*) AS c, round(avg(c.c_acctbal),4) AS a", "SELECT count(*) c, round(avg(c_acctbal),4) a FROM customer WHERE c_mktsegment='BUILDING'"),
    "hop1": ("MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation) RETURN n.n_name AS nation, count(c) AS c", "SELECT n_name nation, count(*) c FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1"),
    "hop2": ("MATCH (c:Customer)-[:CUSTOMER_IN]->(n)-[:IN_REGION]->(r) RETURN r.r_name AS region, count(*) AS c", "SELECT r_name region, count(*) c FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "hop3": ("MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:CUSTOMER_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(o) AS c, max(o.o_totalprice) AS m", "SELECT r_name region, count(*) c, max(o_totalprice) m FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "undirected": ("MATCH (n:Nation)-[:IN_REGION|CUSTOMER_IN]-(x) RETURN n.n_name AS n, count(x) AS c", "SELECT n_name n, 1+count(c_custkey) c FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1"),
    "multi_type": ("MATCH (o:Order)-[x:CONTAINS|SHIPPED_BY]->() RETURN type(x) AS t, count(*) AS c", "SELECT t, count(*) c FROM lineitem, (VALUES ('CONTAINS'),('SHIPPED_BY')) v(t) GROUP BY 1"),
    "type_expr": ("MATCH (c:Customer)-[x:!PLACED&!DID]->(n) RETURN type(x) AS t, count(*) AS c", "SELECT 'CUSTOMER_IN' t, count(*) c FROM customer"),
    "label_expr": ("MATCH (x:Customer|Supplier) RETURN labels(x)[0] AS l, count(*) AS c", "SELECT 'Customer' l, count(*) c FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier"),
    "label_not": ("MATCH (x:!Customer&!Supplier&!Order) WHERE NOT x:Nation RETURN labels(x)[0] AS l, count(*) AS c", f"SELECT * FROM ({_ALL_NODES}) WHERE l NOT IN ('Customer','Supplier','Order','Nation')"),
    "dynamic_label": ("WITH 'Region' AS l MATCH (x:$(l)) RETURN x.r_name AS n", "SELECT r_name n FROM region"),
    "cartesian": ("MATCH (a:Region),(b:Region) RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name a, b.r_name b FROM region a, region b"),
    "theta_join": ("MATCH (a:Nation),(b:Nation) WHERE a.n_name < b.n_name RETURN count(*) AS c", "SELECT count(*) c FROM nation a, nation b WHERE a.n_name<b.n_name"),
    "where_equi_join": ("MATCH (c:Customer),(s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN count(*) AS c", "SELECT count(*) c FROM customer JOIN supplier ON c_nationkey=s_nationkey"),
    "rel_unique": ("MATCH (p1:Part)<-[:CONTAINS]-(o:Order)-[:CONTAINS]->(p2:Part) RETURN count(*) AS c", "WITH l AS (SELECT l_orderkey k, row_number() OVER () r FROM lineitem) SELECT count(*) c FROM l a JOIN l b ON a.k=b.k AND a.r<>b.r"),
    "rel_not_unique_across": ("MATCH (p1:Part)<-[:CONTAINS]-(o:Order) MATCH (o)-[:CONTAINS]->(p2:Part) RETURN count(*) AS c", "SELECT count(*) c FROM lineitem a JOIN lineitem b USING (l_orderkey)"),
    "cycle": ("MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation)<-[:SUPPLIER_IN]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SHIPPED_BY]->(s) RETURN n.n_name AS n, count(*) AS c", "SELECT n_name n, count(*) c FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN supplier ON s_nationkey=n_nationkey JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey AND l_suppkey=s_suppkey GROUP BY 1"),
    "rel_props": ("MATCH (o:Order)-[x:CONTAINS {l_returnflag:'R'}]->(p:Part) WHERE x.l_quantity >= 45 RETURN p.p_brand AS b, count(*) AS c, round(sum(x.l_extendedprice * (1 - x.l_discount)),2) AS r", "SELECT p_brand b, count(*) c, round(sum(l_extendedprice*(1-l_discount)),2) r FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_returnflag='R' AND l_quantity>=45 GROUP BY 1"),
    "correlated_props": ("MATCH (n:Nation) MATCH (s:Supplier {s_nationkey: n.n_nationkey}) RETURN n.n_name AS n, count(s) AS c", "SELECT n_name n, count(*) c FROM nation JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, count(o) AS c", "SELECT c_custkey k, count(o_orderkey) c FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>300000 GROUP BY 1"),
    "optional_chain": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SUPPLIER_IN]-(s:Supplier) WHERE s.s_acctbal < 0 RETURN n.n_name AS n, s.s_name AS s", "SELECT n_name n, s_name s FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_acctbal<0"),
    "exists_pred": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN count(*) AS c", "SELECT count(*) c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)"),
    "not_exists": ("MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS {l_returnflag: 'R'}]-() RETURN p.p_partkey AS k", "SELECT p_partkey k FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_returnflag='R')"),
    "end_nodes": ("MATCH (a)-[x:CUSTOMER_IN|SUPPLIER_IN]->(b) RETURN type(x) AS t, startNode(x).c_name AS c, startNode(x).s_name AS s, labels(startNode(x))[0] AS l, endNode(x).n_name AS n, size(keys(endNode(x))) AS k", "SELECT 'CUSTOMER_IN' t, c_name c, NULL s, 'Customer' l, n_name n, 3::BIGINT k FROM customer JOIN nation ON c_nationkey=n_nationkey UNION ALL SELECT 'SUPPLIER_IN', NULL, s_name, 'Supplier', n_name, 3 FROM supplier JOIN nation ON s_nationkey=n_nationkey"),
    "path_nodes": ("MATCH p=(r:Region)<-[:IN_REGION|SUPPLIER_IN*1..2]-(x) WITH p, [n IN nodes(p) | coalesce(n.r_name, n.n_name, n.s_name)] AS names, [y IN relationships(p) | type(y)] AS types RETURN reduce(s = '', n IN names | s + '/' + n) AS names, reduce(s = '', t IN types | s + '/' + t) AS types, labels(last(nodes(p)))[0] AS l", "SELECT '/'||r_name||'/'||n_name \"names\", '/IN_REGION' \"types\", 'Nation' l FROM region JOIN nation ON n_regionkey=r_regionkey UNION ALL SELECT '/'||r_name||'/'||n_name||'/'||s_name, '/IN_REGION/SUPPLIER_IN', 'Supplier' FROM region JOIN nation ON n_regionkey=r_regionkey JOIN supplier ON s_nationkey=n_nationkey"),
    "path_rels": ("MATCH p=(c:Customer {c_custkey: 7})-[:PLACED|CONTAINS*2]->(x) RETURN x.p_partkey AS k, [y IN relationships(p) | y.l_quantity][1] AS q, endNode(last(relationships(p))).p_name AS n", "SELECT p_partkey k, l_quantity q, p_name n FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey WHERE o_custkey=7"),
    "pattern_comp_outer": ("MATCH (n:Nation) WITH n, n.n_nationkey * 100.0 AS least RETURN n.n_name AS n, size([(n)<-[:SUPPLIER_IN]-(s) WHERE s.s_acctbal > least | s.s_acctbal - least]) AS c", "SELECT n_name n, count(s_suppkey) c FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_acctbal>n_nationkey*100.0 GROUP BY 1"),
    "optional_pattern": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:CUSTOMER_IN]-(c:Customer) WHERE NOT (c)-[:DID]->() AND c.c_acctbal < 0 RETURN n.n_name AS n, count(c) AS c", "SELECT n_name n, count(c_custkey) c FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey AND c_acctbal<0 AND NOT EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey) GROUP BY 1"),
    "bound_rel": ("MATCH (:Customer)-[x:CUSTOMER_IN]->() WITH x MATCH (a)-[x]->(b:Nation) RETURN a.c_name AS c, b.n_name AS n", "SELECT c_name c, n_name n FROM customer JOIN nation ON c_nationkey=n_nationkey"),
    "bound_varlen": ("MATCH (:Turn {turn:0})-[rs:NEXT*2]->() WITH rs MATCH (a)-[rs*1..3]->(b) RETURN a.conv_id AS c, a.turn AS s, b.turn AS e", "SELECT conv_id c, 0::BIGINT s, turn e FROM conversations WHERE turn=2"),
    "varlen_branching": ("MATCH (s:Supplier {s_suppkey: 1})-[:SUPPLIER_IN|IN_REGION*1..3]-(x) RETURN labels(x)[0] AS l, count(*) AS c", "WITH me AS (SELECT n_nationkey k, n_regionkey r FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE s_suppkey=1) SELECT * FROM (SELECT 'Nation' l, count(*) c FROM nation JOIN me ON n_regionkey=r UNION ALL SELECT 'Supplier', count(*)-1 FROM supplier JOIN me ON s_nationkey=k UNION ALL SELECT 'Region', 1) WHERE c>0"),
    "column_names": ("MATCH (n:Nation) RETURN n.n_regionkey, count(*), 1 + 1", "SELECT n_regionkey::BIGINT \"n.n_regionkey\", count(*) \"count(*)\", 2::BIGINT \"1 + 1\" FROM nation GROUP BY 1"),
    "str_more": ("MATCH (p:Part) RETURN p.p_partkey AS k, char_length(p.p_name) AS a, lTrim('  ' + p.p_brand) AS b, rTrim(p.p_brand + ' ') AS c, btrim('xx' + p.p_brand + 'x', 'x') AS d, replace(p.p_brand, '', '.') AS e, size(split(p.p_name, '')) AS f, toLower(toString(p.p_retailprice > 1000)) AS g", "SELECT p_partkey k, length(p_name) a, p_brand b, p_brand c, p_brand d, '.'||array_to_string(string_split(p_brand,''),'.')||'.' e, length(p_name)::BIGINT f, (p_retailprice>1000)::VARCHAR g FROM part"),
    "math_more": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(cos(p.p_size),9) AS a, round(tan(p.p_size),6) AS b, round(cot(p.p_size),6) AS c, round(asin(p.p_size / 100.0),9) AS d, round(acos(p.p_size / 100.0),9) AS e, round(atan(p.p_size),9) AS f, round(degrees(p.p_size),6) AS g, round(e() * pi(),9) AS h", "SELECT p_partkey k, round(cos(p_size),9) a, round(tan(p_size),6) b, round(cot(p_size),6) c, round(asin(p_size/100.0::DOUBLE),9) d, round(acos(p_size/100.0::DOUBLE),9) e, round(atan(p_size),9) f, round(degrees(p_size),6) g, round(exp(1)*pi(),9) h FROM part"),
    "round_modes": ("MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 4.0 - 5 AS x, p.p_partkey % 2 AS q RETURN k, round(x, 1, 'HALF_EVEN') AS a, round(x, 1, 'CEILING') AS b, round(x, 1, 'FLOOR') AS c, round(x, q) AS d, round(x, 1) AS e", "SELECT p_partkey k, round_even(x,1) a, ceil(x*10)/10 b, floor(x*10)/10 c, CASE WHEN p_partkey%2=0 THEN floor(x+0.5) ELSE round(x,1) END d, round(x,1) e FROM (SELECT p_partkey, p_size/4.0::DOUBLE-5 x FROM part)"),
    "conversions_or_null": ("MATCH (p:Part) RETURN p.p_partkey AS k, toIntegerOrNull(p.p_name) AS a, toFloatOrNull(toString(p.p_size)) AS b, toBooleanOrNull([1]) AS c, toStringOrNull(p.p_size) AS d, toIntegerList(['1', 'x', toString(p.p_size)])[2] AS e, toFloatList([1, '2.5'])[1] AS f, toStringList([1, null])[0] AS g, toBooleanList(['true', 'x'])[1] AS h", "SELECT p_partkey k, NULL::BIGINT a, p_size::DOUBLE b, NULL::BOOLEAN c, p_size::VARCHAR d, p_size::BIGINT e, 2.5::DOUBLE f, '1' g, NULL::BOOLEAN h FROM part"),
    "ids": ("MATCH (n:Nation)-[x:IN_REGION]->() RETURN count(DISTINCT id(n)) AS a, count(DISTINCT elementId(n)) AS b, min(elementId(n)) STARTS WITH 'node:' AS c, count(DISTINCT id(x)) AS d, max(elementId(x)) STARTS WITH 'relationship:' AS e", "SELECT count(*) a, count(*) b, true c, count(*) d, true e FROM nation"),
    "random": ("UNWIND range(1, 100) AS i WITH rand() AS r, randomUUID() AS u, timestamp() AS t RETURN min(r) >= 0 AND max(r) < 1 AS a, count(DISTINCT u) AS u, min(size(u)) AS s, count(DISTINCT t) AS t", "SELECT true a, 100::BIGINT u, 36::BIGINT s, 1::BIGINT t"),
    "literals": ("RETURN 0x1F AS a, 0o17 AS b, 1e3 AS c, 'a\\'b' AS d, \"x\" AS e, .5 AS f, size([1, 2] + 3 + [4]) AS g, {k: [1, 2]}.k[1] AS h, -(+3) AS i", "SELECT 31::BIGINT a, 15::BIGINT b, 1000.0::DOUBLE c, 'a''b' d, 'x' e, 0.5::DOUBLE f, 4::BIGINT g, 2::BIGINT h, (-3)::BIGINT i"),
    "mixed_values": ("UNWIND [1, 'a', true, 0.5, null, 2, 'b'] AS x RETURN toString(x) AS s, valueType(x) AS t, x > 0.7 AS g, x = 2.0 AS e, x IN [1, 'b'] AS i", "SELECT * FROM (VALUES ('1','INTEGER NOT NULL',true,false,true), ('a','STRING NOT NULL',NULL,false,false), ('true','BOOLEAN NOT NULL',NULL,false,false), ('0.5','FLOAT NOT NULL',false,false,false), (NULL,'NULL',NULL,NULL,NULL), ('2','INTEGER NOT NULL',true,true,false), ('b','STRING NOT NULL',NULL,false,true)) v(s,t,g,e,i)"),
    "mixed_order": ("UNWIND [1, 'a', true, 0.5, null, 2, 'b'] AS x WITH x ORDER BY x SKIP 1 LIMIT 3 RETURN collect(toString(x))[0] AS a, toString(min(x)) AS b, toString(max(x)) AS c, count(x) AS n", "SELECT 'b' a, 'b' b, '0.5' c, 3::BIGINT n"),
    "mixed_property": ("MATCH (n:Region|Customer|Part) WITH CASE WHEN n.r_name IS NOT NULL THEN n.r_name WHEN n.c_acctbal > 0 THEN n.c_acctbal ELSE n.p_size END AS x RETURN valueType(x) AS t, count(*) AS c, toString(max(x)) = toString(min(x)) AS s", "SELECT * FROM (SELECT 'STRING NOT NULL' t, count(*) c, false s FROM region UNION ALL SELECT 'FLOAT NOT NULL', count(*), false FROM customer WHERE c_acctbal>0 UNION ALL SELECT 'INTEGER NOT NULL', count(*), false FROM part UNION ALL SELECT 'NULL', count(*), NULL FROM customer WHERE c_acctbal<=0) WHERE c>0"),
    "percentile_of_rows": ("MATCH (p:Part) WITH p, 0.25 AS q RETURN p.p_brand AS b, round(percentileCont(p.p_retailprice, q),6) AS c, percentileDisc(p.p_size, q) AS d", "SELECT p_brand b, round(quantile_cont(p_retailprice,0.25),6) c, quantile_disc(p_size::BIGINT,0.25) d FROM part GROUP BY 1"),
    "agg_distinct_more": ("MATCH (p:Part) RETURN sum(DISTINCT p.p_size) AS a, round(avg(DISTINCT p.p_size),6) AS b, size(collect(DISTINCT p.p_brand)) AS c, min(DISTINCT p.p_size) AS d", "SELECT sum(DISTINCT p_size)::BIGINT a, round(avg(DISTINCT p_size),6) b, count(DISTINCT p_brand) c, min(p_size)::BIGINT d FROM part"),
    "node_lists": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS ns UNWIND ns AS n MATCH (n)<-[:SUPPLIER_IN]-(s) RETURN r.r_name AS r, n.n_name AS n, s.s_name AS s", "SELECT r_name r, n_name n, s_name s FROM region JOIN nation ON n_regionkey=r_regionkey JOIN supplier ON s_nationkey=n_nationkey"),
    "exists_or": ("MATCH (c:Customer) WHERE c.c_acctbal < 0 OR exists((c)-[:PLACED]->()) RETURN count(*) AS c", "SELECT count(*) c FROM customer WHERE c_acctbal<0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)"),
    "pattern_comp": ("MATCH (n:Nation) RETURN n.n_name AS n, size([(n)<-[:SUPPLIER_IN]-(s) WHERE s.s_acctbal > 0 | s.s_suppkey]) AS c", "SELECT n_name n, count(s_suppkey) c FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_acctbal>0 GROUP BY 1"),
    "varlen_bounded": ("MATCH (t:Turn)-[:NEXT*1..3]->(u:Turn) RETURN t.turn AS t, u.turn AS u, count(*) AS c", "SELECT a.turn t, b.turn u, count(*) c FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn-a.turn BETWEEN 1 AND 3 GROUP BY 1,2"),
    "varlen_zero": ("MATCH (t:Turn {turn:0})-[:NEXT*0..2]->(u) RETURN u.turn AS u, count(*) AS c", "SELECT b.turn u, count(*) c FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn BETWEEN 0 AND 2 WHERE a.turn=0 GROUP BY 1"),
    "varlen_unbounded": ("MATCH (t:Turn {turn:0})-[rs:NEXT*]->(u) RETURN size(rs) AS hops, count(*) AS c", "SELECT turn hops, count(*) c FROM conversations WHERE turn>0 GROUP BY 1"),
    "path_fn": ("MATCH p=(t:Turn {turn:0})-[:NEXT*]->(u) RETURN u.conv_id AS conv, length(p) AS l, size(nodes(p)) AS n, size(relationships(p)) AS r", "SELECT conv_id conv, turn l, turn+1 n, turn r FROM conversations WHERE turn > 0"),
    "agg_group": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS c, round(sum(o.o_totalprice),2) AS t, round(avg(o.o_totalprice),4) AS a, min(o.o_orderkey) AS lo, max(o.o_orderkey) AS hi", "SELECT o_orderstatus s, count(*) c, round(sum(o_totalprice),2) t, round(avg(o_totalprice),4) a, min(o_orderkey) lo, max(o_orderkey) hi FROM orders GROUP BY 1"),
    "agg_global": ("MATCH (p:Part) RETURN count(*) AS c, sum(p.p_size) AS s, min(p.p_name) AS lo", "SELECT count(*) c, sum(p_size)::BIGINT s, min(p_name) lo FROM part"),
    "agg_empty": ("MATCH (p:Part) WHERE p.p_size < 0 RETURN count(*) AS c, sum(p.p_size) AS s, avg(p.p_size) AS a, stDev(p.p_size) AS d, size(collect(p.p_name)) AS k", "SELECT 0::BIGINT c, 0::BIGINT s, NULL::DOUBLE a, 0.0::DOUBLE d, 0::BIGINT k"),
    "agg_distinct": ("MATCH (o:Order) RETURN count(DISTINCT o.o_custkey) AS c, count(DISTINCT o.o_orderpriority) AS p", "SELECT count(DISTINCT o_custkey) c, count(DISTINCT o_orderpriority) p FROM orders"),
    "agg_stdev": ("MATCH (p:Part) RETURN p.p_type AS t, round(stDev(p.p_retailprice),6) AS a, round(stDevP(p.p_retailprice),6) AS b, round(var(p.p_size),6) AS c, round(varP(p.p_size),6) AS d", "SELECT p_type t, round(stddev_samp(p_retailprice),6) a, round(stddev_pop(p_retailprice),6) b, round(var_samp(p_size),6) c, round(var_pop(p_size),6) d FROM part GROUP BY 1"),
    "agg_pct_cont": ("MATCH (p:Part) RETURN p.p_brand AS b, round(percentileCont(p.p_retailprice, 0.3),6) AS m", "SELECT p_brand b, round(quantile_cont(p_retailprice,0.3),6) m FROM part GROUP BY 1"),
    "agg_pct_disc": ("MATCH (p:Part) RETURN p.p_brand AS b, percentileDisc(p.p_size, 0.5) AS m", "SELECT p_brand b, quantile_disc(p_size::BIGINT,0.5) m FROM part GROUP BY 1"),
    "agg_expr": ("MATCH (n:Nation) RETURN 1 + count(*) AS c, sum(n.n_nationkey) * 2 AS s", "SELECT 1+count(*) c, (sum(n_nationkey)*2)::BIGINT s FROM nation"),
    "having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c.c_nationkey AS n, count(*) AS k WHERE k > 5 RETURN n, k", "SELECT c_nationkey::BIGINT n, count(*) k FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1 HAVING count(*)>5"),
    "group_by_node": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS k WHERE k >= 15 RETURN c.c_name AS n, k", "SELECT c_name n, count(*) k FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_name HAVING count(*)>=15"),
    "collect_sorted": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS r, n.n_name AS n ORDER BY n DESC RETURN r, collect(n)[0] AS f, size(collect(n)) AS c", "SELECT r_name r, max(n_name) f, count(*) c FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.o_orderpriority AS p, o.o_orderstatus AS s", "SELECT DISTINCT o_orderpriority p, o_orderstatus s FROM orders"),
    "order_nulls": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SUPPLIER_IN]-(s:Supplier {s_suppkey: 1}) WITH n.n_name AS n, s.s_name AS s ORDER BY s, n LIMIT 3 RETURN n, s", "SELECT n_name n, s_name s FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_suppkey=1 ORDER BY s NULLS LAST, n LIMIT 3"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP 10 LIMIT 5", "SELECT c_custkey k FROM customer ORDER BY 1 LIMIT 5 OFFSET 10"),
    "topk": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "SELECT o_orderkey k, o_totalprice p FROM orders ORDER BY 2 DESC, 1 LIMIT 10"),
    "order_after_agg": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, count(*) AS c ORDER BY count(*) DESC, p LIMIT 3", "SELECT o_orderpriority p, count(*) c FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "with_star": ("MATCH (r:Region) WITH *, r.r_regionkey + 1 AS k RETURN k, r.r_name AS n", "SELECT r_regionkey::BIGINT+1 k, r_name n FROM region"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey::BIGINT k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (c:Region) RETURN c.r_name AS k UNION ALL MATCH (s:Nation) RETURN s.n_name AS k", "SELECT r_name k FROM region UNION ALL SELECT n_name FROM nation"),
    "unwind": ("MATCH (r:Region) UNWIND [1, 2, r.r_regionkey] AS x RETURN r.r_name AS r, x", "SELECT r_name r, x FROM region, unnest([1::BIGINT,2,r_regionkey]) t(x)"),
    "unwind_null": ("UNWIND [null, 1] AS x UNWIND null AS y RETURN x, y", "SELECT 1::BIGINT x, NULL::VARCHAR y WHERE false"),
    "unwind_words": ("MATCH (d:BenchItem) UNWIND split(d.text, ' ') AS w RETURN d.item_id AS d, count(w) AS c", "SELECT item_id d, len(string_split(text,' ')) c FROM benchmark"),
    "list_comp": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, size([x IN range(0, n.n_nationkey) WHERE x % 3 = 0 | x * x]) AS s", "SELECT n_nationkey::BIGINT k, (n_nationkey//3+1)::BIGINT s FROM nation"),
    "reduce": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, reduce(a = 0, x IN range(1, n.n_nationkey) | a + x) AS s", "SELECT n_nationkey::BIGINT k, (n_nationkey*(n_nationkey+1)//2)::BIGINT s FROM nation"),
    "quantifiers": ("MATCH (r:Region) WITH r, range(0, r.r_regionkey) AS l RETURN r.r_name AS n, all(x IN l WHERE x < 3) AS a, any(x IN l WHERE x = 2) AS b, none(x IN l WHERE x > 1) AS c, single(x IN l WHERE x > 0) AS d", "SELECT r_name n, r_regionkey<3 a, r_regionkey>=2 b, r_regionkey<=1 c, r_regionkey=1 d FROM region"),
    "list_access": ("MATCH (r:Region) WITH r, [10, 20, 30, 40] AS l RETURN r.r_name AS n, l[r.r_regionkey] AS a, l[-1] AS b, size(l[1..3]) AS c, head(l) AS d, last(l) AS e, size(tail(l)) AS f, 20 IN l AS g", "SELECT r_name n, ([10,20,30,40])[r_regionkey+1]::BIGINT a, 40::BIGINT b, 2::BIGINT c, 10::BIGINT d, 40::BIGINT e, 3::BIGINT f, true g FROM region"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS c", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END s, count(*) c FROM orders GROUP BY 1"),
    "case_searched": ("MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 1 WHEN p.p_size < 30 THEN 2 END AS s, count(*) AS c", "SELECT (CASE WHEN p_size<10 THEN 1 WHEN p_size<30 THEN 2 END)::BIGINT s, count(*) c FROM part GROUP BY 1"),
    "null_logic": ("UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS n, a = b AS e, a IS NULL AS i", "SELECT a, b, a AND b x, a OR b y, xor(a::INT,b::INT)::BOOLEAN z, NOT a n, a=b e, a IS NULL i FROM (VALUES (true),(false),(NULL::BOOLEAN)) p(a), (VALUES (true),(false),(NULL::BOOLEAN)) q(b)"),
    "coalesce": ("MATCH (d:Document) RETURN coalesce(d.quality, -1) AS q, count(*) AS c", "SELECT coalesce(quality,-1)::BIGINT q, count(*) c FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "int_div": ("MATCH (o:Order) RETURN o.o_orderkey / 7 AS d, o.o_orderkey % 7 AS m, -o.o_orderkey / 7 AS n, count(*) AS c", "SELECT o_orderkey//7 d, o_orderkey%7 m, -(o_orderkey//7) n, count(*) c FROM orders GROUP BY 1,2,3"),
    "div_float_zero": ("MATCH (r:Region) RETURN r.r_name AS n, 1.0 / (r.r_regionkey - 2) AS x", "SELECT r_name n, CASE WHEN r_regionkey=2 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE/(r_regionkey-2) END x FROM region"),
    "power": ("MATCH (r:Region) RETURN r.r_regionkey ^ 3 AS x, r.r_regionkey + 0.5 AS y, r.r_regionkey * 2 - 1 AS z", "SELECT pow(r_regionkey,3)::DOUBLE x, r_regionkey+0.5::DOUBLE y, r_regionkey::BIGINT*2-1 z FROM region"),
    "comparison_chain": ("MATCH (p:Part) WHERE 5 < p.p_size <= 20 RETURN count(*) AS c", "SELECT count(*) c FROM part WHERE 5<p_size AND p_size<=20"),
    "string_tests": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'p' OR p.p_name CONTAINS '12' OR p.p_brand ENDS WITH '3' RETURN count(*) AS c", "SELECT count(*) c FROM part WHERE starts_with(p_name,'p') OR contains(p_name,'12') OR suffix(p_brand,'3')"),
    "str_case": ("MATCH (p:Part) RETURN p.p_partkey AS k, toUpper(p.p_name) AS a, toLower(p.p_brand) AS b, size(p.p_name) AS c, reverse(p.p_brand) AS d", "SELECT p_partkey k, upper(p_name) a, lower(p_brand) b, length(p_name) c, reverse(p_brand) d FROM part"),
    "str_cut": ("MATCH (p:Part) RETURN p.p_partkey AS k, substring(p.p_name, 1, 3) AS a, left(p.p_brand, 2) AS b, right(p.p_brand, 2) AS c, replace(p.p_type, 'A', '-') AS d, trim('  ' + p.p_brand + ' ') AS e", "SELECT p_partkey k, substr(p_name,2,3) a, left(p_brand,2) b, right(p_brand,2) c, replace(p_type,'A','-') d, p_brand e FROM part"),
    "str_split": ("MATCH (n:Nation) RETURN n.n_name AS n, split(n.n_name, '_')[0] AS a, size(split(n.n_name, '_')) AS b", "SELECT n_name n, split_part(n_name,'_',1) a, len(string_split(n_name,'_')) b FROM nation"),
    "math_round": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(p.p_retailprice) AS a, floor(p.p_retailprice) AS b, ceil(p.p_retailprice) AS c, abs(-p.p_size) AS d, sign(p.p_size) AS e", "SELECT p_partkey k, floor(p_retailprice+0.5) a, floor(p_retailprice) b, ceil(p_retailprice) c, abs(p_size)::BIGINT d, sign(p_size)::BIGINT e FROM part"),
    "math_fn": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(sqrt(p.p_size),6) AS a, round(exp(p.p_size / 50.0),6) AS b, round(log(p.p_size),6) AS c, round(log10(p.p_size),6) AS d, round(sin(p.p_size),6) AS e, round(atan2(p.p_size, 3),6) AS f, round(radians(p.p_size),6) AS g, round(haversin(p.p_size),6) AS h", "SELECT p_partkey k, round(sqrt(p_size),6) a, round(exp(p_size/50.0::DOUBLE),6) b, round(ln(p_size),6) c, round(log10(p_size),6) d, round(sin(p_size),6) e, round(atan2(p_size,3),6) f, round(radians(p_size),6) g, round((1-cos(p_size))/2,6) h FROM part"),
    "conversions": ("MATCH (o:Order) RETURN o.o_orderkey AS k, toString(o.o_orderkey) AS a, toInteger(toString(o.o_orderkey)) AS b, toFloat(o.o_orderkey) AS c, toInteger(o.o_totalprice) AS d, toBoolean('true') AS e, toInteger('x') AS f", "SELECT o_orderkey k, o_orderkey::VARCHAR a, o_orderkey b, o_orderkey::DOUBLE c, trunc(o_totalprice)::BIGINT d, true e, NULL::BIGINT f FROM orders"),
    "null_fn": ("MATCH (r:Region) RETURN r.r_name AS n, nullIf(r.r_regionkey, 2) AS a, isEmpty(r.r_name) AS b, isNaN(0.0 / r.r_regionkey) AS c, valueType(r.r_regionkey) AS d, r.missing IS NULL AS e", "SELECT r_name n, nullif(r_regionkey,2)::BIGINT a, false b, r_regionkey=0 c, 'INTEGER NOT NULL' d, true e FROM region"),
    "graph_fn": ("MATCH (n:Nation)-[x:IN_REGION]->(r:Region) RETURN n.n_name AS n, labels(r)[0] AS l, type(x) AS t, size(keys(n)) AS k, startNode(x) = n AS s, endNode(x) = r AS e, properties(n).n_name AS p, n['n_name'] AS d", "SELECT n_name n, 'Region' l, 'IN_REGION' t, 3::BIGINT k, true s, true e, n_name p, n_name d FROM nation"),
    "map_projection": ("MATCH (r:Region) WITH r {.r_name, k: r.r_regionkey * 2} AS m RETURN m.r_name AS n, m.k AS k", "SELECT r_name n, r_regionkey::BIGINT*2 k FROM region"),
    "doc_quality": ("MATCH (d:Document) WHERE d.quality = 1 RETURN d.lang AS l, count(*) AS c, sum(d.n_chars) AS s", "SELECT lang l, count(*) c, sum(n_chars)::BIGINT s FROM documents JOIN labels USING (doc_id) WHERE quality=1 GROUP BY 1"),
    "events_by_segment": ("MATCH (c:Customer)-[:DID]->(e:Event) RETURN c.c_mktsegment AS s, e.event_type AS t, count(*) AS c, round(sum(e.value),2) AS v", "SELECT c_mktsegment s, event_type t, count(*) c, round(sum(value),2) v FROM customer JOIN events ON user_id=c_custkey GROUP BY 1,2"),
    "turns": ("MATCH (c:Conversation)-[:HAS]->(t:Turn) WHERE t.role = 'user' RETURN c.conv_id AS c, count(t) AS n", "SELECT conv_id c, count(*) n FROM conversations WHERE role='user' GROUP BY 1"),
}


#: name: (update, query on the new graph, SQL)
UPDATES: dict[str, tuple[str, str, str]] = {
    "mutate_set": ("MATCH (r:Region) WHERE r.r_regionkey > 1 SET r.rank = r.r_regionkey * 10, r.r_name = toLower(r.r_name)", "MATCH (r:Region) RETURN r.r_name AS n, r.rank AS k", "SELECT CASE WHEN r_regionkey>1 THEN lower(r_name) ELSE r_name END n, (CASE WHEN r_regionkey>1 THEN r_regionkey*10 END)::BIGINT k FROM region"),
    "mutate_remove": ("MATCH (n:Nation) WHERE n.n_nationkey < 5 REMOVE n.n_name SET n:Small", "MATCH (n:Small) RETURN n.n_nationkey AS k, n.n_name IS NULL AS m", "SELECT n_nationkey::BIGINT k, true m FROM nation WHERE n_nationkey<5"),
    "mutate_create": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:FLAG {of: n.n_name}]->(:Flag {region: r.r_name})", "MATCH (n:Nation)-[x:FLAG]->(f:Flag) RETURN n.n_name AS n, x.of AS o, f.region AS r", "SELECT n_name n, n_name o, r_name r FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "mutate_merge": ("MATCH (n:Nation) MERGE (g:Group {k: n.n_nationkey % 4}) ON CREATE SET g.made = true", "MATCH (g:Group) RETURN g.k AS k, g.made AS m", "SELECT DISTINCT (n_nationkey%4)::BIGINT k, true m FROM nation"),
    "mutate_delete": ("MATCH (r:Region {r_name: 'ASIA'}) DETACH DELETE r", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS c", "SELECT r_name r, count(*) c FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'ASIA' GROUP BY 1"),
    "mutate_fold": ("MATCH (s:Supplier)-[:SUPPLIER_IN]->(n:Nation) SET n.total = coalesce(n.total, 0) + s.s_suppkey, n.seen = n.total >= 50", "MATCH (n:Nation) RETURN n.n_name AS n, n.total AS t, n.seen AS s", "SELECT n_name n, sum(s_suppkey)::BIGINT t, sum(s_suppkey) >= 50 s FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1"),
    "mutate_merge_count": ("MATCH (n:Nation) MERGE (g:Group {k: n.n_nationkey % 4}) ON CREATE SET g.n = 1 ON MATCH SET g.n = g.n + 1", "MATCH (g:Group) RETURN g.k AS k, g.n AS n", "SELECT (n_nationkey%4)::BIGINT k, count(*) n FROM nation GROUP BY 1"),
    "mutate_key": ("MATCH (r:Region) SET r['rank_' + toString(r.r_regionkey % 2)] = r.r_regionkey", "MATCH (r:Region) RETURN r.r_name AS n, r.rank_0 AS a, r.rank_1 AS b", "SELECT r_name n, (CASE WHEN r_regionkey%2=0 THEN r_regionkey END)::BIGINT a, (CASE WHEN r_regionkey%2=1 THEN r_regionkey END)::BIGINT b FROM region"),
    "mutate_map": ("MATCH (r:Region) SET r = {r_name: r.r_name, k: r.r_regionkey}", "MATCH (r:Region) RETURN r.r_name AS n, r.k AS k, r.r_regionkey IS NULL AS gone", "SELECT r_name n, r_regionkey::BIGINT k, true gone FROM region"),
    "mutate_add_map": ("MATCH (r:Region) SET r += {k: 1, r_regionkey: null}", "MATCH (r:Region) RETURN r.r_name AS n, r.k AS k, size(keys(r)) AS s", "SELECT r_name n, 1::BIGINT k, 2::BIGINT s FROM region"),
    "mutate_order": ("UNWIND [3, 1, 2] AS i MATCH (r:Region) SET r.last = i", "MATCH (r:Region) RETURN r.r_name AS n, r.last AS k", "SELECT r_name n, 2::BIGINT k FROM region"),
    "mutate_statements": ("CREATE (:S {k: 1}); MATCH (s:S) SET s.k = s.k + 1; CREATE (:S {k: 5}) FINISH", "MATCH (s:S) RETURN s.k AS k", "SELECT unnest([2::BIGINT,5]) k"),
    "mutate_foreach": ("MATCH (r:Region) FOREACH (i IN range(1, r.r_regionkey) | CREATE (:Mark {of: r.r_name, i: i}))", "MATCH (m:Mark) RETURN m.of AS o, count(*) AS c", "SELECT r_name o, r_regionkey::BIGINT c FROM region WHERE r_regionkey>0"),
}


def _read(text: str):
    return lambda spark, sf_dir: Query(text).execute(graph_of(spark, sf_dir)).df


def _update(change: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph_of(spark, sf_dir).cypher_mut(change)[0].cypher(text).df

    return run


def _selected(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, object]:
    g = graph_of(spark, sf_dir)
    return g, g.cypher_select("MATCH (n:Nation)-[x:IN_REGION]->(r:Region) WHERE n.n_nationkey < 10 RETURN n, x")


def selection_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = _selected(spark, sf_dir)
    return s.induced(g).cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r").df


def selection_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = _selected(spark, sf_dir)
    return s.subgraph(g)[0].cypher("MATCH (n) OPTIONAL MATCH (n)-[x]->() RETURN coalesce(n.n_name, n.r_name) AS n, count(x) AS c").df


def selection_edge_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = _selected(spark, sf_dir)
    return s.edge_filtered(g).cypher("MATCH (n)-[x]->(r) RETURN type(x) AS t, count(*) AS c").df


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "MATCH (c:Customer {c_nationkey: $at.c_nationkey}) WHERE c.c_acctbal > $least AND c.c_mktsegment IN $segments RETURN c.c_custkey AS k, $least AS l"
    return graph_of(spark, sf_dir).cypher(text, {"at": {"c_nationkey": 3}, "least": 10.5, "segments": ["BUILDING", "MACHINERY"]}).df


def script_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PropertyGraph.from_cypher(spark, "CREATE (a:Stop {n: 1})-[:TO {w: 2}]->(b:Stop {n: 2})-[:TO {w: 3}]->(a), (b)-[:TO {w: 5}]->(:Stop {n: 3})")
    return g.cypher("MATCH (a:Stop)-[rs:TO*1..3]->(b) RETURN a.n AS a, b.n AS b, reduce(s = 0, r IN rs | s + r.w) AS w").df


def failed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that fails leaves the graph as it was."""
    g = graph_of(spark, sf_dir)
    try:
        g.cypher_mut("MATCH (r:Region) CREATE (:New) SET r.r_name = 'x' RETURN 1 / (r.r_regionkey - r.r_regionkey) AS x")
    except DivisionByZero:
        pass
    return g.cypher("MATCH (r:Region) OPTIONAL MATCH (n:New) RETURN r.r_name AS n, count(n) AS c").df


#: Queries that are refused, and the kind of error.
REFUSED = {
    "CALL db.labels()": "Unsupported", "LOAD CSV FROM 'x' AS l RETURN l": "Unsupported", "MATCH p = shortestPath((a)-[*]->(b)) RETURN p": "Unsupported", "RETURN 'a' =~ 'b' AS x": "Unsupported", "RETURN 'a' || 'b' AS x": "Unsupported",
    "RETURN 1 IS :: INTEGER AS x": "Unsupported", "MATCH (n) WHERE EXISTS { (n)-->() } RETURN n": "Unsupported", "RETURN 1 AS x UNION RETURN 2 AS x UNION ALL RETURN 3 AS x": "InvalidQuery", "RETURN 1 AS x UNION RETURN 2 AS y": "InvalidQuery", "RETURN count(1, 2) AS x": "InvalidQuery",
    "RETURN foo(1) AS x": "Unsupported", "RETURN size() AS x": "InvalidQuery", "CREATE (n:X)": "InvalidQuery", "MATCH (n) RETURN m": "InvalidQuery", "RETURN $p AS x": "InvalidQuery", "RETURN 1 +": "ParseError", "MATCH (n) WITH n.x RETURN 1 AS x": "InvalidQuery", "MATCH (n $q) RETURN n": "InvalidQuery", "MATCH (n)-[n]->() RETURN n": "InvalidQuery", "MATCH (n) RETURN (n)-->() AS x": "InvalidQuery", "MATCH ()-[r]->()-[r]->() RETURN r": "InvalidQuery", "RETURN 1 AS a, 2 AS a": "InvalidQuery", "RETURN 1 AND true AS x": "TypeMismatch",
}
#: Updates that fail as they run.
FAILING = {
    "MATCH (r:Region) DETACH DELETE r RETURN r.r_name AS n": "QueryRuntimeError", "MATCH (r:Region) DETACH DELETE r RETURN labels(r) AS l": "QueryRuntimeError", "MATCH (r:Region) DELETE r": "QueryRuntimeError",
    "MATCH (r:Region) SET r.m = {a: 1}": "TypeMismatch", "MERGE (:X {k: null})": "QueryRuntimeError", "MATCH (r:Region) SET r.x = 1 / (r.r_regionkey - r.r_regionkey)": "DivisionByZero",
}


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, found = graph_of(spark, sf_dir), []
    for text in REFUSED:
        try:
            g.cypher(text, {"q": {}})
            found.append((text, "none"))
        except CypherError as e:
            found.append((text, type(e).__name__))
    for text in FAILING:
        try:
            g.cypher_mut(text)
            found.append((text, "none"))
        except CypherError as e:
            found.append((text, type(e).__name__))
    return spark.createDataFrame(found, "q string, kind string")


def export_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir).cypher_select("MATCH (r:Region) RETURN r").subgraph(graph_of(spark, sf_dir))[0]
    return script_lines(g).select("line")


def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    starts = g.cypher("MATCH (s:Supplier) RETURN id(s) AS id").df
    return reachable(g, starts).agg(F.count("*").alias("c"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment in rings, by key: every ring is a component, and so is every nation."""
    customers, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    ring = Window.partitionBy("c_nationkey", "c_mktsegment")
    after = F.coalesce(F.lead("c_custkey").over(ring.orderBy("c_custkey")), F.min("c_custkey").over(ring)).alias("next")
    g = PropertyGraph(spark).with_nodes("Customer", customers, "c_custkey").with_nodes("Nation", nations, "n_nationkey")
    g = g.with_rels("RING", customers.select("c_custkey", after), ("Customer", "c_custkey"), ("Customer", "next"), "c_custkey")
    g = g.with_rels("CUSTOMER_IN", customers, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey")
    return components(g).agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))


QUERIES = {n: _read(t) for n, (t, _) in CATALOGUE.items()} | {n: _update(c, t) for n, (c, t, _) in UPDATES.items()} | {f.__name__: f for f in (selection_induced, selection_subgraph, selection_edge_filtered, parameters, script_source, failed_update, refusals, export_script, graph_reachable, graph_components)}
ORACLES = {n: s for n, (_, s) in CATALOGUE.items()} | {n: s for n, (_, _, s) in UPDATES.items()} | {
    "selection_induced": "SELECT n_name n, r_name r FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey<10",
    "selection_subgraph": "SELECT n_name n, 1::BIGINT c FROM nation WHERE n_nationkey<10 UNION ALL SELECT DISTINCT r_name, 0::BIGINT FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey<10",
    "selection_edge_filtered": "SELECT 'IN_REGION' t, count(*) c FROM nation WHERE n_nationkey<10",
    "parameters": "SELECT c_custkey k, 10.5::DOUBLE l FROM customer WHERE c_nationkey=3 AND c_acctbal>10.5 AND c_mktsegment IN ('BUILDING','MACHINERY')",
    "script_source": "SELECT unnest([1,1,1,2,2,2,2])::BIGINT a, unnest([2,1,3,1,3,2,3])::BIGINT b, unnest([2,5,7,3,5,5,10])::BIGINT w",
    "failed_update": "SELECT r_name n, 0::BIGINT c FROM region",
    "refusals": "SELECT * FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + f"', '{kind}')" for q, kind in (REFUSED | FAILING).items()) + ") v(q, kind)",
    "export_script": "SELECT 'CREATE (n' || (row_number() OVER (ORDER BY r_regionkey)-1) || ':Region {r_name: ''' || r_name || ''', r_regionkey: ' || r_regionkey || '})' line FROM region",
    "graph_reachable": "WITH s AS (SELECT * FROM supplier), n AS (SELECT DISTINCT n_nationkey k, n_regionkey r FROM s JOIN nation ON s_nationkey=n_nationkey) SELECT (SELECT count(*) FROM s)+(SELECT count(*) FROM n)+(SELECT count(DISTINCT r) FROM n) c",
    "graph_components": "SELECT (SELECT count(*) FROM customer)+(SELECT count(*) FROM nation) nodes, (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer)+(SELECT count(*) FROM nation) components",
}
