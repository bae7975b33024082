"""A graph as a script of CREATE clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.plans.durable import numbered
from graphspark.plans.types import DYN, FLOAT, INT, STR, T, of_spark
from graphspark.sources.graph import PropertyGraph


def to_cypher_create(g: PropertyGraph) -> str:
    """One CREATE for each node, then one for each relationship; reading it back gives the graph again."""
    return "\n".join(r.line for r in script_lines(g).orderBy("part", "number").toLocalIterator())


def script_lines(g: PropertyGraph) -> DataFrame:
    """The script's lines: part (0 nodes, 1 relationships), number, line."""
    nodes, rels = g.all_nodes(), g.all_rels()
    names = numbered(nodes.select("id"), "number", "id")
    nodes = nodes.join(names, "id")
    labels = F.array_join(F.transform("labels", lambda x: F.concat(F.lit(":"), quoted(x))), "")
    made = nodes.select(F.lit(0).alias("part"), "number", F.concat(F.lit("CREATE (n"), F.col("number").cast("string"), labels, _map(nodes), F.lit(")")).alias("line"))
    end = lambda c: names.select(F.col("id").alias(c), F.col("number").alias(f"{c}_n"))
    rels = numbered(rels, "number", "id").join(end("src"), "src").join(end("dst"), "dst")
    lines = rels.select(F.lit(1).alias("part"), "number", F.concat(F.lit("CREATE (n"), F.col("src_n").cast("string"), F.lit(")-[:"), quoted(F.col("type")), _map(rels), F.lit("]->(n"), F.col("dst_n").cast("string"), F.lit(")")).alias("line"))
    return made.union(lines)


def quoted(name: Column) -> Column:
    """A name, back-quoted unless it is plain."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def _map(df: DataFrame) -> Column:
    parts = [F.when(F.col(f"`{f.name}`").isNotNull(), F.concat(quoted(F.lit(f.name[2:])), F.lit(": "), value_text(F.col(f"`{f.name}`"), of_spark(f.dataType)))) for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name.startswith("p_")]
    if not parts:
        return F.lit("")
    inner = F.concat_ws(", ", *parts)
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" {"), inner, F.lit("}")))


def value_text(c: Column, t: T) -> Column:
    if t.kind == "str":
        out = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
        for code in [*range(0, 10), *range(11, 32), 127]:
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
        return F.concat(F.lit("'"), out, F.lit("'"))
    if t.kind == "float":
        return F.when(F.isnan(c), "0.0 / 0.0").when(c == float("inf"), "1.0 / 0.0").when(c == float("-inf"), "-1.0 / 0.0").otherwise(c.cast("string"))
    if t.kind == "int":
        return F.when(c == -(1 << 63), f"{-(1 << 63) + 1} - 1").otherwise(c.cast("string"))
    if t == DYN:
        return F.coalesce(value_text(c["s"], STR), c["b"].cast("string"), value_text(c["i"], INT), value_text(c["f"], FLOAT))
    if t.kind == "list":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value_text(x, t.elem)), ", "), F.lit("]"))
    return c.cast("string")
