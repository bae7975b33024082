"""Property graphs over DataFrames.

A graph is a list of node tables and relationship tables.  A table may belong
to one label set or type, which then needs no test at run time, or carry them
in a column.  Graphs do not change: updates give new tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.errors import Unsupported
from graphspark.plans.types import MIXED, Elem, T, Val, coerce, of_spark, sql, unify

#: Bits of a mapped key inside an id; the table's number lies above.
KEY_BITS = 44


@dataclass(frozen=True)
class NodeTable:
    """Columns id, labels, p_<key>...; ``labels`` if all rows have the same.

    ``source`` and ``key``: the frame of a mapped table, as long as it is unchanged, and its key.
    ``tag``: the number above the keys in its ids.
    """

    df: DataFrame
    labels: frozenset | None = None
    source: DataFrame | None = None
    key: str | None = None
    tag: int = 0

    @property
    def props(self) -> dict[str, T]:
        return _props(self.df)

    def of(self, df: DataFrame) -> "NodeTable":
        """The table with other rows or values."""
        return replace(self, df=df, source=None)


@dataclass(frozen=True)
class Owner:
    """How relationships follow from the rows of a node table, one from each: the table's own end and the columns."""

    side: str  # "src" or "dst"
    table: NodeTable
    needs: frozenset  # properties from which the columns are made
    columns: Callable[[Elem], dict[str, Column]]


@dataclass(frozen=True)
class RelTable:
    """Columns id, src, dst, type, p_<key>...

    ``src`` and ``dst``: the label sets of the ends, if every row's ends exist and have them.
    ``bare``: the same with null ids, where these cost something.
    """

    df: DataFrame
    type: str | None = None
    src: frozenset | None = None
    dst: frozenset | None = None
    owner: Owner | None = None
    bare: DataFrame | None = None
    tag: int = 0

    @property
    def props(self) -> dict[str, T]:
        return _props(self.df)

    def of(self, df: DataFrame) -> "RelTable":
        return replace(self, df=df, owner=None, bare=None)


def _props(df: DataFrame) -> dict[str, T]:
    return {f.name[2:]: of_spark(f.dataType) for f in df.schema.fields if f.name.startswith("p_")}


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    rels: tuple[RelTable, ...] = ()
    next_id: int = 0
    tags: dict = field(default_factory=dict)

    # -- mapped tables
    def with_nodes(self, label: str, df: DataFrame, key: str, props: list[str] | None = None) -> "PropertyGraph":
        """A table as the nodes of a label; ``key`` holds unique integers from 0 up to 2^44."""
        tags = {**self.tags, label: len(self.tags) + 1}
        cols = [widened(df, c).alias(f"p_{c}") for c in (df.columns if props is None else props)]
        own = df.select(node_id(tags[label], F.col(key)).alias("id"), F.array(F.lit(label)).alias("labels"), *cols)
        return replace(self, nodes=(*self.nodes, NodeTable(own, frozenset([label]), df, key, tags[label])), tags=tags)

    def with_rels(self, kind: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], key: str | None = None, props: list[str] = (), complete: bool = False) -> "PropertyGraph":
        """A table as relationships; ``src`` and ``dst`` are (label, column of its keys).

        Without ``key`` the number of a row's file and its place there are its id.  ``complete`` vouches
        that no end is missing from its label's table, so that plans may leave out joins that only test that.
        """
        tag = len(self.rels) + 1
        ends = {end: node_id(self.tags[label], F.col(c)).alias(end) for end, (label, c) in (("src", src), ("dst", dst))}
        more = [F.lit(kind).alias("type"), *[widened(df, c).alias(f"p_{c}") for c in props]]
        there, bare = df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull()), None
        if key:
            own = there.select(node_id(tag, F.col(key)).alias("id"), *ends.values(), *more)
        else:
            place, placed = row_place(there)
            own = placed.select(node_id(tag, place).alias("id"), *ends.values(), *more)
            bare = there.select(F.lit(None).cast("long").alias("id"), *ends.values(), *more)
        vouched = (frozenset([src[0]]), frozenset([dst[0]])) if complete else (None, None)
        return replace(self, rels=(*self.rels, RelTable(own, kind, *vouched, self._owner(kind, df, src, dst, key, props, tag), bare, tag)))

    def _owner(self, kind: str, df: DataFrame, src: tuple, dst: tuple, key: str | None, props, tag: int) -> Owner | None:
        """The node table of whose rows the relationships are foreign keys."""
        for side, (label, c), (other, far) in (("src", src, dst), ("dst", dst, src)):
            for t in self.nodes:
                if t.source is None or not key or not t.labels == {label} or not t.key == c == key:
                    continue
                needs = {key, far, *props}
                if needs <= set(t.props) and (t.source is df or t.source.sameSemantics(df)):

                    def columns(e: Elem, side=side, far=far, other=other) -> dict:
                        ends = {side: e.at("id"), "dst" if side == "src" else "src": node_id(self.tags[other], e.at(f"p_{far}"))}
                        return {"id": node_id(tag, e.at(f"p_{key}")), **ends, "type": F.lit(kind), **{f"p_{k}": e.at(f"p_{k}") for k in props}}

                    return Owner(side, t, frozenset(needs), columns)
        return None

    # -- queries
    def cypher(self, text: str, params: dict | None = None):
        """The result of a query that only reads."""
        from graphspark.plans.query import Query

        return Query(text).execute(self, params)

    def cypher_mut(self, text: str, params: dict | None = None):
        """(new graph, result) of any query."""
        from graphspark.plans.query import Query

        return Query(text).execute_mut(self, params)

    def cypher_select(self, text: str, params: dict | None = None):
        from graphspark.operators.selection import Selection

        return Selection.from_result(self.cypher(text, params))

    @staticmethod
    def from_cypher(spark: SparkSession, text: str, params: dict | None = None) -> "PropertyGraph":
        """The graph that a script builds."""
        return PropertyGraph(spark).cypher_mut(text, params)[0]

    # -- frames of all rows
    def all_nodes(self) -> DataFrame:
        return union_tables([t.df for t in self.nodes]) if self.nodes else self.spark.createDataFrame([], "id long, labels array<string>")

    def all_rels(self) -> DataFrame:
        return union_tables([t.df for t in self.rels]) if self.rels else self.spark.createDataFrame([], "id long, src long, dst long, type string")


def node_id(tag: int, key: Column) -> Column:
    """The id of a mapped key; keys that do not fit below the tag raise an error instead of meeting other ids."""
    key = key.cast("long")
    return F.when(F.shiftright(key, KEY_BITS) == 0, key + F.lit(tag << KEY_BITS)).when(key.isNotNull(), F.raise_error(F.concat(F.lit("[RuntimeError] a key is no integer from 0 up to 2^44: "), key.cast("string"))).cast("long"))


def row_place(df: DataFrame) -> tuple[Column, DataFrame]:
    """A number for each row of a file source: the file's number above the row's place in it.  (number, frame that has it)"""
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one
    files = sorted(df.inputFiles())
    bits = KEY_BITS - max(0, (len(files) - 1).bit_length())
    row = F.when(F.shiftright("_metadata.row_index", bits) == 0, F.col("_metadata.row_index")).otherwise(F.raise_error(F.lit("[RuntimeError] too many rows in a file for ids of relationships without a key")).cast("long"))
    if len(files) < 2:
        return F.col("_row"), df.select("*", row.alias("_row"))
    numbers = df.sparkSession.createDataFrame([(f, k << bits) for k, f in enumerate(files)], "f string, n long").select(plain("f").alias("_file"), F.col("n").alias("_number"))
    placed = df.select("*", row.alias("_row"), plain("_metadata.file_path").alias("_path")).join(numbers, F.col("_path") == F.col("_file"), "left")
    return F.coalesce("_number", F.raise_error(F.lit("[RuntimeError] a file that was not there when the graph was made")).cast("long")) + F.col("_row"), placed


def widened(df: DataFrame, c: str):
    kind = of_spark(df.schema[c].dataType).kind
    return F.col(c).cast("long") if kind == "int" else F.col(c).cast("double") if kind == "float" else F.col(c)


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that a table lacks is null there.  Integers meet floats as floats, other scalars as DYN.

    A column of lists in one table and scalars in another has no value: its type says so to whoever asks for it.
    """
    kinds: dict[str, T] = {}
    for df in frames:
        for f in df.schema.fields:
            try:
                kinds[f.name] = unify(kinds.get(f.name, T("null")), of_spark(f.dataType))
            except Unsupported:
                kinds[f.name] = MIXED
    out = None
    for df in frames:
        cols = []
        for f in df.schema.fields:
            t = kinds[f.name]
            c = F.col(f"`{f.name}`")
            cols.append((F.lit(None).cast(sql(t)) if t == MIXED else coerce(Val(of_spark(f.dataType), c), t) if t != of_spark(f.dataType) else c).alias(f.name))
        df = df.select(*cols)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
