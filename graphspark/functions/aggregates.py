"""Aggregate functions: an aggregate over a typed argument gives a column for ``agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphspark.errors import InvalidQuery, TypeMismatch
from graphspark.functions.scalar import fail, need
from graphspark.plans.types import FLOAT, INT, NULL, T, Val, list_of, sql


def sorter(order: list[tuple[str, bool]]):
    """A comparator over structs with the sort keys as fields: nulls last if ascending, else first."""

    def compare(a, b):
        out = F.lit(0)
        for name, asc in reversed(order):
            x, y = a[name], b[name]
            one = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1 if asc else -1).when(y.isNull(), -1 if asc else 1)
            out = one.when(x < y, -1 if asc else 1).when(x > y, 1 if asc else -1).otherwise(out)
        return out

    return compare


def aggregate(name: str, distinct: bool, args: list[Val], order: list[tuple[str, bool]]) -> tuple[T, Column]:
    """(type, aggregate column).  ``order``: columns by which earlier clauses sorted the rows."""
    if len(args) != (2 if name.startswith("percentile") else 1):
        raise InvalidQuery(f"{name}() takes another number of arguments")
    v = args[0]
    c = v.elem.at("id") if v.elem is not None and name == "count" else v.column()
    if name == "count":
        return INT, F.count_distinct(c) if distinct else F.count(c)
    if name in ("min", "max"):
        return v.t, (F.min if name == "min" else F.max)(c)
    if name == "collect":
        if distinct:
            return list_of(v.t), F.collect_set(c)
        if not order:
            return list_of(v.t), F.collect_list(c)
        rows = F.collect_list(F.when(c.isNotNull(), F.struct(*[F.col(n) for n, _ in order], c.alias("_value"))))
        return list_of(v.t), F.transform(F.array_sort(rows, sorter(order)), lambda r: r["_value"])
    v = need(v, "int", "float", what=name)
    c = v.column()
    if v.t.kind == "null":
        c = F.lit(None).cast("bigint")
    if name == "sum":
        t = FLOAT if v.t.kind == "float" else INT
        total = F.sum_distinct(c) if distinct else F.sum(c)
        return t, F.coalesce(total, F.lit(0).cast(sql(t)))
    if distinct and name in ("stdev", "stdevp", "var", "varp", "percentilecont"):
        values = F.collect_set(c.cast("double"))
        if name == "percentilecont":
            return FLOAT, _continuous(values, _fraction(args[1]))
        n = F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
        square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        var = square / F.nullif(n - (0 if name.endswith("p") else 1), F.lit(0))
        return FLOAT, F.coalesce(F.sqrt(var) if name.startswith("st") else var, F.lit(0.0))
    if name == "avg":
        return FLOAT, F.avg(c.cast("double")) if not distinct else F.sum_distinct(c.cast("double")) / F.nullif(F.count_distinct(c), F.lit(0))
    if name in ("stdev", "stdevp", "var", "varp"):
        f = {"stdev": F.stddev_samp, "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop}[name]
        return FLOAT, F.coalesce(f(c.cast("double")), F.lit(0.0))
    p = _fraction(args[1])
    if name == "percentilecont" and isinstance(p, float):
        return FLOAT, F.percentile(c.cast("double"), p)
    if name == "percentilecont":
        return FLOAT, _continuous(F.collect_list(c.cast("double")), p)
    values = F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
    return v.t, F.get(values, F.greatest(F.ceil((F.lit(p) if isinstance(p, float) else p) * F.size(values)).cast("int") - 1, F.lit(0)))


def _fraction(v: Val) -> float | Column:
    """The percentile: a number, or where only the rows know it that of a row (the greatest, if they differ)."""
    if v.t.kind not in ("int", "float"):
        raise TypeMismatch("the percentile is a number")
    if v.const is None:
        p = F.max(v.column().cast("double"))
        return F.when((p >= 0) & (p <= 1), p).otherwise(F.when(p.isNotNull(), fail("RuntimeError", "NumberOutOfRange: the percentile lies in 0..1").cast("double")))
    if not 0 <= v.const <= 1:
        raise InvalidQuery("NumberOutOfRange: the percentile lies in 0..1")
    return float(v.const)


def _continuous(values: Column, p: float | Column) -> Column:
    s = F.array_sort(values)
    at = (F.lit(p) if isinstance(p, float) else p) * (F.size(s) - 1)
    lo = F.floor(at).cast("int")
    return F.when(F.size(s) > 0, F.get(s, lo) + (at - lo) * (F.get(s, F.least(lo + 1, F.size(s) - 1)) - F.get(s, lo)))


__all__ = ["aggregate", "sorter", "NULL"]
