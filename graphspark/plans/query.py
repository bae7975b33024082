"""Queries: clauses folded over a frame, results, prepared queries."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.errors import CypherError, DivisionByZero, InvalidQuery, QueryRuntimeError, TypeMismatch, Unsupported
from graphspark.functions import aggregates
from graphspark.operators.pattern import Frame, Match, check_patterns, filtered, free_names, optional, prepared
from graphspark.plans.expr import AGGREGATES, NOW, has_aggregate, is_aggregate
from graphspark.plans.parser import N, parse, walk
from graphspark.plans.types import DYN, INT, Path, T, Val, coerce, elem_type, list_of, unify

UPDATES = ("create", "merge", "set", "remove", "delete", "foreach")


class Result:
    """Columns by name and the rows as a frame; nothing runs before the rows are asked for."""

    def __init__(self, columns: list[str], df: DataFrame, values: dict[str, Val] | None = None):
        self.columns, self.df, self.values = columns, df, values or {}

    def rows(self) -> list[dict]:
        try:
            types = [self.values[c].t if c in self.values else None for c in self.columns]
            return [{c: _plain(v, t) for c, v, t in zip(self.columns, r, types)} for r in self.df.collect()]
        except Exception as e:
            raise translated(e) from e

    def column(self, name: str) -> Iterator:
        return (r[name] for r in self.rows())

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def __len__(self) -> int:
        return len(self.rows())


def _plain(v, t: T | None = None):
    if v is not None and t == DYN:
        return next((x for x in (v["s"], v["b"], v["i"], v["f"]) if x is not None), None)
    if hasattr(v, "asDict"):
        fields = dict(t.fields) if t is not None else {}
        if t is not None and t.kind in ("node", "rel"):
            return {k: _plain(x, T("map", fields=t.fields, spark="sparse") if k == "properties" else None) for k, x in v.asDict().items()}
        sparse = t is not None and t.spark == "sparse"
        return {k: _plain(x, fields.get(k)) for k, x in v.asDict().items() if x is not None or not sparse}
    return [_plain(x, t.elem if t is not None else None) for x in v] if isinstance(v, list) else v


def translated(e: Exception) -> CypherError:
    """An error of a Spark action as one of the language."""
    text = str(e)
    for mark, kind in (("[DivisionByZero]", DivisionByZero), ("DIVIDE_BY_ZERO", DivisionByZero), ("[TypeMismatch]", TypeMismatch), ("[RuntimeError]", QueryRuntimeError), ("ARITHMETIC_OVERFLOW", QueryRuntimeError)):
        if mark in text:
            return kind(text.splitlines()[0])
    return e if isinstance(e, CypherError) else QueryRuntimeError(text.splitlines()[0] if text else repr(e))


class Query:
    """A parsed query, to be run on any graph."""

    def __init__(self, text: str):
        self.statements = parse(text)
        for s in self.statements:
            check_outputs(s)

    @property
    def is_read_only(self) -> bool:
        return not any(c.kind in UPDATES for s in self.statements for b in s.branches for c in b)

    @property
    def parameters(self) -> list[str]:
        return sorted({x.name for s in self.statements for b in s.branches for c in b for x in walk(c) if x.kind == "param"})

    def execute(self, graph, params: dict | None = None) -> Result:
        if not self.is_read_only:
            raise InvalidQuery("the query updates the graph")
        return self.execute_mut(graph, params)[1]

    def execute_mut(self, graph, params: dict | None = None):
        """(new graph, result); a failure leaves the old graph as it was."""
        params = {**(params or {}), NOW: int(time.time() * 1000)}
        if missing := [p for p in self.parameters if p not in params]:
            raise InvalidQuery(f"missing parameters: {', '.join(missing)}")
        from graphspark.operators.mutate import Changes

        changes = Changes(graph)
        result = None
        for s in self.statements:
            result = _safely(lambda: run_statement(changes, s, params))  # noqa: B023
            if changes.dirty and result.columns:
                from graphspark.plans.durable import persisted

                result = Result(result.columns, _safely(lambda: persisted(result.df, "result")) if result.df.columns else result.df, result.values)
        return _safely(changes.commit), result


def _safely(f):
    try:
        return f()
    except CypherError:
        raise
    except Exception as e:
        raise translated(e) from e


def check_outputs(statement: N) -> None:
    names = [[i.alias or i.text for i in b[-1].items] if b[-1].kind == "return" and not b[-1].star else None for b in statement.branches]
    known = [n for n in names if n is not None]
    if len(statement.branches) > 1 and any(sorted(n) != sorted(known[0]) for n in known):
        raise InvalidQuery("DifferentColumnsInUnion")


def run_statement(changes, statement: N, params: dict) -> Result:
    results = [run_branch(changes, b, params) for b in statement.branches]
    out = results[0]
    for r in results[1:]:
        if len(r.columns) != len(out.columns):
            raise InvalidQuery("DifferentColumnsInUnion")
        a, b = out.df, r.df
        kinds = [unify(out.values[x].t, r.values[y].t) for x, y in zip(out.columns, r.columns)]

        def cast(df: DataFrame, have: Result) -> DataFrame:
            return df.select(*[coerce(Val(have.values[old].t, df[f"`{c}`"]), t).alias(n) if t != have.values[old].t else df[f"`{c}`"].alias(n) for c, old, n, t in zip(df.columns, have.columns, out.columns, kinds)])

        out = Result(out.columns, cast(a, out).union(cast(b, r)), {c: Val(t) for c, t in zip(out.columns, kinds)})
    return Result(out.columns, out.df.dropDuplicates(), out.values) if statement.distinct else out


def used_names(clauses: list[N]) -> set | None:
    """Variables of which more is asked than the id; None if a star asks for all."""
    used: set[str] = set()

    def visit(e: N):
        if e.kind == "call" and e.name in ("count", "id", "elementid") and len(e.args) == 1 and e.args[0].kind == "var":
            return
        if e.kind == "chain":  # places in patterns are ids; what is asked of bound ones there needs a scan
            for x in [*e.nodes, *e.rels]:
                if x.var and x.label is not None if x.kind == "node" else False:
                    labelled.setdefault(x.var, 0)
                    labelled[x.var] += 1
                for y in (x.props, getattr(x, "label", None), getattr(x, "types", None)):
                    if y is not None:
                        visit(y)
            if e.path:
                used.update(x.var for x in e.nodes if x.var)
            return
        if e.kind == "var":
            used.add(e.name)
        for c in e.children():
            visit(c)

    labelled: dict[str, int] = {}
    aliases: dict[str, str] = {}
    for c in clauses:
        if getattr(c, "star", False):
            return None
        if c.kind in ("with", "return"):
            for i in c.items:
                if c.kind == "with" and i.expr.kind == "var":
                    aliases[i.expr.name] = i.alias or i.expr.name
                    continue
                visit(i.expr)
            for e in [*(e for e, _ in c.order), c.skip, c.limit, c.where]:
                if e is not None:
                    visit(e)
            if c.distinct:
                used.update(i.expr.name for i in c.items if i.expr.kind == "var")
        else:
            visit(c)
    used |= {n for n, k in labelled.items() if k > 1}
    for _ in aliases:
        used |= {a for a, b in aliases.items() if b in used}
    if any(c.kind in UPDATES for c in clauses):
        return None
    return used


def run_branch(changes, clauses: list[N], params: dict) -> Result:
    frame = Frame(changes.graph, params, used=used_names(clauses), ordered=any(c.kind in UPDATES for c in clauses))
    for k, c in enumerate(clauses):
        if c.kind == "match":
            frame = replace(frame, graph=changes.graph)
            check_new(frame, c.parts)
            if c.optional:
                frame = optional(frame, c.parts, c.where)
            else:
                frame = filtered(Match(frame, c.parts).run(), c.where)
        elif c.kind == "unwind":
            frame = unwind(frame, c)
        elif c.kind in ("with", "return"):
            frame, columns = project(frame, c)
            if c.kind == "return":
                return outcome(frame, columns)
        elif c.kind == "finish":
            break
        else:
            frame = changes.apply(replace(frame, graph=changes.graph), c)
    return Result([], changes.graph.spark.createDataFrame([], "`_` int").select())


def check_new(frame: Frame, parts: list[N]) -> None:
    for p in parts:
        if p.path and p.path in frame.scope:
            raise InvalidQuery(f"VariableAlreadyBound {p.path}")


def outcome(frame: Frame, columns: list[str]) -> Result:
    values = {c: frame.scope[c] for c in columns}
    df = frame.rows().select(*[_shown(values[c]).alias(c) for c in columns])
    return Result(columns, df, values)


def _bare(t: T) -> bool:
    return t.spark == "bare" or t.kind == "list" and _bare(t.elem) or t.kind == "map" and any(_bare(f) for _, f in t.fields)


def _shown(v: Val):
    if _bare(v.t):
        raise Unsupported("startNode, endNode or nodes inside a list expression as a result")
    return v.column() if v.t.kind != "null" else F.lit(None).cast("string")


def unwind(frame: Frame, c: N) -> Frame:
    frame, known = prepared(frame, [c.expr])
    v = frame.compiler(known)(c.expr)
    if c.var in frame.scope:
        raise InvalidQuery(f"VariableAlreadyBound {c.var}")
    if v.t.kind == "null":
        v = Val(list_of(v.t), F.array().cast("array<string>"))
    if v.t.kind != "list":
        v = Val(list_of(v.t), F.when(v.column().isNotNull(), F.array(v.column())))
    name = frame.fresh("u")
    place, seq = frame.fresh("at"), frame.seq
    if frame.ordered:
        df, seq = frame.rows().select("*", F.posexplode(v.column()).alias(place, name)), [*seq, (place, True)]
    else:
        df = frame.rows().select("*", F.explode(v.column()).alias(name))
    return replace(frame, df=df, seq=seq, grain=None, scope={**frame.scope, c.var: Val(v.t.elem, F.col(name), name=name)})


def constant(frame: Frame, e: N, what: str) -> int:
    """SKIP and LIMIT: a non-negative integer without variables."""
    if free_names(e):
        raise InvalidQuery(f"NonConstantExpression in {what}")
    v = frame.compiler()(e)
    if v.t.kind != "int":
        raise InvalidQuery(f"InvalidArgumentType in {what}")
    n = v.const if v.const is not None else frame.graph.spark.range(1).select(v.column()).first()[0]
    if n is None or n < 0:
        raise InvalidQuery(f"NegativeIntegerArgument in {what}")
    return int(n)


def project(frame: Frame, c: N) -> tuple[Frame, list[str]]:
    """WITH and RETURN with all that follows them."""
    items = [(i.alias or i.text, i.expr) for i in c.items]
    if c.star:
        if not frame.scope and not items:
            raise InvalidQuery("NoVariablesInScope")
        items = [(n, N("var", n, name=n)) for n in sorted(frame.scope)] + items
    for i in c.items:
        if c.kind == "with" and i.alias is None and i.expr.kind != "var":
            raise InvalidQuery(f"NoExpressionAlias {i.text}")
    for _, e in items:
        check_patterns(e)
        if any(has_aggregate(x.where or N("lit", value=None)) or x.kind == "comprehension" and x.body is not None and has_aggregate(x.body) for x in walk(e) if x.kind in ("comprehension", "quantifier")):
            raise InvalidQuery("InvalidAggregation inside a list expression")
    names = [n for n, _ in items]
    if len(set(names)) != len(names):
        raise InvalidQuery("ColumnNameConflict")
    order = [(_aliased(e, items), asc) for e, asc in c.order]
    grouped = any(has_aggregate(e) for _, e in items)
    if grouped:
        frame, new, known = aggregate(frame, items, [e for e, _ in order])
        old = {}
    else:
        if any(has_aggregate(e) for e, _ in order):
            raise InvalidQuery("InvalidAggregation in ORDER BY")
        frame, known = prepared(frame, [e for _, e in items] + [e for e, _ in order])
        compiler, new, added = frame.compiler(known), {}, {}
        for n, e in items:
            new[n] = _held(frame, compiler(e), added)
        frame = replace(frame, df=frame.rows().withColumns(added)) if added else frame
        old = frame.scope
    if c.distinct:
        frame = distinct(frame, new)
        old, known = {}, {}
    frame = replace(frame, scope={**old, **new}, order=frame.order if not grouped and not c.distinct else [])
    if order:
        frame, more = prepared(frame, [e for e, _ in order], known)
        compiler, added, keys = frame.compiler({**known, **more}), {}, []
        for e, asc in order:
            v = compiler(e)
            name = frame.fresh("o")
            added[name] = v.elem.at("id") if v.elem is not None else v.column()
            keys.append((name, asc))
        frame = replace(frame, df=frame.rows().withColumns(added), order=keys, seq=keys if frame.ordered else [])
    limited = c.skip is not None or c.limit is not None
    if order and (limited or c.kind == "return"):
        frame = replace(frame, df=frame.df.orderBy(*[F.col(n).asc_nulls_last() if asc else F.col(n).desc_nulls_first() for n, asc in frame.order]))
    if c.skip is not None and (n := constant(frame, c.skip, "SKIP")):
        frame = replace(frame, df=frame.rows().offset(n))
    if c.limit is not None:
        frame = replace(frame, df=frame.rows().limit(constant(frame, c.limit, "LIMIT")))
    if c.where is not None:
        frame = filtered(frame, c.where)
    return replace(frame, scope=new), names


def _held(frame: Frame, v: Val, added: dict) -> Val:
    """The value as it goes on: elements keep their columns, others get one of their own."""
    if v.elem is not None or v.path is not None or v.name is not None:
        return v
    name = frame.fresh("x")
    added[name] = v.column() if v.t.kind != "null" else F.lit(None).cast("string")
    return Val(v.t, F.col(name), name=name)


def _aliased(e: N, items: list[tuple[str, N]]) -> N:
    """The sort expression with projected expressions in it replaced by their names."""
    for n, x in items:
        if x.text == e.text and x.kind != "lit":
            return N("var", n, name=n)
    out = N(e.kind, e.text)
    for k, v in e.__dict__.items():
        if k not in ("kind", "text"):
            out.__dict__[k] = _aliased(v, items) if isinstance(v, N) else [_aliased(x, items) if isinstance(x, N) else x for x in v] if isinstance(v, list) else v
    return out


def _columns(v: Val) -> list[str]:
    if v.elem is not None:
        return v.elem.names()
    if isinstance(v.path, Path):
        return [c for n in v.path.nodes for c in n.names()] + [c for r in v.path.rels if not isinstance(r, tuple) for c in r.names()]
    return []


def distinct(frame: Frame, new: dict[str, Val]) -> Frame:
    """One row for each combination of the values; an element counts by its id."""
    keys, added, rest = [], {}, []
    have = set(frame.rows().columns)
    for n, v in list(new.items()):
        if v.elem is not None:
            keys.append(f"{v.elem.prefix}__id")
            rest += [c for c in v.elem.names() if c in have]
        else:
            if v.path is not None:
                v = new[n] = _held(frame, Val(T("path"), v.column()), added)
            keys.append(v.name)
    df = frame.rows().withColumns(added) if added else frame.rows()
    keep = list(dict.fromkeys([*keys, *rest]))
    return replace(frame, df=df.select(*keep).dropDuplicates(list(dict.fromkeys(keys))), seq=[])


def aggregate(frame: Frame, items: list[tuple[str, N]], order: list[N]) -> tuple[Frame, dict[str, Val], dict[int, Val]]:
    """Group by the items without aggregates; values of the others, also for the sort keys."""
    exprs = [e for _, e in items] + order
    frame, known = prepared(frame, exprs)
    compiler = frame.compiler(known)
    added, keys, new, texts = {}, [], {}, {}
    firsts = []
    have = set(frame.rows().columns)
    for n, e in items:
        if has_aggregate(e):
            continue
        v = compiler(e)
        if v.path is not None:
            v = Val(T("path"), v.column())
        v = new[n] = _held(frame, v, added)
        texts[e.text] = v
        if v.elem is not None:
            keys.append(f"{v.elem.prefix}__id")
            firsts += [c for c in v.elem.names() if c in have and not c.endswith("__id")]
        else:
            keys.append(v.name)
    calls, made = {}, {}
    for e in exprs:
        for x in walk(e):
            if is_aggregate(x):
                if x.kind == "call" and any(has_aggregate(a) for a in x.args):
                    raise InvalidQuery("NestedAggregation")
                name = next((m for m, y in calls.items() if y.text == x.text), None)
                if name is None:
                    name = frame.fresh("a")
                    calls[name] = x
                    if x.kind == "count_star":
                        made[name] = INT, F.count(F.lit(1))
                    else:
                        made[name] = aggregates.aggregate(x.name, x.distinct, [compiler(a) for a in x.args], frame.order)
                known[id(x)] = Val(made[name][0], F.col(name))
    rows = frame.rows().withColumns(added) if added else frame.rows()
    keys = list(dict.fromkeys(keys))
    outs = [c.alias(n) for n, (_, c) in made.items()] + [F.first(f"`{c}`").alias(c) for c in dict.fromkeys(firsts) if c not in keys]
    df = rows.groupBy(*keys).agg(*outs) if outs else rows.select(*keys).distinct()
    frame = replace(frame, df=df, order=[], seq=[], scope={n: v for n, v in new.items()})
    late, more = {}, {}
    for n, e in items:
        if has_aggregate(e):
            inner = _Grouped(texts, frame, {**known, **_by_text(e, texts)})
            new[n] = _held(frame, inner.compiler()(e), late)
    frame = replace(frame, df=frame.df.withColumns(late) if late else frame.df)
    for e in order:
        more |= {k: v for k, v in known.items()} | _by_text(e, texts)
    return frame, {n: new[n] for n, _ in items}, {**known, **more}


def _by_text(e: N, texts: dict[str, Val]) -> dict[int, Val]:
    return {id(x): texts[x.text] for x in walk(e) if x.text in texts and x.kind != "lit"}


class _Grouped:
    """The scope after grouping: grouping keys by their text, variables by name."""

    def __init__(self, texts, frame, known):
        self.frame, self.known = frame, known
        self.scope = {**{t: v for t, v in texts.items() if t.isidentifier()}, **frame.scope}

    def compiler(self):
        from graphspark.plans.expr import Compiler

        return Compiler(self.scope, self.frame.params, self.known)


__all__ = ["AGGREGATES", "Query", "Result", "Unsupported", "elem_type"]
