"""Expressions to columns, with static types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphspark.errors import InvalidQuery, TypeMismatch, Unsupported
from graphspark.functions import scalar
from graphspark.functions.scalar import fail, length_of, need, null_of
from graphspark.plans.parser import N, walk
from graphspark.plans.types import BOOL, DYN, FLOAT, INT, MIXED, NULL, SCALARS, STR, T, Val, coerce, elem_type, list_of, literal, make_list, make_map, map_of, sql, unify

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "var", "varp", "percentilecont", "percentiledisc"}
_NUMBERS = ("int", "float")
#: The parameter that holds the time at which the query began.
NOW = " now"


def is_aggregate(e: N) -> bool:
    return e.kind == "count_star" or e.kind == "call" and e.name in AGGREGATES


def has_aggregate(e: N) -> bool:
    return any(is_aggregate(x) for x in walk(e))


class Compiler:
    """Compiles expressions in one scope.

    ``known`` maps nodes by identity to values made beforehand (aggregates, pattern expressions), or to functions of
    the compiler that give them.
    """

    def __init__(self, scope: dict[str, Val], params: dict, known: dict[int, Val] | None = None):
        self.scope, self.params, self.known = scope, params, known or {}

    def inner(self, **names: Val) -> "Compiler":
        return Compiler({**self.scope, **names}, self.params, self.known)

    def __call__(self, e: N) -> Val:
        if id(e) in self.known:
            found = self.known[id(e)]
            return found(self) if callable(found) else found
        return getattr(self, f"_{e.kind}")(e)

    def condition(self, e: N) -> Column:
        """A predicate: true keeps a row."""
        return need(self(e), "bool", what="WHERE").column().cast("boolean")

    # -- leaves
    def _lit(self, e):
        return literal(e.value)

    def _paren(self, e):
        return self(e.a)

    def _param(self, e):
        if e.name not in self.params:
            raise InvalidQuery(f"missing parameter ${e.name}")
        return literal(self.params[e.name])

    def _var(self, e):
        if e.name not in self.scope:
            raise InvalidQuery(f"UndefinedVariable {e.name}")
        return self.scope[e.name]

    def _list(self, e):
        return make_list([self(x) for x in e.items])

    def _map(self, e):
        return make_map({k: self(x) for k, x in e.pairs})

    # -- access
    def prop(self, base: Val, key: str) -> Val:
        if base.t.kind == "null":
            return null_of(NULL)
        scalar.known(base)
        if base.elem is not None:
            if key not in base.elem.props:
                return null_of(NULL)
            if base.elem.props[key] == MIXED:
                raise Unsupported(f"{key} has values of several types")
            return Val(base.elem.props[key], scalar.living(base, base.elem.at(f"p_{key}")))
        if base.t.kind in ("node", "rel"):
            have = dict(base.t.fields)
            return Val(have[key], base.column()["properties"][key]) if key in have else null_of(NULL)
        if base.t.kind == "map":
            have = dict(base.t.fields)
            return Val(have[key], base.column()[key]) if key in have else null_of(NULL)
        raise TypeMismatch(f"property {key} of {base.t}")

    def _prop(self, e):
        return self.prop(self(e.base), e.key)

    def _index(self, e):
        base, at = self(e.base), self(e.index)
        if "null" in (base.t.kind, at.t.kind):
            return null_of(base.t.elem if base.t.kind == "list" else NULL)
        if base.t.kind == "list":
            need(at, "int", what="list index")
            c, i = base.column(), at.column()
            return Val(base.t.elem, F.get(c, F.when(i < 0, F.when(F.size(c) + i >= 0, F.size(c) + i).otherwise(F.size(c))).otherwise(F.least(i, F.lit(2**31 - 2).cast("bigint"))).cast("int")))
        need(base, "map", "node", "rel", what="index"), need(at, "str", what="key")
        if at.const is not None:
            return self.prop(base, at.const)
        t = NULL
        for _, f in base.t.fields:
            t = unify(t, f)
        out = F.lit(None).cast(sql(t))
        for k, _ in base.t.fields:
            out = F.when(at.column() == k, coerce(self.prop(base, k), t)).otherwise(out)
        return Val(t, out)

    def _slice(self, e):
        base = need(self(e.base), "list", what="slice")
        if base.t.kind == "null":
            return base
        c, n = base.column(), F.size(base.column())
        lo = need(self(e.lo), "int", what="slice") if e.lo else literal(0)
        hi = need(self(e.hi), "int", what="slice") if e.hi else None
        clamp = lambda x: F.least(F.greatest(F.when(x < 0, n + x).otherwise(x), F.lit(0)), n).cast("int")
        a, b = clamp(coerce(lo, INT)), clamp(coerce(hi, INT)) if hi is not None else n
        missing = coerce(lo, INT).isNull() | (coerce(hi, INT).isNull() if hi is not None else F.lit(False))
        return Val(base.t, F.when(missing, F.lit(None)).otherwise(F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))))

    def _map_projection(self, e):
        base, out = self(e.base), {}
        for kind, key, x in e.items:
            if kind == "all":
                have = base.elem.props if base.elem is not None else dict(base.t.fields)
                out |= {k: self.prop(base, k) for k in have}
            elif kind == "prop":
                out[key] = self.prop(base, key)
            elif kind == "var":
                out[key] = self(N("var", key, name=key))
            else:
                out[key] = self(x)
        made = make_map(out)
        there = base.elem.at("id") if base.elem is not None else base.column()
        return Val(made.t, F.when(there.isNotNull(), made.col))

    def labels_test(self, label: N, labels: Column, kind: str = "node") -> Column:
        """A label or type expression over an array of labels."""
        k = label.kind
        if k == "label":
            return F.array_contains(labels, label.name)
        if k == "label_any":
            return F.size(labels) > 0
        if k == "label_not":
            return ~self.labels_test(label.a, labels, kind)
        if k == "label_dynamic":
            v = self(label.expr)
            if v.t.kind == "null":
                return F.lit(False)
            if v.t.kind == "str":
                return F.coalesce(F.array_contains(labels, v.column()), F.lit(False))
            if v.t.kind == "list" and v.t.elem.kind in ("str", "null"):
                test = (lambda f: F.forall(v.column(), f)) if kind == "node" else (lambda f: F.exists(v.column(), f))
                return F.coalesce(test(lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))), F.lit(False))
            raise TypeMismatch(f"label of the type {v.t}")
        a, b = self.labels_test(label.a, labels, kind), self.labels_test(label.b, labels, kind)
        return a & b if k == "label_and" else a | b

    def _has_label(self, e):
        v = need(self(e.a), "node", "rel", what="label test")
        if v.t.kind == "null":
            return null_of(BOOL)
        if v.t.kind == "node":
            scalar.known(v)
        part = (lambda p: v.elem.at(p)) if v.elem is not None else (lambda p: v.column()[p])
        labels = part("labels") if v.t.kind == "node" else F.array(part("type"))
        return Val(BOOL, F.when(part("id").isNotNull(), self.labels_test(e.label, labels, v.t.kind)))

    # -- logic
    def _logic(self, e):
        return [need(self(x), "bool", what=e.kind.upper()).column().cast("boolean") for x in (e.a, e.b)]

    def _and(self, e):
        a, b = self._logic(e)
        return Val(BOOL, a & b)

    def _or(self, e):
        a, b = self._logic(e)
        return Val(BOOL, a | b)

    def _xor(self, e):
        a, b = self._logic(e)
        return Val(BOOL, F.when(a.isNotNull() & b.isNotNull(), a != b))

    def _not(self, e):
        return Val(BOOL, ~need(self(e.a), "bool", what="NOT").column().cast("boolean"))

    def _is_null(self, e):
        v = self(e.a)
        c = v.elem.at("id") if v.elem is not None else v.path.nodes[0].at("id") if v.path is not None else v.column()
        return Val(BOOL, c.isNotNull() if e.negate else c.isNull())

    # -- comparison
    def equal(self, a: Val, b: Val) -> Column:
        """True, false or null, as the language compares."""
        null = F.lit(None).cast("boolean")
        if "null" in (a.t.kind, b.t.kind):
            return null
        there = a.column().isNotNull() & b.column().isNotNull()
        if DYN in (a.t, b.t) and a.t.kind in SCALARS and b.t.kind in SCALARS:
            x, y = coerce(a, DYN), coerce(b, DYN)
            numbers = F.when(x["i"].isNotNull() & y["i"].isNotNull(), x["i"] == y["i"]).otherwise(x["f"] == y["f"])
            return F.when(there, F.when((x["r"] != y["r"]) | (x["r"] == 4), False).when(x["r"] == 1, x["s"] == y["s"]).when(x["r"] == 2, x["b"] == y["b"]).otherwise(numbers))
        if a.t.kind != b.t.kind and not (a.t.kind in _NUMBERS and b.t.kind in _NUMBERS):
            return F.when(there, F.lit(False))
        if a.t.kind in ("node", "rel"):
            part = lambda v: v.elem.at("id") if v.elem is not None else v.column()["id"]
            return part(a) == part(b)
        if a.t.kind == "list":
            x, y = a.column(), b.column()
            pairs = F.zip_with(x, y, lambda p, q: self.equal(Val(a.t.elem, p), Val(b.t.elem, q)))
            return F.when(there, F.when(F.size(x) != F.size(y), False).when(F.exists(pairs, lambda r: F.coalesce(~r, F.lit(False))), False).when(F.exists(pairs, lambda r: r.isNull()), null).otherwise(True))
        if a.t.kind == "map":
            x, y = dict(a.t.fields), dict(b.t.fields)
            if x.keys() != y.keys():
                return F.when(there, F.lit(False))
            parts = F.array(*[self.equal(Val(x[k], a.column()[k]), Val(y[k], b.column()[k])) for k in x]) if x else F.array().cast("array<boolean>")
            return F.when(there, F.when(F.exists(parts, lambda r: F.coalesce(~r, F.lit(False))), False).when(F.exists(parts, lambda r: r.isNull()), null).otherwise(True))
        x, y = a.column(), b.column()
        if a.t.kind == b.t.kind == "float":
            return x == y if _plain(a) or _plain(b) else (x == y) & ~F.isnan(x)
        if a.t.kind != b.t.kind:  # an integer and a float: exactly
            i, f = (x, y) if a.t.kind == "int" else (y, x)
            if _plain(a) and abs(a.const) < 2**53 or _plain(b) and abs(b.const) < 2**53:
                return i.cast("double") == f
            inside = (f >= -(2.0**63)) & (f < 2.0**63)
            return (i.cast("double") == f) & F.when(inside, F.when(inside, f).otherwise(F.lit(0.0)).cast("bigint") == i).otherwise(F.lit(False))
        return x == y

    def less(self, op: str, a: Val, b: Val) -> Column:
        null = F.lit(None).cast("boolean")
        if DYN in (a.t, b.t) and a.t.kind in SCALARS and b.t.kind in SCALARS:
            x, y = coerce(a, DYN), coerce(b, DYN)
            parts = {k: {"<": x[k] < y[k], "<=": x[k] <= y[k], ">": x[k] > y[k], ">=": x[k] >= y[k]}[op] for k in ("s", "b", "f", "i")}
            number = lambda v: v["r"] >= 3
            return F.when(number(x) & number(y), F.when((x["r"] == 4) | (y["r"] == 4), False).when(x["i"].isNotNull() & y["i"].isNotNull(), parts["i"]).otherwise(parts["f"])).when(x["r"] != y["r"], null).when(x["r"] == 1, parts["s"]).when(x["r"] == 2, parts["b"])
        same = a.t.kind == b.t.kind and a.t.kind in ("int", "float", "str", "bool", "other") or a.t.kind in _NUMBERS and b.t.kind in _NUMBERS
        if a.t.kind == b.t.kind == "list":
            t = unify(a.t, b.t)
            x, y = coerce(a, t), coerce(b, t)
            n = F.least(F.size(x), F.size(y))
            head = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & ~F.get(x, i).eqNullSafe(F.get(y, i)))
            at = F.get(head, F.lit(0))
            p, q = F.get(x, at), F.get(y, at)
            cmp = {"<": lambda u, v: u < v, ">": lambda u, v: u > v, "<=": lambda u, v: u <= v, ">=": lambda u, v: u >= v}[op]
            return F.when(x.isNull() | y.isNull(), null).when(at.isNull(), cmp(F.size(x), F.size(y))).otherwise(cmp(p, q))
        if not same:
            return null
        x, y = a.column(), b.column()
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        # Spark has NaN above all numbers; here a comparison with it is false
        if a.t.kind == "float" and op in (">", ">=") or a.t.kind == "float" and not _plain(b):
            out = out & ~F.isnan(x)
        if b.t.kind == "float" and not _plain(b) and not (op in (">", ">=") and _plain(a)):
            out = out & ~F.isnan(y)
        return out

    def _compare(self, e):
        left, out = self(e.first), None
        for op, x in e.rest:
            right = self(x)
            one = self.equal(left, right) if op == "=" else ~self.equal(left, right) if op == "<>" else self.less(op, left, right)
            out = one if out is None else out & one
            left = right
        return Val(BOOL, out)

    def _text_test(self, e):
        a, b = (Val(STR, v.column()["s"]) if v.t == DYN else v for v in (self(e.a), self(e.b)))
        if a.t.kind != "str" or b.t.kind != "str":
            return null_of(BOOL)
        return Val(BOOL, getattr(a.column(), e.op)(b.column()))

    def _in(self, e):
        x, l = self(e.a), need(self(e.b), "list", what="IN")
        if l.t.kind == "null":
            return null_of(BOOL)
        items = _unwrapped(e.b)
        if items.kind == "list" and items.items and x.t.kind in ("int", "str", "bool") and all(i.kind == "lit" and i.value is not None and literal(i.value).t == x.t for i in items.items):
            return Val(BOOL, x.column().isin(*[i.value for i in items.items]))  # a form that scans can use
        c = l.column()
        tests = F.transform(c, lambda y: self.equal(x, Val(l.t.elem, y)))
        return Val(BOOL, F.when(c.isNull(), F.lit(None)).when(F.exists(tests, lambda r: F.coalesce(r, F.lit(False))), True).when(F.exists(tests, lambda r: r.isNull()), F.lit(None)).otherwise(False))

    # -- arithmetic
    def _negate(self, e):
        v = need(self(e.a), *_NUMBERS, what="-")
        return Val(v.t, -v.column()) if v.t.kind != "null" else v

    def _plus(self, e):
        return need(self(e.a), *_NUMBERS, what="+")

    def _arith(self, e):
        return self.arith(e.op, self(e.a), self(e.b))

    def arith(self, op: str, a: Val, b: Val) -> Val:
        if DYN in (a.t, b.t) and a.t.kind in SCALARS and b.t.kind in SCALARS:  # by the types that the row has
            x, y = (Val(DYN, coerce(v, DYN)) for v in (a, b))
            part = lambda v, k: Val({"i": INT, "f": FLOAT}[k], v.col[k])
            ints, floats = self.arith(op, part(x, "i"), part(y, "i")), self.arith(op, part(x, "f"), part(y, "f"))
            there = x.col.isNotNull() & y.col.isNotNull()
            out = F.when(~there, F.lit(None)).when(x.col["i"].isNotNull() & y.col["i"].isNotNull(), coerce(ints, DYN)).when(x.col["f"].isNotNull() & y.col["f"].isNotNull(), coerce(floats, DYN))
            if op == "+":
                out = out.when((x.col["r"] == 1) | (y.col["r"] == 1), coerce(Val(STR, F.concat(scalar.text_of(x), scalar.text_of(y))), DYN))
            return Val(DYN, out.otherwise(fail("TypeMismatch", f"{op} on values of these types").cast(DYN.spark)))
        if op == "+" and ("list" in (a.t.kind, b.t.kind)):
            return self._append(a, b)
        if "null" in (a.t.kind, b.t.kind):
            return null_of(NULL)
        if op == "+" and "str" in (a.t.kind, b.t.kind):
            for v in (a, b):
                need(v, "str", "int", "float", "bool", what="+")
            return Val(STR, F.concat(scalar.text_of(a), scalar.text_of(b)))
        for v in (a, b):
            need(v, *_NUMBERS, what=op)
        x, y = a.column(), b.column()
        if op == "^":
            return Val(FLOAT, F.pow(x.cast("double"), y.cast("double")))
        if a.t.kind == b.t.kind == "int":
            if op in "/%":
                guarded = F.when(y == 0, fail("DivisionByZero", "/ by zero")).otherwise(y)
                return Val(INT, _call("div", x, guarded) if op == "/" else x % guarded)
            tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
            return Val(INT, F.coalesce(tried, F.when(x.isNotNull() & y.isNotNull(), fail("RuntimeError", "integer overflow").cast("bigint"))))
        x, y = x.cast("double"), y.cast("double")
        if op in "/%":
            safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
            if op == "%":
                return Val(FLOAT, F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(x % safe))
            if _plain(b) and b.const != 0:
                return Val(FLOAT, x / y)
            sign = F.when(y.cast("string") == "-0.0", -1.0).otherwise(1.0)
            return Val(FLOAT, F.when(y == 0, F.when(x.isNull(), F.lit(None)).when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * sign * F.lit(float("inf")))).otherwise(x / safe))
        return Val(FLOAT, x + y if op == "+" else x - y if op == "-" else x * y)

    def _append(self, a: Val, b: Val) -> Val:
        if "null" in (a.t.kind, b.t.kind):
            return null_of(a.t if a.t.kind == "list" else b.t)
        t = unify(a.t.elem if a.t.kind == "list" else a.t, b.t.elem if b.t.kind == "list" else b.t)
        parts = [coerce(v, list_of(t)) if v.t.kind == "list" else F.when(v.column().isNotNull(), F.array(coerce(v, t))) for v in (a, b)]
        return Val(list_of(t), F.concat(*parts))

    # -- lists
    def _source(self, e) -> Val:
        v = need(self(e.source), "list", what="list expression")
        return v if v.t.kind == "list" else null_of(list_of(NULL))

    def _comprehension(self, e):
        src = self._source(e)
        c, made = src.column(), {}
        if e.where is not None:
            c = F.filter(c, lambda x: F.coalesce(self.inner(**{e.var: Val(src.t.elem, x)}).condition(e.where), F.lit(False)))
        if e.body is None:
            return Val(src.t, c)

        def body(x):
            v = self.inner(**{e.var: Val(src.t.elem, x)})(e.body)
            made["t"] = v.t
            return v.column()

        out = F.transform(c, body)
        return Val(list_of(made["t"]), out)

    def _quantifier(self, e):
        src = self._source(e)
        test = lambda x: self.inner(**{e.var: Val(src.t.elem, x)}).condition(e.where)
        c = src.column()
        if e.op == "all":
            return Val(BOOL, F.forall(c, test))
        if e.op in ("any", "none"):
            some = F.exists(c, test)
            return Val(BOOL, some if e.op == "any" else ~some)
        results = F.transform(c, test)
        yes = F.size(F.filter(results, lambda r: F.coalesce(r, F.lit(False))))
        unknown = F.exists(results, lambda r: r.isNull())
        return Val(BOOL, F.when(c.isNull(), F.lit(None)).when(yes > 1, False).when(unknown, F.lit(None)).otherwise(yes == 1))

    def _reduce(self, e):
        src, init = self._source(e), self(e.init)
        seen = {}

        def fold(t: T) -> Column:
            def step(acc, x):
                v = self.inner(**{e.acc: Val(t, acc), e.var: Val(src.t.elem, x)})(e.body)
                seen["t"] = unify(t, v.t)
                return coerce(v, t) if v.t.kind == "null" or unify(t, v.t) == t else v.column()

            return F.aggregate(src.column(), coerce(init, t), step)

        out, t = fold(init.t), init.t
        while seen["t"] != t:  # the fold widens the type
            t = seen["t"]
            out = fold(t)
        return Val(t, out)

    # -- case and calls
    def _case(self, e):
        base = self(e.base) if e.base is not None else None
        results = [self(r) for _, r in e.whens] + ([self(e.other)] if e.other is not None else [])
        t = NULL
        for v in results:
            t = unify(t, v.t)
        out = None
        for (cond, _), v in zip(e.whens, results):
            test = self.equal(base, self(cond)) if base is not None else self.condition(cond)
            out = F.when(test, coerce(v, t)) if out is None else out.when(test, coerce(v, t))
        return Val(t, out.otherwise(coerce(results[-1], t)) if e.other is not None else out)

    def _call(self, e):
        if e.name == "timestamp" and not e.args and NOW in self.params:
            return literal(self.params[NOW])
        if e.name == "exists" and len(e.args) == 1:
            if e.args[0].kind == "pattern":
                return self(e.args[0])
            return self._is_null(N("is_null", a=e.args[0], negate=True))
        if e.name in AGGREGATES:
            raise InvalidQuery(f"InvalidAggregation: {e.text}")
        return scalar.call(e.name, [self(a) for a in e.args])

    def _count_star(self, e):
        raise InvalidQuery("InvalidAggregation: count(*)")

    def _pattern(self, e):
        raise InvalidQuery(f"a pattern is not allowed here: {e.text}")

    def _pattern_comprehension(self, e):
        raise InvalidQuery(f"a pattern is not allowed here: {e.text}")


def _unwrapped(e: N) -> N:
    while e.kind == "paren":
        e = e.a
    return e


def _plain(v: Val) -> bool:
    """Whether it is a number known not to be NaN."""
    return v.const is not None and v.const == v.const


def _call(name: str, *cols: Column) -> Column:
    return F.call_function(name, *cols)


__all__ = ["Compiler", "AGGREGATES", "elem_type", "has_aggregate", "is_aggregate", "length_of", "map_of", "T"]
