"""Scalar functions over typed values.  Every entry: (least, most arguments, maker)."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphspark.errors import InvalidQuery, QueryRuntimeError, TypeMismatch, Unsupported
from graphspark.plans.types import BARE, BOOL, DYN, FLOAT, INT, NULL, STR, T, Val, coerce, list_of, literal, make_list, map_of, path_ids, sql, unify

#: White space at the ends of strings, as the language trims it.
_ENDS = r"(?U)^\s+|\s+$"
_BIG = 2.0**52


def need(v: Val, *kinds: str, what: str = "") -> Val:
    if v.t == DYN:
        v = narrowed(v, *kinds)
    if v.t.kind != "null" and v.t.kind not in kinds:
        raise TypeMismatch(f"{what}() does not take {v.t}")
    return v


def narrowed(v: Val, *kinds: str) -> Val:
    """A scalar of several types where one is needed: an error in rows that have another."""
    for kind, t, k in (("bool", BOOL, "b"), ("float", FLOAT, "f"), ("int", INT, "i"), ("str", STR, "s")):
        if kind in kinds:
            c = v.column()
            return Val(t, F.when(c[k].isNotNull(), c[k]).otherwise(F.when(c.isNotNull(), fail("TypeMismatch", f"a value is no {kind}").cast(sql(t)))))
    return v


def fail(kind: str, message: str) -> Column:
    """Raises at run time; the prefix names the error kind."""
    return F.raise_error(F.lit(f"[{kind}] {message}"))


def known(v: Val) -> Val:
    """Refuses a node of which only the id is known, instead of giving nulls for what it has."""
    if v.t.spark == "bare":
        raise Unsupported("labels or properties of startNode, endNode or nodes inside a list expression")
    return v


def living(v: Val, c: Column) -> Column:
    """A part of an element, which a deleted one has no more."""
    if v.elem is None or not v.elem.gone:
        return c
    return F.when(v.elem.at("id").isNotNull() & F.raise_error(F.lit("[RuntimeError] DeletedEntityAccess")).cast("boolean"), c)


def null_of(t: T) -> Val:
    return Val(t, F.lit(None).cast(sql(t)))


def text_of(v: Val) -> Column:
    """A scalar as text: floats keep a fraction, large and small ones have an exponent without a fraction."""
    c = v.column()
    if v.t == DYN:
        return F.coalesce(c["s"], c["b"].cast("string"), c["i"].cast("string"), text_of(Val(FLOAT, c["f"])))
    if v.t.kind == "float":
        s = c.cast("string")
        plain = F.when(c == F.floor(c), F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", ""))
        small = F.lower(F.regexp_replace(s, r"\.0E", "E"))
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")) | ((F.abs(c) < 1e7) & (F.abs(c) >= 1e-3)) | (c == 0), s).when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(small)
    return c.cast("string")


def _math(f):
    def make(v):
        need(v, "int", "float", what="math function")
        return Val(FLOAT, f(v.column().cast("double")))

    return make


def _log(f):
    return _math(lambda c: F.when(c > 0, f(c)).when(c == 0, F.lit(float("-inf"))).when(c.isNotNull(), F.lit(float("nan"))))


def floor_of(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) >= _BIG), c).otherwise(F.floor(F.when(F.isnan(c) | (F.abs(c) >= _BIG), F.lit(0.0)).otherwise(c)).cast("double"))


def _round(x: Val, p: Val | None = None, mode: Val | None = None) -> Val:
    need(x, "int", "float", what="round")
    c = x.column().cast("double")
    if p is None or (p.const == 0 and mode is None):
        f = floor_of(c)
        return Val(FLOAT, F.when(F.isnan(c) | (F.abs(c) >= _BIG), c).when(c - f >= 0.5, f + 1).otherwise(f))
    need(p, "int", what="round")
    if p.const is None:  # a branch for each precision that a double can have
        if mode is not None and mode.const is None:
            raise Unsupported("round() with a mode that is not a literal")
        out = F.when(p.column().isNull() | c.isNull(), F.lit(None).cast("double"))
        for k in range(-15, 16):
            out = out.when(p.column() == k, _round(x, literal(k), mode).column())
        return Val(FLOAT, out.otherwise(fail("RuntimeError", "round() takes a precision from -15 to 15").cast("double")))
    how = "HALF_UP" if mode is None else str(mode.const)
    if how == "HALF_UP":
        return Val(FLOAT, F.round(c, int(p.const)))
    unit = F.lit(f"1{'0' * abs(p.const)}").cast("decimal(20,0)")
    exact = c.cast("string").cast("decimal(38,18)")
    exact = exact * unit if p.const >= 0 else exact / unit
    low = F.floor(exact)
    rest = exact - low
    up = {"UP": F.when(exact > 0, rest > 0).otherwise(F.lit(False)), "DOWN": F.when(exact < 0, rest > 0).otherwise(F.lit(False)), "CEILING": rest > 0, "FLOOR": F.lit(False), "HALF_DOWN": (rest > 0.5) | ((rest == 0.5) & (exact < 0)), "HALF_EVEN": (rest > 0.5) | ((rest == 0.5) & (F.pmod(low, F.lit(2)) == 1))}
    if how not in up:
        raise QueryRuntimeError(f"round mode {how}")
    return Val(FLOAT, F.when(F.isnan(c) | (F.abs(c) >= 1e15), c).otherwise((low + F.when(up[how], 1).otherwise(0)).cast("double") / F.lit(10.0 ** p.const)))


def _to_integer(v: Val, lenient: bool = False) -> Val:
    if v.t.kind == "int":
        return v
    c = v.column()
    if v.t.kind == "bool":
        return Val(INT, c.cast("bigint"))
    if v.t.kind == "float":
        return Val(INT, _truncated(c))
    if v.t.kind == "str":
        s = F.regexp_replace(c, _ENDS, "")
        return Val(INT, F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")), _truncated(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")))))
    return _other(v, INT, lenient, "toInteger")


def _truncated(c: Column) -> Column:
    return F.when((c > -(2.0**63)) & (c < 2.0**63), F.when(F.isnan(c) | (F.abs(c) >= 2.0**63), F.lit(0.0)).otherwise(c).cast("bigint"))


def _other(v: Val, t: T, lenient: bool, what: str) -> Val:
    if v.t.kind == "null" or lenient:
        return null_of(t)
    raise TypeMismatch(f"{what}() does not take {v.t}")


def _to_float(v: Val, lenient: bool = False) -> Val:
    if v.t.kind in ("int", "float"):
        return Val(FLOAT, v.column().cast("double"))
    if v.t.kind == "str":
        s = F.regexp_replace(v.column(), _ENDS, "")
        return Val(FLOAT, F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"), s.try_cast("double")))
    return _other(v, FLOAT, lenient, "toFloat")


def _to_boolean(v: Val, lenient: bool = False) -> Val:
    if v.t.kind == "bool":
        return v
    if v.t.kind == "int":
        return Val(BOOL, v.column() != 0)
    if v.t.kind == "str":
        s = F.lower(F.regexp_replace(v.column(), _ENDS, ""))
        return Val(BOOL, F.when(s == "true", True).when(s == "false", False))
    return _other(v, BOOL, lenient, "toBoolean")


def _to_string(v: Val, lenient: bool = False) -> Val:
    if v.t.kind in ("str", "int", "bool", "float"):
        return Val(STR, text_of(v))
    return _other(v, STR, lenient, "toString")


def _list_of(f, t: T):
    def make(v):
        if v.t.kind == "null":
            return null_of(list_of(t))
        need(v, "list", what="list conversion")
        one = (lambda x: _of_several_types({BOOL: "tobooleanornull", INT: "tointegerornull", FLOAT: "tofloatornull", STR: "tostringornull"}[t], [x])) if v.t.elem == DYN else (lambda x: f(x, True))
        return Val(list_of(t), F.transform(v.column(), lambda x: one(Val(v.t.elem, x)).column()))

    return make


def _size(v: Val) -> Val:
    if v.t.kind == "null":
        return null_of(INT)
    if v.t.kind == "str":
        return Val(INT, F.char_length(v.column()).cast("bigint"))
    need(v, "list", what="size")
    return Val(INT, length_of(v.column()))


def length_of(array: Column) -> Column:
    return F.when(array.isNotNull(), F.size(array).cast("bigint"))


def _length(v: Val) -> Val:
    if v.path is not None:
        return Val(INT, length_of(path_ids(v.path)[1]))
    if v.t.kind == "path":
        return Val(INT, length_of(v.column()["rels"]))
    return _size(v)


def _first(v: Val) -> Val:
    need(v, "list", what="head")
    return null_of(NULL) if v.t.kind == "null" else Val(v.t.elem, F.get(v.column(), F.lit(0)))


def _last(v: Val) -> Val:
    need(v, "list", what="last")
    return null_of(NULL) if v.t.kind == "null" else Val(v.t.elem, F.get(v.column(), F.size(v.column()) - 1))


def _tail(v: Val) -> Val:
    need(v, "list", what="tail")
    return v if v.t.kind == "null" else Val(v.t, F.slice(v.column(), F.lit(2), F.greatest(F.size(v.column()), F.lit(1))))


def _reverse(v: Val) -> Val:
    need(v, "list", "str", what="reverse")
    return Val(v.t, F.reverse(v.column()))


def _range(a: Val, b: Val, step: Val | None = None) -> Val:
    for v in (a, b, *([step] if step else [])):
        need(v, "int", what="range")
    x, y = (coerce(v, INT) for v in (a, b))
    s = coerce(step, INT) if step else F.lit(1).cast("bigint")
    ok = ((s > 0) & (x <= y)) | ((s < 0) & (x >= y))
    some = F.sequence(F.when(ok, x).otherwise(F.lit(0).cast("bigint")), F.when(ok, y).otherwise(F.lit(0).cast("bigint")), F.when(ok, s).otherwise(F.lit(1).cast("bigint")))
    return Val(list_of(INT), F.when(x.isNull() | y.isNull() | s.isNull(), F.lit(None)).when(s == 0, fail("RuntimeError", "range() with step 0")).when(ok, some).otherwise(F.array().cast("array<bigint>")))


def _trim(left: bool, right: bool):
    def make(v, chars=None):
        need(v, "str", what="trim")
        c = v.column()
        if chars is None:
            pattern = "|".join([r"^\s+"] * left + [r"\s+$"] * right)
            return Val(STR, F.regexp_replace(c, "(?U)" + pattern, ""))
        need(chars, "str", what="trim")
        k = chars.column()
        got = F.btrim(c, k) if left and right else F.ltrim(c, k) if left else F.rtrim(c, k)
        return Val(STR, F.when(c.isNull() | k.isNull(), F.lit(None)).when(F.char_length(k) != 1, fail("RuntimeError", "trim() takes one character")).otherwise(got))

    return make


def _substring(v: Val, start: Val, size: Val | None = None) -> Val:
    need(v, "str", what="substring"), need(start, "int", what="substring")
    c, a = v.column(), coerce(start, INT)
    n = coerce(need(size, "int", what="substring"), INT) if size else F.lit(2**31 - 1).cast("bigint")
    clipped = F.least(n, F.lit(2**31 - 1).cast("bigint")).cast("int")
    return Val(STR, F.when(c.isNull() | a.isNull() | n.isNull(), F.lit(None)).when((a < 0) | (n < 0), fail("RuntimeError", "substring() with a negative argument")).otherwise(F.substring(c, (a + 1).cast("int"), clipped)))


def _side(f):
    def make(v, n):
        need(v, "str", what="left"), need(n, "int", what="left")
        c, k = v.column(), coerce(n, INT)
        return Val(STR, F.when(c.isNull() | k.isNull(), F.lit(None)).when(k < 0, fail("RuntimeError", "negative length")).otherwise(f(c, k.cast("int"))))

    return make


def _replace(v: Val, a: Val, b: Val) -> Val:
    for x in (v, a, b):
        need(x, "str", what="replace")
    c, x, y = v.column(), a.column(), b.column()
    between = F.concat(y, F.array_join(F.split(c, F.lit("")), y) if b.const is None else F.array_join(F.split(c, F.lit("")), b.const), y)
    plain = F.replace(c, x, y)
    return Val(STR, plain if a.const else F.when(x == "", F.when(c == "", y).otherwise(between)).otherwise(plain))


def _split(v: Val, d: Val) -> Val:
    need(v, "str", what="split"), need(d, "str", "list", what="split")
    if "null" in (v.t.kind, d.t.kind):
        return null_of(list_of(STR))
    quoted = lambda x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = quoted(d.column()) if d.t.kind == "str" else F.array_join(F.transform(d.column(), quoted), "|")
    return Val(list_of(STR), F.split(v.column(), pattern, F.lit(-1)))


def _abs(v: Val) -> Val:
    need(v, "int", "float", what="abs")
    return Val(v.t, F.abs(v.column()))


def _sign(v: Val) -> Val:
    need(v, "int", "float", what="sign")
    c = v.column()
    return Val(INT, F.when(c.isNull(), None).when((c > 0) & ~F.isnan(c.cast("double")), 1).when(c == 0, 0).otherwise(-1).cast("bigint"))


def _ceil(v: Val) -> Val:
    need(v, "int", "float", what="ceil")
    return Val(FLOAT, -floor_of(-v.column().cast("double")) + F.lit(0.0))


def _floor(v: Val) -> Val:
    need(v, "int", "float", what="floor")
    return Val(FLOAT, floor_of(v.column().cast("double")))


def _coalesce(*vs: Val) -> Val:
    t = NULL
    for v in vs:
        t = unify(t, v.t)
    return Val(t, F.coalesce(*[coerce(v, t) for v in vs])) if vs else null_of(NULL)


def _null_if(a: Val, b: Val) -> Val:
    try:
        t = unify(a.t, b.t)
    except Unsupported:
        return a
    return Val(a.t, F.when(~coerce(a, t).eqNullSafe(coerce(b, t)), a.column()))


def _is_empty(v: Val) -> Val:
    if v.t.kind == "map":
        return Val(BOOL, F.when(v.column().isNotNull(), F.lit(not v.t.fields)))
    return Val(BOOL, _size(v).column() == 0)


def _is_nan(v: Val) -> Val:
    need(v, "int", "float", what="isNaN")
    return Val(BOOL, F.when(v.column().isNotNull(), F.isnan(v.column().cast("double"))))


def _type_name(t: T) -> str:
    names = {"dyn": "ANY", "bool": "BOOLEAN", "int": "INTEGER", "float": "FLOAT", "str": "STRING", "map": "MAP", "node": "NODE", "rel": "RELATIONSHIP", "path": "PATH", "null": "NULL"}
    return f"LIST<{_type_name(t.elem)}>" if t.kind == "list" else names.get(t.kind, t.spark.upper())


def _value_type(v: Val) -> Val:
    if v.t == DYN:
        c = v.column()
        return Val(STR, F.when(c.isNull(), "NULL").when(c["r"] == 1, "STRING NOT NULL").when(c["r"] == 2, "BOOLEAN NOT NULL").when(c["i"].isNotNull(), "INTEGER NOT NULL").otherwise("FLOAT NOT NULL"))
    if v.t.kind == "list":
        c, inner = v.column(), _type_name(v.t.elem)
        body = F.when(F.size(c) == 0, "LIST<NOTHING> NOT NULL").when(F.forall(c, lambda x: x.isNull()), "LIST<NULL> NOT NULL").when(F.exists(c, lambda x: x.isNull()), f"LIST<{inner}> NOT NULL").otherwise(f"LIST<{inner} NOT NULL> NOT NULL")
        return Val(STR, F.when(c.isNull(), "NULL").otherwise(body))
    return Val(STR, F.when(v.column().isNull(), "NULL").otherwise(f"{_type_name(v.t)} NOT NULL"))


# -- graph functions
def _part(v: Val, part: str) -> Column:
    return v.elem.at(part) if v.elem is not None else v.column()[part]


def _id(v: Val) -> Val:
    need(v, "node", "rel", what="id")
    return null_of(INT) if v.t.kind == "null" else Val(INT, _part(v, "id"))


def _element_id(v: Val) -> Val:
    need(v, "node", "rel", what="elementId")
    name = "node:" if v.t.kind == "node" else "relationship:"
    return null_of(STR) if v.t.kind == "null" else Val(STR, F.concat(F.lit(name), _part(v, "id").cast("string")))


def _labels(v: Val) -> Val:
    need(v, "node", what="labels")
    return null_of(list_of(STR)) if v.t.kind == "null" else Val(list_of(STR), living(known(v), _part(v, "labels")))


def _type(v: Val) -> Val:
    need(v, "rel", what="type")
    return null_of(STR) if v.t.kind == "null" else Val(STR, _part(known(v), "type"))


def _properties(v: Val) -> Val:
    need(v, "node", "rel", "map", what="properties")
    if v.t.kind in ("null", "map"):
        return v
    return Val(T("map", fields=v.t.fields, spark="sparse"), living(known(v), v.column()["properties"]))


def _keys(v: Val) -> Val:
    need(v, "node", "rel", "map", what="keys")
    if v.t.kind == "null":
        return null_of(list_of(STR))
    if v.t.kind == "map" and v.t.spark == "sparse":
        c = v.column()
        return Val(list_of(STR), F.when(c.isNotNull(), F.array_compact(F.array(*[F.when(c[k].isNotNull(), k) for k, _ in v.t.fields])) if v.t.fields else F.array().cast("array<string>")))
    if v.t.kind == "map":
        return Val(list_of(STR), F.when(v.column().isNotNull(), F.array(*[F.lit(k) for k, _ in v.t.fields]).cast("array<string>")))
    props = [(k, v.elem.at(f"p_{k}") if v.elem is not None else v.column()["properties"][k]) for k, _ in known(v).t.fields]
    there = v.elem.at("id") if v.elem is not None else v.column()
    return Val(list_of(STR), F.when(there.isNotNull(), F.array_compact(F.array(*[F.when(living(v, c).isNotNull(), k) for k, c in sorted(props, key=lambda x: x[0])])) if props else F.array().cast("array<string>")))


def _nodes(v: Val) -> Val:
    need(v, "path", what="nodes")
    if v.path is not None and all(not isinstance(r, tuple) for r in v.path.rels):
        got = make_list([Val(T("node", fields=tuple(sorted(n.props.items()))), elem=n) for n in v.path.nodes])
        return Val(got.t, F.when(v.path.nodes[0].at("id").isNotNull(), got.col))
    ids = path_ids(v.path)[0] if v.path is not None else v.column()["nodes"]
    return Val(list_of(BARE), F.transform(ids, bare))


def bare(i: Column) -> Column:
    """A node of which only the id is known."""
    return F.struct(i.alias("id"), F.lit(None).cast("array<string>").alias("labels"), F.expr("named_struct()").alias("properties"))


def _relationships(v: Val) -> Val:
    need(v, "path", what="relationships")
    if v.path is not None and all(not isinstance(r, tuple) for r in v.path.rels):
        got = make_list([Val(T("rel", fields=tuple(sorted(r.props.items()))), elem=r) for r in v.path.rels])
        return Val(got.t, F.when(v.path.nodes[0].at("id").isNotNull(), got.col))
    ids = path_ids(v.path)[1] if v.path is not None else v.column()["rels"]
    return Val(list_of(T("rel", spark="bare")), F.transform(ids, lambda x: F.struct(x.alias("id"), *[F.lit(None).cast(k).alias(n) for n, k in (("src", "bigint"), ("dst", "bigint"), ("type", "string"))], F.expr("named_struct()").alias("properties"))))


def _end(part: str):
    def make(v):
        need(v, "rel", what="startNode")
        return Val(BARE, F.when(_part(v, "id").isNotNull(), bare(_part(known(v), part))))

    return make


FUNCTIONS = {
    "coalesce": (0, 99, _coalesce), "nullif": (2, 2, _null_if), "isempty": (1, 1, _is_empty), "isnan": (1, 1, _is_nan), "valuetype": (1, 1, _value_type),
    "size": (1, 1, _size), "length": (1, 1, _length), "char_length": (1, 1, lambda v: _size(need(v, "str", what="char_length"))), "character_length": (1, 1, lambda v: _size(need(v, "str", what="character_length"))),
    "head": (1, 1, _first), "last": (1, 1, _last), "tail": (1, 1, _tail), "reverse": (1, 1, _reverse), "range": (2, 3, _range),
    "toboolean": (1, 1, _to_boolean), "tointeger": (1, 1, _to_integer), "toint": (1, 1, _to_integer), "tofloat": (1, 1, _to_float), "tostring": (1, 1, _to_string),
    "tobooleanornull": (1, 1, lambda v: _to_boolean(v, True)), "tointegerornull": (1, 1, lambda v: _to_integer(v, True)), "tofloatornull": (1, 1, lambda v: _to_float(v, True)), "tostringornull": (1, 1, lambda v: _to_string(v, True)),
    "tobooleanlist": (1, 1, _list_of(_to_boolean, BOOL)), "tointegerlist": (1, 1, _list_of(_to_integer, INT)), "tofloatlist": (1, 1, _list_of(_to_float, FLOAT)), "tostringlist": (1, 1, _list_of(_to_string, STR)),
    "toupper": (1, 1, lambda v: Val(STR, F.upper(need(v, "str", what="toUpper").column()))), "upper": (1, 1, lambda v: Val(STR, F.upper(need(v, "str", what="upper").column()))),
    "tolower": (1, 1, lambda v: Val(STR, F.lower(need(v, "str", what="toLower").column()))), "lower": (1, 1, lambda v: Val(STR, F.lower(need(v, "str", what="lower").column()))),
    "trim": (1, 2, _trim(True, True)), "btrim": (1, 2, _trim(True, True)), "ltrim": (1, 2, _trim(True, False)), "rtrim": (1, 2, _trim(False, True)),
    "substring": (2, 3, _substring), "left": (2, 2, _side(F.left)), "right": (2, 2, _side(F.right)), "replace": (3, 3, _replace), "split": (2, 2, _split),
    "abs": (1, 1, _abs), "sign": (1, 1, _sign), "ceil": (1, 1, _ceil), "floor": (1, 1, _floor), "round": (1, 3, _round),
    "sqrt": (1, 1, _math(F.sqrt)), "exp": (1, 1, _math(F.exp)), "log": (1, 1, _log(F.log)), "log10": (1, 1, _log(F.log10)),
    "sin": (1, 1, _math(F.sin)), "cos": (1, 1, _math(F.cos)), "tan": (1, 1, _math(F.tan)), "cot": (1, 1, _math(lambda c: F.cos(c) * F.when(F.sin(c) != 0, 1 / F.when(F.sin(c) != 0, F.sin(c)).otherwise(1.0)).otherwise(float("inf")))),
    "asin": (1, 1, _math(F.asin)), "acos": (1, 1, _math(F.acos)), "atan": (1, 1, _math(F.atan)),
    "atan2": (2, 2, lambda a, b: Val(FLOAT, F.atan2(need(a, "int", "float", what="atan2").column().cast("double"), need(b, "int", "float", what="atan2").column().cast("double")))),
    "degrees": (1, 1, _math(F.degrees)), "radians": (1, 1, _math(F.radians)), "haversin": (1, 1, _math(lambda c: (1 - F.cos(c)) / 2)),
    "e": (0, 0, lambda: Val(FLOAT, F.e())), "pi": (0, 0, lambda: Val(FLOAT, F.pi())), "rand": (0, 0, lambda: Val(FLOAT, F.rand())), "randomuuid": (0, 0, lambda: Val(STR, F.expr("uuid()"))),
    "timestamp": (0, 0, lambda: Val(INT, F.lit(int(time.time() * 1000)).cast("bigint"))),
    "id": (1, 1, _id), "elementid": (1, 1, _element_id), "labels": (1, 1, _labels), "type": (1, 1, _type), "properties": (1, 1, _properties), "keys": (1, 1, _keys),
    "startnode": (1, 1, _end("src")), "endnode": (1, 1, _end("dst")), "nodes": (1, 1, _nodes), "relationships": (1, 1, _relationships), "rels": (1, 1, _relationships),
}


_CONVERSIONS = ("tostring", "tointeger", "toint", "tofloat", "toboolean", "tostringornull", "tointegerornull", "tofloatornull", "tobooleanornull")
_ANY = ("coalesce", "nullif", "valuetype")
_OF_STRINGS = ("toupper", "upper", "tolower", "lower", "trim", "btrim", "ltrim", "rtrim", "substring", "left", "right", "replace", "split", "size", "char_length", "character_length", "reverse", "isempty")


def _of_several_types(name: str, args: list[Val]) -> Val:
    """A function of scalars of several types: conversions by each row's type, others for the type that they take."""
    if name in _CONVERSIONS:
        c, out = args[0].column(), None
        for t, k in ((STR, "s"), (BOOL, "b"), (INT, "i"), (FLOAT, "f")):
            v = call(name, [Val(t, c[k])])
            out = F.when(c[k].isNotNull(), v.column()) if out is None else out.when(c[k].isNotNull(), v.column())
        return Val(v.t, out)
    first = name in _OF_STRINGS
    return call(name, [narrowed(a, "str" if first and (k == 0 or name in ("replace", "split")) else "int" if first else "float") if a.t == DYN else a for k, a in enumerate(args)])


def call(name: str, args: list[Val]) -> Val:
    if name in FUNCTIONS and any(a.t == DYN for a in args) and name not in _ANY:
        return _of_several_types(name, args)
    if name not in FUNCTIONS:
        raise Unsupported(f"function {name}()")
    least, most, make = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise InvalidQuery(f"{name}() takes {least} to {most} arguments")
    if args and any(a.t.kind == "null" for a in args) and name not in ("coalesce", "nullif", "valuetype", "round", "tostringlist", "tointegerlist", "tofloatlist", "tobooleanlist", "keys", "properties"):
        return null_of(NULL)
    return make(*args)
