"""Pattern matching as joins.

A chain becomes scans and equi-joins; a relationship is used once in a MATCH,
which is a predicate on pairs whose types overlap; variable lengths are joins
level by level that keep the trail; optional patterns are left joins with all
predicates in the join condition; pattern predicates are semi and anti joins.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.errors import InvalidQuery, TypeMismatch, Unsupported
from graphspark.functions.scalar import known as known_parts
from graphspark.plans.durable import numbered, persisted
from graphspark.plans.expr import Compiler
from graphspark.plans.parser import N, walk
from graphspark.plans.types import Elem, Path, T, Val, elem_type, list_of, path_ids, sql
from graphspark.sources.graph import PropertyGraph, union_tables


@dataclass
class Frame:
    """Rows with the variables in scope."""

    graph: PropertyGraph
    params: dict
    df: DataFrame | None = None  # None: one row without columns
    scope: dict[str, Val] = field(default_factory=dict)
    order: list[tuple[str, bool]] = field(default_factory=list)
    names: itertools.count = field(default_factory=itertools.count)
    used: set | None = None  # variables of which more than the id is asked; None: all
    seq: list[tuple[str, bool]] = field(default_factory=list)  # columns that order the rows (ascending?), where updates need that
    ordered: bool = False  # whether the query updates
    grain: str | None = None  # prefix of a node that no two rows share, if one is known: plans choose by it, results do not

    def rows(self) -> DataFrame:
        return self.df if self.df is not None else self.graph.spark.range(1).select()

    def fresh(self, kind: str) -> str:
        return f"{kind}{next(self.names)}"

    def compiler(self, known: dict | None = None) -> Compiler:
        return Compiler(self.scope, self.params, known)


def free_names(e: N | None) -> set[str]:
    return {x.name for x in walk(e) if x.kind == "var"} if e is not None else set()


def conjuncts(e: N | None) -> list[N]:
    if e is None:
        return []
    if e.kind == "and":
        return conjuncts(e.a) + conjuncts(e.b)
    if e.kind == "paren":
        inner = conjuncts(e.a)
        return inner if len(inner) > 1 else [e]
    return [e]


# -- scans
def label_fits(e: N | None, have: frozenset) -> bool | None:
    """Whether a label expression holds for these labels; None if only the run can say."""
    if e is None or e.kind == "label_any":
        return e is None or bool(have)
    if e.kind == "label":
        return e.name in have
    if e.kind == "label_dynamic":
        return None
    a = label_fits(e.a, have)
    if e.kind == "label_not":
        return None if a is None else not a
    b = label_fits(e.b, have)
    if e.kind == "label_and":
        return False if False in (a, b) else None if None in (a, b) else True
    return True if True in (a, b) else None if None in (a, b) else False


def scan_nodes(frame: Frame, label: N | None, among: tuple[frozenset, ...] | None = None) -> tuple[Elem, DataFrame]:
    """The nodes that a label expression without free variables holds for.

    ``among``: label sets, one of which each node has that is looked for.
    """
    prefix = frame.fresh("n")
    parts, tables = [], []
    for t in frame.graph.nodes:
        fits = label_fits(label, t.labels) if t.labels is not None else None if label is not None else True
        if among is not None and t.labels is not None and not any(x <= t.labels for x in among):
            fits = False
        if fits is not False:
            parts.append(t.df if fits else t.df.where(Compiler({}, frame.params).labels_test(label, F.col("labels"))))
            tables.append(t)
    df = union_tables(parts) if parts else frame.graph.spark.createDataFrame([], "id long, labels array<string>")
    return _named("node", prefix, df, tuple(tables))


def _named(kind: str, prefix: str, df: DataFrame, tables: tuple = ()) -> tuple[Elem, DataFrame]:
    from graphspark.plans.types import of_spark

    props = {f.name[2:]: of_spark(f.dataType) for f in df.schema.fields if f.name.startswith("p_")}
    return Elem(kind, prefix, props, tables), df.select(*[F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in df.columns])


def rel_tables(frame: Frame, types: N | None) -> list[tuple]:
    """(table, whether all its rows fit or None) of those that may hold relationships of these types."""
    out = []
    for t in frame.graph.rels:
        fits = label_fits(types, frozenset([t.type])) if t.type is not None else None if types is not None else True
        if fits is not False:
            out.append((t, fits))
    return out


def scan_rels(frame: Frame, rel: N, direction: str, ids: bool = True) -> tuple[Elem, DataFrame, list]:
    """Relationships with the columns ``from`` and ``to`` in the direction of travel, and their tables.

    Without ``ids`` the id column may be null.
    """
    tables, parts = [], []
    for t, fits in rel_tables(frame, rel.types):
        df = t.df if ids or t.bare is None else t.bare
        tables.append(t)
        parts.append(df if fits else df.where(Compiler({}, frame.params).labels_test(rel.types, F.array("type"), "rel")))
    df = union_tables(parts) if parts else frame.graph.spark.createDataFrame([], "id long, src long, dst long, type string")
    out = df.withColumns({"from": F.col("src"), "to": F.col("dst")})
    back = df.withColumns({"from": F.col("dst"), "to": F.col("src")})
    df = out if direction == "out" else back if direction == "in" else out.unionByName(back.where("src <> dst"))
    elem, df = _named("rel", frame.fresh("r"), df, tuple(tables))
    return elem, df, tables


def ends_of(tables: tuple | list | None, *sides: str) -> tuple[frozenset, ...] | None:
    """The label sets of the relationships' ends, if all tables vouch for them."""
    found = [getattr(t, s) for t in tables or () for s in sides]
    return tuple(found) if found and all(x is not None for x in found) else None


# -- matching
class Match:
    """One MATCH: joins its parts to the rows of a frame."""

    def __init__(self, frame: Frame, parts: list[N], outer: dict[str, Val] | None = None, seeds: dict[str, DataFrame] | None = None):
        self.frame, self.parts, self.outer, self.seeds = frame, parts, outer, seeds or {}
        self.elems: dict[str, Elem] = {}
        self.rel_values: list = []  # (types or None, id column or array of them)
        self.deferred: list[Column] = []
        self.grain: str | None = None  # the node that no two rows share
        self.conditions = Compiler({**(outer or {}), **frame.scope}, frame.params)

    def run(self) -> Frame:
        f = self.frame
        keys, pending, todo = {}, [], []
        for p in self.parts:
            own = []
            for n in p.nodes:
                key = n.var or f.fresh("_")
                old = f.scope.get(key) if n.var else None
                if old is not None:
                    if old.t.kind not in ("node", "null"):
                        raise InvalidQuery(f"VariableTypeConflict {n.var}")
                    if old.elem is not None:
                        self.elems[key] = old.elem
                    elif key not in self.elems:
                        self.elems[key] = self._struct_node(old)
                own.append(key)
                keys.setdefault(key, []).append(n)
            for i, r in enumerate(p.rels):
                pending.append([p, i, r, own[i], own[i + 1], None])
                todo.append(pending[-1])
            p._keys = own
        names = [r.var for _, _, r, *_ in pending if r.var]
        if len(names) != len(set(names)):
            raise InvalidQuery("RelationshipUniquenessViolation")
        paths = [p.path for p in self.parts if p.path]
        if clash := ({*names} & {*keys}) | ({*paths} & ({*keys} | {*names})):
            raise InvalidQuery(f"VariableTypeConflict {', '.join(sorted(clash))}")
        df = f.df
        for key in list(self.elems):
            df = self._node_tests(df if df is not None else f.rows(), key, keys.get(key, []), bound=True)
        self.grain = next((k for k, e in self.elems.items() if e.prefix == f.grain), None)
        while todo:
            at = min((e for e in todo if e[3] in self.elems or e[4] in self.elems), key=self._growth, default=None)
            if at is None:
                start = min((k for e in todo for k in e[3:5]), key=lambda k: self._weight(keys[k]))
                at = next(e for e in todo if start in e[3:5])
                if at[2].length is None and at[2].direction != "both" and self._plain(keys[start], at[0]) and start not in self.seeds and not (at[2].var and at[2].var in f.scope):
                    todo.remove(at)
                    df = self._from_edge(df, at, keys)
                elif at[2].length is not None and at[2].length[0] > 0 and at[2].direction != "both" and at[2].var in f.scope and f.scope[at[2].var].t.kind == "list":
                    df = self._from_list(df, at, keys)
                else:
                    df = self._scan(df, start, keys[start])
                continue
            todo.remove(at)
            grain = self._grain_after(at)
            df = self._expand(df, at, keys)
            self.grain = grain
        for key, nodes in keys.items():
            if key not in self.elems:
                df = self._scan(df, key, nodes)
        scope = dict(f.scope)
        for key, nodes in keys.items():
            if nodes[0].var and not (key in f.scope and f.scope[key].elem is None):
                scope[key] = Val(elem_type(self.elems[key]), elem=self.elems[key])
        for p, i, r, a, b, made in pending:
            if r.var and r.var not in f.scope:
                scope[r.var] = made if isinstance(made, Val) else Val(elem_type(made), elem=made)
        for p in self.parts:
            if p.path:
                rels = [next(e for e in pending if e[0] is p and e[1] == i) for i in range(len(p.rels))]
                used = [t for e in rels for t in (e[5].tables if isinstance(e[5], Elem) else e[5]._tables) or (None,)]
                path = Path([self.elems[k] for k in p._keys], [e[5] if isinstance(e[5], Elem) else (e[5]._steps, e[2].length[0]) for e in rels], None if None in used else tuple(used))
                scope[p.path] = Val(T("path"), path=path)
        return replace(f, df=df, scope=scope, grain=self.elems[self.grain].prefix if self.grain else None)

    def _growth(self, edge: list) -> int:
        """How a relationship adds rows, 0: none, 1: one for a row at most, 2: no more in all than its table holds, 3: for each row those of a node that rows share.

        Taken in this order, relationships that close a cycle come before the ones that meet in its hubs.
        """
        rel, left, right = edge[2:5]
        if rel.var and rel.var in self.frame.scope or rel.length is None and left in self.elems and right in self.elems:
            return 0
        start = left if left in self.elems else right
        if self._owner_end(edge) == start:
            return 1
        return 2 if start == self.grain else 3

    def _owner_end(self, edge: list) -> str | None:
        """The end that has one relationship at most, in each of the tables."""
        rel, left, right = edge[2:5]
        sides = {t.owner.side if t.owner else None for t, _ in rel_tables(self.frame, rel.types)}
        if rel.length is not None or rel.direction == "both" or len(sides) != 1 or None in sides:
            return None
        return left if (sides == {"src"}) == (rel.direction == "out") else right

    def _grain_after(self, edge: list) -> str | None:
        """The node that no two rows share once the relationship is there."""
        growth = self._growth(edge)
        if growth < 2:
            return self.grain
        one = len(rel_tables(self.frame, edge[2].types)) == 1
        return self._owner_end(edge) if growth == 2 and one else None

    def _struct_node(self, v: Val) -> Elem:
        """A node held as a struct: only its id takes part."""
        prefix = self.frame.fresh("n")
        f = self.frame
        f.df = f.rows().withColumns({f"{prefix}__id": v.column()["id"] if v.t.kind == "node" else F.lit(None).cast("long"), f"{prefix}__labels": v.column()["labels"] if v.t.kind == "node" else F.lit(None).cast("array<string>")})
        return Elem("node", prefix, {})

    def _weight(self, nodes: list[N]) -> tuple:
        return (not any(n.props is not None for n in nodes), not any(n.label is not None for n in nodes))

    def _label(self, nodes: list[N]) -> N | None:
        out = None
        for n in nodes:
            if n.label is not None:
                out = n.label if out is None else N("label_and", a=out, b=n.label)
        return out

    def _static(self, label: N | None) -> bool:
        return label is None or not any(free_names(x.expr) for x in walk(label) if x.kind == "label_dynamic")

    def _node_tests(self, df: DataFrame, key: str, nodes: list[N], bound: bool) -> DataFrame:
        elem, tests = self.elems[key], []
        label = self._label(nodes)
        if label is not None and (bound or not self._static(label)):
            tests.append(self.conditions.labels_test(label, elem.at("labels")))
        old = self.frame.scope.get(key)
        for n in nodes:
            tests += self._props(old if old is not None and old.elem is None and old.t.kind == "node" else Val(elem_type(elem), elem=elem), n.props)
        for t in tests:
            df = df.where(t)
        if bound and nodes:
            df = df.where(elem.at("id").isNotNull())
        return df

    def _props(self, v: Val, props: N | None) -> list[Column]:
        """Equality tests of an inline map; those that need outer rows are put off to the join."""
        if props is None:
            return []
        if props.kind == "param":
            raise InvalidQuery("InvalidParameterUse: a parameter in the place of a pattern's properties")
        if props.kind == "map":
            pairs = props.pairs
        else:
            raise Unsupported("properties that are not a map")
        out = []
        for k, e in pairs:
            test = F.coalesce(self.conditions.equal(self.conditions.prop(v, k), self.conditions(e)), F.lit(False))
            if self.conditions.prop(v, k).t.kind in ("int", "str", "bool") and not free_names(e):
                test = self.conditions.equal(self.conditions.prop(v, k), self.conditions(e))  # a form that scans can use
            (self.deferred if self.outer and free_names(e) & set(self.outer) else out).append(test)
        return out

    def _scan(self, df: DataFrame | None, key: str, nodes: list[N]) -> DataFrame:
        label = self._label(nodes)
        elem, scan = scan_nodes(self.frame, label if self._static(label) else None)
        self.elems[key] = elem
        self.grain = key if df is None else None
        if key in self.seeds:
            seed = self.seeds[key]
            scan = scan.join(seed, elem.at("id") == F.col(seed.columns[0]), "left_semi")
        own = self._node_tests(scan, key, nodes, bound=False) if df is None or not self._needs_rows(label, nodes) else None
        if df is None:
            return own
        if own is not None:
            return df.crossJoin(own)
        return self._node_tests(df.crossJoin(scan), key, nodes, bound=False)

    def _needs_rows(self, label: N | None, nodes: list[N]) -> bool:
        return not self._static(label) or any(free_names(n.props) for n in nodes)

    def _expand(self, df: DataFrame, edge: list, keys: dict) -> DataFrame:
        p, i, rel, left, right, _ = edge
        forward = left in self.elems
        start, end = (left, right) if forward else (right, left)
        direction = rel.direction if forward or rel.direction == "both" else {"in": "out", "out": "in"}[rel.direction]
        if rel.length is not None:
            return self._levels(df, edge, start, end, direction, forward, keys)
        both = end in self.elems
        owned = self._owned(df, edge, start, keys, direction)
        if owned is not None:
            df, elem, tables, cond = owned
        else:
            elem, scan, tables = scan_rels(self.frame, rel, direction, self._ids_matter(edge))
            cond = self.elems[start].at("id") == elem.at("from")
        edge[5] = elem
        if both:
            cond = cond & (self.elems[start].at("id") == elem.at("from")) & (self.elems[end].at("id") == elem.at("to"))
        cond = cond & self._rel_tests(elem, rel, tables)
        df = df.where(cond) if owned is not None else df.join(scan, cond)
        return df if end in self.elems else self._end(df, end, keys[end], elem, tables, direction, p)

    def _rel_tests(self, elem: Elem, rel: N, tables: list) -> Column:
        """A bound variable, inline properties, and no relationship twice in a MATCH."""
        tests = self._props(Val(elem_type(elem), elem=elem), rel.props)
        old = self.frame.scope.get(rel.var) if rel.var else None
        if old is not None:
            if old.t.kind not in ("rel", "null"):
                raise InvalidQuery(f"VariableTypeConflict {rel.var}")
            tests.append(elem.at("id") == (old.elem.at("id") if old.elem is not None else old.column()["id"]))
        types = _types(tables)
        for other, value in self.rel_values:
            if types is None or other is None or types & other:
                tests.append(elem.at("id") != value if not isinstance(value, tuple) else ~F.array_contains(value[0], elem.at("id")))
        self.rel_values.append((types, elem.at("id")))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def _ids_matter(self, edge: list) -> bool:
        """Whether the ids of this part's relationships take part in anything."""
        p, _, rel, *_ = edge
        if rel.var or p.path:
            return True
        own = _types([t for t, _ in rel_tables(self.frame, rel.types)])
        others = [r for q in self.parts for r in q.rels if r is not rel]
        return any(own is None or (x := _types([t for t, _ in rel_tables(self.frame, r.types)])) is None or own & x for r in others)

    def _owned(self, df: DataFrame | None, edge: list, start: str | None, keys: dict, direction: str) -> tuple | None:
        """The relationship from the columns of the node whose row it is, bound or scanned now: (rows, element, tables, condition).

        ``start``: the end that is bound, None if none is.
        """
        p, _, rel, left, right, _ = edge
        found = rel_tables(self.frame, rel.types)
        if rel.direction == "both" or len(found) != 1 or not found[0][1] or found[0][0].owner is None or left == right:
            return None
        table, owner = found[0][0], found[0][0].owner
        if not any(t is owner.table for t in self.frame.graph.nodes):
            return None
        src, dst = (left, right) if rel.direction == "out" else (right, left)
        own = src if owner.side == "src" else dst
        if own in self.elems:
            node = self.elems[own]
            if node.tables is None or len(node.tables) != 1 or node.tables[0] is not owner.table or node.gone or not {f"{node.prefix}__p_{k}" for k in owner.needs} <= set(df.columns):
                return None
        else:
            label = self._label(keys[own])
            if not self._static(label) or label_fits(label, owner.table.labels) is not True or self._plain(keys[own], p) or own in self.seeds:
                return None
            node, scan = _named("node", self.frame.fresh("n"), owner.table.df, (owner.table,))
            self.elems[own] = node
            if start is not None:
                df = df.join(scan, self.elems[start].at("id") == owner.columns(node)["dst" if owner.side == "src" else "src"])
            else:
                df = scan if df is None else df.crossJoin(scan)
            df = self._node_tests(df, own, keys[own], bound=False)
        prefix, cols = self.frame.fresh("r"), owner.columns(node)
        cols |= {"from": cols["src"], "to": cols["dst"]} if direction == "out" else {"from": cols["dst"], "to": cols["src"]}
        elem = Elem("rel", prefix, dict(table.props), (table,))
        df = df.withColumns({f"{prefix}__{k}": c for k, c in cols.items()})
        return df, elem, [table], elem.at("src").isNotNull() & elem.at("dst").isNotNull()

    def _from_edge(self, df: DataFrame | None, edge: list, keys: dict) -> DataFrame:
        """Begin with the relationships of a pattern neither of whose nodes is bound."""
        p, _, rel, left, right, _ = edge
        one = df is None and len(rel_tables(self.frame, rel.types)) == 1
        self.grain = self._owner_end(edge) if one else None
        owned = self._owned(df, edge, None, keys, rel.direction)
        if owned is not None:
            df, elem, tables, cond = owned
            df = df.where(cond & self._rel_tests(elem, rel, tables))
        else:
            elem, scan, tables = scan_rels(self.frame, rel, rel.direction, self._ids_matter(edge))
            tests = self._rel_tests(elem, rel, tables)
            df = scan.where(tests) if df is None else df.join(scan, tests)
        edge[5] = elem
        for key, end, direction in ((left, _turned(elem), "in" if rel.direction == "out" else "out"), (right, elem, rel.direction)):
            if key not in self.elems:
                df = self._end(df, key, keys[key], end, tables, direction, p)
            elif owned is None or left == right:
                df = df.where(self.elems[key].at("id") == end.at("to"))
        return df

    def _from_list(self, df: DataFrame | None, edge: list, keys: dict) -> DataFrame:
        """Bind the node at which a list of relationships that is there already begins."""
        rel, left = edge[2], edge[3]
        first = F.get(self.frame.scope[rel.var].column(), F.lit(0))
        self.grain = None
        label = self._label(keys[left])
        node, scan = scan_nodes(self.frame, label if self._static(label) else None)
        self.elems[left] = node
        df = (df if df is not None else self.frame.rows()).join(scan, node.at("id") == first["src" if rel.direction == "out" else "dst"])
        return self._node_tests(df, left, keys[left], bound=False)

    def _plain(self, nodes: list[N], part: N) -> bool:
        """Whether only the ids of the nodes are asked for."""
        f = self.frame
        return not part.path and not any(n.props is not None for n in nodes) and (nodes[0].var is None or f.used is not None and nodes[0].var not in f.used)

    def _end(self, df: DataFrame, key: str, nodes: list[N], elem: Elem, tables: list, direction: str, part: N) -> DataFrame:
        """Bind the far node, without a scan where its id is all that is asked and the tables vouch for it."""
        label, f = self._label(nodes), self.frame
        if self._plain(nodes, part) and tables:
            ends = [getattr(t, side) for t in tables for side in {"out": ("dst",), "in": ("src",), "both": ("src", "dst")}[direction]]
            if all(e is not None and label_fits(label, e) for e in ends):
                prefix = f.fresh("n")
                self.elems[key] = Elem("node", prefix, {})
                return df.withColumns({f"{prefix}__id": elem.at("to")})
        among = ends_of(tables, *(("dst",) if direction == "out" else ("src",) if direction == "in" else ("src", "dst")))
        node, scan = scan_nodes(f, label if self._static(label) else None, among)
        self.elems[key] = node
        return self._node_tests(df.join(scan, elem.at("to") == node.at("id")), key, nodes, bound=False)

    def _levels(self, df: DataFrame, edge: list, start: str, end: str, direction: str, forward: bool, keys: dict) -> DataFrame:
        rel, f = edge[2], self.frame
        lo, hi = rel.length
        if rel.var and rel.var in f.scope:
            return self._given(df, edge, start, end, direction, forward, keys)
        prefix = f.fresh("v")
        elem, scan, tables = scan_rels(f, rel, direction)
        for t in self._props(Val(elem_type(elem), elem=elem), rel.props):
            scan = scan.where(t)
        # tables cannot hold structs without fields
        props = [F.struct(*[elem.at(f"p_{k}").alias(k) for k in sorted(elem.props)]).alias("properties")] if elem.props and rel.var else []
        own_t = T("rel", fields=tuple(sorted(elem.props.items())) if rel.var else ())
        step = F.struct(*[elem.at(x).alias(x) for x in ("id", "src", "dst", "type")], *props, elem.at("from").alias("fr"), elem.at("to").alias("to"))
        scan = scan.select(elem.at("from").alias(f"{prefix}_from"), elem.at("to").alias(f"{prefix}_to"), elem.at("id").alias(f"{prefix}_id"), step.alias(f"{prefix}_step"))
        types = _types(tables)
        kind = dict(scan.dtypes)[f"{prefix}_step"]
        base = df.withColumns({f"{prefix}__end": self.elems[start].at("id"), f"{prefix}__ids": F.array().cast("array<bigint>"), f"{prefix}__steps": F.array().cast(f"array<{kind}>")})
        out, level, at, columns = [], 0, base, base.columns
        others = [v for t, v in self.rel_values if types is None or t is None or t & types]
        while True:
            if level >= lo:
                out.append(at)
            if hi is not None and level >= hi:
                break
            fresh = ~F.array_contains(f"{prefix}__ids", F.col(f"{prefix}_id"))
            for v in others:
                fresh = fresh & (F.col(f"{prefix}_id") != v if not isinstance(v, tuple) else ~F.array_contains(v[0], F.col(f"{prefix}_id")))
            at = at.join(scan, (F.col(f"{prefix}__end") == F.col(f"{prefix}_from")) & fresh)
            at = at.withColumns({f"{prefix}__end": F.col(f"{prefix}_to"), f"{prefix}__ids": F.array_append(f"{prefix}__ids", F.col(f"{prefix}_id")), f"{prefix}__steps": F.array_append(f"{prefix}__steps", F.col(f"{prefix}_step"))}).select(*columns)
            level += 1
            if hi is None or lo <= level < hi:  # a level that is both given out and gone on from is made once
                at = persisted(at, "level")
                if at.isEmpty():
                    break
        df = out[0] if out else at
        for x in out[1:]:
            df = df.union(x)
        steps = F.col(f"{prefix}__steps")
        if not forward:
            steps = F.transform(F.reverse(steps), lambda x: x.withField("to", x["fr"]))
        value = F.transform(steps, lambda x: F.struct(*[x[k].alias(k) for k in ("id", "src", "dst", "type")], (x["properties"] if props else F.expr("named_struct()")).alias("properties")))
        edge[5] = Val(list_of(own_t), value)
        edge[5]._steps, edge[5]._tables = steps, tables
        self.rel_values.append((types, (F.col(f"{prefix}__ids"),)))
        if end in self.elems:
            return df.where(F.col(f"{prefix}__end") == self.elems[end].at("id"))
        nodes = keys[end]
        label = self._label(nodes)
        node, scan = scan_nodes(f, label if self._static(label) else None, None if lo == 0 else ends_of(tables, "src", "dst"))
        self.elems[end] = node
        return self._node_tests(df.join(scan, F.col(f"{prefix}__end") == node.at("id")), end, nodes, bound=False)


    def _given(self, df: DataFrame, edge: list, start: str, end: str, direction: str, forward: bool, keys: dict) -> DataFrame:
        """A list of relationships that is there already: kept if it is a walk between the ends."""
        rel, f = edge[2], self.frame
        v, (lo, hi), prefix = f.scope[rel.var], rel.length, f.fresh("v")
        if v.t.kind != "list" or v.t.elem.kind not in ("rel", "null"):
            raise InvalidQuery(f"VariableTypeConflict {rel.var}")
        steps = v.column() if forward else F.reverse(v.column())

        def walk_on(at, x):
            out, back = F.when(at == x["src"], x["dst"]), F.when(at == x["dst"], x["src"])
            return out if direction == "out" else back if direction == "in" else F.coalesce(out, back)

        test = steps.isNotNull() & (F.size(steps) >= lo) & (F.size(F.array_distinct(F.transform(steps, lambda x: x["id"]))) == F.size(steps))
        if hi is not None:
            test = test & (F.size(steps) <= hi)
        far = F.aggregate(steps, self.elems[start].at("id"), walk_on)
        df = df.where(test).withColumns({f"{prefix}__end": far, f"{prefix}__ids": F.transform(steps, lambda x: x["id"])})
        df = df.where(F.col(f"{prefix}__end").isNotNull())
        edge[5] = Val(v.t, v.column())
        edge[5]._steps, edge[5]._tables = F.transform(v.column(), lambda x: x.withField("to", x["dst"] if rel.direction == "out" else x["src"])), None
        for other, value in self.rel_values:
            df = df.where(~F.array_contains(f"{prefix}__ids", value) if not isinstance(value, tuple) else ~F.arrays_overlap(F.col(f"{prefix}__ids"), value[0]))
        self.rel_values.append((None, (F.col(f"{prefix}__ids"),)))
        if end in self.elems:
            return df.where(F.col(f"{prefix}__end") == self.elems[end].at("id"))
        label = self._label(keys[end])
        node, scan = scan_nodes(f, label if self._static(label) else None)
        self.elems[end] = node
        return self._node_tests(df.join(scan, F.col(f"{prefix}__end") == node.at("id")), end, keys[end], bound=False)


def _types(tables: list) -> frozenset | None:
    """The types that the tables' relationships have, if known."""
    return frozenset(t.type for t in tables) if tables and all(t.type is not None for t in tables) else None


class _Turned(Elem):
    """A relationship seen from its other end."""

    def at(self, part: str) -> Column:
        return super().at({"from": "to", "to": "from"}.get(part, part))


def _turned(elem: Elem) -> Elem:
    return _Turned(elem.kind, elem.prefix, elem.props, elem.tables)


def pattern_names(parts: list[N]) -> set[str]:
    return {x.var for p in parts for x in [*p.nodes, *p.rels] if x.var}


def apart(frame: Frame, parts: list[N], used: set | None = frozenset()) -> tuple[Frame, Column, list[Column]]:
    """The pattern matched on its own: (its frame, the join condition to ``frame``, tests put off to that join).

    Variables that ``frame`` has bound are matched anew and meet their old selves by id.
    """
    shared = {n: frame.scope[n] for n in pattern_names(parts) if n in frame.scope and frame.scope[n].t.kind in ("node", "rel")}
    seeds = {}
    if any(r.length is not None for p in parts for r in p.rels):
        for p in parts:
            for n in p.nodes:
                if n.var in shared and shared[n.var].elem is not None and not seeds:
                    seeds[n.var] = frame.rows().select(shared[n.var].elem.at("id").alias(frame.fresh("seed"))).distinct()
    bare = [_without_labels(p, shared) for p in parts]
    ids = Frame(frame.graph, frame.params, names=frame.names, used=None if used is None else {*(frame.used or ()), *used} if frame.used is not None else None)
    if used is not None:
        ids.used = {n for n in pattern_names(parts) if n not in shared and (frame.used is None or n in frame.used) or n in used}
    m = Match(ids, bare, outer=frame.scope, seeds=seeds)
    if seeds:
        m._weight = lambda nodes: (not any(n.var in seeds for n in nodes),)
    sub = m.run()
    on = F.lit(True)
    for n, v in shared.items():
        mine = v.elem.at("id") if v.elem is not None else v.column()["id"]
        on = on & (mine == sub.scope[n].elem.at("id"))
    for p in parts:
        for x in p.nodes:
            if x.var in shared and x.label is not None:
                v = shared[x.var]
                m.deferred.append(frame.compiler().labels_test(x.label, v.elem.at("labels") if v.elem is not None else v.column()["labels"]))
    return sub, on, m.deferred


def _without_labels(p: N, shared: dict) -> N:
    nodes = [N("node", x.text, var=x.var, label=None if x.var in shared else x.label, props=x.props) for x in p.nodes]
    return N("chain", p.text, path=p.path, nodes=nodes, rels=p.rels)


def _has_pattern(e: N | None) -> bool:
    return e is not None and any(x.kind in ("pattern", "pattern_comprehension") for x in walk(e))


def with_numbers(frame: Frame) -> tuple[Frame, str]:
    """The frame written down, with a column that numbers its rows from 0 on, in the order of lists and sort keys before."""
    name = frame.fresh("ord")
    by = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_first() for c, asc in frame.seq]
    return replace(frame, df=numbered(frame.rows(), name, *by)), name


def optional(frame: Frame, parts: list[N], where: N | None) -> Frame:
    """OPTIONAL MATCH: a left join with the predicates in its condition."""
    apart_first = _has_pattern(where) or any(_ends_asked(e) for e in walk(where)) if where is not None else False
    if apart_first:
        frame, ordinal = with_numbers(frame)
    sub, on, deferred = apart(frame, parts, free_names(where))
    new = {n: v for n, v in sub.scope.items() if n not in frame.scope}
    both = replace(frame, scope={**frame.scope, **new}, grain=None)
    for t in deferred:
        on = on & t
    if apart_first:  # what joins the predicates need comes before the left join
        found = filtered(replace(both, df=frame.rows().join(sub.df, on)), where)
        back = found.df.select(F.col(ordinal).alias(f"{ordinal}_"), *[f"`{c}`" for c in sub.df.columns])
        return replace(both, df=frame.df.join(back, F.col(ordinal) == F.col(f"{ordinal}_"), "left"))
    if where is not None:
        on = on & both.compiler().condition(where)
    if frame.df is None:
        return replace(both, df=frame.rows().join(sub.df, on, "left"))
    return replace(both, df=frame.df.join(sub.df, on, "left"))


def filtered(frame: Frame, where: N | None) -> Frame:
    """WHERE: top-level pattern predicates are semi and anti joins, others flags."""
    for e in conjuncts(where):
        inner, negate = e, False
        while inner.kind in ("paren", "not"):
            negate ^= inner.kind == "not"
            inner = inner.a
        if inner.kind == "call" and inner.name == "exists" and len(inner.args) == 1:
            inner = inner.args[0]
        if inner.kind == "pattern":
            _check_bound(frame, inner)
            sub, on, deferred = apart(frame, [inner.chain])
            for t in deferred:
                on = on & t
            frame = replace(frame, df=frame.rows().join(sub.df, on, "left_anti" if negate else "left_semi"))
        else:
            frame, known = prepared(frame, [e])
            frame = replace(frame, df=frame.rows().where(frame.compiler(known).condition(e)))
    return frame


def _check_bound(frame: Frame, e: N) -> None:
    for n in pattern_names([e.chain]):
        if n not in frame.scope:
            raise InvalidQuery(f"UndefinedVariable {n}")


def check_patterns(e: N, predicate: bool = False) -> None:
    """A pattern stands only where a predicate does, or inside exists()."""
    if e.kind == "pattern":
        if not predicate:
            raise InvalidQuery(f"UnexpectedSyntax: a pattern is no value: {e.text}")
    elif e.kind == "call" and e.name == "exists":
        for c in e.children():
            check_patterns(c, True)
    elif e.kind == "paren":
        check_patterns(e.a, predicate)
    elif e.kind != "pattern_comprehension":
        for c in e.children():
            check_patterns(c, e.kind in ("and", "or", "xor", "not", "case", "comprehension", "quantifier"))


def _ends_asked(e: N) -> bool:
    return e.kind == "call" and e.name in ("startnode", "endnode", "nodes", "relationships", "rels")


def prepared(frame: Frame, exprs: list[N], known: dict[int, Val] | None = None) -> tuple[Frame, dict[int, Val]]:
    """Join what pattern predicates and comprehensions, and the parts of paths and relationships, need; their values by node.

    ``known``: values made before.
    """
    known = dict(known or {})
    made: dict[tuple, Val] = {}
    for root in exprs:
        ids_only = {id(a) for x in walk(root) if x.kind == "call" and x.name in ("id", "elementid", "size", "isempty", "length", "count") for a in x.args}
        ids_only |= {id(y) for x in walk(root) if x.kind == "compare" and all(o in ("=", "<>") for o, _ in x.rest) for y in (x.first, *(r for _, r in x.rest))}
        for e in _parts_first(root):
            if id(e) in known:
                continue
            if e.kind == "pattern":
                frame, known[id(e)] = _tested(frame, e)
            elif e.kind == "pattern_comprehension":
                frame, known[id(e)] = _collected(frame, e)
            elif e.kind in ("comprehension", "quantifier", "reduce"):
                frame, ends = _of_items(frame, e, known)
                known |= ends
            elif _ends_asked(e) and len(e.args) == 1 and id(e) not in ids_only:
                fields = _asked(root, e)
                key = e.text, fields
                if key not in made:
                    frame, made[key] = _looked_up(frame, e, fields, known)
                if made[key] is not None:
                    known[id(e)] = made[key]
    return frame, known


def _parts_first(e: N):
    """An expression's nodes, each after those inside it; what is inside patterns has rows of its own."""
    if e.kind not in ("pattern", "pattern_comprehension"):
        for c in e.children():
            yield from _parts_first(c)
    yield e


def _asked(root: N, call: N) -> frozenset | None:
    """The properties that are asked of the items of a list, if it is the source of an expression that shows all uses; None: any."""
    for x in walk(root):
        if x.kind in ("comprehension", "quantifier", "reduce") and x.source is call:
            uses = [y for part in ("where", "body") if getattr(x, part, None) is not None for y in walk(getattr(x, part))]
            props = [y for y in uses if y.kind == "prop" and y.base.kind == "var" and y.base.name == x.var]
            others = [y for y in uses if y.kind == "call" and y.name in ("id", "elementid", "labels", "type") and y.args and y.args[0].kind == "var" and y.args[0].name == x.var]
            if sum(y.kind == "var" and y.name == x.var for y in uses) == len(props) + len(others) and getattr(x, "body", None) is not None:
                return frozenset(y.key for y in props)
    return None


def _looked_up(frame: Frame, e: N, fields: frozenset | None, known: dict) -> tuple[Frame, Val | None]:
    """startNode, endNode, nodes and relationships with labels and properties; None where the argument is no value of the rows."""
    try:
        v = frame.compiler(known)(e.args[0])
    except InvalidQuery:  # a variable of an enclosing expression
        return frame, None
    if e.name in ("startnode", "endnode"):
        if v.t.kind != "rel":
            return frame, None
        known_parts(v)
        side = "src" if e.name == "startnode" else "dst"
        node, scan = scan_nodes(frame, None, ends_of(v.elem.tables, side) if v.elem is not None else None)
        end = v.elem.at(side) if v.elem is not None else v.column()[side]
        return replace(frame, df=frame.rows().join(scan, end == node.at("id"), "left")), Val(elem_type(node), elem=node)
    if v.t.kind != "path" or v.path is not None and not any(isinstance(r, tuple) for r in v.path.rels):
        return frame, None
    tables = v.path.tables if v.path is not None else None
    nodes = e.name == "nodes"
    ids = path_ids(v.path)[0 if nodes else 1] if v.path is not None else v.column()["nodes" if nodes else "rels"]
    if nodes:
        elem, scan = scan_nodes(frame, None, ends_of(tables, "src", "dst") if v.path is not None and _longer(v.path) else None)
    else:
        elem, scan, _ = scan_rels(frame, N("rel", types=None), "out")
        scan = scan.select(*elem.names())
        if tables is not None:
            parts = union_tables([t.df for t in tables])
            elem, scan = _named("rel", elem.prefix, parts, tables)
    if fields is not None:
        elem = replace(elem, props={k: t for k, t in elem.props.items() if k in fields})
    return _lists_of(frame, ids, elem, scan)


def _lists_of(frame: Frame, ids: Column, elem: Elem, scan: DataFrame) -> tuple[Frame, Val]:
    """The scan's elements in the place of each list of ids."""
    name, one, at, item = (frame.fresh(k) for k in ("ids", "one", "at", "items"))
    df = frame.rows().withColumn(name, ids)
    value = Val(elem_type(elem), elem=elem)
    # each list of ids once, whatever the number of rows that have it
    parts = df.select(name).where(F.col(name).isNotNull()).distinct().select(F.col(name).alias(f"{name}_"), F.posexplode(name).alias(at, one))
    joined = parts.join(scan, F.col(one) == elem.at("id"), "left").select(f"{name}_", F.struct(F.col(at).alias("at"), value.column().alias("x")).alias(item))
    lists = joined.groupBy(f"{name}_").agg(F.transform(F.array_sort(F.collect_list(item), lambda a, b: a["at"] - b["at"]), lambda r: r["x"]).alias(item))
    df = df.join(lists, F.col(name) == F.col(f"{name}_"), "left").drop(f"{name}_")
    t = list_of(value.t)
    return replace(frame, df=df), Val(t, F.when(F.col(name).isNotNull(), F.coalesce(F.col(item), F.array().cast(sql(t)))))


def _of_items(frame: Frame, e: N, known: dict) -> tuple[Frame, dict]:
    """The ends of a list expression's own relationships: a map of their nodes in each row, looked up inside the expression."""
    inner = [getattr(e, part) for part in ("where", "body") if getattr(e, part, None) is not None]
    calls = [c for x in inner for c in walk(x) if c.kind == "call" and c.name in ("startnode", "endnode") and len(c.args) == 1 and c.args[0].kind == "var" and c.args[0].name == e.var and id(c) not in known]
    if not calls:
        return frame, {}
    try:
        v = frame.compiler(known)(e.source)
    except InvalidQuery:
        return frame, {}
    if v.t.kind != "list" or v.t.elem.kind != "rel" or v.t.elem.spark == "bare":
        return frame, {}
    rels, name = v.column(), frame.fresh("ends")
    node, scan = scan_nodes(frame, None)
    ids = F.array_sort(F.array_distinct(F.concat(F.transform(rels, lambda r: r["src"]), F.transform(rels, lambda r: r["dst"]))))
    frame, found = _lists_of(frame, ids, node, scan)
    frame = replace(frame, df=frame.rows().withColumn(name, F.map_from_entries(F.transform(found.column(), lambda n: F.struct(n["id"].alias("key"), n.alias("value"))))))
    end = lambda c: lambda compiler: Val(found.t.elem, F.try_element_at(F.col(name), compiler(c.args[0]).column()["src" if c.name == "startnode" else "dst"]))
    return frame, {id(c): end(c) for c in calls}


def _longer(path: Path) -> bool:
    """Whether every node of the path is the end of one of its relationships: not if it can have none."""
    return any(not isinstance(r, tuple) or r[1] > 0 for r in path.rels)


def _tested(frame: Frame, e: N) -> tuple[Frame, Val]:
    """A pattern predicate inside an expression, as a flag of each row."""
    _check_bound(frame, e)
    flag = frame.fresh("flag")
    sub, on, deferred = apart(frame, [e.chain])
    if deferred:  # values of the row take part: the rows that match, by number
        frame, ordinal = with_numbers(frame)
        sub, on, deferred = apart(frame, [e.chain])
        for t in deferred:
            on = on & t
        hits = frame.df.join(sub.df, on, "left_semi").select(F.col(ordinal).alias(f"{flag}_"), F.lit(True).alias(flag))
        frame = replace(frame, df=frame.df.join(hits, F.col(ordinal) == F.col(f"{flag}_"), "left"))
    else:
        shared = [n for n in pattern_names([e.chain]) if n in frame.scope]
        keys = sub.df.select(*[c for n in shared for c in [f"{sub.scope[n].elem.prefix}__id"]]).distinct().withColumn(flag, F.lit(True))
        frame = replace(frame, df=frame.rows().join(keys, on, "left"))
    return frame, Val(T("bool"), F.coalesce(F.col(flag), F.lit(False)))


def _collected(frame: Frame, e: N) -> tuple[Frame, Val]:
    """A pattern comprehension: the pattern on its own, grouped by the ids it shares with the rows.

    Where other values of the rows take part, it is joined to the numbered rows and grouped by the numbers.
    """
    asked = free_names(e.where) | free_names(e.body)
    sub, on, deferred = apart(frame, [e.chain], used=asked)
    shared = [n for n in pattern_names([e.chain]) if n in frame.scope and frame.scope[n].t.kind in ("node", "rel")]
    out = frame.fresh("list")
    collected = lambda v: F.transform(F.collect_list(F.struct(v.column().alias("x")).alias("_row")), lambda r: r["x"]).alias(out)
    if deferred or asked & set(frame.scope) - set(sub.scope):
        frame, ordinal = with_numbers(frame)
        sub, on, deferred = apart(frame, [e.chain], used=asked)
        for t in deferred:
            on = on & t
        rows = replace(frame, df=frame.df.join(sub.df, on), scope={**frame.scope, **{n: v for n, v in sub.scope.items() if n not in frame.scope}})
        rows = filtered(rows, e.where)
        rows, known = prepared(rows, [e.body])
        v = rows.compiler(known)(e.body)
        lists = rows.df.groupBy(F.col(ordinal).alias(f"{out}_")).agg(collected(v))
        frame = replace(frame, df=frame.df.join(lists, F.col(ordinal) == F.col(f"{out}_"), "left"))
    else:
        sub = filtered(sub, e.where)
        sub, known = prepared(sub, [e.body])
        v = sub.compiler(known)(e.body)
        ids = [f"{sub.scope[n].elem.prefix}__id" for n in shared]
        grouped = sub.df.groupBy(*ids).agg(collected(v))
        frame = replace(frame, df=frame.rows().join(grouped, on, "left"))
    t = list_of(v.t)
    return frame, Val(t, F.coalesce(F.col(out), F.array().cast(sql(t))))
