"""Updating clauses: each gives a new version of the graph's tables.

Rows that an update reads are first written to the shared folder, so that an
update is computed once and never sees its own effect.  A query's changes
become visible with the graph that it returns; a failing query changes nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.errors import InvalidQuery, QueryRuntimeError, TypeMismatch, Unsupported
from graphspark.operators.pattern import Frame, Match, check_patterns, free_names, prepared, with_numbers
from graphspark.plans.durable import persisted
from graphspark.plans.expr import Compiler
from graphspark.plans.parser import N, walk
from graphspark.plans.types import Elem, Path, T, Val, coerce, elem_type, of_spark, sql, unify
from graphspark.sources.graph import KEY_BITS, NodeTable, PropertyGraph, RelTable, union_tables


class Changes:
    """The graph as the query's updates leave it so far."""

    def __init__(self, graph: PropertyGraph):
        self.graph, self.dirty, self.gone = graph, False, []

    def commit(self) -> PropertyGraph:
        for ids in self.gone:
            left = self.graph.all_rels()
            if not left.join(ids, left["src"] == ids["gone"], "left_semi").union(left.join(ids, left["dst"] == ids["gone"], "left_semi")).isEmpty():
                raise QueryRuntimeError("DeleteConnectedNode: a deleted node has relationships")
        return self.graph

    def apply(self, frame: Frame, c: N) -> Frame:
        self.dirty = True
        return getattr(self, f"_{c.kind}")(frame, c)

    # -- CREATE
    def _create(self, frame: Frame, c: N, on: N | None = None) -> Frame:
        frame, ordinal = with_numbers(frame)
        for p in c.parts:
            frame = self._create_part(frame, p, ordinal)
        return frame

    def _create_part(self, frame: Frame, p: N, ordinal: str) -> Frame:
        df, scope, elems, new_nodes, new_rels = frame.rows(), dict(frame.scope), [], [], []
        compiler = frame.compiler()
        fresh = [n for n in p.nodes if n.var is None or n.var not in scope]
        slots = len({n.var or id(n) for n in fresh}) + len(p.rels)
        first, slot = self.graph.next_id, 0
        place = lambda k: F.lit(first + k) + F.col(ordinal) * slots
        for n in p.nodes:
            if n.var is not None and n.var in scope:
                v = scope[n.var]
                if v.elem is None or v.elem.kind != "node":
                    raise InvalidQuery(f"VariableTypeConflict {n.var}")
                if len(p.nodes) == 1 or n.label is not None or n.props is not None:
                    raise InvalidQuery(f"VariableAlreadyBound {n.var}")
                df = df.withColumn(f"{v.elem.prefix}__id", F.coalesce(v.elem.at("id"), F.raise_error(F.lit("[RuntimeError] a relationship needs both its nodes"))))
                elems.append(v.elem)
                continue
            labels = list(dict.fromkeys(_plain_labels(n.label)))
            elem, cols = self._element(frame, compiler, "node", n.props, {"id": place(slot), "labels": F.array(*map(F.lit, labels)).cast("array<string>")})
            slot += 1
            df = df.withColumns(cols)
            elems.append(elem)
            new_nodes.append((elem, frozenset(labels)))
            if n.var:
                scope[n.var] = Val(elem_type(elem), elem=elem)
        rels = []
        for r, a, b in zip(p.rels, elems, elems[1:]):
            if r.length is not None:
                raise InvalidQuery("CreatingVarLength")
            if r.direction == "both":
                raise InvalidQuery("RequiresDirectedRelationship")
            if r.types is None or r.types.kind != "label":
                raise InvalidQuery("NoSingleRelationshipType")
            if r.var and r.var in scope:
                raise InvalidQuery(f"VariableAlreadyBound {r.var}")
            src, dst = (a, b) if r.direction == "out" else (b, a)
            elem, cols = self._element(frame, compiler, "rel", r.props, {"id": place(slot), "src": src.at("id"), "dst": dst.at("id"), "type": F.lit(r.types.name)})
            slot += 1
            df = df.withColumns(cols)
            rels.append(elem)
            new_rels.append((elem, r.types.name))
            if r.var:
                scope[r.var] = Val(elem_type(elem), elem=elem)
        if p.path:
            scope[p.path] = Val(T("path"), path=Path(elems, rels))
        df = persisted(df, "created")
        node_tables = [NodeTable(_table(df, e, ("id", "labels")), labels) for e, labels in new_nodes]
        rel_tables = [RelTable(_table(df, e, ("id", "src", "dst", "type")), kind) for e, kind in new_rels]
        self.graph = replace(self.graph, nodes=(*self.graph.nodes, *node_tables), rels=(*self.graph.rels, *rel_tables), next_id=first + slots * df.count())
        return replace(frame, df=df, scope=scope, graph=self.graph)

    def _element(self, frame: Frame, compiler, kind: str, props: N | None, parts: dict) -> tuple[Elem, dict]:
        prefix, values = frame.fresh("c"), {}
        if props is not None:
            v = compiler(props)
            if v.t.kind == "map":
                values = {k: compiler.prop(v, k) for k, t in v.t.fields if t.kind != "null"}
            elif v.t.kind != "null":
                raise TypeMismatch("properties are a map")
        for v in values.values():
            storable(v.t)
        elem = Elem(kind, prefix, {k: v.t for k, v in values.items()})
        return elem, {f"{prefix}__{k}": c for k, c in parts.items()} | {f"{prefix}__p_{k}": v.column() for k, v in values.items()}

    # -- MERGE
    def _merge(self, frame: Frame, c: N) -> Frame:
        part = c.part
        if not part.rels and part.nodes[0].var in frame.scope:
            raise InvalidQuery(f"VariableAlreadyBound {part.nodes[0].var}")
        for x in [*part.nodes, *part.rels]:
            if x.props is not None and x.props.kind == "map":
                for k, e in x.props.pairs:
                    v = frame.compiler()(e)
                    if v.t.kind == "null":
                        raise QueryRuntimeError(f"MergeReadOwnWrites: {k} is null")
        frame, ordinal = with_numbers(frame)
        found = Match(frame, [part]).run()
        missing = replace(frame, df=frame.df.join(found.df.select(F.col(ordinal).alias("_o")).distinct(), F.col(ordinal) == F.col("_o"), "left_anti"))
        keys = [frame.compiler()(e).column() for x in [*part.nodes, *part.rels] if x.props is not None and x.props.kind == "map" for _, e in x.props.pairs]
        keys += [frame.scope[n.var].elem.at("id") for n in part.nodes if n.var in frame.scope]
        least = missing.df.groupBy(*[k.alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.min(ordinal).alias("_o"))
        firsts = persisted(missing.df.join(least, F.col(ordinal) == F.col("_o"), "left_semi"), "merge")
        fresh = N("chain", part.text, path=part.path, nodes=part.nodes, rels=[N("rel", r.text, **{**{k: v for k, v in r.__dict__.items() if k not in ("kind", "text")}, "direction": "out" if r.direction == "both" else r.direction}) for r in part.rels])
        if not firsts.isEmpty():
            made = self._create(replace(frame, df=firsts), N("create", parts=[fresh])) if _creates(part, frame) else replace(frame, df=firsts)
            if c.on_create:
                self._set(made, N("set", items=c.on_create))
        frame = replace(frame, graph=self.graph)
        out = Match(frame, [part]).run()
        if c.on_match:
            out = replace(out, df=persisted(out.df, "merged"))
            old = out.df.join(firsts.select(F.col(ordinal).alias("_o")), F.col(ordinal) == F.col("_o"), "left_anti")
            self._set(replace(out, df=old), N("set", items=c.on_match))
            out = self._refreshed(out)
        return replace(out, graph=self.graph)

    # -- SET and REMOVE
    def _set(self, frame: Frame, c: N) -> Frame:
        """Rows take effect one after the other, each with all items in order.

        Where no item reads what the clause writes, items are done one by one for all rows, the last row of an
        element wins.  Where items read what they write of the same variable, the rows of each element are folded in
        order.  Reading what is written through another variable is done only if no element goes by both.
        """
        pairs, folds = _conflicts(frame, c.items)
        if not folds and not pairs:
            for item in c.items:
                frame = self._assign(frame, item)
            return frame
        frame, ordinal = with_numbers(frame)
        names = sorted({n for pair in pairs for n in pair} | folds)
        values = {n: frame.scope[n] for n in names}
        if any(v.elem is None for v in values.values()):
            raise Unsupported("SET that reads what it writes, on elements that are not bound by a pattern")
        single = frame.df.limit(2).count() < 2
        for x, y in pairs:
            a, b = (frame.df.select(values[n].elem.at("id").alias("id")) for n in (x, y))
            if not single and values[x].elem.kind == values[y].elem.kind and not a.join(b, "id", "left_semi").isEmpty():
                raise Unsupported(f"SET in which rows depend on each other through {x} and {y}")
        if single:
            for item in c.items:
                frame = self._assign(frame, item)
            return frame
        for n in dict.fromkeys(_target(i) for i in c.items):
            own = [i for i in c.items if _target(i) == n]
            if n in folds and not frame.df.groupBy(values[n].elem.at("id").alias("id")).count().where("id is not null and count > 1").isEmpty():
                frame = self._fold(frame, ordinal, n, own)
            else:
                for item in own:
                    frame = self._assign(frame, item)
        return frame

    _remove = _set

    def _fold(self, frame: Frame, ordinal: str, var: str, items: list[N]) -> Frame:
        """Each element's rows in order: the state after an item is what the next one sees."""
        exprs = [x for i in items for x in (getattr(i, "expr", None), getattr(i, "key", None)) if isinstance(x, N)]
        if any(x.kind in ("pattern", "pattern_comprehension") for e in exprs for x in walk(e)):
            raise Unsupported("patterns in a SET that reads what it writes")
        elem, compiler = frame.scope[var].elem, frame.compiler()
        asked = sorted({n for e in exprs for n in free_names(e)} & set(frame.scope) - {var})
        held = {n: Val(frame.scope[n].t, name=frame.fresh("h")) for n in asked}
        rows = frame.df.withColumns({v.name: frame.scope[n].column() for n, v in held.items()}) if held else frame.df
        have = rows.columns
        props = {k: t for k, t in elem.props.items() if f"{elem.prefix}__p_{k}" in have}
        row = F.struct(F.col(ordinal).alias("o"), *[F.col(v.name).alias(v.name) for v in held.values()])
        state = F.struct(elem.at("id").alias("id"), *[elem.at(x).alias(x) for x in (("labels",) if elem.kind == "node" else ("src", "dst", "type"))], *[elem.at(f"p_{k}").alias(f"p_{k}") for k in sorted(props)])
        gathered = rows.where(elem.at("id").isNotNull()).groupBy(elem.at("id").alias("_id")).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("_rows"), F.first(state).alias("_state"))
        parts = ["id", "labels"] if elem.kind == "node" else ["id", "src", "dst", "type"]
        types = dict(props)

        def step(acc, r, i, found):
            """The state after one item."""
            now = F.struct(*[acc[p].alias(p) for p in parts], (F.struct(*[acc[f"p_{k}"].alias(k) for k in sorted(types)]) if types else F.expr("named_struct()")).alias("properties"))
            me = Val(T(elem.kind, fields=tuple(sorted(types.items()))), now)
            inner = Compiler({**{n: Val(v.t, r[v.name]) for n, v in held.items()}, var: me}, frame.params)
            new = {f"p_{k}": acc[f"p_{k}"] for k in types}
            labels = acc["labels"] if elem.kind == "node" else None

            def put(k, v):
                found[k] = unify(found.get(k, types.get(k, T("null"))), v.t)
                if k in types:
                    new[f"p_{k}"] = coerce(v, types[k]) if unify(types[k], v.t) == types[k] else F.lit(None).cast(sql(types[k]))

            if i.kind in ("set_labels", "remove_labels"):
                labels = (F.array_union if i.kind == "set_labels" else F.array_except)(labels, F.array(*map(F.lit, i.labels)))
            elif i.kind in ("set_prop", "remove_prop"):
                put(i.key, inner(i.expr) if i.kind == "set_prop" else Val(T("null"), F.lit(None)))
            elif i.kind == "set_index":
                key = inner(i.key)
                if key.const is None:
                    raise Unsupported("SET n[key] that reads what it writes, with a key that is not constant")
                put(key.const, inner(i.expr))
            else:
                v = inner(i.expr)
                if v.t.kind not in ("map", "node", "rel", "null"):
                    raise TypeMismatch("a map is needed")
                if v.t.kind != "null":
                    there = v.column().isNotNull()
                    old = dict(new)
                    if i.replace:
                        new.update({f"p_{k}": F.lit(None).cast(sql(t)) for k, t in types.items()})
                    for k, _ in v.t.fields:
                        put(k, inner.prop(v, k))
                    for k in new:
                        new[k] = F.when(there, new[k]).otherwise(old[k])
            return F.struct(*[(labels if p == "labels" else acc[p]).alias(p) for p in parts], *[new[f"p_{k}"].alias(f"p_{k}") for k in sorted(types)])

        while True:  # until the properties' types hold all values
            found: dict[str, T] = {}
            start = F.struct(*[F.col("_state")[p].alias(p) for p in parts], *[(coerce(Val(props[k], F.col("_state")[f"p_{k}"]), types[k]) if k in props else F.lit(None).cast(sql(types[k]))).alias(f"p_{k}") for k in sorted(types)])
            turns = F.flatten(F.transform(F.col("_rows"), lambda r: F.transform(F.array(*[F.lit(n) for n in range(len(items))]), lambda n: F.struct(r.alias("r"), n.alias("n")))))

            def turn(acc, x):
                out = None
                for n, i in enumerate(items[:-1]):
                    after = step(acc, x["r"], i, found)
                    out = F.when(x["n"] == n, after) if out is None else out.when(x["n"] == n, after)
                last = step(acc, x["r"], items[-1], found)
                return last if out is None else out.otherwise(last)

            folded = F.aggregate(turns, start, turn)
            if all(types.get(k) == t for k, t in found.items() if t.kind != "null" or k in types):
                break
            types |= {k: unify(types.get(k, T("null")), t) for k, t in found.items()}
        for t in types.values():
            storable(t)
        written = sorted({k for k in found if k in types} | ({*types} if any(i.kind == "set_map" and i.replace for i in items) else set()))
        done = persisted(gathered.select("_id", folded.alias("_new")), "folded")

        def change(t):
            df, have = t.df.join(done, t.df["id"] == done["_id"], "left"), t.props
            hit, cols = F.col("_id").isNotNull(), {}
            for k in written:
                full = unify(have.get(k, T("null")), types[k])
                old = coerce(Val(have[k], F.col(f"p_{k}")), full) if k in have else F.lit(None).cast(sql(full))
                cols[f"p_{k}"] = F.when(hit, coerce(Val(types[k], F.col("_new")[f"p_{k}"]), full)).otherwise(old)
            labels = elem.kind == "node" and any(i.kind in ("set_labels", "remove_labels") for i in items)
            if labels:
                cols["labels"] = F.when(hit, F.col("_new")["labels"]).otherwise(F.col("labels"))
            new = t.of(df.withColumns(cols).drop("_id", "_new"))
            return replace(new, labels=None) if labels else new

        self._change(elem.kind, done.select("_id"), change)
        return self._refreshed(frame)

    def _change(self, kind: str, ids: DataFrame, change) -> None:
        """Apply ``change`` to the tables that may hold the ids (column _id)."""
        tags = _tags(ids, "_id")
        tables = tuple(change(t) if t.tag in tags else t for t in (self.graph.nodes if kind == "node" else self.graph.rels))
        self.graph = replace(self.graph, **{"nodes" if kind == "node" else "rels": tables})

    def _assign(self, frame: Frame, i: N) -> Frame:
        if isinstance(getattr(i, "expr", None), N):
            check_patterns(i.expr)
        frame, found = prepared(frame, [x for x in (getattr(i, "expr", None), getattr(i, "key", None)) if isinstance(x, N)])
        if i.kind == "set_index" and frame.compiler(found)(i.key).const is None:
            return self._by_key(frame, i, found)
        frame, ordinal = with_numbers(frame)
        compiler = frame.compiler(found)
        target = compiler(N("var", i.var, name=i.var) if i.kind in ("set_labels", "remove_labels") else i.target)
        if target.t.kind == "null":
            return frame
        if target.elem is None:
            raise TypeMismatch(f"{target.t} has no properties to set")
        elem = target.elem
        if i.kind in ("set_labels", "remove_labels"):
            ids = persisted(frame.df.select(elem.at("id").alias("_id")).where("_id is not null").distinct(), "ids")
            f = F.array_union if i.kind == "set_labels" else F.array_except
            change = lambda t: replace(t.of(t.df.join(ids, t.df["id"] == ids["_id"], "left").withColumn("labels", F.when(F.col("_id").isNotNull(), f("labels", F.array(*map(F.lit, i.labels)))).otherwise(F.col("labels"))).drop("_id")), labels=None)
            self._change("node", ids, change)
            return self._refreshed(frame)
        values, clear, skip = {}, False, F.lit(False)
        if i.kind in ("set_prop", "remove_prop"):
            values[i.key] = compiler(i.expr) if i.kind == "set_prop" else Val(T("null"), F.lit(None))
        elif i.kind == "set_index":
            key = compiler(i.key)
            if key.t.kind != "str":
                raise TypeMismatch("a key is a string")
            values[key.const] = compiler(i.expr)
        else:
            v = compiler(i.expr)
            if v.t.kind == "null":
                return frame
            if v.t.kind not in ("map", "node", "rel"):
                raise TypeMismatch("a map is needed")
            values = {k: compiler.prop(v, k) for k, _ in v.t.fields}
            clear, skip = i.replace, (v.elem.at("id") if v.elem is not None else v.column()).isNull()
        for v in values.values():
            storable(v.t)
        return self._write(frame, ordinal, elem, values, clear, skip)

    def _by_key(self, frame: Frame, i: N, found: dict) -> Frame:
        """SET n[key] with keys from the rows: each key that occurs is a property of its own."""
        key = frame.compiler(found)(i.key)
        if key.t.kind != "str":
            raise TypeMismatch("a key is a string")
        name = frame.fresh("key")
        frame = replace(frame, df=persisted(frame.rows().withColumn(name, key.column()), "keys"))
        keys = [r[0] for r in frame.df.select(name).distinct().collect()]  # as many as the element gets properties
        if None in keys:
            raise TypeMismatch("a key is a string")
        for k in sorted(keys):
            self._assign(replace(frame, df=frame.df.where(F.col(name) == k)), N("set_prop", i.text, target=i.target, key=k, expr=i.expr))
        return self._refreshed(frame)

    def _write(self, frame: Frame, ordinal: str, elem: Elem, values: dict[str, Val], clear: bool, skip) -> Frame:
        """The last row of an element wins."""
        row = F.struct(*[(v.column() if v.t.kind != "null" else F.lit(None).cast("string")).alias(f"v{k}") for k, v in enumerate(values.values())], F.lit(1).alias("there"))
        last = frame.df.where(elem.at("id").isNotNull() & ~skip).select(elem.at("id").alias("_id"), row.alias("_row"), F.col(ordinal).alias("_o")).groupBy("_id").agg(F.max_by("_row", "_o").alias("_row"))
        last = persisted(last, "set")
        types = {k: v.t for k, v in values.items()}

        def change(t):
            df, have = t.df.join(last, t.df["id"] == last["_id"], "left"), t.props
            hit, cols = F.col("_id").isNotNull(), {}
            for n, (k, kind) in enumerate(types.items()):
                if kind.kind == "null" and k not in have:
                    continue
                full = unify(have.get(k, T("null")), kind)
                old = coerce(Val(have[k], F.col(f"p_{k}")), full) if k in have else F.lit(None).cast(sql(full))
                cols[f"p_{k}"] = F.when(hit, coerce(Val(kind, F.col("_row")[f"v{n}"]), full)).otherwise(old)
            if clear:
                cols |= {f"p_{k}": F.when(~hit, F.col(f"p_{k}")) for k in have if k not in types}
            return t.of(df.withColumns(cols).drop("_id", "_row"))

        self._change(elem.kind, last.select("_id"), change)
        return self._refreshed(frame)

    def _refreshed(self, frame: Frame) -> Frame:
        """The frame with the elements' columns as the graph has them now."""
        df, scope, done = frame.rows(), dict(frame.scope), {}
        for n, v in frame.scope.items():
            if v.elem is None or v.elem.gone:
                continue
            if v.elem.prefix in done:
                scope[n] = done[v.elem.prefix]
                continue
            tags = _tags(df, f"{v.elem.prefix}__id")
            tables = [t for t in (self.graph.nodes if v.elem.kind == "node" else self.graph.rels) if t.tag in tags]
            if not tables:
                continue
            new, prefix = union_tables([t.df for t in tables]), frame.fresh("f")
            elem = Elem(v.elem.kind, prefix, {f.name[2:]: of_spark(f.dataType) for f in new.schema.fields if f.name.startswith("p_")}, tuple(tables))
            new = new.toDF(*[f"{prefix}__{c}" for c in new.columns])
            df = df.join(new, v.elem.at("id") == elem.at("id"), "left")
            scope[n] = done[v.elem.prefix] = Val(elem_type(elem), elem=elem)
        return replace(frame, df=persisted(df, "refreshed") if done else df, scope=scope, graph=self.graph)

    # -- DELETE
    def _delete(self, frame: Frame, c: N) -> Frame:
        frame = replace(frame, df=persisted(frame.rows(), "rows"))
        nodes: list[DataFrame] = []
        rels: list[DataFrame] = []
        for e in c.items:
            if e.kind in ("arith", "lit", "has_label"):
                raise InvalidQuery("InvalidDelete")
            v = frame.compiler()(e)
            if v.t.kind == "null":
                continue
            if v.t.kind == "path":
                s = v.column()
                nodes.append(frame.df.select(F.explode(s["nodes"]).alias("gone")))
                rels.append(frame.df.select(F.explode(s["rels"]).alias("gone")))
            elif v.t.kind in ("node", "rel"):
                (nodes if v.t.kind == "node" else rels).append(frame.df.select((v.elem.at("id") if v.elem is not None else v.column()["id"]).alias("gone")))
            elif v.t.kind == "list" and v.t.elem.kind in ("node", "rel"):
                (nodes if v.t.elem.kind == "node" else rels).append(frame.df.select(F.explode(F.transform(v.column(), lambda x: x["id"])).alias("gone")))
            else:
                raise TypeMismatch(f"{v.t} is nothing to delete")

        def ids(frames):
            out = frames[0]
            for f in frames[1:]:
                out = out.union(f)
            return persisted(out.where("gone is not null").distinct(), "gone")

        without = lambda df, col, gone: df.join(gone, df[col] == gone["gone"], "left_anti")
        g = self.graph
        if rels:
            gone = ids(rels)
            g = replace(g, rels=tuple(t.of(without(t.df, "id", gone)) for t in g.rels))
        if nodes:
            gone = ids(nodes)
            g = replace(g, nodes=tuple(t.of(without(t.df, "id", gone)) for t in g.nodes))
            if c.detach:
                g = replace(g, rels=tuple(t.of(without(without(t.df, "src", gone), "dst", gone)) for t in g.rels))
            else:
                self.gone.append(gone)
        self.graph = g
        named = {frame.scope[e.name].elem.prefix for e in c.items if e.kind == "var" and e.name in frame.scope and frame.scope[e.name].elem is not None}
        dead = lambda v: v.elem is not None and v.elem.prefix in named
        return replace(frame, graph=g, scope={n: replace(v, elem=replace(v.elem, gone=True)) if dead(v) else v for n, v in frame.scope.items()})

    # -- FOREACH
    def _foreach(self, frame: Frame, c: N) -> Frame:
        frame = replace(frame, df=persisted(frame.rows().withColumn(frame.fresh("k"), F.lit(1)), "rows"))
        v = frame.compiler()(c.expr)
        if v.t.kind == "null":
            return frame
        if v.t.kind != "list":
            raise TypeMismatch("FOREACH takes a list")
        name = frame.fresh("u")
        place = frame.fresh("at")
        side = replace(frame, df=frame.df.select("*", F.posexplode(v.column()).alias(place, name)), seq=[*frame.seq, (place, True)], scope={**frame.scope, c.var: Val(v.t.elem, F.col(name), name=name)})
        for u in c.body:
            side = self.apply(replace(side, graph=self.graph), u)
        return self._refreshed(frame)


def _tags(df: DataFrame, col: str) -> set[int]:
    """The tags of the tables that a column of ids belongs to: a few numbers."""
    return {r[0] for r in df.select(F.shiftright(col, KEY_BITS).cast("int")).distinct().collect()}


def _target(i: N) -> str | None:
    """The variable that an item writes."""
    if i.kind in ("set_labels", "remove_labels"):
        return i.var
    t = i.target
    while t.kind == "paren":
        t = t.a
    return t.name if t.kind == "var" else None


def _conflicts(frame: Frame, items: list[N]) -> tuple[set[tuple[str, str]], set[str]]:
    """(pairs of variables one of which is written where the other is read or written too, variables read where written)."""
    writes: list[tuple[str, str]] = []  # (variable, key); "*" is any property, ":" the labels
    reads: list[tuple[str, str]] = []
    for i in items:
        var = _target(i)
        if var is None:
            continue
        key = ":" if i.kind.endswith("labels") else i.key if i.kind in ("set_prop", "remove_prop") else "*"
        writes.append((var, key))
        for e in (getattr(i, "expr", None), getattr(i, "key", None)):
            if isinstance(e, N):
                reads += _reads(e, frame.scope)
    meet = lambda a, b: a == b or "*" in (a, b) and ":" not in (a, b)
    pairs, folds = set(), set()
    for var, key in writes:
        folds |= {var for other, k in reads if other == var and meet(k, key)}
        pairs |= {(var, other) for other, k in reads if other != var and meet(k, key)}
        pairs |= {tuple(sorted((var, other))) for other, k in writes if other != var and meet(k, key)}
    return pairs, folds


def _reads(e: N, scope: dict[str, Val]) -> list[tuple[str, str]]:
    """What an expression reads of the elements in scope."""
    element = lambda x: x.kind == "var" and x.name in scope and scope[x.name].t.kind in ("node", "rel")
    if e.kind == "prop" and element(e.base):
        return [(e.base.name, e.key)]
    if e.kind == "call" and e.name in ("id", "elementid", "type") and e.args and element(e.args[0]):
        return []
    if e.kind == "has_label" and element(e.a) or e.kind == "call" and e.name == "labels" and e.args and element(e.args[0]):
        return [((e.a if e.kind == "has_label" else e.args[0]).name, ":")]
    if element(e):
        return [(e.name, "*"), (e.name, ":")]
    return [r for c in e.children() for r in _reads(c, scope)]


def storable(t: T) -> None:
    if t.kind in ("map", "node", "rel", "path") or t.kind == "list" and t.elem.kind not in ("bool", "int", "float", "str", "dyn", "null"):
        raise TypeMismatch(f"InvalidPropertyType: {t}")


def _plain_labels(e: N | None) -> list[str]:
    if e is None:
        return []
    if e.kind == "label":
        return [e.name]
    if e.kind == "label_and":
        return _plain_labels(e.a) + _plain_labels(e.b)
    raise Unsupported("label expressions in updates")


def _creates(part: N, frame: Frame) -> bool:
    return bool(part.rels) or any(n.var is None or n.var not in frame.scope for n in part.nodes)


def _table(df: DataFrame, e: Elem, parts: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{e.prefix}__{p}`").alias(p) for p in [*parts, *(f"p_{k}" for k in e.props)]])


__all__ = ["Changes", "free_names"]
