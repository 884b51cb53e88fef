"""Updating clauses as DataFrame merges: each gives a new Graph version; the old one stays as it is."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import values as V
from orrery.graph import EdgeTable, Graph, NodeTable, column_of, common_type, key_of
from orrery.plans import ast as A
from orrery.plans.compiler import Compiler, CypherError, Entity, Scalar, replace_compiler
from orrery.storage import cut

UPDATES = (A.Create, A.Merge, A.Set, A.Remove, A.Delete, A.Foreach)


@dataclass
class WriteStats:
    nodes_created: int = 0
    relationships_created: int = 0
    properties_set: int = 0
    nodes_deleted: int = 0
    relationships_deleted: int = 0

    def as_dict(self) -> dict[str, int]:
        return asdict(self)


def numbered(df: DataFrame, name: str = "row") -> tuple[DataFrame, int]:
    """df, written out, with rows numbered 0, 1, ... in `name`, and how many there are.

    A row's number is its place in its partition plus the rows of the partitions before: no global sort, and the
    only single-partition step is over one row for each partition.
    """
    spot = cut(df.withColumn("_nr_spot", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_nr_spot", 33)
    sizes = cut(spot.groupBy(part.alias("_nr_part")).agg(F.count(F.lit(1)).alias("_nr_n")), "numbered")
    first = sizes.select("_nr_part", F.coalesce(F.sum("_nr_n").over(W.orderBy("_nr_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_nr_first"))
    out = spot.withColumn("_nr_part", part).join(first, "_nr_part").withColumn(name, F.col("_nr_first") + F.col("_nr_spot").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_nr_spot", "_nr_part", "_nr_first"), int(sizes.select(F.coalesce(F.sum("_nr_n"), F.lit(0))).first()[0])


def next_id(tables) -> int:
    out = None
    for t in tables:
        top = t.df.select(F.max("id")).first()[0]
        out = top if out is None or (top is not None and top > out) else out
    return 1 if out is None else int(out) + 1


MANY_PARTS = 16  # appended parts after which a table is written anew as one


def appended(table, new: DataFrame) -> dict:
    """df and parts of the table with new rows, which alone are written; a column of two types gets their common one."""
    new = cut(new, "table")
    if table is None:
        return {"df": new, "parts": 1}
    old = table.df
    a, b = {f.name: f.dataType for f in old.schema.fields}, {f.name: f.dataType for f in new.schema.fields}
    kinds = {k: common_type(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
    fit = lambda df, have: df.select(*[(F.col(f"`{k}`").cast(t) if k in have else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])
    both = fit(old, a).union(fit(new, b))
    return {"df": both, "parts": table.parts + 1} if table.parts < MANY_PARTS else {"df": cut(both, "table"), "parts": 1}


def add_nodes(g: Graph, labels: frozenset, rows: DataFrame) -> Graph:
    old = next((t for t in g.nodes if t.labels == labels), None)
    table = NodeTable(labels, **appended(old, rows))
    return g.with_tables(nodes=tuple(table if t is old else t for t in g.nodes) if old else (*g.nodes, table))


def add_edges(g: Graph, kind: str, rows: DataFrame) -> Graph:
    old = next((t for t in g.edges if t.type == kind), None)
    table = EdgeTable(kind, **appended(old, rows))
    return g.with_tables(edges=tuple(table if t is old else t for t in g.edges) if old else (*g.edges, table))


class Writer:
    """Applies updating clauses to a compiler's bindings and graph."""

    def __init__(self, c: Compiler, stats: WriteStats):
        self.c, self.stats = c, stats

    @property
    def graph(self) -> Graph:
        return self.c.graph()

    @graph.setter
    def graph(self, g: Graph) -> None:
        self.c.graphs[self.c.main] = g

    def settle(self) -> None:
        """The bindings, written out: from here on they don't change with the graph."""
        cols = [f"`{x}`" for x in dict.fromkeys(self.c.visible())]
        self.c.df = cut(self.c.df.select(*cols) if cols else self.c.df.select(F.lit(0).alias(".")), "bindings")

    def apply(self, clause: A.Node) -> None:
        self.settle()
        if isinstance(clause, A.Create):
            self.create(clause.paths)
        elif isinstance(clause, A.Merge):
            self.merge(clause)
        elif isinstance(clause, A.Set):
            self.set_items(clause.items)
        elif isinstance(clause, A.Remove):
            self.remove(clause)
        elif isinstance(clause, A.Delete):
            self.delete(clause)
        elif isinstance(clause, A.Foreach):
            self.foreach(clause)
        self.c.empty = False
        self.c.log.append(type(clause).__name__)

    # Values of a pattern's property map

    def values(self, p) -> dict[str, V.E]:
        if isinstance(p.props, A.Param):
            pairs = {k: V.lit(v) for k, v in (self.c.param(p.props.name) or {}).items()}
        else:
            pairs = {k: V.from_json_text(self.c.expr(x)) for k, x in (p.props.items if p.props else ())}
        return {k: V.E(V.text(e), V.STRING) if e.kind in ("list", "map", "node", "rel") else e for k, e in pairs.items()}

    def bound(self, kind: str, values: dict[str, V.E], fixed: dict[str, Column]) -> Entity:
        """A new entity of the bindings with these values."""
        kinds = {k: T._parse_datatype_string(V.sql_name(e.t)) for k, e in values.items() if e.kind != "null"}
        e = Entity(kind, self.c.fresh("n" if kind == "node" else "r"), kinds, self.graph.name)
        cols = {f"{e.prefix}.{k}": v for k, v in fixed.items()} | {f"{e.prefix}.p.{k}": values[k].col.cast(t) for k, t in kinds.items()}
        self.c.df = self.c.df.withColumns(cols)
        return e

    def rows_of(self, e: Entity) -> DataFrame:
        ends = [] if e.kind == "node" else [e.col("src").alias("src"), e.col("dst").alias("dst")]
        return self.c.df.select(e.id.alias("id"), *ends, *[e.prop(k).alias(column_of(k)) for k in e.props])

    # CREATE

    def create(self, paths: tuple) -> None:
        c = self.c
        paths = [c.named(p) for p in paths]
        c.df, n = numbered(c.df, ".row")
        if not n:
            pass
        node_id, edge_id, row = next_id(self.graph.nodes), next_id(self.graph.edges), F.col("`.row`")
        new_nodes, new_edges = [], []
        for p in paths:
            for x in p.elems[::2]:
                if x.var in c.scope:
                    continue
                labels = F.array(*[F.lit(k) for k in sorted(x.labels)]).cast("array<string>")
                c.scope[x.var] = e = self.bound("node", self.values(x), {"id": (row + node_id).cast("long"), "labels": labels})
                new_nodes.append((frozenset(x.labels), e))
                node_id += n
            for i, r in enumerate(p.elems[1::2]):
                a, b = (c.entity(p.elems[2 * i + k].var).id for k in (0, 2))
                if r.direction == "in":
                    a, b = b, a
                kind = r.types[0] if r.types else "RELATED"
                c.scope[r.var] = e = self.bound("rel", self.values(r), {"id": (row + edge_id).cast("long"), "src": a, "dst": b, "type": F.lit(kind)})
                new_edges.append((kind, e))
                edge_id += n
        self.settle()
        if not n:
            return
        for labels, e in new_nodes:
            self.graph = add_nodes(self.graph, labels, self.rows_of(e))
            self.stats.nodes_created += n
            self.stats.properties_set += n * len(e.props)
        for kind, e in new_edges:
            self.graph = add_edges(self.graph, kind, self.rows_of(e))
            self.stats.relationships_created += n
            self.stats.properties_set += n * len(e.props)

    # MERGE: element by element, nodes first

    def merge(self, m: A.Merge) -> None:
        c, made = self.c, F.lit(False)
        for p in (c.named(p) for p in m.paths):
            for x in p.elems[::2]:
                if x.var not in c.scope:
                    made = made | self.merge_node(x)
            for i, r in enumerate(p.elems[1::2]):
                made = made | self.merge_edge(p.elems[2 * i], r, p.elems[2 * i + 2])
        if m.on_create or m.on_match:
            c.df = c.df.withColumn(".made", made)
            c.df = cut(c.df, "bindings")
            self.set_items(m.on_create, F.col("`.made`"))
            self.set_items(m.on_match, ~F.col("`.made`"))
        self.settle()

    def keys(self, values: dict[str, V.E]) -> dict[str, str]:
        names = {k: self.c.fresh(".key") for k in values}
        self.c.df = self.c.df.withColumns({names[k]: e.col.cast("string") if e.kind == "null" else e.col for k, e in values.items()}) if values else self.c.df
        return names

    def fit(self, e: Entity, values: dict[str, V.E], names: dict[str, str]) -> Column:
        cond = F.lit(True)
        for k, v in values.items():
            own, key = self.c.prop_of(e, k), V.E(F.col(f"`{names[k]}`"), v.t)
            if own.kind == "null":
                same = key.col.isNull()
            elif own.kind == key.kind or {own.kind, key.kind} <= {"int", "float"}:
                same = own.col.eqNullSafe(key.col)  # an equi join
            else:
                same = own.col.isNull() & key.col.isNull() | F.coalesce(V.compare("=", own, key).col, F.lit(False))
            cond = cond & same
        return cond

    def merge_node(self, x: A.NodePat) -> Column:
        c, values = self.c, self.values(x)
        names = self.keys(values)
        wanted = cut(c.df.select(*[F.col(f"`{n}`") for n in names.values()] or [F.lit(0).alias(".")]).distinct(), "merge")
        e, scan = c.scan(A.NodePat(x.var, x.labels, None), self.graph)
        missing, n = numbered(wanted.join(scan, self.fit(e, values, names), "left_anti"))
        base = next_id(self.graph.nodes)
        if n:
            kinds = {k: v for k, v in values.items() if v.kind != "null"}
            rows = missing.select((F.col("row") + base).alias("id"), *[F.col(f"`{names[k]}`").cast(V.sql_name(v.t)).alias(column_of(k)) for k, v in kinds.items()])
            self.graph = add_nodes(self.graph, frozenset(x.labels), rows)
            self.stats.nodes_created += n
            self.stats.properties_set += n * len(kinds)
        e, scan = c.scan(A.NodePat(x.var, x.labels, None), self.graph)
        c.df = c.df.join(scan, self.fit(e, values, names))
        c.df = cut(c.df.drop(*names.values()), "bindings")
        c.scope[x.var] = e
        return e.id >= base

    def merge_edge(self, a: A.NodePat, r: A.RelPat, b: A.NodePat) -> Column:
        c, values = self.c, self.values(r)
        src, dst = c.entity(a.var).id, c.entity(b.var).id
        if r.direction == "in":
            src, dst = dst, src
        names = self.keys(values)
        s, d = c.fresh(".src"), c.fresh(".dst")
        c.df = c.df.withColumns({s: src, d: dst})
        kind = r.types[0] if r.types else "RELATED"
        wanted = cut(c.df.select(F.col(f"`{s}`"), F.col(f"`{d}`"), *[F.col(f"`{n}`") for n in names.values()]).distinct(), "merge")

        def found() -> tuple[Entity, DataFrame, Column]:
            e, edges = c.edges(A.RelPat(r.var, (kind,), None, r.direction if r.direction == "both" else "out"), self.graph, True)
            on = (F.col(f"`{e.prefix}.from`") == F.col(f"`{s}`")) & (F.col(f"`{e.prefix}.to`") == F.col(f"`{d}`"))
            return e, edges, on & self.fit(e, values, names)

        e, edges, on = found()
        missing, n = numbered(wanted.join(edges, on, "left_anti"))
        base = next_id(self.graph.edges)
        if n:
            kinds = {k: v for k, v in values.items() if v.kind != "null"}
            rows = missing.select((F.col("row") + base).alias("id"), F.col(f"`{s}`").alias("src"), F.col(f"`{d}`").alias("dst"), *[F.col(f"`{names[k]}`").cast(V.sql_name(v.t)).alias(column_of(k)) for k, v in kinds.items()])
            self.graph = add_edges(self.graph, kind, rows)
            self.stats.relationships_created += n
            self.stats.properties_set += n * len(kinds)
        e, edges, on = found()
        c.df = cut(c.df.join(edges, on).drop(*names.values(), s, d, f"{e.prefix}.from", f"{e.prefix}.to"), "bindings")
        c.scope[r.var] = e
        return e.id >= base

    # SET and REMOVE

    def set_items(self, items: tuple, when: Column | None = None) -> None:
        for x in items:
            e = self.c.entity(x.var)
            if isinstance(x, A.SetLabels):
                self.move(e, set(x.labels), set(), when)
            elif isinstance(x, A.SetProp):
                self.set_prop(e, x.key, self.c.expr(x.value), when)
            else:
                value = self.c.expr(x.value)
                if value.fields is None:
                    raise CypherError("SET needs a map here")
                for k, v in value.fields.items():
                    self.set_prop(self.c.entity(x.var), k, v, when)
                for k in set(e.props) - set(value.fields) if x.replace else ():
                    self.set_prop(self.c.entity(x.var), k, V.lit(None), when)

    def set_prop(self, e: Entity, key: str, value: V.E, when: Column | None = None) -> None:
        c, column = self.c, column_of(key)
        value = V.from_json_text(value)
        value = V.E(V.text(value), V.STRING) if value.kind in ("list", "map", "node", "rel") else value
        kind = T._parse_datatype_string(V.sql_name(value.t)) if value.kind != "null" else T.NullType()
        rows = c.df.filter(e.id.isNotNull())
        rows = rows.filter(when) if when is not None else rows
        new = cut(rows.select(e.id.alias("id"), (value.col if value.kind != "null" else F.lit(None).cast("string")).alias(".new")).groupBy("id").agg(F.max("`.new`").alias(".new")), "set")
        self.stats.properties_set += new.count()
        self.update(e, lambda df, have: self.overwrite(df, have, new, column, kind))
        old = e.props.get(key, T.NullType())
        both = common_type(old, kind) if key in e.props else kind
        if not isinstance(both, T.NullType):
            changed = F.col("`.new`").cast(both)
            seen = e.prop(key).cast(both) if key in e.props else F.lit(None).cast(both)
            got = new.withColumnRenamed("id", ".id").withColumn(".hit", F.lit(True))
            name = f"{e.prefix}.p.{key}"
            df = c.df.join(got, e.id == F.col("`.id`"), "left").withColumn(name, F.when(F.col("`.hit`"), changed).otherwise(seen)).drop(".id", ".new", ".hit")
            c.df = cut(df, "bindings")
            e.props[key] = both

    @staticmethod
    def overwrite(df: DataFrame, have: dict, new: DataFrame, column: str, kind: T.DataType) -> DataFrame:
        both = common_type(have[column], kind) if column in have else kind
        if isinstance(both, T.NullType):
            return df
        got = new.select(F.col("id").alias(".id"), F.col("`.new`").cast(both).alias(".new"), F.lit(True).alias(".hit"))
        old = F.col(f"`{column}`").cast(both) if column in have else F.lit(None).cast(both)
        return df.join(got, F.col("id") == F.col("`.id`"), "left").withColumn(column, F.when(F.col("`.hit`"), F.col("`.new`")).otherwise(old)).drop(".id", ".new", ".hit")

    def update(self, e: Entity, change) -> None:
        """Rewrite those tables that bound entities come from."""
        if e.kind == "node":
            hit = {frozenset(r[0]) for r in self.c.df.filter(e.id.isNotNull()).select(e.col("labels").alias("l")).distinct().collect()}
            self.graph = self.graph.with_tables(nodes=tuple(replace(t, df=cut(change(t.df, t.props), "table"), parts=1) if t.labels in hit else t for t in self.graph.nodes))
        else:
            hit = {r[0] for r in self.c.df.filter(e.id.isNotNull()).select(e.col("type").alias("t")).distinct().collect()}
            self.graph = self.graph.with_tables(edges=tuple(replace(t, df=cut(change(t.df, t.props), "table"), parts=1) if t.type in hit else t for t in self.graph.edges))

    def move(self, e: Entity, more: set, less: set, when: Column | None = None) -> None:
        """Nodes with labels added or taken away go to the table of their new label set."""
        if e.kind != "node":
            raise CypherError("only nodes have labels")
        rows = self.c.df.filter(e.id.isNotNull())
        rows = rows.filter(when) if when is not None else rows
        ids = cut(rows.select(e.id.alias("id"), e.col("labels").alias("l")).distinct(), "move")
        for (old,) in ids.select("l").distinct().collect():
            labels = (frozenset(old) | more) - less
            if labels == frozenset(old):
                continue
            table = next(t for t in self.graph.nodes if t.labels == frozenset(old))
            moved = cut(table.df.join(ids, "id", "left_semi"), "move")
            rest = replace(table, df=cut(table.df.join(ids.select("id"), "id", "left_anti"), "table"), parts=1)
            self.graph = add_nodes(self.graph.with_tables(nodes=tuple(rest if t is table else t for t in self.graph.nodes)), labels, moved)
        got = ids.select(F.col("id").alias(".id"))
        new = F.array_except(F.array_sort(F.array_union(e.col("labels"), F.array(*map(F.lit, sorted(more))).cast("array<string>"))), F.array(*map(F.lit, sorted(less))).cast("array<string>"))
        df = self.c.df.join(got.distinct(), e.id == F.col("`.id`"), "left").withColumn(f"{e.prefix}.labels", F.when(F.col("`.id`").isNotNull(), new).otherwise(e.col("labels"))).drop(".id")
        self.c.df = cut(df, "bindings")

    def remove(self, r: A.Remove) -> None:
        for x in r.items:
            target = x.base if isinstance(x, A.Prop) else x.x
            if not isinstance(target, A.Var):
                raise CypherError("REMOVE needs a variable")
            e = self.c.entity(target.name)
            if isinstance(x, A.HasLabel):
                self.move(e, set(), set(x.labels))
            elif x.key in e.props:
                self.set_prop(e, x.key, V.E(F.lit(None).cast(e.props[x.key]), V.type_of(e.props[x.key])))

    # DELETE

    def delete(self, d: A.Delete) -> None:
        node_ids, edge_ids = [], []
        for x in d.exprs:
            if not isinstance(x, A.Var):
                raise CypherError("DELETE needs variables")
            v = self.c.lookup(x.name)
            if not isinstance(v, Entity):
                raise CypherError(f"cannot delete {x.name}")
            (node_ids if v.kind == "node" else edge_ids).append(self.c.df.filter(v.id.isNotNull()).select(v.id.alias("id")))
        g = self.graph

        def union(parts: list[DataFrame]) -> DataFrame | None:
            out = None
            for p in parts:
                out = p if out is None else out.union(p)
            return cut(out.distinct(), "delete") if out is not None else None

        nodes, edges = union(node_ids), union(edge_ids)
        new_edges = []
        for t in g.edges:
            df = t.df
            if edges is not None:
                df = df.join(edges, "id", "left_anti")
            if nodes is not None:
                src, dst = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
                if d.detach:
                    df = df.join(src, "src", "left_anti").join(dst, "dst", "left_anti")
                elif not df.join(src, "src", "left_semi").isEmpty() or not df.join(dst, "dst", "left_semi").isEmpty():
                    raise CypherError("Cannot delete node - it still has relationships")
            new_edges.append(self.without(t, df, "relationships_deleted") if df is not t.df else t)
        new_nodes = []
        for t in g.nodes:
            new_nodes.append(self.without(t, t.df.join(nodes, "id", "left_anti"), "nodes_deleted") if nodes is not None else t)
        self.graph = g.with_tables(tuple(new_nodes), tuple(new_edges))

    def without(self, t, left: DataFrame, stat: str):
        """The table with only the rows of `left`; it is rewritten only if it loses some."""
        gone = t.df.count() - left.count()
        if not gone:
            return t
        setattr(self.stats, stat, getattr(self.stats, stat) + gone)
        return replace(t, df=cut(left.select(*t.df.columns), "table"), parts=1)

    # FOREACH

    def foreach(self, f: A.Foreach) -> None:
        c = self.c
        src = c.source(f.source)
        inner = replace_compiler(c, c.scope)
        name = inner.fresh("each")
        inner.graphs, inner.empty = c.graphs, False
        inner.df = c.df.withColumn(name, F.explode(src.col))
        inner.scope[f.var] = Scalar(name, src.elem)
        w = Writer(inner, self.stats)
        for u in f.updates:
            w.apply(u)


__all__ = ["UPDATES", "WriteStats", "Writer", "add_edges", "add_nodes", "key_of", "next_id", "numbered"]
