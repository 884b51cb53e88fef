"""From syntax tree to DataFrame plan.

The rows of a query are a bindings table: an entity variable is a prefix under which the table has the columns
id, labels or type, src, dst and one for each property. Catalyst prunes those that no later clause reads down to
the Parquet scan, so nothing is fetched lazily and no property costs a join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import values as V
from orrery.functions.values import AGGREGATES, FUNCTIONS, E
from orrery.graph import Graph, column_of, key_of, merged_props
from orrery.operators import expand
from orrery.plans import ast as A


class CypherError(ValueError):
    pass


@dataclass
class Entity:
    kind: str  # "node" or "rel"
    prefix: str
    props: dict  # key -> DataType
    graph: str = "main"

    def col(self, part: str) -> Column:
        return F.col(f"`{self.prefix}.{part}`")

    def prop(self, key: str) -> Column:
        return F.col(f"`{self.prefix}.p.{key}`")

    @property
    def id(self) -> Column:
        return self.col("id")

    def columns(self) -> list[str]:
        fixed = ["id", "labels"] if self.kind == "node" else ["id", "src", "dst", "type"]
        return [f"{self.prefix}.{c}" for c in fixed] + [f"{self.prefix}.p.{k}" for k in self.props]

    def type(self) -> tuple:
        inner = ("properties", ("map", tuple((k, V.type_of(t)) for k, t in self.props.items())))
        fixed = (("id", V.INT), ("labels", V.list_of(V.STRING))) if self.kind == "node" else (("id", V.INT), ("type", V.STRING), ("startNode", V.INT), ("endNode", V.INT))
        return (self.kind, (*fixed, inner))

    def properties(self) -> Column:
        if not self.props:
            return F.create_map().cast("map<string,string>")
        return F.struct(*[self.prop(k).alias(k) for k in self.props])

    def value(self) -> E:
        parts = [self.id.alias("id")]
        parts += [self.col("labels").alias("labels")] if self.kind == "node" else [self.col("type").alias("type"), self.col("src").alias("startNode"), self.col("dst").alias("endNode")]
        return E(F.when(self.id.isNotNull(), F.struct(*parts, self.properties().alias("properties"))), self.type())


@dataclass
class PathValue:
    prefix: str

    @property
    def nodes(self) -> Column:
        return F.col(f"`{self.prefix}.nodes`")

    @property
    def rels(self) -> Column:
        return F.col(f"`{self.prefix}.rels`")

    def columns(self) -> list[str]:
        return [f"{self.prefix}.nodes", f"{self.prefix}.rels"]

    def value(self) -> E:
        t = ("map", (("nodes", V.list_of(V.INT)), ("relationships", V.list_of(V.INT))))
        return E(F.when(self.nodes.isNotNull(), F.struct(self.nodes.alias("nodes"), self.rels.alias("relationships"))), t)


@dataclass
class Scalar:
    """A variable with a plain value in one column."""

    column: str
    t: tuple
    fields: dict | None = None

    def columns(self) -> list[str]:
        return [self.column]

    def value(self) -> E:
        return E(F.col(f"`{self.column}`"), self.t)


def conjuncts(x: A.Node | None) -> list[A.Node]:
    if x is None:
        return []
    return conjuncts(x.left) + conjuncts(x.right) if isinstance(x, A.Bin) and x.op == "and" else [x]


def has_aggregate(x: A.Node) -> bool:
    return any(isinstance(n, A.Call) and n.name in AGGREGATES for n in x.walk())


def is_constant(x: A.Node) -> bool:
    return not any(isinstance(n, (A.Var, A.Exists, A.PatComp)) for n in x.walk())


class Compiler:
    def __init__(self, graphs: dict[str, Graph], params: dict | None = None, main: str = "main", max_hops: int = 100):
        self.graphs, self.params, self.main, self.max_hops = graphs, params or {}, main, max_hops
        self.spark = graphs[main].spark
        self.df: DataFrame = self.spark.range(1).select(F.lit(0).alias("."))
        self.scope: dict[str, object] = {}
        self.empty = True  # no pattern or list has bound rows yet
        self.n = 0
        self.done: dict[A.Node, E] = {}  # expressions that have a column already
        self.used: set[str] = set()
        self.log: list[str] = []

    # Small things

    def fresh(self, what: str = "v") -> str:
        self.n += 1
        return f"{what}{self.n}"

    def graph(self, name: str | None = None) -> Graph:
        name = name or self.main
        if name not in self.graphs:
            raise CypherError(f"unknown graph: {name}")
        g = self.graphs[name]
        return g if g.name == name else replace(g, name=name)  # graph(x) tells the name that the session knows it by

    def visible(self) -> list[str]:
        return [c for v in self.scope.values() for c in v.columns()]

    # Queries

    def learn_uses(self, q: A.Node) -> None:
        """Variables that anything but a pattern, id() or count() mentions."""
        skip: set[int] = set()
        for n in q.walk():
            if isinstance(n, A.Call) and n.name in ("id", "count") and len(n.args) == 1 and isinstance(n.args[0], A.Var):
                skip.add(id(n.args[0]))
        for n in q.walk():
            if isinstance(n, A.Var) and id(n) not in skip:
                self.used.add(n.name)
            if isinstance(n, A.Project) and n.star:
                self.used.add("*")
            if isinstance(n, (A.SetProp, A.SetLabels, A.SetMap)):
                self.used.add(n.var)

    def read_clause(self, c: A.Node) -> DataFrame | None:
        """Run a clause that writes nothing; RETURN gives the result."""
        if isinstance(c, A.Match):
            self.match(c)
        elif isinstance(c, A.Unwind):
            self.unwind(c)
        elif isinstance(c, A.LoadCsv):
            self.load_csv(c)
        elif isinstance(c, A.Project):
            return self.project(c)
        else:
            raise CypherError(f"unsupported clause: {type(c).__name__}")
        return None

    # Patterns

    def match(self, m: A.Match) -> None:
        self.log.append(f"{'OptionalMatch' if m.optional else 'Match'} {len(m.paths)} pattern(s)" + (f" from {m.graph}" if m.graph else ""))
        if m.optional:
            self.optional(m)
            return
        self.bind(m.paths, m.graph)
        for c in conjuncts(m.where):
            self.filter(c)

    def filter(self, c: A.Node) -> None:
        negated = isinstance(c, A.Un) and c.op == "not" and isinstance(c.x, A.Exists)
        if isinstance(c, A.Exists) or negated:
            sub, keys = self.subplan((c.x if negated else c).paths, (c.x if negated else c).where)
            self.join_sub(sub.df.select(*[F.col(f"`{k}`") for k in keys] or [F.lit(0).alias(".")]).distinct(), keys, "left_anti" if negated else "left_semi")
            return
        self.df = self.df.filter(self.boolean(self.expr(c)))

    @staticmethod
    def boolean(e: E) -> Column:
        if e.kind in ("bool", "any", "null"):
            return e.col.cast("boolean")
        if e.kind in ("int", "float"):
            return e.col != 0
        return V._to_boolean(e).col

    def subplan(self, paths: tuple, where: A.Node | None, extra: A.Node | None = None) -> tuple[Compiler, list[str]]:
        """A compiler over the distinct outer values that the pattern and its conditions use, with the pattern bound."""
        names = {p.var for path in paths for p in path.elems if p.var} | {n.name for x in (*paths, where, extra) if x is not None for n in x.walk() if isinstance(n, A.Var)}
        outer = {k: v for k, v in self.scope.items() if k in names}
        keys = []
        for v in outer.values():
            keys += v.columns()
        sub = replace_compiler(self, outer)
        if keys:
            ids = [f"{v.prefix}.id" if isinstance(v, Entity) else v.columns()[0] for v in outer.values()]
            firsts = [c for c in keys if c not in ids]
            rows = self.df.groupBy(*[F.col(f"`{c}`") for c in ids]).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in firsts]) if firsts else self.df.select(*[F.col(f"`{c}`") for c in ids]).distinct()
            sub.df, sub.empty, keys = rows, False, ids
        else:
            sub.df, sub.empty = self.spark.range(1).select(F.lit(0).alias(".")), True
        sub.bind(paths, None)
        for c in conjuncts(where):
            sub.filter(c)
        return sub, keys

    def join_sub(self, sub: DataFrame, keys: list[str], how: str) -> None:
        """Join the bindings with sub on the key columns, nulls never matching (an unbound variable has no pattern)."""
        names = {k: self.fresh("k") for k in keys}
        sub = sub.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in sub.columns])
        cond = F.lit(True)
        for k, n in names.items():
            cond = cond & (F.col(f"`{k}`") == F.col(n))
        out = self.df.join(sub, cond, how)
        self.df = out.drop(*names.values()) if how in ("left", "left_outer", "inner") else out

    def optional(self, m: A.Match) -> None:
        sub, keys = self.subplan_optional(m)
        new = {k: v for k, v in sub.scope.items() if k not in self.scope}
        cols = [c for v in new.values() for c in v.columns()]
        right = sub.df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *cols])])
        if not keys and self.empty:  # OPTIONAL MATCH as the first clause
            right = right.drop(".")
        self.join_sub(right, keys, "left")
        self.scope |= new
        self.empty = False

    def subplan_optional(self, m: A.Match) -> tuple[Compiler, list[str]]:
        main = self.main
        self.main = m.graph or main
        try:
            return self.subplan(m.paths, m.where)
        finally:
            self.main = main

    def bind(self, paths: tuple, graph: str | None) -> None:
        g = self.graph(graph)
        pending = [self.named(p) for p in paths]
        while pending:
            bound = [p for p in pending if any(e.var in self.scope for e in p.elems if isinstance(e, A.NodePat))]
            path = bound[0] if bound else max(pending, key=lambda p: max(self.weight(e) for e in p.elems[::2]))
            pending.remove(path)
            self.bind_path(path, g)

    def named(self, p: A.Path) -> A.Path:
        return replace(p, elems=tuple(e if e.var else replace(e, var=f" {self.fresh()}") for e in p.elems))

    def weight(self, n: A.NodePat) -> int:
        return (4 if isinstance(n.props, A.MapLit) and n.props.items else 0) + (1 if n.labels else 0)

    def bind_path(self, path: A.Path, g: Graph) -> None:
        nodes, rels = path.elems[::2], path.elems[1::2]
        known = [i for i, n in enumerate(nodes) if n.var in self.scope]
        at = known[0] if known else max(range(len(nodes)), key=lambda i: (self.weight(nodes[i]), -i))
        self.node(nodes[at], g, self.possible(nodes[at], rels[at] if at < len(rels) else None, rels[at - 1] if at else None, g))
        pieces: dict[int, tuple] = {}
        for i in range(at, len(rels)):
            pieces[i] = self.hop(nodes[i], rels[i], nodes[i + 1], False, g, path.shortest)
        for i in range(at - 1, -1, -1):
            pieces[i] = self.hop(nodes[i + 1], rels[i], nodes[i], True, g, path.shortest)
        if path.var:
            ids = F.array(self.entity(nodes[0].var).id)
            links = F.array().cast("array<bigint>")
            for i in range(len(rels)):
                more_nodes, more_rels = pieces[i]
                ids, links = F.concat(ids, more_nodes), F.concat(links, more_rels)
            value = PathValue(self.fresh("path"))
            self.df = self.df.withColumns({f"{value.prefix}.nodes": ids, f"{value.prefix}.rels": links})
            self.scope[path.var] = value

    def entity(self, name: str) -> Entity:
        e = self.scope.get(name)
        if not isinstance(e, Entity):
            raise CypherError(f"{name} is not a node or relationship" if e is not None else f"Unknown variable: {name}")
        return e

    def possible(self, n: A.NodePat, right: A.RelPat | None, left: A.RelPat | None, g: Graph) -> set[str] | None:
        """Labels that the declared ends of the neighbouring relationships leave (None: any)."""
        out: set[str] | None = None
        for r, from_left in ((right, True), (left, False)):
            if r is None or r.varlen or r.direction == "both" or not (tables := g.edge_tables(r.types)):
                continue
            ends = {t.src_label if (r.direction == "out") == from_left else t.dst_label for t in tables}
            if None not in ends:
                out = ends if out is None else out & ends
        return out

    def node(self, n: A.NodePat, g: Graph, labels: set[str] | None = None) -> None:
        """Bind a node pattern, by a scan or, for a bound variable, by filters."""
        if n.var in self.scope:
            e = self.entity(n.var)
            for label in n.labels:
                self.df = self.df.filter(F.array_contains(e.col("labels"), label))
            self.check_props(n, e)
            return
        e, scan = self.scan(n, g, labels)
        self.df = scan if self.empty else self.df.crossJoin(scan)
        self.empty = False
        self.scope[n.var] = e
        self.check_props(n, e, constants=False)

    def scan(self, n: A.NodePat, g: Graph, labels: set[str] | None = None) -> tuple[Entity, DataFrame]:
        tables = [t for t in g.node_tables(n.labels) if labels is None or t.labels & labels]
        e = Entity("node", self.fresh("n"), {key_of(k): t for k, t in merged_props(tables).items()}, g.name)
        parts = []
        for t in tables:
            cols = [F.col("id").alias(f"{e.prefix}.id"), F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>").alias(f"{e.prefix}.labels")]
            cols += self.prop_columns(e, t)
            df = t.df
            for key, value in self.constant_props(n):  # on the stored column, where Parquet can use it
                df = df.filter(V.compare("=", E(F.col(column_of(key)), V.type_of(t.props[column_of(key)])), value).col if column_of(key) in t.props else F.lit(False)) if value.kind != "null" else df.filter(F.col(column_of(key)).isNull() if column_of(key) in t.props else F.lit(True))
            parts.append(df.select(*cols))
        return e, self.union(parts, e)

    def prop_columns(self, e: Entity, t) -> list[Column]:
        have = t.props
        return [(F.col(f"`{column_of(k)}`").cast(kind) if column_of(k) in have else F.lit(None).cast(kind)).alias(f"{e.prefix}.p.{k}") for k, kind in e.props.items()]

    def union(self, parts: list[DataFrame], e: Entity) -> DataFrame:
        if not parts:
            kinds = {"id": T.LongType(), "labels": T.ArrayType(T.StringType()), "src": T.LongType(), "dst": T.LongType(), "type": T.StringType()}
            fields = [T.StructField(c, e.props[c.split(".p.", 1)[1]] if ".p." in c else kinds[c.rsplit(".", 1)[1]]) for c in e.columns()]
            return self.spark.createDataFrame([], T.StructType(fields))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def constant_props(self, p) -> list[tuple[str, E]]:
        if isinstance(p.props, A.Param):
            return [(k, V.lit(v)) for k, v in (self.param(p.props.name) or {}).items()]
        return [(k, self.expr(x)) for k, x in (p.props.items if p.props else ()) if is_constant(x)]

    def check_props(self, p, e: Entity, constants: bool = True) -> None:
        """Filter on a pattern's property map; constants only if the scan hasn't done it."""
        pairs = self.constant_props(p) if constants else []
        if isinstance(p.props, A.MapLit):
            pairs += [(k, self.expr(x)) for k, x in p.props.items if not is_constant(x)]
        for key, value in pairs:
            own = self.prop_of(e, key)
            self.df = self.df.filter(own.col.isNull() if value.kind == "null" else V.compare("=", own, value).col)

    def prop_of(self, e: Entity, key: str) -> E:
        if key not in e.props:
            return V.lit(None)
        return E(e.prop(key), V.type_of(e.props[key]))

    def edges(self, r: A.RelPat, g: Graph, forward: bool, name: str | None = None) -> tuple[Entity, DataFrame]:
        """Edges of the pattern's types with the columns `from` and `to` along the walk; forward: from src to dst."""
        tables = g.edge_tables(r.types)
        e = Entity("rel", name or self.fresh("r"), {key_of(k): t for k, t in merged_props(tables).items()}, g.name)
        parts = []
        for t in tables:
            df = t.df
            for key, value in self.constant_props(r):
                df = df.filter(V.compare("=", E(F.col(column_of(key)), V.type_of(t.props[column_of(key)])), value).col if column_of(key) in t.props else F.lit(False)) if value.kind != "null" else df.filter(F.col(column_of(key)).isNull() if column_of(key) in t.props else F.lit(True))
            parts.append(df.select(F.col("id").alias(f"{e.prefix}.id"), F.col("src").alias(f"{e.prefix}.src"), F.col("dst").alias(f"{e.prefix}.dst"), F.lit(t.type).alias(f"{e.prefix}.type"), *self.prop_columns(e, t)))
        df = self.union(parts, e)
        src, dst = e.col("src"), e.col("dst")
        one = lambda d, a, b: d.withColumns({f"{e.prefix}.from": a, f"{e.prefix}.to": b})
        if r.direction == "both":
            return e, one(df, src, dst).union(one(df.filter(src != dst), dst, src))
        return e, one(df, src, dst) if forward else one(df, dst, src)

    def hop(self, a: A.NodePat, r: A.RelPat, b: A.NodePat, backwards: bool, g: Graph, shortest: str | None) -> tuple[Column, Column]:
        """Walk from the bound node a over r to b; gives the node and relationship ids that it adds, left to right."""
        start = self.entity(a.var)
        forward = (r.direction == "out") != backwards
        if r.varlen or shortest:
            return self.far_hop(start, r, b, backwards, forward, g, shortest)
        again = self.scope.get(r.var)
        e, edges = self.edges(r, g, forward)
        ends = [f"{e.prefix}.from", f"{e.prefix}.to"]
        if again is not None:
            own = self.entity(r.var)
            edges = edges.select(*[F.col(f"`{c}`") for c in (f"{e.prefix}.id", *ends)])
            self.df = self.df.join(edges, (start.id == F.col(f"`{ends[0]}`")) & (own.id == F.col(f"`{e.prefix}.id`"))).drop(f"{e.prefix}.id")
            e = own
        else:
            self.df = self.df.join(edges, start.id == F.col(f"`{ends[0]}`"))
            self.scope[r.var] = e
            self.check_props(r, e, constants=False)
        self.reach(b, F.col(f"`{ends[1]}`"), r, forward, g)
        self.df = self.df.drop(*ends)
        links, ids = F.array(e.id), F.array(self.entity(b.var).id)
        return (F.array(start.id), links) if backwards else (ids, links)

    def reach(self, b: A.NodePat, to: Column, r: A.RelPat, forward: bool, g: Graph) -> None:
        if b.var in self.scope:
            self.df = self.df.filter(self.entity(b.var).id == to)
            self.node(b, g)
            return
        ends = {(t.dst_label if forward else t.src_label) for t in g.edge_tables(r.types)} if r.direction != "both" and not r.varlen else {None}
        idle = b.var not in self.used and "*" not in self.used and not b.props
        if idle and len(ends) == 1 and None not in ends and set(b.labels) <= ends:  # the end is promised: no join
            e = Entity("node", self.fresh("n"), {}, g.name)
            self.df = self.df.withColumns({f"{e.prefix}.id": to, f"{e.prefix}.labels": F.array(*[F.lit(x) for x in ends])})
            self.scope[b.var] = e
            return
        e, scan = self.scan(b, g, ends if None not in ends and ends else None)
        self.df = self.df.join(scan, to == e.id)
        self.scope[b.var] = e
        self.check_props(b, e, constants=False)

    def far_hop(self, start: Entity, r: A.RelPat, b: A.NodePat, backwards: bool, forward: bool, g: Graph, shortest: str | None) -> tuple[Column, Column]:
        _, edges = self.edges(r, g, forward, p := self.fresh("w"))
        steps = edges.select(F.col(f"`{p}.from`").alias("from"), F.col(f"`{p}.to`").alias("to"), F.col(f"`{p}.id`").alias("rel"))
        lo = r.lo if r.lo is not None else 1
        hi = r.hi if r.hi is not None else (self.max_hops if r.varlen else 1)
        starts = self.df.select(start.id.alias("start")).distinct()
        ends = None
        if b.var in self.scope:
            ends = self.df.select(self.entity(b.var).id.alias("end")).distinct()
        elif shortest and (b.labels or b.props):
            e, scan = self.scan(b, g)
            ends = scan.select(F.col(f"`{e.prefix}.id`").alias("end"))
        walk = expand.shortest_paths(starts, steps, lo, hi, shortest == "one", ends) if shortest else expand.variable_paths(starts, steps, lo, hi)
        w = self.fresh("walk")
        walk = walk.select(*[F.col(c).alias(f"{w}.{c}") for c in ("start", "end", "nodes", "rels")])
        self.df = self.df.join(walk, start.id == F.col(f"`{w}.start`"))
        self.reach(b, F.col(f"`{w}.end`"), replace(r, varlen=True), forward, g)
        rels = F.reverse(F.col(f"`{w}.rels`")) if backwards else F.col(f"`{w}.rels`")
        self.df = self.df.withColumns({f"{w}.rels": rels}).drop(f"{w}.start", f"{w}.end")
        self.scope[r.var] = Scalar(f"{w}.rels", V.list_of(V.INT))
        self.scope[f" {w}"] = Scalar(f"{w}.nodes", V.list_of(V.INT))
        nodes = F.col(f"`{w}.nodes`")
        count = F.greatest(F.size(nodes) - 1, F.lit(0))
        # Without the left end, which the path has already; a backwards walk starts at the right end.
        added = F.slice(F.reverse(nodes), F.lit(2), count) if backwards else F.slice(nodes, F.lit(2), count)
        return added, F.col(f"`{w}.rels`")

    # Other reading clauses

    def unwind(self, c: A.Unwind) -> None:
        self.prepare(c.expr)
        e = self.expr(c.expr)
        if e.kind == "null":
            e = E(F.array().cast("array<string>"), V.list_of(V.STRING))
        if e.kind != "list":
            e = V.array([e])
        name = self.fresh("u")
        self.df = self.df.withColumn(name, F.explode(e.col))
        self.scope[c.var] = Scalar(name, e.elem if e.elem != V.NULL else V.STRING)
        self.empty = False
        self.log.append(f"Unwind {c.var}")

    def load_csv(self, c: A.LoadCsv) -> None:
        from orrery.sources.csv import csv_rows

        path = self.expr(c.path).const
        if not isinstance(path, str):
            raise CypherError("LOAD CSV needs a constant path")
        rows, t = csv_rows(self.spark, path, c.headers, c.sep)
        name = self.fresh("csv")
        rows = rows.select(F.col("row").alias(name))
        self.df = rows if self.empty else self.df.crossJoin(rows)
        self.scope[c.var] = Scalar(name, t)
        self.empty = False
        self.log.append(f"LoadCsv {path}")

    # Projections

    def project(self, p: A.Project) -> DataFrame | None:
        items = list(p.items)
        if p.star:
            items = [A.Item(A.Var(k), k, k) for k in self.scope if not k.startswith(" ")] + items
        for i in items:
            self.prepare(i.expr)
        aggregated = any(has_aggregate(i.expr) for i in items)
        names = [self.item_name(i, k, p.kind) for k, i in enumerate(items)]
        old_scope = dict(self.scope)
        made = self.aggregate(items) if aggregated else [self.item_value(i.expr) for i in items]
        if aggregated:
            old_scope = {}
        new_scope: dict[str, object] = {}
        columns: dict[str, Column] = {}
        for name, value in zip(names, made, strict=True):
            key = name if name not in new_scope else f"{name} {len(new_scope)}"
            if isinstance(value, (Entity, PathValue)):
                new_scope[key] = value
            elif isinstance(value, Scalar):
                new_scope[key] = value
            else:
                c = self.fresh("x")
                columns[c] = value.col if value.kind != "null" else value.col.cast("string")
                new_scope[key] = Scalar(c, value.t if value.kind != "json" else V.STRING)
        self.df = self.df.withColumns(columns) if columns else self.df
        keep = list(dict.fromkeys(c for v in new_scope.values() for c in v.columns()))
        known = {i.expr: new_scope[k] for i, k in zip(items, new_scope, strict=True)}
        if p.distinct:
            self.df = self.distinct([*new_scope.values()])
            old_scope = {}
        if p.order:
            self.scope = {**old_scope, **new_scope}
            self.done |= {x: v.value() for x, v in known.items() if not isinstance(x, A.Var)}
            keys = []
            for x, down in p.order:
                self.prepare(x)
                e = self.expr(x)
                col = e.col["id"] if e.kind in ("node", "rel") else e.col
                keys.append(col.desc() if down else col.asc())
            self.df = self.df.orderBy(*keys)
        self.done = {}
        if not p.distinct:
            self.df = self.df.select(*[F.col(f"`{c}`") for c in keep]) if keep else self.df
        self.scope = new_scope
        if p.skip is not None:
            self.df = self.df.offset(self.count_of(p.skip))
        if p.limit is not None:
            self.df = self.df.limit(self.count_of(p.limit))
        self.empty = False
        self.log.append(f"{p.kind.title()} {', '.join(names)}" + (" distinct" if p.distinct else "") + (" grouped" if aggregated else ""))
        if p.kind == "with":
            for c in conjuncts(p.where):
                self.prepare(c)
                self.filter(c)
            return None
        outs = []
        for v in new_scope.values():
            e = v.value()
            outs.append(e.col.cast("string") if e.kind == "null" else e.col)
        return self.df.select(*[o.alias(f"c{i}") for i, o in enumerate(outs)]).toDF(*names)

    def count_of(self, x: A.Node) -> int:
        e = self.expr(x)
        if e.const is not None:
            return int(e.const)
        row = self.spark.range(1).select(e.col.alias("n")).first()
        return int(row["n"])

    def item_name(self, i: A.Item, k: int, kind: str) -> str:
        if i.alias:
            return i.alias
        x = i.expr
        if isinstance(x, A.Var):
            return x.name
        if isinstance(x, A.Prop) or isinstance(x, A.Call):
            return i.text
        if kind == "with":
            raise CypherError(f"an expression in WITH needs an alias: {i.text}")
        return f"column_{k}"

    def item_value(self, x: A.Node):
        if isinstance(x, A.Var) and x.name in self.scope and not isinstance(self.scope[x.name], E):
            return self.scope[x.name]
        return self.expr(x)

    def distinct(self, values: list) -> DataFrame:
        ids = list(dict.fromkeys(c for v in values for c in ([f"{v.prefix}.id"] if isinstance(v, Entity) else v.columns())))
        rest = [c for v in values for c in v.columns() if c not in ids]
        q = lambda c: F.col(f"`{c}`")
        if not rest:
            return self.df.select(*[q(c) for c in ids]).distinct()
        return self.df.groupBy(*[q(c) for c in ids]).agg(*[F.first(q(c)).alias(c) for c in dict.fromkeys(rest)])

    def aggregate(self, items: list[A.Item]) -> list:
        """Group by all items without an aggregate (and by aggregate-free parts of the others)."""
        keys: dict[A.Node, object] = {}
        calls: dict[A.Call, None] = {}

        def parts(x: A.Node) -> None:
            if isinstance(x, A.Call) and x.name in AGGREGATES:
                calls[x] = None
            elif not has_aggregate(x):
                if not is_constant(x):
                    keys.setdefault(x, None)
            else:
                for c in x.children():
                    parts(c)

        for i in items:
            if has_aggregate(i.expr):
                parts(i.expr)
            else:
                keys.setdefault(i.expr, None)
        by, firsts, columns = [], [], {}
        for x in keys:
            v = self.item_value(x)
            if isinstance(v, Entity):
                by.append(f"{v.prefix}.id")
                firsts += v.columns()[1:]
            elif isinstance(v, (PathValue, Scalar)):
                by += v.columns()
            else:
                c = self.fresh("g")
                columns[c] = v.col if v.kind != "null" else v.col.cast("string")
                v = Scalar(c, v.t)
                by.append(c)
            keys[x] = v
        self.df = self.df.withColumns(columns) if columns else self.df
        aggs, types = [], {}
        for c in calls:
            name = self.fresh("a")
            col, t = self.aggregate_call(c)
            aggs.append(col.alias(name))
            types[c] = Scalar(name, t)
        q = lambda c: F.col(f"`{c}`")
        firsts = [F.first(q(c)).alias(c) for c in dict.fromkeys(firsts)]
        by = list(dict.fromkeys(by))
        self.df = self.df.groupBy(*[q(c) for c in by]).agg(*aggs, *firsts)
        self.scope = {}
        self.done = {x: v.value() for x, v in [*keys.items(), *types.items()]}
        out = [keys[i.expr] if i.expr in keys else types[i.expr] if i.expr in types else self.expr(i.expr) for i in items]
        return out

    def aggregate_call(self, c: A.Call) -> tuple[Column, tuple]:
        if c.star or not c.args:
            return F.count(F.lit(1)), V.INT
        x = c.args[0]
        v = self.item_value(x)
        e = v.value() if not isinstance(v, E) else v
        if c.name == "count":
            col = v.id if isinstance(v, Entity) else e.col["id"] if e.kind in ("node", "rel") else e.col
            return (F.count_distinct(col) if c.distinct else F.count(col)), V.INT
        if c.name == "collect":
            t = e.t if e.kind != "null" else V.STRING
            return (F.collect_set(e.col) if c.distinct else F.collect_list(e.col)), V.list_of(t)
        if c.name in ("min", "max"):
            return getattr(F, c.name)(e.col), e.t
        n = V.number(V.from_json_text(e, E(F.lit(0.0), V.FLOAT)))
        if c.name == "sum":
            total = (F.sum_distinct if c.distinct else F.sum)(n)
            return F.coalesce(total, F.lit(0).cast("bigint" if e.kind == "int" else "double")), V.INT if e.kind == "int" else V.FLOAT
        if c.name == "avg":
            return (F.sum_distinct(n) / F.count_distinct(n) if c.distinct else F.avg(n)), V.FLOAT
        return getattr(F, "stddev" if c.name == "stdev" else "stddev_pop")(n), V.FLOAT

    # Subqueries in expressions

    def prepare(self, x: A.Node) -> None:
        """Give the pattern predicates and comprehensions in x a column of the bindings each."""
        for n in x.walk():
            if n in self.done:
                continue
            if isinstance(n, A.Exists):
                sub, keys = self.subplan(n.paths, n.where)
                flag = self.fresh("e")
                rows = sub.df.select(*[F.col(f"`{k}`") for k in keys]).distinct().withColumn(flag, F.lit(True)) if keys else sub.df.limit(1).select(F.lit(True).alias(flag))
                self.join_sub(rows, keys, "left")
                self.done[n] = E(F.coalesce(F.col(flag), F.lit(False)), V.BOOL)
            elif isinstance(n, A.PatComp):
                sub, keys = self.subplan((n.path,), n.where, n.expr)
                sub.prepare(n.expr)
                e = sub.expr(n.expr)
                got = self.fresh("c")
                rows = sub.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.collect_list(e.col).alias(got))
                self.join_sub(rows, keys, "left")
                t = e.t if e.kind != "null" else V.STRING
                empty = F.filter(F.col(got), lambda _: F.lit(False))
                self.done[n] = E(F.coalesce(F.col(got), empty, F.array().cast(V.sql_name(V.list_of(t))) if t[0] in V.SQL_NAMES else empty), V.list_of(t))

    # Expressions

    def param(self, name: str):
        if name not in self.params:
            raise CypherError(f"missing parameter: {name}")
        return self.params[name]

    def lookup(self, name: str):
        if name not in self.scope:
            raise CypherError(f"Unknown variable: {name}")
        return self.scope[name]

    def expr(self, x: A.Node) -> E:
        if x in self.done:
            return self.done[x]
        return getattr(self, f"x_{type(x).__name__.lower()}")(x)

    def x_lit(self, x: A.Lit) -> E:
        return V.lit(x.value)

    def x_param(self, x: A.Param) -> E:
        return V.lit(self.param(x.name))

    def x_var(self, x: A.Var) -> E:
        v = self.lookup(x.name)
        return v if isinstance(v, E) else v.value()

    def x_prop(self, x: A.Prop) -> E:
        if isinstance(x.base, A.Var) and x.base not in self.done:
            v = self.lookup(x.base.name)
            if isinstance(v, Entity):
                return self.prop_of(v, x.key)
        return V.field(self.expr(x.base), x.key)

    def x_index(self, x: A.Index) -> E:
        i = self.expr(x.index)
        if isinstance(x.base, A.Var) and isinstance(i.const, str):
            return self.x_prop(A.Prop(x.base, i.const))
        return V.at_index(self.expr(x.base), i)

    def x_un(self, x: A.Un) -> E:
        e = self.expr(x.x)
        return E(~self.boolean(e), V.BOOL) if x.op == "not" else E(-V.number(e), e.t if e.kind in ("int", "float") else V.FLOAT)

    def x_bin(self, x: A.Bin) -> E:
        a, b = self.expr(x.left), self.expr(x.right)
        a, b = V.from_json_text(a, b), V.from_json_text(b, a)
        if x.op in ("and", "or", "xor"):
            p, q = self.boolean(a), self.boolean(b)
            return E(p & q if x.op == "and" else p | q if x.op == "or" else p != q, V.BOOL)
        if x.op in ("=", "<>", "<", ">", "<=", ">="):
            return V.compare(x.op, a, b)
        if x.op == "in":
            return V.contains(a, b)
        if x.op == "+":
            return V.plus(a, b)
        if x.op in ("-", "*", "/", "%"):
            return V.arithmetic(x.op, a, b)
        s, t = V.text(a), V.text(b)
        return E({"starts with": F.startswith, "ends with": F.endswith, "contains": F.contains, "=~": F.rlike}[x.op](s, t), V.BOOL)

    def x_isnull(self, x: A.IsNull) -> E:
        if isinstance(x.x, A.Var) and isinstance(v := self.scope.get(x.x.name), Entity):
            c = v.id
        else:
            c = self.expr(x.x).col
        return E(c.isNotNull() if x.negated else c.isNull(), V.BOOL)

    def x_haslabel(self, x: A.HasLabel) -> E:
        if isinstance(x.x, A.Var):
            e = self.entity(x.x.name)
            labels = e.col("labels") if e.kind == "node" else F.array(e.col("type"))
        else:
            labels = self.expr(x.x).col["labels"]
        out = F.lit(True)
        for label in x.labels:
            out = out & F.array_contains(labels, label)
        return E(out, V.BOOL)

    def x_case(self, x: A.Case) -> E:
        operand = self.expr(x.operand) if x.operand is not None else None
        results = [V.from_json_text(self.expr(r)) for _, r in x.whens] + [V.from_json_text(self.expr(x.default)) if x.default is not None else V.lit(None)]
        t = V.common(results)
        out = None
        for (cond, _), r in zip(x.whens, results, strict=False):
            c = self.expr(cond)
            test = self.boolean(c) if operand is None else V.compare("=", *(lambda p, q: (V.from_json_text(p, q), V.from_json_text(q, p)))(operand, c)).col
            value = V.to_type(r, t) if r.kind != "null" or t[0] not in V.SQL_NAMES else r.col.cast(V.sql_name(t))
            out = F.when(test, value) if out is None else out.when(test, value)
        last = results[-1]
        return E(out.otherwise(V.to_type(last, t)) if last.kind != "null" else out, t)

    def x_listlit(self, x: A.ListLit) -> E:
        return V.array([V.from_json_text(self.expr(i)) for i in x.items])

    def x_maplit(self, x: A.MapLit) -> E:
        return V.struct({k: V.from_json_text(self.expr(v)) for k, v in x.items})

    def x_mapproj(self, x: A.MapProj) -> E:
        fields: dict[str, E] = {}
        v = self.scope.get(x.base.name) if isinstance(x.base, A.Var) else None
        for kind, what in x.items:
            if kind == ".*":
                names = list(v.props) if isinstance(v, Entity) else [k for k, _ in (self.expr(x.base).t[1] if self.expr(x.base).kind == "map" else ())]
                fields |= {k: self.x_prop(A.Prop(x.base, k)) for k in names}
            elif kind == ".":
                fields[what] = self.x_prop(A.Prop(x.base, what))
            else:
                fields[kind] = self.expr(what)
        return V.struct({k: V.from_json_text(e) for k, e in fields.items()})

    def inner(self, names: dict[str, E], x: A.Node) -> E:
        old = {k: self.scope.get(k) for k in names}
        self.scope |= names
        try:
            return self.expr(x)
        finally:
            for k, v in old.items():
                if v is None:
                    self.scope.pop(k)
                else:
                    self.scope[k] = v

    def source(self, x: A.Node) -> E:
        e = self.expr(x)
        if e.kind == "json":
            e = E(F.from_json(e.col, "array<string>"), V.list_of(V.STRING))
        if e.kind == "null" or e.t == V.list_of(V.NULL):
            return E(F.array().cast("array<string>") if e.kind != "null" else F.lit(None).cast("array<string>"), V.list_of(V.STRING))
        if e.kind != "list":
            raise CypherError(f"not a list: {e.t}")
        return e

    def x_listcomp(self, x: A.ListComp) -> E:
        src = self.source(x.source)
        out, t = src.col, src.t
        if x.where is not None:
            out = F.filter(out, lambda v: self.boolean(self.inner({x.var: E(v, src.elem)}, x.where)))
        if x.expr is not None:
            kinds: list[tuple] = []

            def go(v: Column) -> Column:
                e = self.inner({x.var: E(v, src.elem)}, x.expr)
                kinds.append(e.t)
                return e.col

            out = F.transform(out, go)
            t = V.list_of(kinds[0])
        return E(out, t)

    def x_quant(self, x: A.Quant) -> E:
        src = self.source(x.source)
        test = lambda v: self.boolean(self.inner({x.var: E(v, src.elem)}, x.pred))
        if x.kind == "all":
            return E(F.forall(src.col, test), V.BOOL)
        if x.kind == "single":
            return E(F.size(F.filter(src.col, test)) == 1, V.BOOL)
        some = F.exists(src.col, test)
        return E(some if x.kind == "any" else ~some, V.BOOL)

    def x_reduce(self, x: A.Reduce) -> E:
        src, init = self.source(x.source), self.expr(x.init)
        kinds: list[tuple] = []

        def probe(acc: Column, v: Column) -> Column:
            e = self.inner({x.acc: E(acc, init.t), x.var: E(v, src.elem)}, x.expr)
            kinds.append(e.t)
            return e.col

        F.aggregate(src.col, init.col, probe)
        t = V.merge_types(init.t, kinds[0])
        start = V.to_type(init, t)
        step = lambda acc, v: V.to_type(self.inner({x.acc: E(acc, t), x.var: E(v, src.elem)}, x.expr), t)
        return E(F.aggregate(src.col, start, step), t)

    def x_exists(self, x: A.Exists) -> E:
        self.prepare(x)
        return self.done[x]

    def x_patcomp(self, x: A.PatComp) -> E:
        self.prepare(x)
        return self.done[x]

    def x_call(self, x: A.Call) -> E:
        if x.name in AGGREGATES:
            raise CypherError(f"{x.name}() is not allowed here")
        if x.name in ENTITY_FUNCTIONS and len(x.args) == 1:
            got = ENTITY_FUNCTIONS[x.name](self, x.args[0])
            if got is not None:
                return got
        if x.name not in FUNCTIONS:
            raise CypherError(f"Unsupported function: {x.name}")
        least, most, build = FUNCTIONS[x.name]
        if not least <= len(x.args) <= most:
            raise CypherError(f"{x.name}() takes {least if least == most else f'{least} to {most}'} argument(s), not {len(x.args)}")
        return build(*[V.from_json_text(self.expr(a)) for a in x.args])

    # Functions of entities and paths

    def target(self, x: A.Node):
        if isinstance(x, A.Var) and x not in self.done:
            return self.lookup(x.name)
        return self.expr(x)

    def f_id(self, x: A.Node) -> E:
        v = self.target(x)
        if isinstance(v, Entity):
            return E(v.id, V.INT)
        e = v if isinstance(v, E) else v.value()
        return E(e.col["id"], V.INT) if e.kind in ("node", "rel") else e

    def f_labels(self, x: A.Node) -> E | None:
        v = self.target(x)
        if isinstance(v, Entity) and v.kind == "node":
            return E(v.col("labels"), V.list_of(V.STRING))
        e = v if isinstance(v, E) else v.value()
        return E(e.col["labels"], V.list_of(V.STRING))

    def f_type(self, x: A.Node) -> E:
        v = self.target(x)
        if isinstance(v, Entity) and v.kind == "rel":
            return E(v.col("type"), V.STRING)
        e = v if isinstance(v, E) else v.value()
        if e.kind != "rel":
            raise CypherError("type() needs a relationship")
        return E(e.col["type"], V.STRING)

    def f_properties(self, x: A.Node) -> E | None:
        v = self.target(x)
        if isinstance(v, Entity):
            return E(F.when(v.id.isNotNull(), v.properties()), v.type()[1][-1][1])
        e = v if isinstance(v, E) else v.value()
        return E(e.col["properties"], dict(e.t[1])["properties"]) if e.kind in ("node", "rel") else e

    def f_keys(self, x: A.Node) -> E | None:
        v = self.target(x)
        if not isinstance(v, Entity):
            e = v if isinstance(v, E) else v.value()
            if e.kind not in ("node", "rel"):
                return None
            inner = dict(dict(e.t[1])["properties"][1])
            return E(F.array_compact(F.array(*[F.when(e.col["properties"][k].isNotNull(), F.lit(k)) for k in inner])), V.list_of(V.STRING))
        if not v.props:
            return E(F.array().cast("array<string>"), V.list_of(V.STRING))
        return E(F.array_compact(F.array(*[F.when(v.prop(k).isNotNull(), F.lit(k)) for k in v.props])), V.list_of(V.STRING))

    def f_graph(self, x: A.Node) -> E:
        v = self.target(x)
        return V.lit(v.graph if isinstance(v, Entity) else self.main)

    def f_startnode(self, x: A.Node) -> E:
        v = self.target(x)
        return E(v.col("src"), V.INT) if isinstance(v, Entity) else E((v if isinstance(v, E) else v.value()).col["startNode"], V.INT)

    def f_endnode(self, x: A.Node) -> E:
        v = self.target(x)
        return E(v.col("dst"), V.INT) if isinstance(v, Entity) else E((v if isinstance(v, E) else v.value()).col["endNode"], V.INT)

    def f_nodes(self, x: A.Node) -> E | None:
        v = self.target(x)
        return E(v.nodes, V.list_of(V.INT)) if isinstance(v, PathValue) else None

    def f_rels(self, x: A.Node) -> E | None:
        v = self.target(x)
        return E(v.rels, V.list_of(V.INT)) if isinstance(v, PathValue) else None

    def f_length(self, x: A.Node) -> E | None:
        v = self.target(x)
        return E(F.size(v.rels).cast("long"), V.INT) if isinstance(v, PathValue) else None


ENTITY_FUNCTIONS = {
    "id": Compiler.f_id,
    "labels": Compiler.f_labels,
    "type": Compiler.f_type,
    "properties": Compiler.f_properties,
    "keys": Compiler.f_keys,
    "graph": Compiler.f_graph,
    "startnode": Compiler.f_startnode,
    "endnode": Compiler.f_endnode,
    "nodes": Compiler.f_nodes,
    "relationships": Compiler.f_rels,
    "rels": Compiler.f_rels,
    "length": Compiler.f_length,
    "size": Compiler.f_length,
}


def replace_compiler(outer: Compiler, scope: dict) -> Compiler:
    sub = Compiler(outer.graphs, outer.params, outer.main, outer.max_hops)
    sub.n = outer.n + 1000
    outer.n += 100_000
    sub.scope, sub.used = dict(scope), set(outer.used)
    return sub
