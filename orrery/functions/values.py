"""Typed expressions: a Column with a small static type, and the functions of the language on them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CypherTypeError(ValueError):
    pass


NULL, BOOL, INT, FLOAT, STRING, TEMPORAL, ANY = ("null",), ("bool",), ("int",), ("float",), ("string",), ("temporal",), ("any",)


def list_of(t: tuple) -> tuple:
    return ("list", t)


def type_of(dt: T.DataType) -> tuple:
    if isinstance(dt, T.BooleanType):
        return BOOL
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(dt, T.NumericType):
        return FLOAT
    if isinstance(dt, T.StringType):
        return STRING
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(dt, T.ArrayType):
        return list_of(type_of(dt.elementType))
    if isinstance(dt, T.StructType):
        names = dt.fieldNames()
        fields = tuple((f.name, type_of(f.dataType)) for f in dt.fields)
        return (("node" if names == ["id", "labels", "properties"] else "rel" if names == ["id", "type", "startNode", "endNode", "properties"] else "map"), fields)
    if isinstance(dt, T.NullType):
        return NULL
    return ANY


@dataclass
class E:
    col: Column
    t: tuple
    fields: dict[str, E] | None = None  # of a map whose keys are known
    const: Any = None
    items: list[E] | None = None  # of a list literal

    @property
    def kind(self) -> str:
        return self.t[0]

    @property
    def elem(self) -> tuple:
        return self.t[1] if self.kind == "list" else ANY


def lit(v: Any) -> E:
    if v is None:
        return E(F.lit(None), NULL)
    if isinstance(v, bool):
        return E(F.lit(v), BOOL, const=v)
    if isinstance(v, int):
        return E(F.lit(v).cast("long"), INT, const=v)
    if isinstance(v, float):
        return E(F.lit(v), FLOAT, const=v)
    if isinstance(v, str):
        return E(F.lit(v), STRING, const=v)
    if isinstance(v, (list, tuple)):
        return array([lit(x) for x in v])
    if isinstance(v, dict):
        return struct({str(k): lit(x) for k, x in v.items()})
    return E(F.lit(v), type_of(T._infer_type(v)), const=v)


def merge_types(a: tuple, b: tuple) -> tuple:
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if {a, b} == {INT, FLOAT}:
        return FLOAT
    if a[0] == b[0] == "list":
        return list_of(merge_types(a[1], b[1]))
    if a[0] == b[0] and a[0] in ("map", "node", "rel"):
        return a
    return STRING


SQL_NAMES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "temporal": "timestamp", "null": "void", "any": "string"}


def sql_name(t: tuple) -> str:
    if t[0] == "list":
        return f"array<{sql_name(t[1]) if t[1] != NULL else 'string'}>"
    return SQL_NAMES[t[0]]


def to_type(e: E, t: tuple) -> Column:
    if e.t == t or t[0] in ("null", "any", "map", "node", "rel", "path"):
        return e.col
    if t == STRING and e.kind in ("list", "map", "node", "rel"):
        return F.to_json(e.col)
    if t[0] == "list" and t[1][0] not in SQL_NAMES and e.t != list_of(NULL):
        return e.col
    return e.col.cast(sql_name(t))


def common(es: list[E]) -> tuple:
    t = NULL
    for e in es:
        t = merge_types(t, e.t)
    return t


def array(es: list[E]) -> E:
    if not es:
        return E(F.array().cast("array<string>"), list_of(NULL), items=[])
    t = common(es)
    return E(F.array(*[to_type(e, t) for e in es]), list_of(t), items=es)


def struct(fields: dict[str, E]) -> E:
    if not fields:
        return E(F.create_map().cast("map<string,string>"), ("map", ()), fields={})
    return E(F.struct(*[e.col.alias(k) for k, e in fields.items()]), ("map", tuple((k, e.t) for k, e in fields.items())), fields=fields)


def text(e: E) -> Column:
    return to_type(e, STRING) if e.kind != "string" else e.col


def number(e: E) -> Column:
    return e.col if e.kind in ("int", "float") else e.col.try_cast("double")


def real(f: Callable[[Column], Column]) -> Callable[[E], E]:
    """A function on doubles whose domain errors are null."""

    def go(e: E) -> E:
        out = f(e.col.try_cast("double"))
        return E(F.when(~F.isnan(out), out), FLOAT)

    return go


def plus(a: E, b: E) -> E:
    if a.kind == "list" or b.kind == "list":
        if a.kind == "list" and b.kind == "list":
            t = merge_types(a.t, b.t)
            return E(F.concat(to_type(a, t), to_type(b, t)), t)
        if a.kind == "list":
            t = list_of(merge_types(a.elem, b.t))
            return E(F.array_append(to_type(a, t), to_type(b, t[1])), t)
        t = list_of(merge_types(b.elem, a.t))
        return E(F.array_prepend(to_type(b, t), to_type(a, t[1])), t)
    if "string" in (a.kind, b.kind) or "temporal" in (a.kind, b.kind):
        return E(F.concat(text(a), text(b)), STRING)
    return E(number(a) + number(b), INT if a.kind == b.kind == "int" else FLOAT if "null" not in (a.kind, b.kind) else NULL if a.kind == b.kind else a.t if b.kind == "null" else b.t)


def arithmetic(op: str, a: E, b: E) -> E:
    whole = a.kind == b.kind == "int"
    x, y = number(a), number(b)
    if op == "-":
        return E(x - y, INT if whole else FLOAT)
    if op == "*":
        return E(x * y, INT if whole else FLOAT)
    y0 = F.nullif(y, F.lit(0))
    if op == "/":
        return E(F.call_function("div", x, y0), INT) if whole else E(x.cast("double") / y0.cast("double"), FLOAT)
    return E(F.call_function("mod", x, y0), INT if whole else FLOAT)


CLASSES = {"int": "number", "float": "number"}


def compare(op: str, a: E, b: E) -> E:
    x, y = a.col, b.col
    ca, cb = CLASSES.get(a.kind, a.kind), CLASSES.get(b.kind, b.kind)
    if {ca, cb} == {"temporal", "string"}:
        x, y = (F.try_to_timestamp(c) if k == "string" else c for c, k in ((x, ca), (y, cb)))
    elif ca == cb == "list" and a.t != b.t:
        t = merge_types(a.t, b.t)
        x, y = to_type(a, t), to_type(b, t)
    elif ca in ("node", "rel") and ca == cb:
        x, y = x["id"], y["id"]
    elif ca != cb and not {ca, cb} & {"null", "any"}:
        known = x.isNotNull() & y.isNotNull()
        return E(F.when(known, F.lit(op == "<>")) if op in ("=", "<>") else F.lit(None).cast("boolean"), BOOL)
    out = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()
    return E(out, BOOL)


def contains(x: E, items: E) -> E:
    if items.kind == "null":
        return E(F.lit(None).cast("boolean"), BOOL)
    if items.items is not None:
        if not items.items:
            return E(F.lit(False), BOOL)
        fitting = [i for i in items.items if CLASSES.get(i.kind, i.kind) == CLASSES.get(x.kind, x.kind) or {i.kind, x.kind} & {"null", "any"}]
        if fitting and all(i.const is not None for i in fitting) and len(fitting) == len(items.items):
            return E(x.col.isin(*[i.const for i in fitting]), BOOL)
        out = F.lit(False)
        for i in items.items:
            out = out | compare("=", x, i).col
        return E(out, BOOL)
    t = merge_types(items.elem, x.t)
    if t == STRING and x.kind != items.elem[0]:
        return E(F.lit(False), BOOL)
    return E(F.array_contains(to_type(items, list_of(t)), to_type(x, t)), BOOL)


def at_index(base: E, i: E) -> E:
    if base.kind == "list":
        n = i.col.cast("int")
        return E(F.when((n >= -F.size(base.col)) & (n < F.size(base.col)), F.try_element_at(base.col, F.when(n >= 0, n + 1).otherwise(n))), base.elem)
    if i.const is not None and isinstance(i.const, str):
        return field(base, i.const)
    if base.kind == "map" and base.fields is not None:
        out = F.lit(None)
        for k, e in base.fields.items():
            out = F.when(i.col == k, text(e)).otherwise(out)
        return E(out, STRING)
    return E(F.get_json_object(text(base), F.concat(F.lit("$["), i.col.cast("string"), F.lit("]"))), STRING)


def field(base: E, key: str) -> E:
    if base.fields is not None:
        return base.fields.get(key, lit(None))
    if base.kind in ("map", "node", "rel"):
        fields = dict(base.t[1])
        if base.kind in ("node", "rel"):
            inner = dict(fields.get("properties", ("map", ()))[1] if len(fields.get("properties", ())) > 1 else ())
            return E(base.col["properties"][key], inner[key]) if key in inner else lit(None)
        return E(base.col[key], fields[key]) if key in fields else lit(None)
    if base.kind == "null":
        return lit(None)
    if base.kind == "list":
        return lit(None)
    raw = F.get_json_object(text(base), f"$.{key}")
    return E(raw, ("json",))


def from_json_text(e: E, other: E | None = None) -> E:
    """A value out of JSON text, read as the type that it meets."""
    if e.kind != "json":
        return e
    if other is not None and other.kind in ("int", "float"):
        return E(e.col.try_cast("double") if other.kind == "float" else e.col.try_cast("bigint"), other.t)
    if other is not None and other.kind == "bool":
        return E(e.col.try_cast("boolean"), BOOL)
    return E(e.col, STRING)


# The function table: name -> (least and most arguments, builder)


def _size(e: E) -> E:
    return E(F.size(e.col).cast("long"), INT) if e.kind == "list" else lit(None) if e.kind == "null" else E(F.char_length(text(e)).cast("long"), INT)


def _whole(f):
    return lambda e: E(f(number(e)).cast("bigint"), INT)


def _substring(s: E, start: E, n: E | None = None) -> E:
    rest = F.substring(text(s), start.col.cast("int") + 1, F.lit(2**31 - 1) if n is None else n.col.cast("int"))
    return E(rest, STRING)


def _range(a: E, b: E, step: E | None = None) -> E:
    s = step.col if step is not None else F.lit(1).cast("long")
    ok = ((s > 0) & (a.col <= b.col)) | ((s < 0) & (a.col >= b.col))
    return E(F.when(ok, F.sequence(a.col, b.col, F.when(ok, s).otherwise(F.when(a.col <= b.col, 1).otherwise(-1)))).otherwise(F.array().cast("array<bigint>")), list_of(INT))


def _to_integer(e: E) -> E:
    if e.kind == "bool":
        return E(e.col.cast("bigint"), INT)
    return E(e.col.try_cast("bigint") if e.kind == "int" else F.coalesce(text(e).try_cast("bigint"), text(e).try_cast("double").try_cast("bigint")), INT)


def _to_boolean(e: E) -> E:
    if e.kind == "bool":
        return e
    s = F.lower(F.trim(text(e)))
    return E(F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False), BOOL)


def _to_string(e: E) -> E:
    return E(text(e), STRING)


def _clock(pattern: str):
    def go(e: E | None = None) -> E:
        at = F.current_timestamp() if e is None else e.col if e.kind == "temporal" else F.try_to_timestamp(text(e))
        return E(F.date_format(at, pattern), STRING)

    return go


def _round(e: E, p: E | None = None) -> E:
    if p is None or p.const is not None:
        return E(F.round(number(e), 0 if p is None else int(p.const)).cast("double"), FLOAT)
    scale = F.pow(F.lit(10.0), p.col)
    return E(F.round(number(e) * scale, 0) / scale, FLOAT)


def _coalesce(*es: E) -> E:
    t = common(list(es))
    if any(e.kind in ("node", "rel") for e in es):
        return E(F.coalesce(*[e.col for e in es]), next(e.t for e in es if e.kind in ("node", "rel")))
    return E(F.coalesce(*[to_type(e, t) for e in es]), t)


def _reverse(e: E) -> E:
    return E(F.reverse(e.col), e.t) if e.kind == "list" else E(F.reverse(text(e)), STRING)


def _keys(e: E) -> E:
    if e.fields is not None:
        return E(F.array(*[F.lit(k) for k in e.fields]) if e.fields else F.array().cast("array<string>"), list_of(STRING))
    names = dict(e.t[1]) if e.kind == "map" else {}
    return E(F.array(*[F.lit(k) for k in names]) if names else F.array().cast("array<string>"), list_of(STRING))


FUNCTIONS: dict[str, tuple[int, int, Callable[..., E]]] = {
    "toupper": (1, 1, lambda e: E(F.upper(text(e)), STRING)),
    "tolower": (1, 1, lambda e: E(F.lower(text(e)), STRING)),
    "trim": (1, 1, lambda e: E(F.trim(text(e)), STRING)),
    "ltrim": (1, 1, lambda e: E(F.ltrim(text(e)), STRING)),
    "rtrim": (1, 1, lambda e: E(F.rtrim(text(e)), STRING)),
    "length": (1, 1, _size),
    "size": (1, 1, _size),
    "reverse": (1, 1, _reverse),
    "substring": (2, 3, _substring),
    "replace": (3, 3, lambda s, a, b: E(F.replace(text(s), text(a), text(b)), STRING)),
    "split": (2, 2, lambda s, d: E(F.split(text(s), F.concat(F.lit("\\Q"), text(d), F.lit("\\E")), F.lit(-1)), list_of(STRING))),
    "left": (2, 2, lambda s, n: E(F.left(text(s), n.col.cast("int")), STRING)),
    "right": (2, 2, lambda s, n: E(F.right(text(s), n.col.cast("int")), STRING)),
    "startswith": (2, 2, lambda s, p: E(F.startswith(text(s), text(p)), BOOL)),
    "endswith": (2, 2, lambda s, p: E(F.endswith(text(s), text(p)), BOOL)),
    "contains": (2, 2, lambda s, p: E(F.contains(text(s), text(p)), BOOL)),
    "abs": (1, 1, lambda e: E(F.abs(number(e)), e.t if e.kind == "int" else FLOAT)),
    "ceil": (1, 1, _whole(F.ceil)),
    "floor": (1, 1, _whole(F.floor)),
    "sign": (1, 1, _whole(F.signum)),
    "sqrt": (1, 1, real(F.sqrt)),
    "log": (1, 1, real(F.log)),
    "log10": (1, 1, real(F.log10)),
    "exp": (1, 1, real(F.exp)),
    "sin": (1, 1, real(F.sin)),
    "cos": (1, 1, real(F.cos)),
    "tan": (1, 1, real(F.tan)),
    "asin": (1, 1, real(F.asin)),
    "acos": (1, 1, real(F.acos)),
    "atan": (1, 1, real(F.atan)),
    "round": (1, 2, _round),
    "rand": (0, 0, lambda: E(F.rand(), FLOAT)),
    "random": (0, 0, lambda: E(F.rand(), FLOAT)),
    "pi": (0, 0, lambda: lit(math.pi)),
    "e": (0, 0, lambda: lit(math.e)),
    "head": (1, 1, lambda e: E(F.get(e.col, F.lit(0)), e.elem) if e.kind == "list" else lit(None)),
    "last": (1, 1, lambda e: E(F.try_element_at(e.col, F.lit(-1)), e.elem) if e.kind == "list" else lit(None)),
    "tail": (1, 1, lambda e: E(F.slice(e.col, F.lit(2), F.greatest(F.size(e.col) - 1, F.lit(0))), e.t) if e.kind == "list" else lit(None)),
    "range": (2, 3, _range),
    "coalesce": (1, 99, _coalesce),
    "tostring": (1, 1, _to_string),
    "tointeger": (1, 1, _to_integer),
    "tofloat": (1, 1, lambda e: E(e.col.try_cast("double") if e.kind in ("int", "float", "bool") else text(e).try_cast("double"), FLOAT)),
    "toboolean": (1, 1, _to_boolean),
    "date": (0, 1, _clock("yyyy-MM-dd")),
    "time": (0, 1, _clock("HH:mm:ss")),
    "datetime": (0, 1, _clock("yyyy-MM-dd'T'HH:mm:ss'Z'")),
    "localdatetime": (0, 1, _clock("yyyy-MM-dd'T'HH:mm:ss")),
    "timestamp": (0, 0, lambda: E(F.unix_millis(F.current_timestamp()), INT)),
    "randomuuid": (0, 0, lambda: E(F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"), STRING)),
    "keys": (1, 1, _keys),
}


def register(name: str, build: Callable[..., E], least: int = 1, most: int | None = None) -> None:
    """Add a function of one's own: build takes and returns typed expressions."""
    FUNCTIONS[name.lower()] = (least, least if most is None else most, build)


AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp"}
