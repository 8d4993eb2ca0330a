"""Typing and translation of expressions to Spark columns, with strict types and three-valued logic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch
from ..frontend import ast as A

INT, BOOL, STRING, NULL, OTHER = "int", "bool", "string", "null", "other"

#: What a reference to an attribute means: its type and its column.
Resolver = Callable[[A.Attr], tuple[str, Column]]


def type_of(spark_type: T.DataType) -> str:
    if isinstance(spark_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT
    return BOOL if isinstance(spark_type, T.BooleanType) else STRING if isinstance(spark_type, T.StringType) else NULL if isinstance(spark_type, T.NullType) else OTHER


def _same(a: str, b: str, e: A.Expr) -> str:
    """The common type of two operands; a bare NULL takes the other's."""
    if OTHER in (a, b):
        raise TypeMismatch(f"{A.show(e)}: a column of this type can only be selected, grouped or tested for NULL")
    if a != b and NULL not in (a, b):
        raise TypeMismatch(f"{A.show(e)}: {a} and {b}")
    return b if a == NULL else a


def _want(got: str, kind: str, e: A.Expr) -> None:
    if got not in (kind, NULL):
        raise TypeMismatch(f"{A.show(e)}: expected {kind}, found {got}")


_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_CAST = {INT: "long", BOOL: "boolean", STRING: "string"}


def compile_expr(e: A.Expr, resolve: Resolver) -> tuple[str, Column]:
    """Type and column of ``e``."""
    match e:
        case A.Attr():
            return resolve(e)
        case A.Int(v):
            return INT, F.lit(v).cast("long")
        case A.Str(v):
            return STRING, F.lit(v)
        case A.Lit("TRUE") | A.Lit("FALSE"):
            return BOOL, F.lit(e.value == "TRUE")
        case A.Lit("UNKNOWN"):
            return BOOL, F.lit(None).cast("boolean")
        case A.Lit("NULL"):
            return NULL, F.lit(None).cast("boolean")
        case A.Un("isnull", x):
            return BOOL, compile_expr(x, resolve)[1].isNull()
        case A.Un("not", x):
            t, c = compile_expr(x, resolve)
            _want(t, BOOL, e)
            return BOOL, ~c
        case A.Un("-", x):
            t, c = compile_expr(x, resolve)
            _want(t, INT, e)
            return INT, -c.cast("long")
        case A.Is(x, what):
            t, c = compile_expr(x, resolve)
            _want(t, BOOL, e)
            return BOOL, c.isNull() if what == "UNKNOWN" else c.eqNullSafe(F.lit(what == "TRUE"))
        case A.In(x, values, negated):
            return BOOL, _membership(e, x, values, negated, resolve)
        case A.Bin(op, left, right):
            (lt, lc), (rt, rc) = compile_expr(left, resolve), compile_expr(right, resolve)
            if op in ("and", "or"):
                _want(lt, BOOL, e)
                _want(rt, BOOL, e)
                return BOOL, lc & rc if op == "and" else lc | rc
            kind = _same(lt, rt, e)
            lc, rc = (c.cast(_CAST.get(kind, "boolean")) if t == NULL else c for t, c in ((lt, lc), (rt, rc)))
            if op in A.COMPARISONS:
                return BOOL, getattr(lc, _COMPARE[op])(rc)
            _want(kind, INT, e)
            return INT, _arithmetic(op, lc.cast("long"), rc.cast("long"))
        case A.Agg():
            raise TypeMismatch(f"{A.show(e)}: aggregate outside a grouped select list")
    raise TypeMismatch(f"{A.show(e)} can't stand here")


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    match op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return F.call_function("div", a, b)  # integer division, towards zero
        case "%":
            return a % b
    return F.pow(a.cast("double"), b.cast("double")).cast("long")


def _membership(e: A.In, x: A.Expr, values: tuple[A.Expr, ...], negated: bool, resolve: Resolver) -> Column:
    kind, col = compile_expr(x, resolve)
    found = [compile_expr(v, resolve) for v in values]
    for t, _ in found:
        if NULL not in (kind, t):
            _same(kind, t, e)
    known = [c.cast(_CAST.get(kind, "boolean")) for t, c in found if t != NULL] if kind != NULL else []
    constant = all(isinstance(v, (A.Int, A.Str, A.Lit)) for v in values)
    plain = [v.value for v in values if isinstance(v, (A.Int, A.Str))]
    if kind == NULL:
        hit: Column = F.lit(None).cast("boolean")
    elif constant and len(plain) == len(known) and plain:
        hit = col.isin(*plain)
    elif known:
        hit = reduce(lambda a, b: a | b, [col == c for c in known])
    else:
        hit = F.lit(None).cast("boolean")
    if kind != NULL and known and len(known) < len(found):
        hit = hit | F.lit(None).cast("boolean")  # NULL in the list: never FALSE
    return ~hit if negated else hit


def compile_agg(a: A.Agg, resolve: Resolver) -> tuple[str, Column]:
    if a.fn == "COUNT":
        return INT, F.count(F.lit(1)) if a.arg is None else F.count(compile_expr(a.arg, resolve)[1])
    t, c = compile_expr(a.arg, resolve)
    _want(t, INT, a)
    total = F.sum(c.cast("long"))
    return INT, F.coalesce(total, F.lit(0).cast("long")) if a.fn == "SUM0" else total
