"""Row estimates and costs.  All constants are fixed values of the cost model."""

from __future__ import annotations

import math

from ..frontend import ast as A
from ..operators.rewrites import covers

EQUALS_CONST, RANGE, UNKNOWN, IN_EACH, IN_MOST = 0.10, 0.50, 0.50, 0.10, 0.50


def selectivity(e: A.Expr) -> float:
    match e:
        case A.Bin("and", a, b):
            return selectivity(a) * selectivity(b)
        case A.Bin("or", a, b):
            x, y = selectivity(a), selectivity(b)
            return x + y - x * y
        case A.Un("not", x):
            return 1 - selectivity(x)
        case A.In(_, vs, negated):
            s = min(IN_MOST, IN_EACH * len(vs))
            return 1 - s if negated else s
        case A.Bin("=", a, b):
            constant = (A.Int, A.Str, A.Lit)
            return EQUALS_CONST if isinstance(a, constant) or isinstance(b, constant) else UNKNOWN
        case A.Bin("<" | "<=" | ">" | ">=", _, _):
            return RANGE
    return UNKNOWN


def scaled(rows: int, s: float) -> int:
    return max(1, round(rows * s)) if rows else 0


def join_rows(left: int, right: int, cond: A.Expr, lc: list[A.Attr], rc: list[A.Attr]) -> int:
    s = 1.0
    for c in A.conjuncts(cond):
        if isinstance(c, A.Bin) and c.op == "=" and isinstance(c.left, A.Attr) and isinstance(c.right, A.Attr) and covers(lc, c.left) != covers(lc, c.right):
            s /= max(left, right, 1)
        else:
            s *= selectivity(c)
    return scaled(left * right, s)


def bit_width(n: int) -> int:
    return max(1, n).bit_length()


def scan(rows: int) -> int:
    return 100 * rows


def filter_(out: int) -> int:
    return 100 * out


def seek(out: int) -> int:
    return 200 * out + 100 * bit_width(out)


def projection(out: int) -> int:
    return 22 * out


def nested_loop(left: int, right: int) -> int:
    return 70 * left * right


def cross(left: int, right: int) -> int:
    return 104 * left * right


def hash_join(build: int, build_width: int, probe: int, out: int, out_width: int) -> int:
    return 100 * build * build_width + 35 * probe + 10 * out * out_width


def merge_join(left: int, right: int, out: int, out_width: int) -> int:
    return 18 * (left + right) + 10 * out * out_width


def hash_aggregate(rows: int) -> int:
    return 510 * rows


def stream_aggregate(rows: int) -> int:
    return 130 * rows


def sort(rows: int) -> int:
    return math.ceil(11 * rows * bit_width(rows))
