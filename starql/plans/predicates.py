"""Canonical form of predicates, so that equal meanings compare equal."""

from __future__ import annotations

from ..frontend import ast as A


def canonical(e: A.Expr) -> A.Expr:
    """NOT pushed to the leaves, IN spelled out, comparisons turned to < and <=, commutative operands sorted, repeated
    terms dropped.  Holds under three-valued logic."""
    return _canon(e, False)


def equivalent(a: A.Expr, b: A.Expr) -> bool:
    return canonical(a) == canonical(b)


def _canon(e: A.Expr, negate: bool) -> A.Expr:
    match e:
        case A.Un("not", x):
            return _canon(x, not negate)
        case A.In(x, values, negated):
            wrong = negated != negate
            each = [A.Bin("!=" if wrong else "=", x, v) for v in values]
            return _chain("and" if wrong else "or", [_canon(t, False) for t in each])
        case A.Bin("and" | "or" as op, _, _):
            terms = [_canon(t, negate) for t in _terms(op, e)]
            return _chain({"and": "or", "or": "and"}[op] if negate else op, terms)
        case A.Bin(op, a, b) if op in A.COMPARISONS:
            op = A.OPPOSITE[op] if negate else op
            a, b = _canon(a, False), _canon(b, False)
            if op in (">", ">=") or op in ("=", "!=") and A.show(b) < A.show(a):
                op, a, b = A.MIRROR[op], b, a
            return A.Bin(op, a, b)
        case A.Bin("+" | "*" as op, _, _):
            return _fold(op, sorted((_canon(t, False) for t in _terms(op, e)), key=A.show))
        case A.Lit("TRUE" | "FALSE") if negate:
            return A.Lit("FALSE" if e.value == "TRUE" else "TRUE")
        case A.Lit("NULL" | "UNKNOWN") if negate:
            return e
    out = A.rebuild(e, tuple(_canon(c, False) for c in A.children(e)))
    return A.Un("not", out) if negate else out


def _terms(op: str, e: A.Expr) -> list[A.Expr]:
    return [*_terms(op, e.left), *_terms(op, e.right)] if isinstance(e, A.Bin) and e.op == op else [e]


def _fold(op: str, terms: list[A.Expr]) -> A.Expr:
    out = terms[0]
    for t in terms[1:]:
        out = A.Bin(op, out, t)
    return out


def _chain(op: str, terms: list[A.Expr]) -> A.Expr:
    flat = {A.show(x): x for t in terms for x in _terms(op, t)}
    return _fold(op, [flat[k] for k in sorted(flat)])


def null_rejecting(e: A.Expr, columns: set[A.Attr]) -> bool:
    """Whether the predicate can't be TRUE when all of ``columns`` are NULL (sound; may miss some)."""
    return not _maybe_true(canonical(e), columns)


def _maybe_true(e: A.Expr, columns: set[A.Attr]) -> bool:
    match e:
        case A.Bin("and", a, b):
            return _maybe_true(a, columns) and _maybe_true(b, columns)
        case A.Bin("or", a, b):
            return _maybe_true(a, columns) or _maybe_true(b, columns)
        case A.Bin(op, a, b) if op in A.COMPARISONS:
            return not (_strict(a, columns) or _strict(b, columns))
        case A.Un("not", A.Un("isnull", x)):
            return not _strict(x, columns)
        case A.Attr():
            return e not in columns
        case A.Lit():
            return e.value == "TRUE"
    return True


def _strict(e: A.Expr, columns: set[A.Attr]) -> bool:
    """Whether a value is NULL whenever ``columns`` are."""
    match e:
        case A.Attr():
            return e in columns
        case A.Bin(op, a, b) if op in A.ARITHMETIC:
            return _strict(a, columns) or _strict(b, columns)
        case A.Un("-", x):
            return _strict(x, columns)
    return False
