"""Search over plan alternatives, for analysis only: cheapest plan, rule lineage, reachability of a given plan.

A *space* holds groups of equivalent logical operators.  An operator whose inputs are groups stands for all plans that
its inputs stand for.  Rules look at an operator (and, where they need to, at the operators of its input groups) and
propose equivalent trees, which are added to its group; every pair of rule and operator is tried once.  Physical plans
are then read off the groups: the cheapest one by dynamic programming, or the one nearest to a given plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache

from ..frontend import ast as A
from ..operators.compile import rewrite_group_exprs
from ..operators.rewrites import covers, visible_columns
from ..sources.catalog import Catalog
from . import cost as C
from .physical import Node
from .predicates import canonical, equivalent, null_rejecting


@dataclass(frozen=True)
class Ref:
    """An input that is a group."""

    group: int


@dataclass
class Space:
    catalog: Catalog
    #: Additions by rules after which exploration gives up; ``complete`` tells whether it did.
    limit: int = 4000
    complete: bool = True
    groups: list[dict[str, A.Op]] = field(default_factory=list)
    columns: list[list[A.Attr]] = field(default_factory=list)
    home: dict[str, int] = field(default_factory=dict)
    origin: dict[tuple[int, str], frozenset[str]] = field(default_factory=dict)
    naive: bool = False

    # -- building --

    def add(self, op: A.Op | Ref, group: int | None = None, rules: frozenset[str] = frozenset()) -> int:
        """The group of a tree whose leaves may be ``Ref``; with ``group``, the tree joins that group."""
        if isinstance(op, Ref):
            return op.group
        kids = tuple(Ref(self.add(x, None, rules)) for x in A.inputs(op))
        flat = A.with_inputs(op, kids)
        key = repr(flat)
        if group is None:
            if key in self.home:
                return self.home[key]
            group = len(self.groups)
            self.groups.append({})
            self.columns.append(self._columns(flat))
        if key not in self.groups[group]:
            self.groups[group][key] = flat
            self.home.setdefault(key, group)
            self.origin.setdefault((group, key), rules)
        return group

    def _columns(self, op: A.Op) -> list[A.Attr]:
        """Output columns of an operator over groups: its inputs are stood in for by tables of the same columns."""
        match op:
            case A.Filter(Ref(g), _):
                return self.columns[g]
            case A.Cross(Ref(a), Ref(b)) | A.Join(_, Ref(a), Ref(b)):
                return self.columns[a] + self.columns[b]
            case A.Derived(Ref(g), alias):
                return [A.Attr(alias, c.name) for c in self.columns[g]]
            case A.Project(Ref(g), exprs, aliases):
                out = []
                for e, a in zip(exprs, aliases, strict=True):
                    if isinstance(e, A.Star):
                        out += [c for c in self.columns[g] if not e.table or c.table == e.table]
                    else:
                        out.append(A.Attr("", a) if a else e if isinstance(e, A.Attr) else A.Attr("", ""))
                return out
        return visible_columns(op, self.catalog)

    def explore(self, rules: dict[str, Rule]) -> None:
        done: set[tuple[int, str, str, int]] = set()
        moved, total = True, 0
        while moved:
            moved = False
            for g in range(len(self.groups)):
                for key, op in list(self.groups[g].items()):
                    seen = sum(len(self.groups[x.group]) for x in A.inputs(op))  # an input group that grew is tried again
                    for name, rule in rules.items():
                        mark = (g, key, name, seen)
                        if mark in done:
                            continue
                        done.add(mark)
                        for new in rule(self, op):
                            before = len(self.groups[g]), len(self.groups)
                            self.add(new, g, self.origin[g, key] | {name})
                            if (len(self.groups[g]), len(self.groups)) != before:
                                moved, total = True, total + 1
                                if total > self.limit:
                                    self.complete = False
                                    return

    def members(self, ref: A.Op, *kinds: type) -> Iterator[A.Op]:
        for op in list(self.groups[ref.group].values()):
            if isinstance(op, kinds):
                yield op

    def base(self, g: int, a: A.Attr, seen: frozenset[int] = frozenset()) -> tuple[str, str] | None:
        """Stored column behind an attribute of a group."""
        for op in self.groups[g].values():
            if isinstance(op, A.Table) and op.visible == a.table:
                return op.name, a.name
            for x in A.inputs(op):
                if x.group not in seen and (got := self.base(x.group, a, seen | {g})):
                    return got
        return None

    # -- estimates --

    def rows(self, g: int) -> int:
        """Rows of a group, from the first operator it got (all are equivalent)."""
        return self._rows(next(iter(self.groups[g].values())))

    def _rows(self, op: A.Op) -> int:
        match op:
            case A.Table():
                return self.catalog.size(op.name)
            case A.Filter(Ref(g), pred):
                return C.scaled(self.rows(g), C.selectivity(pred))
            case A.Cross(Ref(a), Ref(b)):
                return self.rows(a) * self.rows(b)
            case A.Join(_, Ref(a), Ref(b), cond):
                return C.join_rows(self.rows(a), self.rows(b), cond, self.columns[a], self.columns[b])
            case A.Aggregate(Ref(g), groups, _, _):
                return self.rows(g) if groups else 1
            case A.Project(Ref(g)) | A.Derived(Ref(g)):
                return self.rows(g)
        return 1


Rule = Callable[[Space, A.Op], Iterator[A.Op]]
RULES: dict[str, Rule] = {}


def _rule(f: Rule) -> Rule:
    RULES["".join(w.capitalize() for w in f.__name__.split("_"))] = f
    return f


_SWAP = {"inner": "inner", "full": "full", "left": "right", "right": "left"}


@_rule
def join_commutativity(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Join):
        yield A.Join(_SWAP[op.kind], op.right, op.left, op.cond)


@_rule
def join_associativity(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Join) and op.kind == "inner":
        for low in s.members(op.left, A.Join):
            if low.kind == "inner":
                inner_cols = s.columns[low.right.group] + s.columns[op.right.group]
                parts = A.conjuncts(op.cond) + A.conjuncts(low.cond)
                inside = [p for p in parts if covers(inner_cols, p)]
                outside = [p for p in parts if not covers(inner_cols, p)]
                if inside and outside:
                    yield A.Join("inner", low.left, A.Join("inner", low.right, op.right, A.conjoin(inside)), A.conjoin(outside))


@_rule
def filter_split(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Filter) and len(parts := A.conjuncts(op.pred)) > 1:
        for k, p in enumerate(parts):
            yield A.Filter(A.Filter(op.source, A.conjoin(parts[:k] + parts[k + 1 :])), p)


@_rule
def filter_merge(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Filter):
        for low in s.members(op.source, A.Filter):
            yield A.Filter(low.source, A.conjoin(A.conjuncts(low.pred) + A.conjuncts(op.pred)))


@_rule
def filter_pushdown_through_projection(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Filter):
        for low in s.members(op.source, A.Project):
            plain = {e for e, a in zip(low.exprs, low.aliases, strict=True) if isinstance(e, A.Attr) and not a}
            if A.attrs(op.pred) <= plain:
                yield A.Project(A.Filter(low.source, op.pred), low.exprs, low.aliases)


@_rule
def filter_pushdown_through_join(s: Space, op: A.Op) -> Iterator[A.Op]:
    if not isinstance(op, A.Filter):
        return
    for low in s.members(op.source, A.Join):
        parts = A.conjuncts(op.pred)
        for side, kinds in (("left", ("inner", "left")), ("right", ("inner", "right"))):
            at = getattr(low, side)
            down = [p for p in parts if covers(s.columns[at.group], p)] if low.kind in kinds else []
            if down:
                rest = [p for p in parts if p not in down]
                new = replace(low, **{side: A.Filter(at, A.conjoin(down))})
                yield A.Filter(new, A.conjoin(rest)) if rest else new


@_rule
def in_to_or_chain(s: Space, op: A.Op) -> Iterator[A.Op]:
    def spell(e: A.Expr) -> A.Expr | None:
        if isinstance(e, A.In):
            parts = [A.Bin("!=" if e.negated else "=", e.arg, v) for v in e.values]
            out = parts[0]
            for p in parts[1:]:
                out = A.Bin("and" if e.negated else "or", out, p)
            return out
        return None

    if isinstance(op, A.Filter) and (new := A.transform(op.pred, spell)) != op.pred:
        yield A.Filter(op.source, new)
    if isinstance(op, A.Join) and (new := A.transform(op.cond, spell)) != op.cond:
        yield replace(op, cond=new)


@_rule
def filter_to_join_predicate(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Filter):
        for low in s.members(op.source, A.Join):
            if low.kind == "inner":
                yield replace(low, cond=A.conjoin(A.conjuncts(low.cond) + A.conjuncts(op.pred)))


@_rule
def cross_join_to_join(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Filter):
        for low in s.members(op.source, A.Cross):
            yield A.Join("inner", low.left, low.right, op.pred)


@_rule
def filter_lift_through_join(s: Space, op: A.Op) -> Iterator[A.Op]:
    if isinstance(op, A.Join) and op.kind == "inner":
        for side in ("left", "right"):
            for low in s.members(getattr(op, side), A.Filter):
                yield A.Filter(replace(op, **{side: low.source}), low.pred)


@_rule
def projection_pushdown_through_join(s: Space, op: A.Op) -> Iterator[A.Op]:
    if not isinstance(op, A.Project) or any(isinstance(e, A.Star) for e in op.exprs):
        return
    for low in s.members(op.source, A.Join, A.Cross):
        need = {a for e in op.exprs for a in A.attrs(e)} | (A.attrs(low.cond) if isinstance(low, A.Join) else set())
        for side in ("left", "right"):
            at = getattr(low, side)
            cols = s.columns[at.group]
            keep = tuple(c for c in cols if c in need)
            if keep and len(keep) < len(cols) and all(c.table for c in keep):
                yield replace(op, source=replace(low, **{side: A.Project(at, keep, (None,) * len(keep))}))


@_rule
def outer_join_to_inner(s: Space, op: A.Op) -> Iterator[A.Op]:
    if not isinstance(op, A.Filter):
        return
    for low in s.members(op.source, A.Join):
        left, right = set(s.columns[low.left.group]), set(s.columns[low.right.group])
        no_left, no_right = null_rejecting(op.pred, left), null_rejecting(op.pred, right)
        new = {"left": "inner" if no_right else "left", "right": "inner" if no_left else "right", "full": "inner" if no_left and no_right else "left" if no_left else "right" if no_right else "full"}.get(low.kind, low.kind)
        if new != low.kind:
            yield A.Filter(replace(low, kind=new), op.pred)


def _one_equality(s: Space, join: A.Join) -> tuple[A.Attr, A.Attr] | None:
    c = join.cond
    if join.kind == "inner" and isinstance(c, A.Bin) and c.op == "=" and isinstance(c.left, A.Attr) and isinstance(c.right, A.Attr):
        lc, rc = s.columns[join.left.group], s.columns[join.right.group]
        for a, b in ((c.left, c.right), (c.right, c.left)):
            if covers(lc, a) and covers(rc, b):
                return a, b
    return None


@_rule
def aggregation_pushdown_through_join(s: Space, op: A.Op) -> Iterator[A.Op]:
    if not isinstance(op, A.Aggregate) or not op.aggs or any(n.startswith("__part") for n in op.names) or any(a.fn == "SUM0" for a in op.aggs):
        return
    for low in s.members(op.source, A.Join):
        cols = s.columns[low.left.group]
        if (keys := _one_equality(s, low)) and all(covers(cols, a.arg) for a in op.aggs if a.arg is not None) and not any(c.name.startswith("__part") for c in cols):
            own = tuple(dict.fromkeys([g for g in op.groups if covers(cols, g)] + [keys[0]]))
            part = tuple(f"__part_{n}" for n in op.names)
            above = tuple(A.Agg("SUM0" if a.fn == "COUNT" else "SUM", A.Attr("", p)) for a, p in zip(op.aggs, part, strict=True))
            yield A.Aggregate(A.Join("inner", A.Aggregate(low.left, own, op.aggs, part), low.right, low.cond), op.groups, above, op.names)


@_rule
def aggregation_join_transpose(s: Space, op: A.Op) -> Iterator[A.Op]:
    if not isinstance(op, A.Project):
        return
    for agg in s.members(op.source, A.Aggregate):
        for low in s.members(agg.source, A.Join):
            keys = _one_equality(s, low)
            if not keys or keys[0] not in agg.groups:
                continue
            here, there = s.base(low.left.group, keys[0]), s.base(low.right.group, keys[1])
            plain = any(isinstance(x, A.Table) for x in s.groups[low.right.group].values())
            if here and there and plain and s.catalog.is_unique(*there) and s.catalog.has_foreign_key(*here, *there):
                if all(covers(s.columns[low.left.group], x) for x in [*agg.groups, *[a.arg for a in agg.aggs if a.arg is not None]]):
                    yield A.Project(A.Join("inner", A.Aggregate(low.left, agg.groups, agg.aggs, agg.names), low.right, low.cond), op.exprs, op.aliases)


# --- physical plans -----------------------------------------------------------------------------------------------

Order = tuple[A.SortKey, ...]


def _seekable(s: Space, t: A.Table, pred: A.Expr) -> Iterator[A.Attr]:
    for c in A.conjuncts(pred):
        if isinstance(c, A.Bin) and c.op in ("=", "<", "<=", ">", ">="):
            for a, b in ((c.left, c.right), (c.right, c.left)):
                if isinstance(a, A.Attr) and isinstance(b, A.Int) and a.table == t.visible and (t.name, a.name) in s.catalog.sorted_indexes:
                    yield a


def _equalities(op: A.Join) -> list[A.Bin]:
    return [c for c in A.conjuncts(op.cond) if isinstance(c, A.Bin) and c.op == "=" and isinstance(c.left, A.Attr) and isinstance(c.right, A.Attr) and c.left != c.right]


def choices(s: Space, g: int) -> Iterator[tuple[Node, tuple[int, ...], tuple[Order, ...], Order, int, str]]:
    """Physical operators of a group: (node without inputs, input groups, order needed of each, order delivered or
    None if that of the first input, own cost, key of the logical operator)."""
    rows = s.rows(g)
    width = max(1, len(s.columns[g]))
    for key, op in list(s.groups[g].items()):
        kids = tuple(x.group for x in A.inputs(op))
        free: tuple[Order, ...] = ((),) * len(kids)
        n = [s.rows(k) for k in kids]
        match op:
            case A.Table(name, alias):
                yield Node("SeqScan", (name, alias)), (), (), (), C.scan(rows), key
            case A.Filter(_, pred):
                yield Node("PhysicalFilter", (pred,)), kids, free, None, C.filter_(rows), key
                if not s.naive:
                    for t in s.members(op.source, A.Table):
                        for a in dict.fromkeys(_seekable(s, t, pred)):
                            yield Node("IndexSeek", (pred, t.name, t.alias)), (), (), (A.SortKey(a),), C.seek(rows), key
            case A.Project(_, exprs, aliases):
                yield Node("PhysicalProjection", (exprs, aliases)), kids, free, None, C.projection(rows), key
            case A.Cross():
                yield Node("NestedLoopCrossJoin"), kids, free, (), C.cross(*n), key
            case A.Join(kind, _, _, cond):
                yield Node("NestedLoopJoin", (kind, cond)), kids, free, (), C.nested_loop(*n), key
                equal = [] if s.naive else _equalities(op)
                if equal and kind == "inner":
                    yield Node("HashJoin", (kind, cond)), kids, free, (), C.hash_join(n[0], max(1, len(s.columns[kids[0]])), n[1], rows, width), key
                if len(equal) == 1 and equal[0] == cond:
                    a, b = (equal[0].left, equal[0].right) if covers(s.columns[kids[0]], equal[0].left) else (equal[0].right, equal[0].left)
                    need = (A.SortKey(a),), (A.SortKey(b),)
                    yield Node("MergeJoin", (kind, cond)), kids, need, need[kind == "right"] if kind != "full" else (), C.merge_join(*n, rows, width), key
            case A.Aggregate(_, groups, aggs, names):
                kind = "FinalAggregate" if any("__part_" in A.show(a) for a in aggs) else "PartialAggregate" if any(x.startswith("__part") for x in names) else "HashAggregate"
                yield Node(kind, (groups, aggs, names)), kids, free, (), C.hash_aggregate(n[0]), key
                if groups and not s.naive and kind == "HashAggregate" and all(isinstance(x, A.Attr) for x in groups):
                    order = tuple(A.SortKey(x) for x in groups)
                    yield Node("StreamAggregate", (groups, aggs, names)), kids, (order,), order, C.stream_aggregate(n[0]), key
            case A.Derived():
                yield Node("SeqScan", ("(derived)", op.alias)), (), (), (), C.scan(rows), key
            case A.Empty():
                yield Node("SeqScan", ("_EMPTY_TABLE_", None)), (), (), (), C.scan(1), key


def _satisfies(have: Order, need: Order) -> bool:
    return have[: len(need)] == need


@dataclass(frozen=True)
class Winner:
    cost: int
    plan: Node
    order: Order
    rules: frozenset[str]


def best(s: Space, g: int, need: Order = (), _busy: frozenset = frozenset(), _memo: dict | None = None) -> Winner | None:
    """The cheapest plan of a group that delivers ``need``."""
    memo = {} if _memo is None else _memo
    if (g, need) in memo:
        return memo[g, need]
    if (g, need) in _busy:
        return None
    busy = _busy | {(g, need)}
    found: Winner | None = None
    cut = False
    rows = s.rows(g)
    for node, kids, needs, order, own, key in choices(s, g):
        asks = [needs]
        if order is None and need and covers(s.columns[kids[0]], A.conjoin([k.attr for k in need])):
            asks.append((need,))  # an operator that keeps order may pass the demand on
        for each in asks:
            parts = [best(s, k, o, busy, memo) for k, o in zip(kids, each, strict=True)]
            if None in parts:
                cut = True
                continue
            have = parts[0].order if order is None else order
            total = own + sum(p.cost for p in parts)
            plan = replace(node, inputs=tuple(p.plan for p in parts), rows=rows, cost=total)
            rules = frozenset().union(s.origin[g, key], {f"Implement{node.kind}"}, *[p.rules for p in parts])
            if not _satisfies(have, need):
                if not all(covers(s.columns[g], k.attr) for k in need):
                    continue
                total += C.sort(rows)
                plan = Node("Sort", (need,), (plan,), rows, total)
                rules, have = rules | {"SortEnforcer"}, need
            if found is None or total < found.cost:
                found = Winner(total, plan, have, rules)
    if found is not None and not (cut and _busy):
        memo[g, need] = found
    return found


@dataclass(frozen=True)
class Optimized:
    plan: Node
    cost: int
    rules: frozenset[str]
    complete: bool = True


def space_of(q: A.Query, catalog: Catalog, naive: bool = False, limit: int = Space.limit) -> tuple[Space, int]:
    s = Space(catalog, limit, naive=naive)
    root = s.add(rewrite_group_exprs(q.op))
    if not naive:
        s.explore(RULES)
    return s, root


def optimize(q: A.Query, catalog: Catalog, naive: bool = False, limit: int = Space.limit) -> Optimized:
    """The cheapest plan; where the search gave up (not ``complete``), the cheapest of those it had come to."""
    s, root = space_of(q, catalog, naive, limit)
    w = best(s, root, q.order)
    if w is None:
        raise RuntimeError("no plan")
    return Optimized(w.plan, w.cost, w.rules, s.complete)


# --- reachability -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reach:
    """Without ``complete``, a plan that is not reachable in the explored part may still be, and the distance is a bound."""

    reachable: bool
    distance: int
    mismatch: str = ""
    complete: bool = True


def _same_label(a: Node, b: Node) -> str:
    """Empty if two operators agree, else what differs."""
    if a.kind != b.kind:
        return f"operator: {a.kind} and {b.kind}"
    if a.kind in ("PhysicalFilter", "IndexSeek"):
        return "" if equivalent(a.args[0], b.args[0]) and a.args[1:] == b.args[1:] else "predicate"
    if a.kind in ("NestedLoopJoin", "HashJoin", "MergeJoin"):
        return "join type" if a.args[0] != b.args[0] else "" if equivalent(a.args[1], b.args[1]) else "join qual"
    if a.kind.endswith("Aggregate"):
        same = set(map(canonical, a.args[0])) == set(map(canonical, b.args[0])) and list(map(canonical, a.args[1])) == list(map(canonical, b.args[1]))
        return "" if same else "aggregation"
    if a.kind == "PhysicalProjection":
        return "" if a.args[0] == b.args[0] else "projection"
    return "" if a.args == b.args else {"Sort": "sort keys", "SeqScan": "table"}.get(a.kind, "arguments")


def reach(target: Node, q: A.Query, catalog: Catalog, limit: int = Space.limit) -> Reach:
    """Whether the search space holds ``target``, and how far the nearest plan is: changed, removed and added operators
    each count one, inputs are compared in order."""
    s, root = space_of(q, catalog, limit=limit)
    target = target.bare()
    reasons: dict[int, str] = {}

    @cache
    def smallest(g: int) -> int:
        return best(s, g).plan.size()

    busy: set[tuple[int, int]] = set()
    memo: dict[tuple[int, int], int] = {}
    nodes: list[Node] = []

    def number(n: Node) -> int:
        for k, x in enumerate(nodes):
            if x is n:
                return k
        nodes.append(n)
        return len(nodes) - 1

    def near(t: Node, g: int) -> int:
        mark = (number(t), g)
        if mark in memo:
            return memo[mark]
        if mark in busy:
            return 10**6
        busy.add(mark)
        found = 10**6
        sorts = [(Node("Sort", (o,)), (g,), (o,)) for o in sorted({needs[k] for _, _, needs, _, _, _ in choices(s, g) for k in range(len(needs)) if needs[k]}, key=repr)] if t.kind == "Sort" else []
        for node, kids, *_ in [*choices(s, g), *sorts]:
            why = _same_label(t, node)
            if why and mark[0] not in reasons:
                reasons[mark[0]] = why
            if node.kind == "Sort" and why:
                continue
            found = min(found, bool(why) + forest(t.inputs, kids))
            if not found:
                break
        if found:
            for x in t.inputs:  # leave the target's operator out
                rest = sum(y.size() for y in t.inputs if y is not x)
                found = min(found, 1 + rest + near(x, g))
        busy.discard(mark)
        memo[mark] = found
        return found

    def forest(ts: tuple[Node, ...], gs: tuple[int, ...]) -> int:
        """Edit distance of two lists of inputs."""
        row = [0]
        for g in gs:
            row.append(row[-1] + smallest(g))
        for t in ts:
            new = [row[0] + t.size()]
            for j, g in enumerate(gs):
                new.append(min(row[j + 1] + t.size(), new[-1] + smallest(g), row[j] + near(t, g)))
            row = new
        return row[-1]

    def at_root(t: Node) -> int:
        if not q.order:
            return near(t, root)
        if t.kind == "Sort":
            same = t.args[0] == q.order
            if not same:
                reasons[number(t)] = "sort keys"
            return (not same) + near(t.inputs[0], root)
        w = best(s, root, q.order)
        reasons.setdefault(number(t), "sort")
        return 0 if w.plan.kind != "Sort" and w.plan.bare() == t else 1 + near(t, root)

    d = at_root(target)
    return Reach(d == 0, d, "" if d == 0 else next(iter(reasons.values()), "operator"), s.complete)
