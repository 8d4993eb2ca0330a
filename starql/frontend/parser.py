"""Lexer and recursive-descent parser of the SELECT dialect.

Precedence from loose to tight: OR, AND, NOT, IS, comparison, BETWEEN / IN, + -, * / %, ^, sign.  What the dialect does
not have is refused by name (``NotSupported``) instead of being dropped."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ConversionError, NotSupported, SyntaxProblem
from . import ast as A

_LEX = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<special>[EeBbXxNn]'|[Uu]&['"])
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")+")
      |(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      |(?P<based>0[xXoObB][0-9a-fA-F_]+)
      |(?P<int>\d+)
      |(?P<word>[A-Za-z_\u0080-￿][A-Za-z0-9_$\u0080-￿]*)
      |(?P<op>::|<=|>=|<>|!=|<<|>>|\|\||[-+*/%^=<>(),.;\[\]:&|~@#?!$])""",
    re.VERBOSE | re.DOTALL,
)

# Words that can't be a bare name or alias.
RESERVED = set(
    """all and any array as asc between by case cast check collate create cross desc distinct else end except exists false fetch
    filter for from full group having in inner intersect into is isnull join lateral left like ilike limit natural not notnull null
    offset on or order outer over right select similar some table tablesample then true union unknown using when where window with""".split()
)
STATEMENTS = set("insert update delete merge create drop alter truncate copy explain analyze begin commit rollback set show grant revoke vacuum call do declare execute prepare values table with".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _LEX.match(sql, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup == "special":
            raise NotSupported(f"prefixed literal at {at}")
        if m.lastgroup in ("float", "based"):
            raise NotSupported(f"{'non-decimal' if m.lastgroup == 'based' else 'fractional'} number {m[0]}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    out.append(Token("end", "", at))
    return out


def parse(sql: str) -> A.Query:
    """The query of a text with exactly one SELECT statement (a trailing semicolon is allowed)."""
    return _Parser(tokenize(sql)).statement()


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0

    # -- tokens --

    @property
    def cur(self) -> Token:
        return self.t[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def at(self, *words: str) -> bool:
        return self.cur.kind in ("word", "op") and self.cur.low in words

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SyntaxProblem(f"expected {word!r} at {self.cur.at}, found {self.cur.text or 'end of text'!r}")

    def refuse(self, *words: str) -> None:
        if self.at(*words):
            raise NotSupported(f"{self.cur.text.upper()} at {self.cur.at}")

    def name(self, what: str) -> str:
        c = self.cur
        if c.kind == "quoted":
            self.i += 1
            return c.text[1:-1].replace('""', '"')
        if c.kind == "word" and c.low not in RESERVED:
            self.i += 1
            return c.text
        raise SyntaxProblem(f"expected {what} at {c.at}, found {c.text or 'end of text'!r}")

    # -- statements --

    def statement(self) -> A.Query:
        if self.cur.kind == "end" or self.at(";"):
            while self.take(";"):
                pass
            if self.cur.kind == "end":
                return A.Query(A.Empty())
        if self.cur.kind == "word" and self.cur.low in STATEMENTS:
            raise NotSupported(f"statement {self.cur.text.upper()}")
        q = self.query()
        while self.take(";"):
            pass
        if self.cur.kind != "end":
            self.refuse("select", *STATEMENTS)
            raise SyntaxProblem(f"unexpected {self.cur.text!r} at {self.cur.at}")
        return q

    def query(self) -> A.Query:
        if self.at("(") and self.opens_select():
            self.i += 1
            inner = self.query()
            self.need(")")
            return A.Query(inner.op, self.order() or inner.order)
        self.refuse("with", "values", "table")
        op = self.select()
        return A.Query(op, self.order())

    def opens_select(self) -> bool:
        k = 0
        while self.peek(k).text == "(":
            k += 1
        return self.peek(k).low in ("select", "with", "values")

    def select(self) -> A.Op:
        self.need("select")
        self.refuse("distinct", "all")
        targets: list[tuple[A.Expr, str | None]] = []
        if not (self.at("from", "where", "group", ";", ")", "order") or self.cur.kind == "end"):
            targets.append(self.target())
            while self.take(","):
                targets.append(self.target())
        self.refuse("into")
        source: A.Op = A.Empty()
        if self.take("from"):
            source = self.table_ref()
            while self.take(","):
                source = A.Cross(source, self.table_ref())
        if self.take("where"):
            pred = self.expr()
            if any(isinstance(x, A.Agg) for x in A.walk(pred)):
                raise NotSupported("aggregate in WHERE")
            source = A.Filter(source, pred)
        groups: list[A.Expr] = []
        grouped = False
        if self.take("group"):
            self.need("by")
            grouped = True
            groups.append(self.group())
            while self.take(","):
                groups.append(self.group())
        self.refuse("having", "window", "union", "except", "intersect")
        return self.finish(targets, source, groups, grouped)

    def group(self) -> A.Expr:
        if self.cur.kind == "word" and (self.cur.low in ("rollup", "cube") and self.peek().text == "(" or self.cur.low == "grouping" and self.peek().low == "sets"):
            raise NotSupported(f"GROUP BY {self.cur.text.upper()}")
        if self.at("(") and self.peek().text == ")":
            raise NotSupported("empty grouping set")
        self.refuse("distinct", "all")
        e = self.expr()
        if isinstance(e, A.Int):
            raise NotSupported("GROUP BY ordinal")
        if any(isinstance(x, A.Agg) for x in A.walk(e)):
            raise NotSupported("aggregate in GROUP BY")
        return e

    @staticmethod
    def finish(targets: list[tuple[A.Expr, str | None]], source: A.Op, groups: list[A.Expr], grouped: bool) -> A.Op:
        found = list(dict.fromkeys(x for e, _ in targets for x in A.walk(e) if isinstance(x, A.Agg)))
        if grouped or found:
            names = tuple(f"__agg{k}" for k in range(len(found)))
            place = {a: A.Attr("", n) for a, n in zip(found, names, strict=True)}
            source = A.Aggregate(source, tuple(dict.fromkeys(groups)), tuple(found), names)
            if any(isinstance(e, A.Star) for e, _ in targets):
                raise NotSupported("* in a grouped query")
            targets = [(A.transform(e, place.get), a or (A.show(e).lower() if isinstance(e, A.Agg) else None)) for e, a in targets]
        if len(targets) == 1 and targets[0][0] == A.Star() or not targets:
            return source
        return A.Project(source, tuple(e for e, _ in targets), tuple(a for _, a in targets))

    def target(self) -> tuple[A.Expr, str | None]:
        if self.take("*"):
            return A.Star(), None
        if self.cur.kind in ("word", "quoted") and self.peek().text == "." and self.peek(2).text == "*":
            table = self.name("table")
            self.i += 2
            return A.Star(table), None
        e = self.expr()
        if self.take("as"):
            c = self.cur
            if c.kind == "word":
                self.i += 1
                return e, c.text
            return e, self.name("alias")
        if self.cur.kind == "quoted" or self.cur.kind == "word" and self.cur.low not in RESERVED:
            return e, self.name("alias")
        return e, None

    def order(self) -> tuple[A.SortKey, ...]:
        keys: list[A.SortKey] = []
        if self.take("order"):
            self.need("by")
            while True:
                e = self.expr()
                if not isinstance(e, A.Attr):
                    raise NotSupported("ORDER BY takes columns only")
                self.refuse("using", "nulls")
                down = self.take("desc")
                if not down:
                    self.take("asc")
                self.refuse("nulls")
                keys.append(A.SortKey(e, down))
                if not self.take(","):
                    break
        self.refuse("limit", "offset", "fetch", "for", "union", "except", "intersect")
        return tuple(keys)

    # -- FROM --

    def table_ref(self) -> A.Op:
        left = self.table_primary()
        while True:
            self.refuse("natural", "tablesample")
            if self.take("cross"):
                self.need("join")
                left = A.Cross(left, self.table_primary())
                continue
            kind = "inner"
            if self.at("left", "right", "full"):
                kind = self.cur.low
                self.i += 1
                self.take("outer")
                self.need("join")
            elif self.take("inner"):
                self.need("join")
            elif not self.take("join"):
                return left
            right = self.table_primary()
            self.refuse("using")
            self.need("on")
            left = A.Join(kind, left, right, self.no_aggregates(self.expr(), "ON"))

    @staticmethod
    def no_aggregates(e: A.Expr, where: str) -> A.Expr:
        if any(isinstance(x, A.Agg) for x in A.walk(e)):
            raise NotSupported(f"aggregate in {where}")
        return e

    def table_primary(self) -> A.Op:
        self.refuse("lateral", "only", "unnest", "xmltable", "rows", "values")
        if self.at("("):
            if self.opens_select():
                self.i += 1
                inner = self.query()
                self.need(")")
                alias = self.alias()
                return A.Derived(inner.op, alias) if alias else inner.op
            self.i += 1
            inner_ref = self.table_ref()
            self.need(")")
            if self.alias():
                raise NotSupported("alias of a parenthesised join")
            return inner_ref
        table = self.name("table")
        if self.at("."):
            raise NotSupported("schema-qualified table")
        if self.at("("):
            raise NotSupported("table function")
        if self.at("*"):
            raise NotSupported("table *")
        return A.Table(table, self.alias())

    def alias(self) -> str | None:
        if self.take("as"):
            got = self.name("alias")
        elif self.cur.kind == "quoted" or self.cur.kind == "word" and self.cur.low not in RESERVED:
            got = self.name("alias")
        else:
            return None
        if self.at("("):
            raise NotSupported("alias with a column list")
        return got

    # -- expressions --

    def expr(self) -> A.Expr:
        e = self.conjunction()
        while self.take("or"):
            e = A.Bin("or", e, self.conjunction())
        return e

    def conjunction(self) -> A.Expr:
        e = self.negation()
        while self.take("and"):
            e = A.Bin("and", e, self.negation())
        return e

    def negation(self) -> A.Expr:
        if self.take("not"):
            return A.Un("not", self.negation())
        return self.test()

    def test(self) -> A.Expr:
        e = self.comparison()
        while True:
            if self.take("isnull"):
                e = A.Un("isnull", e)
            elif self.take("notnull"):
                e = A.Un("not", A.Un("isnull", e))
            elif self.take("is"):
                negated = self.take("not")
                if self.take("null"):
                    e = A.Un("isnull", e)
                elif self.at("true", "false", "unknown"):
                    e = A.Is(e, self.cur.low.upper())
                    self.i += 1
                else:
                    self.refuse("distinct", "of", "document", "normalized", "json")
                    raise SyntaxProblem(f"unexpected {self.cur.text!r} after IS at {self.cur.at}")
                if negated:
                    e = A.Un("not", e)
            else:
                return e

    def comparison(self) -> A.Expr:
        e = self.range()
        if self.at("=", "<>", "!=", "<", "<=", ">", ">="):
            op = {"<>": "!="}.get(self.cur.text, self.cur.text)
            self.i += 1
            self.refuse("any", "all", "some")
            e = A.Bin(op, e, self.range())
            if self.at("=", "<>", "!=", "<", "<=", ">", ">="):
                raise SyntaxProblem(f"chained comparison at {self.cur.at}")
        return e

    def range(self) -> A.Expr:
        e = self.sum()
        negated = self.at("not") and self.peek().low in ("between", "in", "like", "ilike", "similar")
        if negated:
            self.i += 1
        self.refuse("like", "ilike", "similar")
        if self.take("between"):
            self.refuse("symmetric")
            self.take("asymmetric")
            low = self.sum()
            self.need("and")
            e = A.Bin("and", A.Bin(">=", e, low), A.Bin("<=", e, self.sum()))
            return A.Un("not", e) if negated else e
        if self.take("in"):
            self.need("(")
            self.refuse("select", "with", "values")
            values = [self.expr()]
            while self.take(","):
                values.append(self.expr())
            self.need(")")
            return A.In(e, tuple(values), negated)
        return e

    def sum(self) -> A.Expr:
        e = self.product()
        while self.at("+", "-"):
            op = self.cur.text
            self.i += 1
            e = A.Bin(op, e, self.product())
        self.refuse("<<", ">>", "||", "&", "|", "#", "~", "@", "?")
        return e

    def product(self) -> A.Expr:
        e = self.power()
        while self.at("*", "/", "%"):
            op = self.cur.text
            self.i += 1
            e = A.Bin(op, e, self.power())
        return e

    def power(self) -> A.Expr:
        e = self.sign()
        while self.take("^"):
            e = A.Bin("^", e, self.sign())
        return e

    def sign(self) -> A.Expr:
        if self.take("-"):
            if self.cur.kind == "int" and self.peek().text != "^" and self.cur.text == "9223372036854775808":
                self.i += 1
                return A.Int(-(2**63))
            return A.Un("-", self.sign())
        if self.take("+"):
            return self.sign()
        e = self.primary()
        self.refuse("::", "[", "collate")
        if self.at("at") and self.peek().low == "time":
            raise NotSupported("AT TIME ZONE")
        return e

    def primary(self) -> A.Expr:
        c = self.cur
        if c.kind == "int":
            self.i += 1
            if int(c.text) >= 2**63:
                raise ConversionError(f"{c.text} does not fit into 64 bits")
            return A.Int(int(c.text))
        if c.kind == "string":
            self.i += 1
            return A.Str(c.text[1:-1].replace("''", "'"))
        if self.at("true", "false", "null"):
            self.i += 1
            return A.Lit(c.low.upper())
        if self.at("("):
            if self.opens_select():
                raise NotSupported("subquery expression")
            self.i += 1
            e = self.expr()
            if self.at(","):
                raise NotSupported("row constructor")
            self.need(")")
            return e
        self.refuse("case", "cast", "exists", "array", "any", "all", "some", "$", "?", ":", "default", "interval", "row")
        if c.kind in ("word", "quoted"):
            if c.kind == "word" and self.peek().text == "(":
                return self.call()
            first = self.name("expression")
            if self.take("."):
                second = self.name("column")
                if self.at("."):
                    raise NotSupported("schema-qualified column")
                return A.Attr(first, second)
            return A.Attr("", first)
        raise SyntaxProblem(f"expected an expression at {c.at}, found {c.text or 'end of text'!r}")

    def call(self) -> A.Expr:
        fn = self.cur.low
        if fn not in ("sum", "count"):
            raise NotSupported(f"function {self.cur.text}")
        self.i += 2
        self.refuse("distinct", "all", "variadic")
        arg: A.Expr | None = None
        if self.take("*"):
            if fn != "count":
                raise NotSupported(f"{fn.upper()}(*)")
        else:
            arg = self.expr()
            if any(isinstance(x, A.Agg) for x in A.walk(arg)):
                raise NotSupported("nested aggregate")
            if self.at(","):
                raise NotSupported(f"{fn.upper()} takes one argument")
        self.refuse("order")
        self.need(")")
        if self.at("over", "filter", "within") and (self.peek().text == "(" or self.peek().low == "group"):
            raise NotSupported(f"{self.cur.text.upper()} after an aggregate")
        return A.Agg(fn.upper(), arg)
