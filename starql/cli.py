"""Command line: a query on standard input over a folder of typed CSV files.

``python -m starql --data-dir DIR [--print-plan] [--print-ast] [--jit] [--stats] [--dump-dot DIR] < query.sql``
``python -m starql --check-reachable PLAN_FILE [--data-dir DIR] < query.sql``

Exit codes: 0 done, 64 usage, 1 parse error, 2 planning error, 3 runtime error, 4 plan not reachable, 5 search given up
before the plan was found.
``--jit`` turns whole-stage code generation on, which otherwise follows the session; ``--dump-dot`` writes the plans."""

from __future__ import annotations

import sys
import time
from pathlib import Path

from .engine import Engine
from .errors import QueryError
from .frontend.ast import to_sexpr
from .frontend.parser import parse
from .plans.physical import deserialize, serialize, to_dot
from .plans.search import optimize, reach
from .sources import Catalog, csv_catalog
from .sources.sinks import tab_separated

OK, USAGE, PARSE, PLAN, RUNTIME, NOT_REACHABLE, GAVE_UP = 0, 64, 1, 2, 3, 4, 5


class _Usage(Exception):
    pass


def _arguments(argv: list[str]) -> dict:
    out: dict = {"--data-dir": "", "--check-reachable": "", "--dump-dot": "", "--print-plan": False, "--print-ast": False, "--jit": False, "--stats": False}
    rest = iter(argv)
    for a in rest:
        if a not in out:
            raise _Usage(f"unknown argument: {a}")
        if isinstance(out[a], bool):
            out[a] = True
        else:
            out[a] = next(rest, "")
            if not out[a]:
                raise _Usage(f"{a} requires an argument")
    if not out["--data-dir"] and not out["--check-reachable"]:
        raise _Usage("usage: starql --data-dir DIR [--print-plan] [--print-ast] [--jit] [--stats] < query.sql")
    return out


def main(argv: list[str] | None = None, text: str | None = None, spark=None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = _arguments(sys.argv[1:] if argv is None else argv)
    except _Usage as e:
        print(e, file=err)
        return USAGE
    plan_text = None
    if args["--check-reachable"]:
        try:
            plan_text = Path(args["--check-reachable"]).read_text()
        except OSError:
            print(f"cannot open plan file: {args['--check-reachable']}", file=err)
            return USAGE
        try:
            target = deserialize(plan_text)
        except QueryError as e:
            print(f"plan parse error: {e}", file=err)
            return PARSE
    sql = sys.stdin.read() if text is None else text
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("starql").config("spark.ui.enabled", "false").getOrCreate()
    if plan_text is not None:
        try:
            cat = csv_catalog(spark, args["--data-dir"]) if args["--data-dir"] else _open_catalog(spark, sql)
            found = reach(target, parse(sql), cat)
        except Exception as e:
            print(f"reachability error: {e}", file=err)
            return PLAN
        if not found.reachable and not found.complete:
            print(f"UNDECIDED distance<={found.distance}: search given up", file=out)
            return GAVE_UP
        print(f"REACHABLE distance={found.distance}" if found.reachable else f"NOT REACHABLE distance={found.distance}: {found.mismatch}", file=out)
        return OK if found.reachable else NOT_REACHABLE
    try:
        query = parse(sql)
    except QueryError as e:
        print(f"parse error: {e}", file=err)
        return PARSE
    if args["--print-ast"]:
        print(to_sexpr(query.op), file=err)
    try:
        cat = csv_catalog(spark, args["--data-dir"])
        if args["--print-plan"] or args["--stats"] or args["--dump-dot"]:
            chosen, naive = optimize(query, cat), optimize(query, cat, naive=True)
            if args["--print-plan"]:
                print(serialize(chosen.plan), file=err)
            if args["--stats"]:
                for r in sorted(chosen.rules):
                    print(f"RULE {r}", file=err)
            if args["--dump-dot"]:
                folder = Path(args["--dump-dot"])
                folder.mkdir(parents=True, exist_ok=True)
                stamp = time.strftime("%Y%m%d-%H%M%S")
                (folder / f"{stamp}.dot").write_text(to_dot(chosen.plan) + to_dot(naive.plan))
        relation = Engine(cat).relation(query)
    except Exception as e:
        print(f"optimizer error: {e}", file=err)
        return PLAN
    old = spark.conf.get("spark.sql.codegen.wholeStage")
    try:
        if args["--jit"]:
            spark.conf.set("spark.sql.codegen.wholeStage", "true")
        began = time.time()
        result = tab_separated(relation, bool(query.order))
        took = int((time.time() - began) * 1e6)
    except Exception as e:
        print(f"runtime error: {e}", file=err)
        return RUNTIME
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", old)
    out.write(result)
    if args["--stats"]:
        print(f"STATS plan_cost={chosen.cost} naive_plan_cost={naive.cost} exec_us={took} rows={result.count(chr(10)) - 1}" + " search=incomplete" * (not chosen.complete), file=err)
    return OK


def _open_catalog(spark, sql: str) -> Catalog:
    """Without data, tables have the columns that the query names."""
    from .frontend import ast as A

    query = parse(sql)
    named: dict[str, set[str]] = {}

    def visit(op: A.Op) -> None:
        exprs = [getattr(op, f) for f in ("pred", "cond") if hasattr(op, f)] + [e for f in ("exprs", "groups", "aggs") for e in getattr(op, f, ())]
        for a in (x for e in exprs for x in A.attrs(e)):
            named.setdefault(a.table, set()).add(a.name)
        for x in A.inputs(op):
            visit(x)

    visit(query.op)
    cat = Catalog(spark)
    for t in A.scans(query.op):
        cat._schemas[t.name] = sorted(set(cat._schemas.get(t.name, [])) | named.get(t.visible, set()) | {k.attr.name for k in query.order if k.attr.table == t.visible})
    return cat


if __name__ == "__main__":
    sys.exit(main())
