"""Integer and string views over the driver's Parquet tables: the dialect has no fractions and no dates.

Money becomes cents, dates become ``yyyymmdd``.  Each view exists twice, as a DataFrame and as DuckDB text.  The star
schema (``lineorder`` and its dimensions) is loaded once for a session: integer columns, the fact sorted by date, so
comparisons with constants reach the Parquet footers and no query derives a dimension again."""

from __future__ import annotations

from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, ForeignKey
from ..sources.sorted_table import write_sorted
from ..sources.stored import files_for, stored, stored_small, stored_sorted


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def _date(c: str):
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("long")


@lru_cache(maxsize=8)
def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """One catalog for each session and folder: schemas and file lists are read once, data never kept."""

    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def located(table: str, p: str, key: str) -> DataFrame:
        """Customers or suppliers with nation, region and city."""
        n = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        df = read(table).join(n, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        city = F.concat(F.col("n_name"), F.lit("#"), (F.col(key) % 10).cast("string"))
        out = df.select(F.col(key), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"), city.alias(f"{p}_city"))
        return stored_small(out, f"{sf_dir} {table}_dim")

    def lineorder() -> DataFrame:
        price, off = _cents("l_extendedprice"), _cents("l_discount")
        out = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("lo_orderkey"), F.col("l_linenumber").cast("long").alias("lo_linenumber"), F.col("o_custkey").alias("lo_custkey"),
            F.col("l_partkey").alias("lo_partkey"), F.col("l_suppkey").alias("lo_suppkey"), _date("o_orderdate").alias("lo_orderdate"), F.col("l_quantity").cast("long").alias("lo_quantity"),
            price.alias("lo_extendedprice"), off.alias("lo_discount"), (price * (100 - off)).alias("lo_revenue"), (price * 60).alias("lo_supplycost"),
        )
        return stored_sorted(out, f"{sf_dir} lineorder", "lo_orderdate", files_for(spark, read("lineitem"), read("orders")))

    def date_dim() -> DataFrame:
        d = F.col("o_orderdate")
        week = (F.floor((F.dayofyear(d) - 1) / 7) + 1).cast("long")
        out = read("orders").select(_date("o_orderdate").alias("d_datekey"), F.year(d).cast("long").alias("d_year"), (F.year(d) * 100 + F.month(d)).cast("long").alias("d_yearmonthnum"), week.alias("d_weeknuminyear")).distinct()
        return stored_small(out.coalesce(1), f"{sf_dir} date_dim")

    def part_dim() -> DataFrame:
        k = F.substring("p_brand", 7, 4).cast("long")
        maker = F.concat(F.lit("MFGR#"), (F.floor((k - 1) / 5) + 1).cast("long").cast("string"))
        out = read("part").select("p_partkey", "p_brand", maker.alias("p_mfgr"), F.concat(maker, (k % 5 + 1).cast("string")).alias("p_category"))
        return stored_small(out, f"{sf_dir} part_dim")

    def items() -> DataFrame:
        return read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("l_quantity"),
            _cents("l_extendedprice").alias("l_extendedprice"), _cents("l_discount").alias("l_discount"), "l_returnflag", "l_linestatus", _date("l_shipdate").alias("l_shipdate"),
        )

    def holes() -> DataFrame:
        i = items()
        gap = lambda c, v: F.when(F.col(c) != v, F.col(c))
        return i.select("l_orderkey", "l_quantity", gap("l_linenumber", 3).alias("x"), gap("l_linenumber", 5).alias("y"), gap("l_returnflag", "R").alias("f"))

    def orders() -> DataFrame:
        return read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", _cents("o_totalprice").alias("o_totalprice"), _date("o_orderdate").alias("o_orderdate"), "o_orderpriority")

    def sorted_orders() -> str:
        return stored(spark, f"{sf_dir} sorted orders", lambda path: write_sorted(orders(), path, "o_orderkey", files_for(spark, read("orders"))))

    c = Catalog(spark)
    c.add("t_region", lambda: read("region")).add("t_nation", lambda: read("nation"))
    c.add("t_customer", lambda: read("customer").select("c_custkey", "c_name", "c_nationkey", _cents("c_acctbal").alias("c_acctbal"), "c_mktsegment"))
    c.add("t_supplier", lambda: read("supplier").select("s_suppkey", "s_name", "s_nationkey", _cents("s_acctbal").alias("s_acctbal")))
    c.add("t_part", lambda: read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", _cents("p_retailprice").alias("p_retailprice")))
    c.add("t_orders", orders).add("s_orders", lambda: spark.read.schema(orders().schema).parquet(sorted_orders()))
    c.sorted_indexes.add(("s_orders", "o_orderkey"))
    c.add("t_lineitem", items).add("holes", holes)
    c.add("lineorder", lineorder).add("date_dim", date_dim).add("part_dim", part_dim)
    c.add("customer_dim", lambda: located("customer", "c", "c_custkey")).add("supplier_dim", lambda: located("supplier", "s", "s_suppkey"))
    c.readers = {name: cache(reader) for name, reader in c.readers.items()}
    c.unique |= {("t_orders", "o_orderkey"), ("t_part", "p_partkey"), ("t_supplier", "s_suppkey"), ("t_customer", "c_custkey"), ("t_nation", "n_nationkey"), ("t_region", "r_regionkey")}
    c.foreign_keys |= {ForeignKey("t_lineitem", "l_orderkey", "t_orders", "o_orderkey"), ForeignKey("t_lineitem", "l_partkey", "t_part", "p_partkey"), ForeignKey("t_orders", "o_custkey", "t_customer", "c_custkey"), ForeignKey("t_nation", "n_regionkey", "t_region", "r_regionkey")}
    return c


def _d(c: str) -> str:
    return f"CAST(year({c})*10000+month({c})*100+day({c}) AS BIGINT)"


def _c(c: str) -> str:
    return f"CAST(ROUND({c}*100) AS BIGINT)"


_CITY = "concat(n_name, '#', CAST({k} % 10 AS VARCHAR))"
_K = "CAST(substring(p_brand, 7) AS BIGINT)"
_MAKER = f"concat('MFGR#', CAST(CAST(FLOOR(({_K}-1)/5) AS BIGINT)+1 AS VARCHAR))"

#: The same views as DuckDB text.
SQL = {
    "t_region": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
    "t_nation": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "t_customer": f"SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, {_c('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer",
    "t_supplier": f"SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, {_c('s_acctbal')} AS s_acctbal FROM supplier",
    "t_part": f"SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, {_c('p_retailprice')} AS p_retailprice FROM part",
    "t_orders": f"SELECT o_orderkey, o_custkey, o_orderstatus, {_c('o_totalprice')} AS o_totalprice, {_d('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders",
    "s_orders": f"SELECT o_orderkey, o_custkey, o_orderstatus, {_c('o_totalprice')} AS o_totalprice, {_d('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders",
    "t_lineitem": f"SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, {_c('l_extendedprice')} AS l_extendedprice, {_c('l_discount')} AS l_discount, l_returnflag, l_linestatus, {_d('l_shipdate')} AS l_shipdate FROM lineitem",
    "holes": "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(NULLIF(l_linenumber, 3) AS BIGINT) AS x, CAST(NULLIF(l_linenumber, 5) AS BIGINT) AS y, NULLIF(l_returnflag, 'R') AS f FROM lineitem",
    "lineorder": f"SELECT l_orderkey AS lo_orderkey, CAST(l_linenumber AS BIGINT) AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey, {_d('o_orderdate')} AS lo_orderdate, CAST(l_quantity AS BIGINT) AS lo_quantity, {_c('l_extendedprice')} AS lo_extendedprice, {_c('l_discount')} AS lo_discount, {_c('l_extendedprice')}*(100-{_c('l_discount')}) AS lo_revenue, {_c('l_extendedprice')}*60 AS lo_supplycost FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
    "date_dim": f"SELECT DISTINCT {_d('o_orderdate')} AS d_datekey, CAST(year(o_orderdate) AS BIGINT) AS d_year, CAST(year(o_orderdate)*100+month(o_orderdate) AS BIGINT) AS d_yearmonthnum, CAST((dayofyear(o_orderdate)-1)//7+1 AS BIGINT) AS d_weeknuminyear FROM orders",
    "part_dim": f"SELECT p_partkey, p_brand, {_MAKER} AS p_mfgr, concat({_MAKER}, CAST({_K} % 5 + 1 AS VARCHAR)) AS p_category FROM part",
    "customer_dim": f"SELECT c_custkey, n_name AS c_nation, r_name AS c_region, {_CITY.format(k='c_custkey')} AS c_city FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    "supplier_dim": f"SELECT s_suppkey, n_name AS s_nation, r_name AS s_region, {_CITY.format(k='s_suppkey')} AS s_city FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
}
