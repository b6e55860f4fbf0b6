"""The registered queries of the relational operators, each with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import udfs
from tessella.functions.digests import hmac256, sha256
from tessella.functions.predicates import compare, in_list, like_plain, pad_trim, truthy
from tessella.functions.programs import compile_program, run_trigger
from tessella.operators import changes, constraints, scans
from tessella.operators.aggregates import Agg, aggregate, group_aggregate
from tessella.operators.joins import chain_join, compare_scalar, equi_join, except_ids, in_subquery, intersect_ids, not_in_subquery, union_ids
from tessella.operators.ordering import distinct_rows, sorted_page
from tessella.plans.engine import Engine
from tessella.schema import Kind
from tessella.sources import copying, formats
from tessella.sources.refresh import VersionedTable, next_json, pages, refresh, refresh_pages
from tessella.storage import scratch
from tessella.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None):
    """Register a function of the tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def c(name: str) -> Column:
    return F.col(name)


def cents(x: Column) -> Column:
    return F.round(x, 2)


# scans


@query("SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_orderkey = 42")
def point_lookup(t):
    return scans.get_by_id(t.orders, "o_orderkey", 42).drop("o_orderdate")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def point_lookup_sql(t):
    e = Engine(t.spark)
    e.register("nation", t.nation)
    return e.sql("SELECT * FROM nation ID $1", [7]).select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def eq_lookup(t):
    return scans.find_by(t.orders, "o_custkey", 7, "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size = 10")
def composite_lookup(t):
    return scans.find_by_composite(t.part, {"p_brand": "Brand#12", "p_size": 10}, "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 30 ORDER BY o_orderkey")
def range_lookup(t):
    return scans.find_range(t.orders, "o_custkey", 10, 30, "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size <= 20 AND p_retailprice >= 950 ORDER BY p_partkey")
def query_conjunction(t):
    return scans.query(t.part, [("p_size", ">=", 5), ("p_size", "<=", 20), ("p_retailprice", ">=", 950)], "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size < 10 AND (p_brand = 'Brand#11' OR NOT p_size > 3)")
def filter_and_or_not(t):
    return scans.select_rows(t.part, (c("p_size") < 10) & ((c("p_brand") == "Brand#11") | ~(c("p_size") > 3)), ["p_partkey", "p_name"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def in_list_query(t):
    return scans.select_rows(t.nation, in_list(c("n_regionkey"), [1, 3]), ["n_nationkey", "n_name"])


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
def not_in_list(t):
    return scans.select_rows(t.nation, ~in_list(c("n_regionkey"), [1, 3]), ["n_nationkey"])


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def between(t):
    return scans.select_rows(t.part, c("p_size").between(10, 20), ["p_partkey"])


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
def not_between(t):
    return scans.select_rows(t.part, ~c("p_size").between(10, 20), ["p_partkey"])


@query("SELECT n_name FROM nation WHERE n_nationkey IN (2, 4, 6)")
def any_array(t):
    e = Engine(t.spark)
    e.register("nation", t.nation)
    return e.sql("SELECT n_name FROM nation WHERE n_nationkey = ANY (ARRAY[2, 4, 6])")


@query("SELECT n_name FROM nation WHERE false")
def any_array_empty(t):
    e = Engine(t.spark)
    e.register("nation", t.nation)
    return e.sql("SELECT n_name FROM nation WHERE n_nationkey = ANY (ARRAY[])")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000000%'")
def like_prefix(t):
    return scans.select_rows(t.customer, like_plain(c("c_name"), "Customer#00000000%"), ["c_custkey", "c_name"])


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_1'")
def like_underscore(t):
    return scans.select_rows(t.part, like_plain(c("p_brand"), "Brand#_1"), ["p_partkey", "p_brand"])


@query("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%STEEL%'")
def not_like(t):
    return scans.select_rows(t.part, ~like_plain(c("p_type"), "%STEEL%"), ["p_partkey"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NULL")
def is_null(t):
    return t.orders.select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("s")).where(c("s").isNull()).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NOT NULL")
def is_not_null(t):
    return t.orders.select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("s")).where(c("s").isNotNull()).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT coalesce(NULLIF(p_size, 5) > 10, false)")
def null_two_valued(t):
    return t.part.where(~compare(F.nullif(c("p_size"), F.lit(5)), ">", F.lit(10))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 5) > 10)")
def null_three_valued(t):
    return t.part.where(~(F.nullif(c("p_size"), F.lit(5)) > 10)).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE rtrim(n_name || '   ') = 'FRANCE' OR n_regionkey <> 0 AND n_nationkey % 2 <> 0")
def padded_compare_truthy(t):
    padded = pad_trim(F.concat(c("n_name"), F.lit("   "))) == "FRANCE"
    return t.nation.where(padded | (truthy(c("n_regionkey")) & truthy(c("n_nationkey") % 2))).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey < n_nationkey AND n_name <> 'CHINA'")
def column_compare(t):
    return t.nation.where(compare(c("n_regionkey"), "<", c("n_nationkey")) & compare(c("n_name"), "<>", F.lit("CHINA"))).select("n_nationkey")


@query("SELECT table_name, column_name, position FROM (VALUES ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) v(table_name, column_name, position)")
def describe_table(t):
    e = Engine(t.spark)
    e.register("nation", t.nation)
    return e.sql("DESCRIBE nation").select("table_name", "column_name", "position")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05")
def sql_parameters(t):
    e = Engine(t.spark)
    e.register("lineitem", t.lineitem)
    return e.sql("SELECT count(*) AS n FROM lineitem WHERE l_quantity < $1 AND l_discount > $2", [10, 0.05])


# order and paging


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def projection_limit_sorted(t):
    return sorted_page(scans.select_rows(t.orders, c("o_orderstatus") == "O", ["o_orderkey", "o_totalprice"]), "o_orderkey", "o_orderkey", limit=25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 10")
def order_offset_limit(t):
    return sorted_page(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", offset=10, limit=20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_desc(t):
    return sorted_page(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", descending=True, limit=20)


@query("SELECT p_partkey, NULLIF(p_size, 1) AS s FROM part ORDER BY s ASC NULLS LAST, p_partkey LIMIT 40")
def order_nulls_last(t):
    return sorted_page(t.part.select("p_partkey", F.nullif(c("p_size"), F.lit(1)).alias("s")), "s", "p_partkey", limit=40)


@query("SELECT p_partkey, NULLIF(p_size, 1) AS s FROM part ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 40")
def order_nulls_first(t):
    return sorted_page(t.part.select("p_partkey", F.nullif(c("p_size"), F.lit(1)).alias("s")), "s", "p_partkey", descending=True, limit=40)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_cols(t):
    return distinct_rows(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("SELECT DISTINCT n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def distinct_rows_query(t):
    return distinct_rows(equi_join(t.nation, t.region, "n_regionkey", "r_regionkey").select("n_regionkey", "r_name"))


@query("SELECT event_id, user_id FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 50")
def sequence_page(t):
    return scans.sequence_page(t.events.select("event_id", "user_id"), "event_id", 500, 50)


# aggregates


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def agg_count(t):
    return aggregate(t.lineitem, [Agg("count", None, "n")], c("l_quantity") > 25)


@query("SELECT count(NULLIF(o_orderstatus, 'F')) AS n FROM orders")
def agg_count_column(t):
    return aggregate(t.orders, [Agg("count", F.nullif(c("o_orderstatus"), F.lit("F")), "n")])


@query("SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part")
def agg_sum(t):
    return aggregate(t.part, [Agg("sum", "p_size", "s")])


@query("SELECT min(o_totalprice) AS low, min(o_orderpriority) AS first_priority FROM orders")
def agg_min(t):
    return aggregate(t.orders, [Agg("min", "o_totalprice", "low"), Agg("min", "o_orderpriority", "first_priority")])


@query("SELECT max(o_totalprice) AS high, max(o_orderpriority) AS last_priority FROM orders")
def agg_max(t):
    return aggregate(t.orders, [Agg("max", "o_totalprice", "high"), Agg("max", "o_orderpriority", "last_priority")])


@query("SELECT round(avg(l_quantity), 6) AS q FROM lineitem")
def agg_avg(t):
    return aggregate(t.lineitem, [Agg("avg", "l_quantity", "q")]).select(F.round("q", 6).alias("q"))


@query("SELECT CAST(CAST(sum(p_size) AS BIGINT) // count(p_size) AS BIGINT) AS q FROM part")
def agg_int_avg(t):
    return aggregate(t.part, [Agg("int_avg", "p_size", "q")])


@query("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS s, coalesce(min(p_size), 0) AS low, count(*) AS n FROM part WHERE p_size < 0")
def agg_empty_compat(t):
    return aggregate(t.part, [Agg("sum", "p_size", "s"), Agg("min", "p_size", "low"), Agg("count", None, "n")], c("p_size") < 0, compat=True)


_Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus"""


@query(_Q1)
def group_multi_agg(t):
    price = c("l_extendedprice") * (1 - c("l_discount"))
    sums = {"sum_qty": c("l_quantity"), "sum_base_price": c("l_extendedprice"), "sum_disc_price": price, "sum_charge": price * (1 + c("l_tax"))}
    means = {"avg_qty": "l_quantity", "avg_price": "l_extendedprice", "avg_disc": "l_discount"}
    aggs = [Agg("sum", x, n) for n, x in sums.items()] + [Agg("avg", x, n) for n, x in means.items()] + [Agg("count", None, "count_order")]
    out = group_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], aggs, condition=c("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return out.select("l_returnflag", "l_linestatus", *[cents(c(n)).alias(n) for n in sums], *[F.round(n, 6).alias(n) for n in means], "count_order")


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6_revenue(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = t.lineitem.where((c("l_shipdate") >= day("1996-01-01")) & (c("l_shipdate") < day("1997-01-01")) & c("l_discount").between(0.05, 0.07) & (c("l_quantity") < 24))
    return rows.agg(cents(F.sum(c("l_extendedprice") * c("l_discount"))).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2")
def group_multi_col(t):
    return group_aggregate(t.orders, ["o_orderstatus", "o_orderpriority"], [Agg("count", None, "n"), Agg("min", "o_totalprice", "low"), Agg("max", "o_totalprice", "high")])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(t):
    return group_aggregate(t.orders, ["o_custkey"], [Agg("count", None, "n")], having=c("n") > 12)


@query("SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand HAVING count(*) >= 5 ORDER BY s DESC NULLS FIRST, p_brand LIMIT 6 OFFSET 1")
def group_having_sorted(t):
    return group_aggregate(t.part, ["p_brand"], [Agg("count", None, "n"), Agg("sum", "p_size", "s")], having=c("n") >= 5, order="s", descending=True, offset=1, limit=6)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC NULLS FIRST, p_brand LIMIT 5")
def top_n_groups(t):
    return group_aggregate(t.part, ["p_brand"], [Agg("count", None, "n")], order="n", descending=True, limit=5)


@query("SELECT n_regionkey, count(*) AS n, CAST(CAST(sum(n_nationkey) AS BIGINT) // count(*) AS BIGINT) AS a FROM nation WHERE n_nationkey BETWEEN 2 AND 22 GROUP BY n_regionkey")
def group_filtered_int_avg(t):
    return group_aggregate(t.nation, ["n_regionkey"], [Agg("count", None, "n"), Agg("int_avg", "n_nationkey", "a")], condition=c("n_nationkey").between(2, 22))


# joins


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_inner(t):
    labels = t.labels.withColumnRenamed("doc_id", "l_id")
    return equi_join(t.documents.select("doc_id", "lang"), labels, "doc_id", "l_id").select("doc_id", "lang", "quality")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(t):
    return equi_join(t.documents.select("doc_id"), t.labels.withColumnRenamed("doc_id", "l_id"), "doc_id", "l_id", "left").select("doc_id", "quality")


@query("SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c RIGHT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON c.c_custkey = o.o_custkey")
def join_right(t):
    return equi_join(t.customer.where("c_mktsegment = 'BUILDING'"), t.orders.where("o_orderstatus <> 'F'"), "c_custkey", "o_custkey", "right").select("c_custkey", "o_orderkey")


@query("SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON c.c_custkey = o.o_custkey")
def join_full(t):
    return equi_join(t.customer.where("c_mktsegment = 'BUILDING'"), t.orders.where("o_orderstatus <> 'F'"), "c_custkey", "o_custkey", "full").select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
def join_chain3(t):
    out = chain_join([("region", t.region), ("nation", t.nation), ("customer", t.customer)], [("region.r_regionkey", "nation.n_regionkey"), ("customer.c_nationkey", "nation.n_nationkey")])
    return out.select(c("`region.r_name`").alias("r_name"), c("`nation.n_name`").alias("n_name"), c("`customer.c_custkey`").alias("c_custkey"))


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(t):
    out = chain_join([("a", t.nation), ("b", t.nation)], [("a.n_regionkey", "b.n_regionkey")])
    return out.where(c("`a.n_nationkey`") < c("`b.n_nationkey`")).select(c("`a.n_name`").alias("n1"), c("`b.n_name`").alias("n2"))


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 AND o_totalprice > 1000")
def join_where(t):
    return equi_join(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "left").where((c("l_quantity") > 45) & (c("o_totalprice") > 1000)).select("o_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 15 OFFSET 5")
def join_sorted_page(t):
    out = equi_join(t.customer, t.nation, "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name", "c_acctbal")
    return sorted_page(out, "c_acctbal", "c_custkey", descending=True, offset=5, limit=15).drop("c_acctbal")


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_group_agg(t):
    return group_aggregate(equi_join(t.customer, t.nation, "c_nationkey", "n_nationkey"), ["n_name"], [Agg("count", None, "n"), Agg("sum", "c_acctbal", "b")]).select("n_name", "n", cents(c("b")).alias("balance"))


@query("SELECT o_orderkey, count(l_orderkey) AS n, count(*) AS n_rows FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_left_group_count(t):
    return group_aggregate(equi_join(t.orders, t.lineitem.select("l_orderkey"), "o_orderkey", "l_orderkey", "left"), ["o_orderkey"], [Agg("count", "l_orderkey", "n"), Agg("count", None, "n_rows")])


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 4 ORDER BY n DESC NULLS FIRST, n_name LIMIT 10")
def join_group_having(t):
    return group_aggregate(equi_join(t.supplier, t.nation, "s_nationkey", "n_nationkey"), ["n_name"], [Agg("count", None, "n")], having=c("n") >= 4, order="n", descending=True, limit=10)


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE r_name = 'ASIA' GROUP BY n_name")
def join_five_tables(t):
    asia = t.region.where("r_name = 'ASIA'")
    out = chain_join(
        [("region", asia), ("nation", t.nation), ("customer", t.customer), ("orders", t.orders), ("lineitem", t.lineitem)],
        [("region.r_regionkey", "nation.n_regionkey"), ("nation.n_nationkey", "customer.c_nationkey"), ("customer.c_custkey", "orders.o_custkey"), ("orders.o_orderkey", "lineitem.l_orderkey")],
    )
    revenue = c("`lineitem.l_extendedprice`") * (1 - c("`lineitem.l_discount`"))
    return group_aggregate(out.select(c("`nation.n_name`").alias("n_name"), revenue.alias("r")), ["n_name"], [Agg("sum", "r", "revenue")]).select("n_name", cents(c("revenue")).alias("revenue"))


# subqueries and sets


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def in_subquery_query(t):
    return in_subquery(t.orders, "o_orderkey", t.lineitem.where("l_quantity > 49").select("l_orderkey")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_in_subquery_query(t):
    return not_in_subquery(t.orders, "o_orderkey", t.lineitem.select("l_orderkey")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT NULLIF(l_orderkey, 5) FROM lineitem)")
def not_in_with_null(t):
    return not_in_subquery(t.orders, "o_orderkey", t.lineitem.select(F.nullif(c("l_orderkey"), F.lit(5)).alias("k"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT k FROM (SELECT NULLIF(l_orderkey, 5) AS k FROM lineitem) WHERE k IS NOT NULL)")
def not_in_skip_nulls(t):
    return not_in_subquery(t.orders, "o_orderkey", t.lineitem.select(F.nullif(c("l_orderkey"), F.lit(5)).alias("k")), skip_nulls=True).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def scalar_subquery(t):
    return compare_scalar(t.orders, "o_totalprice", "=", t.orders.agg(F.max("o_totalprice"))).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(t):
    return in_subquery(t.customer, "c_custkey", t.orders.where("o_orderstatus = 'P'").select("o_custkey")).select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000 ORDER BY k")
def union_ids_query(t):
    return union_ids(t.orders.where("o_totalprice > 300000").select(c("o_custkey").alias("k")), t.customer.where("c_acctbal > 9000").select(c("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000 ORDER BY k")
def intersect_ids_query(t):
    return intersect_ids(t.orders.where("o_orderstatus = 'O'").select(c("o_custkey").alias("k")), t.customer.where("c_acctbal > 5000").select(c("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY k")
def except_ids_query(t):
    return except_ids(t.customer.select(c("c_custkey").alias("k")), t.orders.where("o_totalprice > 100000").select(c("o_custkey").alias("k")).distinct())


# versions, changes, constraints: relations, not writes

_VERSIONS = "(SELECT user_id, event_id, event_type, event_type = 'signup' AS gone FROM events)"


def _versions(t):
    return t.events.select("user_id", "event_id", "event_type", (c("event_type") == "signup").alias("gone"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_version(t):
    return changes.latest(t.events.select("user_id", "event_id"), "user_id", "event_id")


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {_VERSIONS} WHERE event_id <= 5000) WHERE rn = 1 AND NOT gone")
def snapshot_read(t):
    return changes.snapshot(_versions(t), "user_id", "event_id", 5000, "gone").select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id FROM events WHERE event_id > 100 AND event_id <= 900")
def version_in_range(t):
    return changes.has_version_in_range(t.events, "user_id", "event_id", 100, 900)


@query("SELECT count(*) AS n FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events WHERE event_id <= 4000 GROUP BY user_id) g ON e.user_id = g.user_id WHERE g.m IS NULL OR e.event_id >= g.m")
def version_gc(t):
    return changes.collect_garbage(t.events.select("user_id", "event_id"), "user_id", "event_id", 4000).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-30')")
def write_conflicts(t):
    return changes.write_conflicts(t.events.where("event_type = 'signup'"), t.events, "user_id", "ts", F.lit("2024-01-30").cast("timestamp_ntz"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size > 40")
def upsert_merge(t):
    base = t.part.select("p_partkey", "p_size")
    return changes.upsert(base, base.where("p_size > 40").withColumn("p_size", F.lit(0)), "p_partkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'BAD' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(t):
    return changes.update_where(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), c("c_acctbal") < 0, {"c_mktsegment": F.lit("BAD")})[0].drop("c_acctbal")


@query("SELECT c_custkey, 'BAD' AS c_mktsegment FROM customer WHERE c_acctbal < 0")
def update_returning(t):
    return changes.update_where(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), c("c_acctbal") < 0, {"c_mktsegment": F.lit("BAD")})[1].drop("c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(NULLIF(c_acctbal, 0) < 1000, false)")
def delete_where(t):
    return changes.delete_where(t.customer, F.nullif(c("c_acctbal"), F.lit(0)) < 1000)[0].select("c_custkey")


@query("SELECT n_nationkey + CASE WHEN n_nationkey > 20 THEN 100 ELSE 0 END AS k FROM nation UNION ALL SELECT 900 + r_regionkey FROM region")
def insert_rows(t):
    base = t.nation.select(F.when(c("n_nationkey") > 20, c("n_nationkey") + 100).otherwise(c("n_nationkey")).alias("k"))
    return changes.insert(base, t.region.select((c("r_regionkey") + 900).alias("k")), "k")[0]


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def update_set_patch(t):
    patch = t.nation.where("n_regionkey = 2").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    return changes.update_set(t.nation.select("n_nationkey", "n_name"), patch, "n_nationkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS serial FROM orders")
def serial_numbers(t):
    return changes.numbered(t.orders.select("o_orderkey").withColumn("d", -c("o_orderkey")), "serial", ["d"]).select("o_orderkey", c("serial").cast("long").alias("serial"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def fk_violations(t):
    return constraints.foreign_violations(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(t):
    return constraints.unique_violations(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0)")
def check_violations(t):
    return constraints.check_violations(t.customer, "c_acctbal >= 0").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def balance_violations(t):
    return constraints.balance_violations(t.supplier, "s_acctbal").select("s_suppkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_set_null(t):
    return constraints.on_delete(t.nation.select("n_nationkey", "n_regionkey"), "n_regionkey", t.region.where("r_regionkey = 1"), "r_regionkey", "set_null")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 1")
def fk_cascade(t):
    return constraints.on_delete(t.nation, "n_regionkey", t.region.where("r_regionkey = 1"), "r_regionkey", "cascade").select("n_nationkey")


# programs, digests, sources' paths


@query("SELECT p_partkey, p_size * 2 + 1 AS v, (p_size // 7) % 3 AS m FROM part WHERE NOT (p_size > 30) AND p_name LIKE '%a%'")
def program_columns(t):
    keep = compile_program([("load", "p_size"), ("push", 30), "gt", "not", ("load", "p_name"), ("like", "%a%"), "and"], t.part).top
    v = compile_program([("load", "p_size"), ("push", 2), "mul", ("push", 1), "add"], t.part).top
    m = compile_program([("load", "p_size"), ("push", 7), "div", ("push", 3), "mod"], t.part).top
    return t.part.where(keep).select("p_partkey", v.cast("int").alias("v"), m.cast("int").alias("m"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN p_size ELSE p_size + 100 END AS p_size FROM part WHERE p_size <> 1 AND p_size < 45")
def trigger_rows(t):
    return run_trigger(t.part.select("p_partkey", "p_size"), [("load", "p_size"), ("push", 45), "ge", "reject", ("load", "p_size"), ("push", 1), "eq", "reject", ("load", "p_size"), ("push", 100), "add", ("set", "p_size")])


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_column(t):
    return t.documents.select("doc_id", F.lower(F.hex(sha256(c("text")))).alias("digest"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_path_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# beyond: windows, grouping sets, time windows


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 3")
def top_per_group(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 3")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(t):
    hour = F.window("ts", "1 hour")["start"]
    return t.events.groupBy("event_type", hour.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_timestamp(c("w").cast("timestamp")).alias("hour"), "n")


# sources, sinks, refresh and streams: each writes to the shared folder and reads back


def _source(name: str, columns: list[tuple[str, str]], format: str, key: str, rows: str = "") -> formats.SourceDef:
    return formats.SourceDef(name, tuple(formats.SourceColumn(n, Kind.parse(k), n) for n, k in columns), format, key, rows)


_NATION = [("n_nationkey", "INT"), ("n_name", "VARCHAR(40)"), ("n_regionkey", "INT")]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(t):
    formats.write_csv(t.nation, path := scratch(t.spark, "csv"))
    return formats.read_source(t.spark, _source("nation", _NATION, "csv", "n_nationkey"), path)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def source_ndjson(t):
    t.customer.select(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey"))).write.text(path := scratch(t.spark, "ndjson"))
    return formats.read_source(t.spark, _source("customer", [("c_custkey", "BIGINT"), ("c_name", "VARCHAR(40)"), ("c_nationkey", "INT")], "ndjson", "c_custkey"), path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_json_envelope(t):
    rows = t.nation.agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(*t.nation.columns)).alias("rows")).alias("data"))))
    rows.write.text(path := scratch(t.spark, "json"))
    return formats.read_source(t.spark, _source("nation", _NATION, "json", "n_nationkey", "data.rows"), path)


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def source_parquet_zstd(t):
    t.supplier.write.option("compression", "zstd").parquet(path := scratch(t.spark, "zstd"))
    return formats.read_parquet(t.spark, path, ["s_suppkey", "s_name", "s_acctbal"]).withColumn("s_acctbal", cents(c("s_acctbal")))


@query("SELECT doc_id, text FROM documents")
def copy_text_round_trip(t):
    copying.write_copy_text(t.documents.select("doc_id", "text"), path := scratch(t.spark, "copy"))
    return copying.read_copy_text(t.spark, path, "doc_id long, text string")


@query("SELECT doc_id, text FROM documents")
def copy_csv_round_trip(t):
    copying.write_copy_csv(t.documents.select("doc_id", "text"), path := scratch(t.spark, "copy"))
    return copying.read_copy_csv(t.spark, path, "doc_id long, text string")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '' WHEN lang = 'es' THEN NULL ELSE '\\N,' || lang END AS a, CAST(n_chars AS DECIMAL(12, 2)) AS b, n_chars % 2 = 0 AS f FROM documents")
def copy_csv_awkward(t):
    copying.write_copy_csv(_awkward(t), path := scratch(t.spark, "copy"), copying.CopyOptions.of({"FORMAT": "csv", "DELIMITER": "|", "HEADER": "true", "QUOTE": "~"}))
    return copying.read_copy_csv(t.spark, path, _AWKWARD, copying.CopyOptions.of({"FORMAT": "csv", "DELIMITER": "|", "HEADER": "true", "QUOTE": "~"}), multi_line=False)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '' WHEN lang = 'es' THEN NULL ELSE '\\N,' || lang END AS a, CAST(n_chars AS DECIMAL(12, 2)) AS b, n_chars % 2 = 0 AS f FROM documents")
def copy_text_awkward(t):
    options = copying.CopyOptions.of({"DELIMITER": ",", "NULL": "nothing", "HEADER": "true"})
    copying.write_copy_text(_awkward(t), path := scratch(t.spark, "copy"), options)
    return copying.read_copy_text(t.spark, path, _AWKWARD, options)


_AWKWARD = "doc_id long, a string, b decimal(12,2), f boolean"


def _awkward(t) -> DataFrame:
    a = F.when(c("lang") == "en", "").when(c("lang") == "es", None).otherwise(F.concat(F.lit("\\N,"), "lang"))
    return t.documents.select("doc_id", a.alias("a"), c("n_chars").cast("decimal(12,2)").alias("b"), (c("n_chars") % 2 == 0).alias("f"))


@query("SELECT event_id, user_id, event_type, NULLIF(event_type, 'click') AS other FROM events")
def copy_binary_round_trip(t):
    rows = t.events.select("event_id", "user_id", "event_type", F.nullif(c("event_type"), F.lit("click")).alias("other"))
    return copying.from_copy_binary(copying.to_copy_binary(rows), "event_id long, user_id long, event_type string, other string")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def refresh_upsert(t):
    managed = VersionedTable(t.spark, scratch(t.spark, "table"))
    managed.write(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    t.nation.where("n_regionkey = 2").select(F.to_json(F.struct("n_nationkey", F.lower("n_name").alias("n_name"), "n_regionkey"))).write.text(path := scratch(t.spark, "feed"))
    refresh(managed, _source("nation", _NATION, "ndjson", "n_nationkey"), path)
    return managed.read()


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_refresh(t):
    rows = t.events.select("user_id", "event_id")
    rows.repartition(3).write.parquet(path := scratch(t.spark, "in"))
    managed = VersionedTable(t.spark, scratch(t.spark, "table"))
    # one file a trigger: later batches may hold older events, so the newest of both sides stays
    logs.refresh_stream(logs.read_stream(t.spark, path, "user_id long, event_id long"), managed, "user_id", "event_id", scratch(t.spark, "progress")).awaitTermination()
    return logs.merged(managed, "user_id", "event_id")


@query("SELECT row_number() OVER (ORDER BY event_type IS DISTINCT FROM 'click', event_id) AS seq, event_id FROM events")
def log_append_once(t):
    log = VersionedTable(t.spark, scratch(t.spark, "log"))
    for rows in (t.events.where("event_type = 'click'"), t.events, t.events):  # the clicks come again, then all
        logs.append_once(log, rows.select("event_id"), ["event_id"], ["event_id"])
    return log.read().select(c("seq").cast("long").alias("seq"), "event_id")


# statements: each changes or loads a table of an engine, and is read back


def _engine(t, *names: str) -> Engine:
    e = Engine(t.spark)
    for n in names:
        e.register(n, getattr(t, n))
    return e


@query("SELECT 900 + r_regionkey AS n_nationkey, 'it''s \"' || lower(r_name) || '\" $1' AS n_name, r_regionkey AS n_regionkey FROM region")
def sql_insert_returning(t):
    e = _engine(t, "nation", "region")
    return e.sql("INSERT INTO nation (n_nationkey, n_name, n_regionkey) SELECT $1 + r_regionkey, 'it''s \"' || lower(r_name) || '\" $1', r_regionkey FROM region -- all of them\nRETURNING *;", [900])


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'x' || n_name ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 4")
def sql_update_delete(t):
    e = _engine(t, "nation")
    e.sql("UPDATE nation SET n_name = concat($1, n_name) WHERE n_regionkey = 2", ["x"])
    e.sql('DELETE FROM "nation" WHERE "n_regionkey" = 4')
    return e.sql('SELECT n_nationkey, "n_name" FROM nation')


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE 'C%' OR n_regionkey > 3")
def sql_delete_returning(t):
    return _engine(t, "nation").sql("DELETE FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE 'C%' OR n_regionkey > 3 RETURNING n_nationkey, n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_name <> 'x' AND 'costs $1' <> 'a = ANY (ARRAY[1])'")
def sql_quoted_names(t):
    return _engine(t, "nation").sql("SELECT \"n_nationkey\", \"n_name\" FROM nation WHERE n_regionkey = $1 AND n_name <> 'x' AND 'costs $1' <> 'a = ANY (ARRAY[1])' /* '\" */", [1])


@query("SELECT n_nationkey, 'costs $1 \\n' AS a, 'it''s' AS b FROM nation WHERE n_nationkey = 7")
def sql_string_compare(t):
    return _engine(t, "nation").sql("SELECT n_nationkey, 'costs $1 \\n' AS a, 'it''s' AS b FROM nation WHERE n_nationkey = '7'")


@query("SELECT p_partkey, p_size::BIGINT * 2 AS a, p_size::VARCHAR || '!' AS b, (p_size % 2)::BOOLEAN AS c FROM part")
def sql_casts(t):
    return _engine(t, "part").sql("SELECT p_partkey, p_size::bigint * 2 AS a, p_size::string || '!' AS b, (p_size % 2)::boolean AS c FROM part")


@query("SELECT n_nationkey AS id, n_name AS label, 'none' AS note, n_nationkey + 1 AS serial FROM nation")
def sql_ddl(t):
    e = _engine(t, "nation")
    e.sql("CREATE TABLE place (id INT PRIMARY KEY, serial BIGSERIAL, name VARCHAR(40) NOT NULL, spare INT, CHECK (id >= 0))")
    e.sql("INSERT INTO place (id, name) SELECT n_nationkey, n_name FROM nation")
    e.sql("ALTER TABLE place ADD COLUMN note VARCHAR(8) DEFAULT 'none'")
    e.sql("ALTER TABLE place RENAME COLUMN name TO label")
    e.sql("ALTER TABLE place DROP COLUMN spare")
    e.sql("CREATE UNIQUE INDEX by_label ON place (label)")
    return e.sql("SELECT id, label, note, serial FROM place").select("id", "label", "note", c("serial").cast("int").alias("serial"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 3 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def sql_delete_set_null(t):
    e = Engine(t.spark)
    e.sql("CREATE TABLE area (r_regionkey INT PRIMARY KEY)")
    e.sql("CREATE TABLE place (n_nationkey INT PRIMARY KEY, n_name VARCHAR(40), n_regionkey INT REFERENCES area(r_regionkey) ON DELETE SET NULL)")
    e.add("area", t.region.select("r_regionkey"))
    e.add("place", t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    e.sql("DELETE FROM area WHERE r_regionkey = 3")
    return e.sql("SELECT * FROM place")


@query("SELECT * FROM (VALUES ('nation', 1, 'n_nationkey'), ('nation', 2, 'n_name'), ('nation', 3, 'n_regionkey'), ('region', 1, 'r_regionkey'), ('region', 2, 'r_name')) AS v(table_name, position, column_name)")
def sql_catalog(t):
    return _engine(t, "nation", "region").catalog().select("table_name", "position", "column_name")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def sql_external_source(t):
    path, e = scratch(t.spark, "feed"), Engine(t.spark)
    line = lambda name: F.to_json(F.struct(c("n_nationkey").alias("k"), F.struct(name.alias("name")).alias("deep")))
    t.nation.select(line(c("n_name"))).write.text(path)
    e.sql(f"CREATE EXTERNAL SOURCE place (n_nationkey INT FROM 'k', n_name VARCHAR(40) FROM 'deep.name') FROM '{path}' FORMAT ndjson KEY n_nationkey")
    e.sql("REFRESH place")
    t.nation.where("n_regionkey = 0").select(line(F.lower("n_name"))).write.mode("overwrite").text(path)
    e.sql("REFRESH place")  # rows gone from the source stay
    return e.sql("SELECT * FROM place")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def sql_copy(t):
    path, e = scratch(t.spark, "copy"), _engine(t, "orders")
    e.sql("CREATE TABLE again (o_orderkey BIGINT, o_orderstatus VARCHAR(4), o_orderpriority VARCHAR(20), spare INT)")
    e.sql(f"COPY orders (o_orderkey, o_orderstatus, o_orderpriority) TO '{path}' WITH (FORMAT csv, DELIMITER ';', HEADER)")
    e.sql(f"COPY again (o_orderkey, o_orderstatus, o_orderpriority) FROM '{path}' WITH (FORMAT csv, DELIMITER ';', HEADER)")
    return e.sql("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM again WHERE spare IS NULL")


# more of joins, constraints, digests, sources and streams


@query("SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 3")
def distinct_limit(t):
    return sorted_page(distinct_rows(t.orders, ["o_orderpriority"]), "o_orderpriority", "o_orderpriority", limit=3)


@query("SELECT c_mktsegment, count(*) AS n, count(c_custkey) AS with_customer FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_right_group(t):
    out = equi_join(t.customer.where("c_acctbal > 0"), t.orders, "c_custkey", "o_custkey", "right")
    return group_aggregate(out, ["c_mktsegment"], [Agg("count", None, "n"), Agg("count", "c_custkey", "with_customer")])


@query("SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS with_order FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_full_group(t):
    out = equi_join(t.customer.where("c_acctbal > 0"), t.orders, "c_custkey", "o_custkey", "full")
    return group_aggregate(out, ["c_mktsegment"], [Agg("count", None, "n"), Agg("count", "o_orderkey", "with_order")])


@query("SELECT a.n_nationkey AS l, b.n_nationkey AS r FROM (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation) a LEFT JOIN (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation) b ON a.k = b.k")
def join_null_keys(t):
    side = lambda k, n: t.nation.select(c("n_nationkey").alias(n), F.nullif(c("n_regionkey"), F.lit(2)).alias(k))
    return equi_join(side("k", "l"), side("j", "r"), "k", "j", "left").select("l", "r")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_set_default(t):
    return constraints.on_delete(t.nation.select("n_nationkey", "n_regionkey"), "n_regionkey", t.region.where("r_regionkey = 1"), "r_regionkey", "set_default", 4)


def _unreferenced(t) -> DataFrame:
    return t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def fk_restrict(t):
    return constraints.on_delete(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", _unreferenced(t), "o_orderkey", "restrict")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def fk_no_action(t):
    return constraints.on_delete(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", _unreferenced(t), "o_orderkey", "no_action")


@query("SELECT doc_id FROM documents WHERE NULLIF(lang, 'en') IS NULL")
def null_violations(t):
    return constraints.null_violations(t.documents.select("doc_id", F.nullif(c("lang"), F.lit("en")).alias("lang")), "lang").select("doc_id")


def _pads(key: bytes) -> tuple[str, str]:
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


_INNER, _OUTER = _pads(b"a key")


@query(f"SELECT doc_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(text)))) AS digest FROM documents")
def hmac_column(t):
    return t.documents.select("doc_id", F.lower(F.hex(hmac256(F.lit("a key"), c("text")))).alias("digest"))


@query("SELECT n_nationkey, substr(sha256(unhex('74657373656c6c612d726f770007000000') || encode(n_nationkey::VARCHAR)), 1, 32) AS id FROM nation")
def source_row_id(t):
    return t.nation.select("n_nationkey", F.lower(F.hex(formats.row_id(7, c("n_nationkey")))).alias("id"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_json_array(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(*t.nation.columns))).alias("value")).select("value")
    rows.repartition(5).write.text(path := scratch(t.spark, "json"))  # several files, each a whole array
    return formats.read_source(t.spark, _source("nation", _NATION, "json", "n_nationkey"), path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_pages(t):
    """Pages by region, each naming the next; the fetch stands in for a web service."""
    body = lambda r: t.nation.where(c("n_regionkey") == r).agg(F.to_json(F.struct(F.collect_list(F.struct(*t.nation.columns)).alias("rows"), F.lit(f"/p{r + 1}" if r < 4 else "").alias("next")))).head()[0]
    managed = VersionedTable(t.spark, scratch(t.spark, "table"))
    found = pages(lambda url: {"url": url, "body": body(int(url[-1]))}, "http://site/p0", next_json("next"))
    refresh_pages(managed, _source("nation", _NATION, "json", "n_nationkey", "rows"), found, scratch(t.spark, "pages"))
    return managed.read()


@query("SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us FROM events")
def source_parquet_int96(t):
    own = t.spark.newSession()
    own.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.read.parquet(f"{t.dir}/events.parquet").select("event_id", c("ts").cast("timestamp").alias("ts")).write.parquet(path := scratch(t.spark, "int96"))
    return formats.read_parquet(own, path).select("event_id", F.unix_micros("ts").alias("us"))


@query("SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(9, 2)) AS a, CAST(s_acctbal AS DECIMAL(18, 2)) AS b, CAST(s_acctbal AS DECIMAL(30, 2)) AS c FROM supplier")
def source_parquet_decimal(t):
    rows = t.supplier.select("s_suppkey", *[c("s_acctbal").cast(f"decimal({n},2)").alias(x) for x, n in (("a", 9), ("b", 18), ("c", 30))])
    rows.write.parquet(path := scratch(t.spark, "decimal"))  # 32 and 64 bits, and bytes
    return formats.read_parquet(t.spark, path)


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders")
def agg_from_metadata(t):
    return formats.parquet_bounds(t.spark, f"{t.dir}/orders.parquet", "o_orderkey")


@query("SELECT to_json({n_nationkey: n_nationkey, n_name: n_name})::VARCHAR AS line FROM nation")
def render_json(t):
    return formats.json_lines(t.nation.select("n_nationkey", "n_name"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_once(t):
    rows = t.events.select("event_id", "user_id", "ts")
    rows.union(rows).repartition(3).write.parquet(path := scratch(t.spark, "in"))
    stream = logs.read_stream(t.spark, path, "event_id long, user_id long, ts timestamp_ntz").withColumn("ts", c("ts").cast("timestamp"))
    unique = logs.once(stream, ["event_id"], "ts", "10000 days")
    out = unique.writeStream.format("parquet").option("checkpointLocation", scratch(t.spark, "progress")).option("path", to := scratch(t.spark, "out")).trigger(availableNow=True).start()
    out.awaitTermination()
    return t.spark.read.parquet(to).select("event_id", "user_id")


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(t):
    t.events.select("event_type", "ts").repartition(3).write.parquet(path := scratch(t.spark, "in"))
    stream = logs.read_stream(t.spark, path, "event_type string, ts timestamp_ntz").withColumn("ts", c("ts").cast("timestamp"))
    counts = logs.windowed_counts(stream, "ts", "1 hour", "10000 days", "event_type")
    managed = VersionedTable(t.spark, scratch(t.spark, "table"))
    one = lambda batch, epoch: managed.write(batch.select("event_type", F.unix_timestamp("window.start").alias("hour"), "n")) and None
    counts.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", scratch(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return managed.read()


@query("SELECT event_id, event_type FROM events")
def stream_copy(t):
    """COPY text as it arrives, each micro-batch all or nothing."""
    copying.write_copy_text(t.events.select("event_id", "event_type").repartition(3), path := scratch(t.spark, "copy"))
    managed = VersionedTable(t.spark, scratch(t.spark, "table"))
    logs.copy_stream(t.spark, path, "event_id long, event_type string", managed, scratch(t.spark, "progress"), per_trigger=1).awaitTermination()
    return managed.read()


@query("SELECT doc_id, text FROM documents WHERE doc_id = 17")
def get_blob(t):
    return scans.get_by_id(t.documents.select("doc_id", "text"), "doc_id", 17)


@query("SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS fit FROM (SELECT o_orderstatus FROM orders WHERE o_orderstatus = 'O' LIMIT 70)")
def select_limit(t):
    page = scans.select_rows(t.orders, c("o_orderstatus") == "O", ["o_orderstatus"], 70)
    return page.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(c("o_orderstatus") == "O", 1)).alias("fit"))


@query("SELECT 'gzip' AS codec, count(*) AS n, sum(l_orderkey)::BIGINT AS s FROM lineitem UNION ALL SELECT 'lz4raw', count(*), sum(l_orderkey)::BIGINT FROM lineitem UNION ALL SELECT 'snappy', count(*), sum(l_orderkey)::BIGINT FROM lineitem UNION ALL SELECT 'uncompressed', count(*), sum(l_orderkey)::BIGINT FROM lineitem")
def source_parquet_codecs(t):
    out = None
    for codec in ("gzip", "lz4raw", "snappy", "uncompressed"):
        t.lineitem.select("l_orderkey", "l_returnflag").write.option("compression", "lz4_raw" if codec == "lz4raw" else codec).parquet(path := scratch(t.spark, codec))
        one = formats.read_parquet(t.spark, path, ["l_orderkey"]).agg(F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def source_parquet_brotli(t):
    def packed(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            pq.write_table(pa.Table.from_batches([b]), out := io.BytesIO(), compression="brotli", data_page_version="2.0")
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["content"])

    rows = t.orders.select("o_orderkey", "o_orderpriority")
    copying.write_files(rows.mapInArrow(packed, "content binary"), path := scratch(t.spark, "brotli"))
    return formats.read_parquet_brotli(t.spark, path, f"o_orderkey {rows.schema[0].dataType.simpleString()}, o_orderpriority string")


@query("SELECT n_nationkey, to_json({name: n_name, region: [n_regionkey, n_regionkey + 1]})::VARCHAR AS deep, to_json([{k: n_name}])::VARCHAR AS list FROM nation")
def source_parquet_nested(t):
    deep = F.struct(c("n_name").alias("name"), F.array(c("n_regionkey"), c("n_regionkey") + 1).alias("region"))
    t.nation.select("n_nationkey", deep.alias("deep"), F.array(F.struct(c("n_name").alias("k"))).alias("list")).write.parquet(path := scratch(t.spark, "nested"))
    return formats.flattened(formats.read_parquet(t.spark, path))


@query("SELECT o_orderkey, length(o_orderpriority) * 2 AS twice, least(o_custkey, 100) AS low FROM orders")
def udf_scalar(t):
    def twice(x: pd.Series) -> pd.Series:
        return x.str.len() * 2

    double = udfs.scalar(t.spark, "twice_the_length", twice, "bigint")
    low = udfs.scalar_rows(t.spark, "at_most", lambda x, y: min(x, y), "bigint")
    return t.orders.select("o_orderkey", double("o_orderpriority").alias("twice"), low(c("o_custkey").cast("long"), F.lit(100)).alias("low"))


@query("SELECT n_regionkey, max(n_nationkey) - min(n_nationkey) AS spread FROM nation GROUP BY n_regionkey")
def udf_aggregate(t):
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    made = udfs.aggregate(t.spark, "spread_of", spread, "bigint")
    return t.nation.groupBy("n_regionkey").agg(made(c("n_nationkey").cast("long")).alias("spread"))


@query("SELECT r_regionkey, i FROM region, unnest(range(0, r_regionkey)) AS u(i)")
def udf_table(t):
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    udfs.table(t.spark, "count_below", Count, "i bigint")
    t.region.createOrReplaceTempView("regions_to_count")
    return t.spark.sql("SELECT r_regionkey, i FROM regions_to_count, LATERAL count_below(CAST(r_regionkey AS INT))")
