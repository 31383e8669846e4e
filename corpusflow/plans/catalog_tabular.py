"""User tables: profiles and the documented SQL patterns."""

from pyspark.sql import functions as F

from corpusflow.operators import profile
from corpusflow.plans.registry import query, table
from corpusflow.sources import tables as user_tables

ORDERS_TEXT = ("o_orderstatus", "o_orderpriority")


def _union_sql(columns, fmt):
    return " union all ".join(fmt.format(c=c) for c in columns)


ORDERS_COLUMNS = (
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"),
    ("o_totalprice", "numeric"), ("o_orderdate", "time"), ("o_orderpriority", "text"),
)


@query("d01_inspect", " union all ".join(
    f"select {i}::bigint as position, '{c}' as column_name, '{k}' as kind, count(*) as n_rows, count({c}) as non_null from orders"
    for i, (c, k) in enumerate(ORDERS_COLUMNS)))
def _(spark, d):
    return profile.inspect(table(spark, d, "orders"))


@query("d01_sample_rows", "select o_orderkey, o_custkey, o_orderpriority from orders order by o_orderkey limit 5")
def _(spark, d):
    return profile.sample_rows(table(spark, d, "orders"), "o_orderkey", 5).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("d02_numeric_profile", _union_sql(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), """
select '{c}' as column_name, count({c}) as n, count(*) - count({c}) as nulls, round(avg({c}), 6) as mean,
 round(stddev_samp({c}), 6) as std, min({c})::double as min, round(quantile_cont({c}, 0.25), 6) as q25,
 round(median({c}), 6) as median, round(quantile_cont({c}, 0.75), 6) as q75, max({c})::double as max from lineitem"""))
def _(spark, d):
    p = profile.numeric_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("column_name", "n", "nulls", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")], "max")


@query("d03_categorical_profile", _union_sql(ORDERS_TEXT, """
select '{c}' as column_name, count({c}) as n, count(distinct {c}) as n_unique,
 (select {c} from orders where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as top,
 count(*) - count({c}) as nulls from orders"""))
def _(spark, d):
    return profile.categorical_summary(table(spark, d, "orders"), list(ORDERS_TEXT))


@query("d04_top_values", _union_sql(ORDERS_TEXT, """
select * from (select '{c}' as column_name, row_number() over (order by count(*) desc, {c}) as rank, {c} as value,
 count(*) as freq, round(count(*) / (select count(*) from orders) * 100, 4) as pct from orders where {c} is not null group by {c})
 where rank <= 5"""))
def _(spark, d):
    return profile.top_values(table(spark, d, "orders"), list(ORDERS_TEXT))


@query("d05_sql_over_tables", """
select o_orderpriority, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total
from orders group by rollup(o_orderpriority, o_orderstatus)""")
def _(spark, d):
    names = user_tables.register(spark, {"orders 2024.csv": table(spark, d, "orders")})
    return user_tables.run_sql(spark, """
        select o_orderpriority, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total
        from "orders 2024.csv" group by rollup(o_orderpriority, o_orderstatus)""", names)


@query("d06_value_distribution", "select 'o_orderpriority' as column_name, o_orderpriority as value, count(*) as freq, round(count(*) * 100.0 / (select count(*) from orders), 4) as pct from orders group by o_orderpriority")
def _(spark, d):
    return profile.value_distribution(table(spark, d, "orders"), ["o_orderpriority"])


@query("d06_value_range", """
select count(distinct o_orderpriority) as n_priorities, strftime(min(o_orderdate), '%Y-%m-%d') as first_day,
 strftime(max(o_orderdate), '%Y-%m-%d') as last_day from orders""")
def _(spark, d):
    return table(spark, d, "orders").agg(
        F.count_distinct("o_orderpriority").alias("n_priorities"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@query("d07_category_month_top", """
select o_orderpriority, strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, count(*) as n,
 round(sum(o_totalprice), 2) as total from orders group by 1, 2 order by total desc, 1, 2 limit 10""")
def _(spark, d):
    g = table(spark, d, "orders").groupBy(
        "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.orderBy(F.desc("total"), "o_orderpriority", "month").limit(10)


@query("d08_equi_join", """
select o_orderkey, c_name, c_mktsegment, o_totalprice from orders join customer on o_custkey = c_custkey
where o_totalprice > 100000""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("d09_running_total_rank", """
select o_orderkey, o_custkey, o_totalprice,
 round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate), 2) as running_total,
 rank() over (partition by o_custkey order by o_totalprice desc) as amount_rank from orders""")
def _(spark, d):
    r = profile.running_total_and_rank(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return r.select("o_orderkey", "o_custkey", "o_totalprice", F.round("running_total", 2).alias("running_total"), "amount_rank")


@query("d10_pivot", """
select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as F,
 round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 2) as O,
 round(sum(case when o_orderstatus = 'P' then o_totalprice else 0 end), 2) as P from orders group by 1""")
def _(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).sum("o_totalprice")
    return p.select("o_orderpriority", *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c) for c in "FOP"])


@query("d11_join_product_top", """
select p_brand, round(sum(l_quantity * p_retailprice), 2) as revenue, count(*) as n
from lineitem join part on l_partkey = p_partkey group by p_brand order by revenue desc, p_brand limit 10""")
def _(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(
        table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_brand").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("revenue"), F.count("*").alias("n"))
    return g.orderBy(F.desc("revenue"), "p_brand").limit(10)


@query("d12_content_set_hash", """
with l as (select sha256(doc_id::varchar) as k, sha256(text) as h from documents),
a as (select substr(k, 1, 4) as k, sha256(string_agg(h, '' order by k, h)) as h from l group by 1),
b as (select substr(k, 1, 2) as k, sha256(string_agg(h, '' order by k, h)) as h from a group by 1)
select sha256(string_agg(h, '' order by k, h)) as set_hash from b""")
def _(spark, d):
    return profile.content_set_hash(table(spark, d, "documents"), "doc_id", F.col("text"))


SCAN = ("URGENT", "LOW", "F")


@query("d13_token_scan", "with c as (" + _union_sql(ORDERS_TEXT, "select o_orderkey, '{c}' as column_name, {c} as value from orders")
       + "), h as (" + " union all ".join(f"select '{t}' as token, o_orderkey, column_name from c where contains(value, '{t}')" for t in SCAN)
       + """), r as (select *, row_number() over (partition by token order by o_orderkey, column_name) as rn from h)
select token, count(*) as n_cells, string_agg(o_orderkey || ':' || column_name, ',' order by o_orderkey, column_name) filter (rn <= 20) as locations
from r group by token""")
def _(spark, d):
    return profile.token_scan(table(spark, d, "orders"), "o_orderkey", SCAN, list(ORDERS_TEXT))
