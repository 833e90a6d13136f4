"""Every registered query of the relational core, with its DuckDB counterpart."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, settings
from ..operators import groups, joins, vectors
from ..sources import files
from ..sources.files import table as _t
from ..streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the folder all executors share; of its own only in a local session that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{folder}/{tag}_{uuid.uuid4().hex}"


def _money(x: str | F.Column) -> F.Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")


def _sum(x: F.Column) -> F.Column:
    return F.sum(x).cast("decimal(38,2)")


@query(
    """select n_name, o_orderpriority, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as revenue
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by n_name, o_orderpriority"""
)
def revenue_by_nation_priority(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'")
    j = o.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), _sum(_money("o_totalprice")).alias("revenue"))


@query(
    """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(38,2)) as sum_qty,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as sum_price, count(*) as n,
    cast(count(distinct l_suppkey) as bigint) as n_suppliers, cast(count(case when l_discount > 0.05 then 1 end) as bigint) as n_discounted
    from lineitem where l_shipdate <= timestamp '2000-09-02' group by l_returnflag, l_linestatus"""
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        _sum(_money("l_quantity")).alias("sum_qty"), _sum(_money("l_extendedprice")).alias("sum_price"), F.count("*").alias("n"),
        F.countDistinct("l_suppkey").alias("n_suppliers"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("n_discounted"),
    )


@query("select l_orderkey, l_partkey, l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(24,4)) as net from lineitem where l_quantity >= 45 and l_returnflag = 'R'")
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").where((F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", (_money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(24,4)").alias("net"))


@query("select c_custkey, c_name, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' where c_acctbal > 5000")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").where("o_orderstatus = 'P'")
    return _t(spark, d, "customer").where("c_acctbal > 5000").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query(
    """select c_nationkey, s_nationkey, n_customers, n_suppliers from (select c_nationkey, count(*) as n_customers from customer where c_acctbal > 8000 group by 1) a
    full join (select s_nationkey, count(*) as n_suppliers from supplier where s_acctbal > 5000 group by 1) b on c_nationkey = s_nationkey"""
)
def full_join(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "customer").where("c_acctbal > 8000").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    b = _t(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full")


@query("select s_suppkey, o_orderkey from (select * from orders where o_totalprice > 400000) right join (select s_suppkey from supplier) on o_orderkey = s_suppkey")
def right_join(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey")
    return o.join(_t(spark, d, "supplier").select("s_suppkey"), F.col("o_orderkey") == F.col("s_suppkey"), "right").select("s_suppkey", "o_orderkey")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("select doc_id, lang from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels"), "doc_id", "left_anti")


@query("select a.n_name as n1, b.n_name as n2 from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _t(spark, d, "nation").alias("a"), _t(spark, d, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("n1"), F.col("b.n_name").alias("n2"))


@query("select r_name, q as quarter from region cross join (values (1), (2), (3), (4)) as x(q)")
def cross_join(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "region").crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("quarter"))).select("r_name", "quarter")


@query(
    """select e.event_id, e.user_id, c.value as last_click from (select * from events where event_type = 'purchase') e
    asof left join (select user_id, ts, value from events where event_type = 'click') c on e.user_id = c.user_id and e.ts >= c.ts"""
)
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value")
    return joins.as_of(left, right, "user_id", "ts", "value", F.date_trunc("day", "ts"), "last_click").select("event_id", "user_id", "last_click")


@query(
    """with p as (select event_id, user_id, epoch_us(ts) // 1000000 as s from events where event_type = 'purchase'),
    e as (select user_id, epoch_us(ts) // 1000000 as s from events where event_type = 'error')
    select p.event_id, count(*) as n_errors from p join e on p.user_id = e.user_id and e.s between p.s and p.s + 7200 group by p.event_id"""
)
def range_join(spark: SparkSession, d: str) -> DataFrame:
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", second.alias("s"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("s").alias("low"), (F.col("s") + 7200).alias("high"))
    failed = e.where("event_type = 'error'").select("user_id", "s")
    return joins.in_range(failed, "s", bought, "low", "high", 7200, ("user_id",)).groupBy("event_id").agg(F.count("*").alias("n_errors"))


@query("select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 490000")
def salted_join(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").where("o_totalprice > 490000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    j = joins.salted(o, _t(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], 4)
    return j.join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")


@query(
    """select l_returnflag, l_linestatus, cast(grouping(l_returnflag) + grouping(l_linestatus) as int) as level, count(*) as n
    from lineitem group by cube (l_returnflag, l_linestatus)"""
)
def cube(spark: SparkSession, d: str) -> DataFrame:
    level = (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int")
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(level.alias("level"), F.count("*").alias("n"))


@query("select p_brand, p_type, count(*) as n, max(p_size) as largest from part group by rollup (p_brand, p_type)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))


@query("select event_type, user_id, count(*) as n from events group by grouping sets ((event_type), (user_id), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("select event_type, user_id, count(*) as n from {e} group by grouping sets ((event_type), (user_id), ())", e=_t(spark, d, "events"))


@query(
    """select event_type, round(stddev_samp(value), 4) as sd, round(quantile_cont(value, 0.9), 4) as p90, round(corr(value, event_id), 4) as r,
    round(median(value), 4) as mid from events group by event_type"""
)
def statistics(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    moments = e.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.corr("value", "event_id"), 4).alias("r"))
    places = groups.percentiles(e, "event_type", "value", {"p90": 0.9, "mid": 0.5})
    return moments.join(places, "event_type").select("event_type", "sd", F.round("p90", 4).alias("p90"), "r", F.round("mid", 4).alias("mid"))


@query("select event_type, count(distinct user_id) as n_users from events group by event_type")
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return groups.distinct_in_two(_t(spark, d, "events"), ["event_type"], "user_id", "n_users")


@query("select event_type, count(distinct user_id) as n_users, true as close from events group by event_type")
def approximate_users(spark: SparkSession, d: str) -> DataFrame:
    """A sketch's count held against the exact one: whether it is within four of its standard errors."""
    e = _t(spark, d, "events")
    near = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("near"))
    close = (F.abs(F.col("near") - F.col("n_users")) <= 0.08 * F.col("n_users")).alias("close")
    return groups.distinct_in_two(e, ["event_type"], "user_id", "n_users").join(near, "event_type").select("event_type", "n_users", close)


@query(
    """select o_custkey, o_orderkey, row_number() over w as n, lag(o_totalprice) over w as before, rank() over (partition by o_orderstatus order by o_totalprice) as by_price,
    cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as decimal(38,2)) as three
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"""
)
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = groups.ranked(_t(spark, d, "orders"), "o_orderstatus", "o_totalprice", "by_price")  # a status has much of the table
    return rows.select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("n"), F.lag("o_totalprice").over(w).alias("before"), F.col("by_price").cast("long"),
        F.sum(_money("o_totalprice")).over(w.rowsBetween(-2, 0)).cast("decimal(38,2)").alias("three"),
    )


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("select o_orderpriority, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) <= 3")
def top_per_priority(spark: SparkSession, d: str) -> DataFrame:
    return groups.top_per_group(_t(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(_t(spark, d, "supplier").select("s_nationkey"))


@query(
    """select p_partkey, upper(p_name) as name, cast(length(p_brand) as int) as n, replace(p_type, 'O', '0') as t, substr(p_name, 1, 3) as s,
    regexp_extract(p_brand, '([0-9]+)', 1) as num, p_brand || '/' || p_type as both_, reverse(p_type) as r from part"""
)
def strings(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("name"), F.length("p_brand").alias("n"), F.replace("p_type", F.lit("O"), F.lit("0")).alias("t"),
        F.substring("p_name", 1, 3).alias("s"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.concat_ws("/", "p_brand", "p_type").alias("both_"), F.reverse("p_type").alias("r"),
    )


@query(
    """select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(week(o_orderdate) as int) as w, date_trunc('month', o_orderdate) as first_,
    cast(date_diff('day', timestamp '1995-01-01', o_orderdate) as int) as days, strftime(o_orderdate, '%Y/%m/%d') as text from orders"""
)
def dates(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_orderdate")
    return _t(spark, d, "orders").select(
        "o_orderkey", F.year(x).alias("y"), F.month(x).alias("m"), F.weekofyear(x).alias("w"), F.date_trunc("month", x).cast("timestamp_ntz").alias("first_"),
        F.datediff(x, F.lit("1995-01-01").cast("date")).alias("days"), F.date_format(x, "yyyy/MM/dd").alias("text"),
    )


@query(
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt(l_extendedprice), 4) as root, round(ln(l_quantity), 6) as ln_q, cast(floor(l_discount * 100) as bigint) as pct,
    round(power(l_tax + 1, 2), 6) as sq, cast(l_orderkey % 7 as bigint) as m, round(l_extendedprice / nullif(l_tax, 0), 2) as per_tax from lineitem"""
)
def maths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 4).alias("root"), F.round(F.ln("l_quantity"), 6).alias("ln_q"),
        F.floor(c("l_discount") * 100).alias("pct"), F.round(F.pow(c("l_tax") + 1, F.lit(2)), 6).alias("sq"), (c("l_orderkey") % 7).alias("m"),
        F.round(F.try_divide("l_extendedprice", "l_tax"), 2).alias("per_tax"),
    )


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(json_extract_string(props, '$.k') as int) % 2 = 0 as even from events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return _t(spark, d, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query("select vec_id, embedding[1] as first_, cast(len(embedding) as int) as n, list_max(embedding) as most from embeddings")
def arrays(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("first_"), F.size("embedding").alias("n"), F.array_max("embedding").alias("most"))


@query("select label, i as place, round(avg(x), 5) as mean from (select label, unnest(range(64)) as i, unnest(embedding) as x from embeddings) group by label, i")
def exploded_means(spark: SparkSession, d: str) -> DataFrame:
    each = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return each.groupBy("label", F.col("place").cast("long").alias("place")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(
    """with q as (select vec_id as asked, cast(embedding as double[]) as e from embeddings where vec_id % 20 = 0),
    a as (select asked, vec_id, round(list_cosine_similarity(cast(embedding as double[]), e), 6) as alike from embeddings, q where vec_id <> asked)
    select asked, vec_id, alike from a qualify row_number() over (partition by asked order by alike desc, vec_id) <= 10"""
)
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, among all."""
    found = vectors.nearest(_t(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)
    return found.withColumnRenamed("id", "vec_id")


@query("select l_partkey, count(*) as n from lineitem a where l_quantity > (select avg(l_quantity) + 15 from lineitem b where b.l_partkey = a.l_partkey) group by l_partkey")
def correlated_subquery(spark: SparkSession, d: str) -> DataFrame:
    sql = "select l_partkey, count(*) as n from {l} a where l_quantity > (select avg(l_quantity) + 15 from {l} b where b.l_partkey = a.l_partkey) group by l_partkey"
    return spark.sql(sql, l=_t(spark, d, "lineitem"))


@query(
    """with big as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by o_custkey), mean as (select avg(total) as m from big)
    select c_mktsegment, count(*) as n from big join customer on o_custkey = c_custkey, mean where total > m group by c_mktsegment"""
)
def common_tables(spark: SparkSession, d: str) -> DataFrame:
    sql = """with big as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from {o} group by o_custkey)
    select c_mktsegment, count(*) as n from big join {c} on o_custkey = c_custkey where total > (select avg(total) from big) group by c_mktsegment"""
    return spark.sql(sql, o=_t(spark, d, "orders"), c=_t(spark, d, "customer"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = _t(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


@query(
    """with s as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new_ from events window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(new_) over (partition by user_id order by ts, event_id) as k from s)
    select user_id, min(ts) as start, max(ts) as stop, count(*) as n from g group by user_id, k"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return groups.sessions(_t(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = stream.drain(stream.windowed(stream.source(spark, d), "1 day", "1 hour"), "streamed", _scratch(spark, "streamed"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select p_partkey, round(p_retailprice * 1.1, 2) as price from part")
def vector_udf(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def raised(x: pd.Series) -> pd.Series:
        return x * 1.1

    return _t(spark, d, "part").select("p_partkey", F.round(raised("p_retailprice"), 2).alias("price"))


@query("select user_id, round(max(value) - min(value), 4) as spread from events group by user_id")
def group_udf(spark: SparkSession, d: str) -> DataFrame:
    def spread(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": g["user_id"].iloc[:1], "spread": [round(g["value"].max() - g["value"].min(), 4)]})

    return _t(spark, d, "events").select("user_id", "value").groupBy("user_id").applyInPandas(spread, "user_id long, spread double")


@query("select user_id, round(mad(value), 4) as deviation from events group by user_id")
def aggregate_udf(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate that Spark lacks; a group's values meet in one task, so it is for groups that stay small."""

    @F.pandas_udf("double")
    def deviation(x: pd.Series) -> float:
        return (x - x.median()).abs().median()

    return _t(spark, d, "events").groupBy("user_id").agg(deviation("value").alias("deviation")).select("user_id", F.round("deviation", 4).alias("deviation"))


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def table_udf(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for w in (text or "").split(" "):
                yield (w,)

    return _t(spark, d, "part").lateralJoin(Words(F.col("p_name").outer())).select("p_partkey", "word")


@query("select l_returnflag, cast(count(case when l_linestatus = 'O' then 1 end) as bigint) as O, cast(count(case when l_linestatus = 'F' then 1 end) as bigint) as F from lineitem group by l_returnflag")
def pivoted(spark: SparkSession, d: str) -> DataFrame:
    out = _t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("O"), F.coalesce("F", F.lit(0)).alias("F"))


@query(
    """select c_custkey, coalesce(nullif(case when c_acctbal < 0 then '' else c_mktsegment end, ''), 'NONE') as segment,
    case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'much' end as band from customer"""
)
def defaults(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("c_acctbal")
    segment = scalar.or_default(F.when(balance < 0, "").otherwise(F.col("c_mktsegment")), "NONE")
    band = F.when(balance < 0, "debt").when(balance < 5000, "some").otherwise("much")
    return _t(spark, d, "customer").select("c_custkey", segment.alias("segment"), band.alias("band"))


@query("select n_name as key, coalesce(r_name, cast(n_regionkey as varchar)) as value from nation left join region on r_regionkey = n_regionkey and r_regionkey < 3")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    old = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = n.join(_t(spark, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    return settings.upsert(old, new)


@query("select text, count(*) as copies, min(doc_id) as first_id from documents group by text having count(*) > 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    by = _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    return by.join(_t(spark, d, "documents").select(F.col("doc_id").alias("first_id"), "text"), "first_id").select("text", "copies", "first_id")


@query(
    """select c.role, cast(count(*) as bigint) as n, cast(sum(length(c.text)) as bigint) as chars from conversations c join
    (select conv_id, max(turn) as turn from conversations group by conv_id) l on c.conv_id = l.conv_id and c.turn = l.turn group by c.role"""
)
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    last = _t(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("role", F.length("text").alias("n")), "turn").alias("x"))
    return last.groupBy("x.role").agg(F.count("*").alias("n"), F.sum("x.n").alias("chars"))


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders")
def sorted_orders(spark: SparkSession, d: str) -> DataFrame:
    """A full sort: places over all rows, ranked in ranges and sorted by them."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("all"), (-F.col("o_totalprice")).alias("low"))
    tied = Window.partitionBy("low").orderBy("o_orderkey")
    out = groups.ranked(o, "all", "low", "first").select("o_orderkey", "o_totalprice", (F.col("first") + F.row_number().over(tied) - 1).cast("long").alias("place"))
    return out.orderBy("place")


@query("select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(_t(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer where c_acctbal > 0 except select s_nationkey from supplier where s_acctbal > 5000")
def except_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).subtract(_t(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("select p_partkey, map_extract(map {'brand': p_brand, 'type': p_type}, 'type')[1] as t, len(map_keys(map {'brand': p_brand, 'type': p_type})) as n from part")
def maps(spark: SparkSession, d: str) -> DataFrame:
    both = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return _t(spark, d, "part").select("p_partkey", F.element_at(both, "type").alias("t"), F.size(F.map_keys(both)).cast("long").alias("n"))


@query("select lower(n_name) as name, contains(lower(n_name), 'an') as has_an, c_custkey is not null as has_customer, n_nationkey from nation left join (select min(c_custkey) as c_custkey, c_nationkey from customer where c_acctbal > 9900 group by c_nationkey) on c_nationkey = n_nationkey")
def flags(spark: SparkSession, d: str) -> DataFrame:
    """Lower case, contains, and a flag for what a left join found."""
    rich = _t(spark, d, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    j = _t(spark, d, "nation").join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    name = F.lower("n_name")
    return j.select(name.alias("name"), F.contains(name, F.lit("an")).alias("has_an"), F.col("c_custkey").isNotNull().alias("has_customer"), "n_nationkey")


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA'")
def view(spark: SparkSession, d: str) -> DataFrame:
    """A temporary view over two tables, queried by name."""
    _t(spark, d, "nation").createOrReplaceTempView("quarryflow_nation")
    _t(spark, d, "region").createOrReplaceTempView("quarryflow_region")
    spark.sql("create or replace temporary view quarryflow_places as select n_nationkey, n_name, r_name from quarryflow_nation join quarryflow_region on n_regionkey = r_regionkey")
    return spark.sql("select * from quarryflow_places where r_name <> 'ASIA'")


@query("select n_nationkey, upper(n_name) as n_name from nation where n_regionkey < 2 union all select n_nationkey, n_name from nation where n_regionkey = 4")
def stored_table(spark: SparkSession, d: str) -> DataFrame:
    """A catalog table: created, filled, overwritten, added to. The name goes when the reader is made; the files stay as scratch."""
    name, path, n = f"quarryflow_{uuid.uuid4().hex}", _scratch(spark, "stored"), _t(spark, d, "nation")
    spark.sql(f"create table {name} (n_nationkey int, n_name string) using parquet location '{path}'")
    spark.sql(f"insert into {name} select n_nationkey, n_name from {{n}}", n=n)
    spark.sql(f"insert overwrite {name} select n_nationkey, upper(n_name) from {{n}} where n_regionkey < 2", n=n)
    spark.sql(f"insert into {name} select n_nationkey, n_name from {{n}} where n_regionkey = 4", n=n)
    out = spark.read.schema(spark.table(name).schema).parquet(path)
    spark.sql(f"drop table {name}")
    return out


@query("select 'N' || n_nationkey as key, n_name as value from nation where n_regionkey <> 0")
def parsed_settings(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("# N="), "n_name")).otherwise(F.format_string('export N%d="%s"', "n_nationkey", "n_name"))
    return settings.parse(_t(spark, d, "nation").select(line.alias("value")))


@query("select c_nationkey, min(c_custkey) as c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000) group by c_nationkey")
def first_present(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation the first customer that has a large order."""
    c = _t(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("place"))
    large = _t(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return settings.first_present(c, large, "c_nationkey", "c_custkey", "place")


@query(
    """with known as (select n_nationkey as key, n_name as value from nation where n_regionkey < 3)
    select * from known union all select distinct s_nationkey, 'supplier' from supplier where s_nationkey not in (select key from known)"""
)
def append_absent(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return settings.append_absent(known, _t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("supplier").alias("value")), ["key"])


@query("select p_partkey, p_size as major, substr(p_type, 1, 1) in ('s', 'S') as yes from part")
def answers(spark: SparkSession, d: str) -> DataFrame:
    """The number before the first dot of a version, and whether an answer affirms."""
    major = scalar.major_version(F.format_string("v%d.%d.0", "p_size", "p_partkey"))
    return _t(spark, d, "part").select("p_partkey", major.alias("major"), scalar.affirmative(F.substring("p_type", 1, 1)).alias("yes"))


def _round_trip(format: str, schema: str | None) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        rows = _t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        rows = rows.select(F.to_json(F.struct("*")).alias("value")) if format == "text" else rows
        files.write(rows, path := _scratch(spark, format), format)
        back = files.read(spark, path, format, schema)
        return back.select(F.from_json("value", "s_suppkey long, s_name string, s_nationkey long").alias("x")).select("x.*") if format == "text" else back

    f.__name__ = f"{format}_files"
    return f


for _format, _schema in (("csv", "s_suppkey long, s_name string, s_nationkey long"), ("json", "s_suppkey long, s_name string, s_nationkey long"), ("orc", None), ("text", None)):
    query("select s_suppkey, s_name, s_nationkey from supplier")(_round_trip(_format, _schema))


@query(
    """select x as start, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval '6 hours']) as x from events)
    group by 1, 2"""
)
def sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 12 hours every 6, as a real stream with a watermark."""
    out = stream.drain(stream.windowed(stream.source(spark, d), "12 hours", "1 hour", "6 hours"), "sliding", _scratch(spark, "sliding"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """with s as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new_ from events window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(new_) over (partition by user_id order by ts, event_id) as k from s)
    select user_id, min(ts) as start, count(*) as n from g group by user_id, k"""
)
def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = stream.drain(stream.sessions(stream.source(spark, d), "30 minutes", "1 hour"), "sessions", _scratch(spark, "sessions"), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("select event_id, user_id, event_type from events")
def streamed_once(spark: SparkSession, d: str) -> DataFrame:
    """The stream united with itself, each event once."""
    twice = stream.source(spark, d).unionByName(stream.source(spark, d))
    return stream.drain(stream.once(twice, "1 hour"), "once", _scratch(spark, "once")).select("event_id", "user_id", "event_type")


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id")
def streamed_running(spark: SparkSession, d: str) -> DataFrame:
    """Running state of each user; the last of what a stream gave is what its state holds."""
    out = stream.drain(stream.running(stream.source(spark, d)), "running", _scratch(spark, "running"), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).select("user_id", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql is not None}
