"""Queries of the array operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import astronomy as astro
from lattica.functions import dates, sofa, special
from lattica.functions import random as rnd
from lattica.functions import strings as st
from lattica.ndarray import NdArray
from lattica.operators import cluster as cl
from lattica.operators import directions
from lattica.operators import elementwise as el
from lattica.operators import fitting as fit
from lattica.operators import images as im
from lattica.operators import reductions as red
from lattica.operators import selection as sel
from lattica.operators import shape as sh
from lattica.operators import spectral as sp
from lattica.operators import windows as win
from lattica.streaming.windows import tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def tab(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark, sf) -> NdArray:
    """Event values by event number."""
    return NdArray.from_table(tab(spark, sf, "events"), ["event_id"], "value")


def orders(spark, sf) -> NdArray:
    return NdArray.from_table(tab(spark, sf, "orders"), ["o_orderkey"], "o_totalprice")


def emb(spark, sf) -> NdArray:
    """Embeddings as a matrix, vector by component."""
    t = tab(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return NdArray.from_table(t, ["vec_id", "k"], F.col("x").cast("double"))


def r4(c: Column | str, name: str = "v", places: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places).alias(name)


def out(a: NdArray, places: int = 4) -> DataFrame:
    return a.df.select(*a.axes, r4(F.col("v").cast("double"), "v", places))


# SQL of the same arrays.
EV = "(select event_id as i0, value as v from events)"
OR = "(select o_orderkey as i0, o_totalprice as v from orders)"
EM = "(select vec_id as i0, cast(k - 1 as bigint) as i1, cast(embedding[k] as double) as v from embeddings, range(1, 65) t(k))"

# Sources, projections and reductions of tables.


@q("""select l_returnflag as flag, round(sum(l_extendedprice * (1 - l_discount)), 2) as total, round(avg(l_extendedprice * (1 - l_discount)), 2) as mean, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1""")
def total_by_flag(spark, sf):
    x = tab(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return x.groupBy(F.col("l_returnflag").alias("flag")).agg(r4(F.sum("x"), "total", 2), r4(F.avg("x"), "mean", 2), F.count("*").alias("n"))


@q(f"select i0, round(sum(v), 4) as v from {EM} group by 1")
def total_axis(spark, sf):
    return red.total(emb(spark, sf), 1).select("i0", r4("v"))


@q(f"select cast(0 as bigint) as i0, i1, round(sum(v * v), 4) as v from {EM} group by 2")
def total_power_keepdims(spark, sf):
    return red.total(emb(spark, sf), 0, power=2, keepdims=True).select("i0", "i1", r4("v"))


@q(f"select i1, round(avg(v), 5) as v from {EM} group by 1")
def mean_axis(spark, sf):
    return red.mean(emb(spark, sf), 0).select("i1", r4("v", places=5))


@q(f"select round(avg(case when i0 % 7 <> 0 then v end), 4) as v from {EV}")
def mean_omitnans(spark, sf):
    a = ev(spark, sf).with_index(lambda v, i: el.set_nan(v, (i % 7 == 0).cast("int")))
    return red.mean(a, omitnans=True).select(r4("v"))


@q("select o_orderstatus as status, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 3) as v from orders group by 1")
def mean_weighted(spark, sf):
    return red.weighted_mean(tab(spark, sf, "orders"), ["o_orderstatus"], F.col("o_totalprice"), F.col("o_custkey")).select(F.col("o_orderstatus").alias("status"), r4("v", places=3))


@q(f"select i0, round(var_samp(v), 6) as v from {EM} group by 1")
def variance_axis(spark, sf):
    return red.variance(emb(spark, sf), 1).select("i0", r4("v", places=6))


@q(f"select i0, round(stddev_pop(v), 6) as v from {EM} group by 1")
def sdev_population(spark, sf):
    return red.sdev(emb(spark, sf), 1, population=True).select("i0", r4("v", places=6))


@q("""select user_id as class, count(value) as n, round(sum(value), 3) as total, round(avg(value), 4) as mean, round(case when count(value) = 1 then 0 else var_samp(value) end, 3) as variance,
round(sqrt(case when count(value) = 1 then 0 else var_samp(value) end), 4) as sdev from events group by 1""")
def moments_by_class(spark, sf):
    d = red.by_class(tab(spark, sf, "events"), F.col("user_id"), F.col("value"))
    return d.select("class", "n", r4("total", "total", 3), r4("mean", "mean"), r4("variance", "variance", 3), r4("sdev", "sdev"))


@q("select l_returnflag as flag, round(covar_samp(l_quantity, l_extendedprice), 2) as v from lineitem group by 1")
def covariance_by_flag(spark, sf):
    return red.covariance(tab(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice")).select(F.col("l_returnflag").alias("flag"), r4("v", places=2))


@q("select strftime(l_shipdate, '%Y') as year, round(corr(l_quantity, l_extendedprice), 6) as v from lineitem group by 1")
def crosscorr_by_year(spark, sf):
    t = tab(spark, sf, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy"))
    return red.crosscorr(t, ["year"], F.col("l_quantity"), F.col("l_extendedprice")).select("year", r4("v", places=6))


@q(f"select i0, round(max(v), 6) as hi, round(min(v), 6) as lo from {EM} group by 1")
def extremes_axis(spark, sf):
    a = emb(spark, sf)
    return red.maximum(a, 1).withColumnRenamed("v", "hi").join(red.minimum(a, 1).withColumnRenamed("v", "lo"), "i0").select("i0", r4("hi", "hi", 6), r4("lo", "lo", 6))


@q(f"select i0, arg_max(i1, v) as at_i1 from {EM} group by 1")
def maxloc_axis(spark, sf):
    return red.maxloc(emb(spark, sf), 1)


@q(f"select i0, arg_min(i1, v) as at_i1 from {EM} group by 1")
def minloc_axis(spark, sf):
    return red.minloc(emb(spark, sf), 1)


@q("select l_returnflag as flag, round(sum(l_quantity * power(l_linenumber, 2) * l_suppkey), 1) as v from lineitem group by 1")
def psum_by_flag(spark, sf):
    return red.psum(tab(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_quantity"), [F.col("l_linenumber"), F.col("l_suppkey")], [2, 1]).select(F.col("l_returnflag").alias("flag"), r4("v", places=1))


@q("select b as i0, count(l_quantity) as v from range(0, (select max(cast(l_quantity as bigint)) + 1 from lineitem)) t(b) left join lineitem on floor(l_quantity) = b group by 1")
def hist_quantity(spark, sf):
    return red.hist(tab(spark, sf, "lineitem"), F.col("l_quantity"))


@q("""with h as (select floor(value) as i0, count(*) as n from events where value >= 0 group by 1), r as (select cast(b as bigint) as i0, coalesce(n, 0) as n from range(0, (select cast(max(i0) as bigint) + 1 from h)) t(b) left join h on h.i0 = b)
select i0, round(sum(n) over (order by i0) / sum(n) over (), 6) as v from r""")
def histr_value(spark, sf):
    t = tab(spark, sf, "events").where("value >= 0")
    return red.histr(t, F.col("value")).select("i0", r4("v", places=6))


@q("select b as i0, round(coalesce(sum(value), 0), 3) as v from range(0, 200) t(b) left join events on user_id = b group by 1")
def distr_value(spark, sf):
    t = tab(spark, sf, "events")
    bins = max(200, (t.agg(F.max("user_id")).first()[0] or 0) + 1)  # the SQL has 200
    return red.distr(t, F.col("user_id"), F.col("value"), bins).select("i0", r4("v", places=3))


@q(f"select i0, round(quantile_cont(v, 0.3), 6) as v from {EM} group by 1")
def quantile_axis(spark, sf):
    return red.quantile(emb(spark, sf), 0.3, 1).select("i0", r4("v", places=6))


@q("select floor(quantile_cont(p_size, 0.5))::bigint as v from part")
def median_whole(spark, sf):
    return red.median(NdArray.from_table(tab(spark, sf, "part"), ["p_partkey"], "p_size")).select(F.col("v").cast("bigint").alias("v"))


@q(f"select 0::bigint as i0, 0::bigint as i1, round(quantile_cont(v, 0.3), 6) as v from {EM}")
def quantile_all_keepdims(spark, sf):
    return red.quantile(emb(spark, sf), 0.3, None, True).select("i0", "i1", r4("v", places=6))


@q("select round(quantile_cont(o_totalprice, 0.9), 3) as v from orders")
def quantile_of_prices(spark, sf):
    return red.quantile(orders(spark, sf), 0.9).select(r4("v", places=3))


@q("select c_custkey, coalesce((select min(o_orderkey) from orders where o_custkey = c_custkey), -1) as v from customer")
def match_first_order(spark, sf):
    return red.match(tab(spark, sf, "customer").select("c_custkey"), "c_custkey", tab(spark, sf, "orders"), "o_custkey", "o_orderkey")


@q("select s_suppkey, coalesce((select min(event_id) from events where user_id = s_suppkey and event_id >= 500), -1) as v from supplier")
def find_offset(spark, sf):
    return red.find(tab(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", tab(spark, sf, "events"), "user_id", "event_id", 500)


@q("select s_acctbal, coalesce((select min(p_partkey) from part where p_retailprice >= s_acctbal), -1) as v from supplier")
def find_at_or_past(spark, sf):
    return red.find_at_or_past(tab(spark, sf, "supplier").select("s_acctbal"), "s_acctbal", tab(spark, sf, "part"), "p_retailprice", "p_partkey")


@q(f"with f as (select i0, i0 - row_number() over (order by i0) as g from {EV} where v > 20) select min(i0) as start, count(*) as length from f group by g")
def spans_over_twenty(spark, sf):
    return red.findspans(ev(spark, sf).map(lambda v: (v > 20).cast("int")))


@q("""with recursive e as (select distinct l_suppkey % 40 as a, 1000 + l_linenumber * 40 + (l_suppkey % 40) // 4 as b from lineitem), u as (select a, b from e union select b, a from e),
c(node, root) as (select a, a from u union select u.b, c.root from c join u on u.a = c.node) select node, min(root) as root from c group by 1""")
def equivalence_classes(spark, sf):
    t = tab(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("a"), (1000 + F.col("l_linenumber") * 40 + F.floor((F.col("l_suppkey") % 40) / 4)).cast("bigint").alias("b")).distinct()
    return red.equivalence(t)


@q()
def equivalence_classes_whole(spark, sf):
    t = tab(spark, sf, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"))
    return red.equivalence(t)


@q(f"with m as {EM} select a.i1 as i0, b.i1 as i1, round(sum(a.v * b.v), 3) as v from m a join m b using (i0) group by a.i1, b.i1")
def mproduct_gram(spark, sf):
    a = emb(spark, sf)
    return out(red.mproduct(sh.transpose(a), a), 3)


# Elementwise operators.


@q("""select o_orderkey, o_custkey // 7 as q, o_custkey % 7 as m, case when 2 * (o_custkey % 7) > 7 then o_custkey % 7 - 7 else o_custkey % 7 end as s, o_custkey & 12 as a, o_custkey | 12 as o, xor(o_custkey, 12) as x,
bit_count(xor(o_custkey, o_orderkey))::bigint as h, (o_custkey >> 2) & 7 as b, greatest(o_custkey, 700) as hi, least(o_custkey, 700) as lo, (o_custkey > 700)::bigint as gt, (o_custkey = 0)::bigint as n from orders""")
def integer_operators(spark, sf):
    k, seven = F.col("o_custkey"), F.lit(7)
    c = lambda x, n: x.cast("bigint").alias(n)
    return tab(spark, sf, "orders").select("o_orderkey", c(el.idiv(k, seven), "q"), c(el.fmod(k, seven), "m"), c(el.smod(k, seven), "s"), c(el.bit_and(k, F.lit(12)), "a"), c(el.bit_or(k, F.lit(12)), "o"), c(el.bit_xor(k, F.lit(12)), "x"), c(el.hamming(k, F.col("o_orderkey")), "h"), c(el.extract_bits(k, 2, 3), "b"), c(el.larger(k, F.lit(700)), "hi"), c(el.smaller(k, F.lit(700)), "lo"), c(el.gt(k, F.lit(700)), "gt"), c(el.not_(k), "n"))


@q("""select l_orderkey, l_linenumber, round(sqrt(l_quantity) + ln(l_quantity) + exp(l_discount) + sin(l_tax) + cos(l_tax) + tan(l_tax) + atan2(l_tax, l_quantity) + cbrt(l_quantity) + asin(l_tax) + acos(l_tax) + atan(l_quantity)
+ log10(l_quantity) + log2(l_quantity) + abs(-l_quantity) + sign(l_tax) + power(l_quantity, 1.5) + floor(l_extendedprice / 7) + ceil(l_extendedprice / 9), 3) as v, round(case when l_tax = 0 then 0 else 1 / l_tax end, 4) as z,
round(1 + 2 * l_discount + 3 * l_discount * l_discount, 6) as p from lineitem""")
def real_functions(spark, sf):
    n, d, t, e = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    v = F.sqrt(n) + F.log(n) + F.exp(d) + F.sin(t) + F.cos(t) + F.tan(t) + F.atan2(t, n) + F.cbrt(n) + F.asin(t) + F.acos(t) + F.atan(n) + F.log10(n) + F.log2(n) + F.abs(el.neg(n)) + F.signum(t) + el.power(n, F.lit(1.5)) + F.floor(e / 7) + F.ceil(e / 9)
    return tab(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r4(v, "v", 3), r4(el.zinv(t), "z"), r4(el.poly(d, [1, 2, 3]), "p", 6))


@q("""select l_orderkey, l_linenumber, l_extendedprice::bigint & 255 as b8, ((trunc(l_extendedprice)::bigint + 32768) % 65536) - 32768 as w16, trunc(l_extendedprice)::bigint as l64, round(l_extendedprice)::bigint as r, cast(l_linenumber as varchar) as s from
(select l_orderkey, l_linenumber, trunc(l_extendedprice) + 0.25 as l_extendedprice from lineitem)""")
def conversions(spark, sf):
    v = F.floor("l_extendedprice") + 0.25
    return tab(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sh.convert(v, "byte").cast("bigint").alias("b8"), sh.convert(v, "int16").cast("bigint").alias("w16"), sh.convert(v, "int64").alias("l64"), el.rfix(v).cast("bigint").alias("r"), sh.convert(F.col("l_linenumber"), "string").alias("s"))


@q("""select o_orderkey, round(o_totalprice * o_custkey - 3 * o_orderkey, 2) as re, round(o_totalprice * o_orderkey + 3 * o_custkey, 2) as im, round(atan2(3, o_totalprice), 8) as arg, round(o_totalprice * o_totalprice + 9, 2) as sq from orders""")
def complex_numbers(spark, sf):
    a, b = el.cplx(F.col("o_totalprice"), F.lit(3.0)), el.cplx(F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double"))
    p = el.cmul(a, b)
    return tab(spark, sf, "orders").select("o_orderkey", r4(p["re"], "re", 2), r4(p["im"], "im", 2), r4(el.arg(a), "arg", 8), r4(el.complex_square(a), "sq", 2))


@q(f"select a.i0, round(a.v - 2 * b.v, 3) as v from {EV} a join {OR} b using (i0)")
def array_with_array(spark, sf):
    a, b = ev(spark, sf), orders(spark, sf)
    n = min(a.dims[0], b.dims[0])
    return out(sh.subscript(a, slice(0, n)).zip(sh.subscript(b, slice(0, n)), lambda x, y: x - 2 * y), 3)


# Shape and subscripts.


@q(f"select i1 as i0, i0 as i1, round(v, 6) as v from {EM}")
def transposed(spark, sf):
    return out(sh.transpose(emb(spark, sf)), 6)


@q(f"select (select max(vec_id) from embeddings) - i0 as i0, i1, round(v, 6) as v from {EM}")
def reversed_axis(spark, sf):
    return out(sh.reverse(emb(spark, sf), 0), 6)


@q(f"select (i0 + i1 * (select max(vec_id) + 1 from embeddings)) % 64 as i0, (i0 + i1 * (select max(vec_id) + 1 from embeddings)) // 64 as i1, round(v, 6) as v from {EM}")
def redimensioned(spark, sf):
    a = emb(spark, sf)
    return out(sh.redim(a, 64, a.dims[0]), 6)


@q(f"select (i0 + 3) % (select max(vec_id) + 1 from embeddings) as i0, (i1 + 60) % 64 as i1, round(v, 6) as v from {EM}")
def shifted(spark, sf):
    return out(sh.shift(emb(spark, sf), [3, -4]), 6)


@q(f"select a.i0, round(coalesce(b.v, 0), 4) as v from {EV} a left join {EV} b on b.i0 = a.i0 - 5")
def shifted_blank(spark, sf):
    return out(sh.shift(ev(spark, sf), [5], 0.0))


@q(f"select i0 // 10 as i0, i1 // 4 as i1, round(avg(v), 6) as v from {EM} where i0 < (select (max(vec_id) + 1) // 10 * 10 from embeddings) group by 1, 2")
def compressed(spark, sf):
    return out(sh.compress(emb(spark, sf), 10, 4), 6)


@q(f"select i0 * 2 + a as i0, i1 * 2 + b as i1, round(v, 6) as v from {EM}, range(0, 2) x(a), range(0, 2) y(b)")
def expanded(spark, sf):
    return out(sh.expand(emb(spark, sf), 2, 2), 6)


@q(f"with e as {EV}, x as (select i0, v, coalesce(lead(v) over (order by i0), v) as n from e) select i0 * 3 + o as i0, round(v + (n - v) * o / 3.0, 4) as v from x, range(0, 3) t(o)")
def expanded_linear(spark, sf):
    return out(sh.expand_linear(ev(spark, sf), 3))


@q(f"select i0 - 10 as i0, i1 // 2 as i1, round(v, 6) as v from {EM} where i0 >= 10 and i0 < 90 and i1 in (0, 2, 4)")
def subscripted(spark, sf):
    return out(sh.subscript(emb(spark, sf), slice(10, 90), [0, 2, 4]), 6)


@q(f"select i1 as i0, round(sum(v), 5) as v from {EM} where i0 < 50 group by 1")
def subscript_summed(spark, sf):
    return out(sh.subscript(sh.subscript(emb(spark, sf), slice(0, 50), slice(0, 64)), "+", slice(0, 64)), 5)


@q(f"select i0, i1, round(v, 6) as v from {EM} union all select i0, i1 + 64, round(2 * v, 6) from {EM}")
def concatenated(spark, sf):
    a = emb(spark, sf)
    return out(sh.concat(a, a.map(lambda v: 2 * v)), 6)


@q(f"select i0, i1, round(case when i0 between 5 and 24 and i1 between 8 and 27 then 1 else v end, 6) as v from {EM}")
def inserted(spark, sf):
    a = emb(spark, sf)
    return out(sh.insert(a, NdArray.full(spark, (20, 20), 1.0), [5, 8]), 6)


@q("select a as i0, b as i1, round(sqrt((a - 49.5) * (a - 49.5) + (b - 24.5) * (b - 24.5)), 6) as v from range(0, 100) x(a), range(0, 50) y(b)")
def distances(spark, sf):
    return out(sh.distarr(spark, (100, 50)), 6)


@q("select a as i0, b as i1, a + 100 * b as v from range(0, 100) x(a), range(0, 50) y(b)")
def counted(spark, sf):
    return sh.indgen(NdArray.full(spark, (100, 50))).df


@q(f"with h as (select max(event_id) + 1 as n from events) select (i0 + n // 2) % n as i0, round(v, 4) as v from {EV}, h")
def halves_swapped(spark, sf):
    return out(sh.swaphalf(ev(spark, sf)))


# Selection and ordering.


@q(f"select i0, v from {EV} where v > 20 and i0 % 3 = 0")
def sieved(spark, sf):
    return sel.sieve(ev(spark, sf), (F.col("v") > 20) & (F.col("i0") % 3 == 0))


@q(f"select row_number() over (order by v) - 1 as i0, v from {EV}")
def sorted_values(spark, sf):
    return sel.sort(ev(spark, sf)).df


@q(f"select i0, row_number() over (partition by i0 order by v) - 1 as i1, round(v, 6) as v from {EM}")
def sorted_axis(spark, sf):
    return out(sel.sort(emb(spark, sf), 1), 6)


@q(f"select i0, row_number() over (partition by i0 order by v, i1) - 1 as i1, i1 as v from {EM}")
def index_axis(spark, sf):
    return sel.index(emb(spark, sf), 1).df


@q(f"select i0, i1, row_number() over (partition by i0 order by v, i1) - 1 as v from {EM}")
def rank_axis(spark, sf):
    return sel.rank(emb(spark, sf), 1).df


@q("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else o_orderstatus end as o_orderstatus from orders")
def replaced(spark, sf):
    t = spark.createDataFrame([("F", "final"), ("O", "open")], "source string, target string")
    return sel.replace(tab(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", t)


@q("select p_partkey, dense_rank() over (order by p_brand) - 1 as lookup from part")
def looked_up(spark, sf):
    return sel.tolookup(tab(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")[1]


@q("select s_suppkey as k, count(*) as n from supplier join events on user_id = s_suppkey where s_suppkey < 50 group by 1")
def multisieved(spark, sf):
    y = tab(spark, sf, "supplier").where("s_suppkey < 50").select(F.col("s_suppkey").alias("k"))
    return sel.multisieve_ends(sel.multisieve(tab(spark, sf, "events"), "user_id", "event_id", y, "k"), "k")


@q()
def multisieved_whole(spark, sf):
    y = tab(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return sel.multisieve_ends(sel.multisieve(tab(spark, sf, "events"), "user_id", "event_id", y, "k"), "k")


@q(f"select i0, max(v) over (order by i0 rows between 3 preceding and 3 following) as v from {EV}")
def maxfiltered(spark, sf):
    return sel.maxfilter(ev(spark, sf), 0, 7).df


@q(f"select i0, i1, round(min(v) over (partition by i0 order by i1 rows between 2 preceding and 2 following), 6) as v from {EM}")
def minfiltered(spark, sf):
    return out(sel.minfilter(emb(spark, sf), 1, 5), 6)


@q(f"select i0, round(median(v) over (order by i0 rows between 2 preceding and 2 following), 4) as v from {EV}")
def medfiltered(spark, sf):
    return out(sel.medfilter(ev(spark, sf), 0, 5))


@q(f"select i0, round(quantile_cont(v, 0.25) over (order by i0 rows between 4 preceding and 4 following), 4) as v from {EV}")
def ordfiltered(spark, sf):
    return out(sel.ordfilter(ev(spark, sf), 0, 9, 0.25))


@q(f"with x as (select i0, v, lag(v) over (order by i0) as l, lead(v) over (order by i0) as r from {EV}) select i0, v from x where v > l and v >= r")
def local_maxima(spark, sf):
    return sel.find_max(ev(spark, sf))


@q(f"with x as (select i0, v, lag(v) over (order by i0) as l, lead(v) over (order by i0) as r from {EV}) select i0, v, round(i0 + (l - r) / (2 * (l - 2 * v + r)), 4) as place from x where v < l and v <= r")
def local_minima(spark, sf):
    return sel.find_min(ev(spark, sf), subgrid=True).select("i0", "v", r4("place", "place"))


# Windows along an axis.


@q(f"select i0, round(sum(v) over (order by i0), 2) as v from {EV}")
def running_sum(spark, sf):
    return out(win.runsum(ev(spark, sf)), 2)


@q(f"select i0, round(sum(v) over (partition by i0 % 3 order by i0), 2) as v from {EV}")
def running_sum_strided(spark, sf):
    return out(win.runsum(ev(spark, sf), order=3), 2)


@q(f"select i0, max(v) over (order by i0) as v from {EV}")
def running_max(spark, sf):
    return win.runmax_all(ev(spark, sf)).df


@q(f"select i0, i1, round(product(1 + v / 10) over (partition by i0 order by i1), 6) as v from {EM}")
def running_product(spark, sf):
    return out(win.runprod(emb(spark, sf).map(lambda v: 1 + v / 10), 1), 6)


@q(f"select i0, round(sum(v) over (order by i0 rows between 4 preceding and current row), 3) as v from {EV}")
def running_window_sum(spark, sf):
    return out(win.runcum(ev(spark, sf), 5, partial_width=True), 3)


@q(f"select i0, round(avg(v) over (order by i0 rows between 3 preceding and 3 following), 4) as v from {EV}")
def smoothed(spark, sf):
    return out(win.smooth(ev(spark, sf), 7))


@q(f"""with s as (select i0, avg(v) over (order by i0 rows between 3 preceding and 3 following) as m from {EV}), n as (select max(i0) as n from s)
select a.i0, round(s.m, 4) as v from {EV} a, n, s where s.i0 = greatest(3, least(n.n - 3, a.i0))""")
def smoothed_held_edges(spark, sf):
    return out(win.smooth(ev(spark, sf), 7, partial_width=False))


@q(f"select i0, round(0.25 * coalesce(lag(v) over (order by i0), 0) + 0.5 * v + 0.25 * coalesce(lead(v) over (order by i0), 0), 4) as v from {EV}")
def kernel_smoothed(spark, sf):
    return out(win.ksmooth(ev(spark, sf), [0.25, 0.5, 0.25]))


@q(f"""with e as {EV}, k as (select cast(o as bigint) as o, exp(-0.5 * power(o / (3 / sqrt(8 * ln(2))), 2)) as w from range(-6, 7) t(o))
select a.i0, round(sum(k.w * b.v) / sum(k.w), 4) as v from e a, k join e b on b.i0 = a.i0 + k.o group by 1""")
def gauss_smoothed(spark, sf):
    return out(win.gsmooth(ev(spark, sf), 3.0))


@q(f"select i0, round(coalesce(v - lag(v, 2) over (order by i0), 0), 4) as v from {EV}")
def differences(spark, sf):
    return out(win.differ(ev(spark, sf), 2))


@q(f"select i0, i1, round(coalesce(v - lag(v) over (partition by i0 order by i1), v), 6) as v from {EM}")
def differences_copied(spark, sf):
    return out(win.differ(emb(spark, sf), -1, 1), 6)


@q(f"select i0, round(coalesce(lead(v) over (order by i0) - lag(v) over (order by i0), 0), 4) as v from {EV}")
def differences_central(spark, sf):
    return out(win.differ(ev(spark, sf), 1, central=True))


@q(f"""with x as (select i0, v, lead(v) over (order by i0) as n from {EV}) select i0, round(i0 + case when v = 20 then 0 else (20 - v) / (n - v) end, 3) as place from x where v = 20 or (v - 20) * (n - 20) < 0""")
def level_crossings(spark, sf):
    return win.bisect(ev(spark, sf), 20.0).select("i0", r4("place", "place", 3))


@q(f"select i0, round(sqrt(sum(v * v)), 6) as v from {EM} group by 1")
def norms(spark, sf):
    return win.hypot_axis(emb(spark, sf), 1).select("i0", r4("v", places=6))


@q(f"select i0, round(i0 * 0.7, 4) as v from {EV}")
def unwrapped(spark, sf):
    return out(win.unmod(ev(spark, sf).with_index(lambda v, i: F.pmod(i * 0.7, F.lit(6.0))), 6.0))


# Interpolation and fits.


@q("select round(regr_intercept(l_extendedprice, l_quantity), 3) as c0, round(regr_slope(l_extendedprice, l_quantity), 4) as c1 from lineitem")
def line_fit(spark, sf):
    c = fit.pit(tab(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 1)
    return spark.createDataFrame([(round(float(c[0]), 3), round(float(c[1]), 4))], "c0 double, c1 double")


@q(f"select i0, round(v - (select regr_intercept(v, i0) from {EV}) - i0 * (select regr_slope(v, i0) from {EV}), 4) as v from {EV}")
def detrended(spark, sf):
    return out(fit.detrend(ev(spark, sf), 1))


@q("""with t as (select n_nationkey * 400.0 as x, n_regionkey * 10.0 + n_nationkey as y from nation), p as (select x, y, lead(x) over w as x2, lead(y) over w as y2, row_number() over w as n, count(*) over () as c from t window w as (order by x))
select p_partkey, round(y + (p_retailprice - x) * (y2 - y) / (x2 - x), 5) as v from part join p on x2 is not null and (p_retailprice >= x or n = 1) and (p_retailprice < x2 or n = c - 1)""")
def interpolated(spark, sf):
    t = tab(spark, sf, "nation").select((F.col("n_nationkey") * 400.0).alias("x"), (F.col("n_regionkey") * 10.0 + F.col("n_nationkey")).alias("y"))
    p = tab(spark, sf, "part").select("p_partkey", "p_retailprice")
    return fit.polate(t, "x", "y", p, "p_retailprice").select("p_partkey", r4("v", places=5))


@q()
def spline_of_embeddings(spark, sf):
    from lattica.ndarray import along_axis

    at = np.arange(0, 63, 0.5)
    return out(along_axis(emb(spark, sf), 1, lambda y: fit.cspline(np.arange(len(y)), y, at), len(at)))


# Spectra: sums of cosines and sines in SQL.


@q(f"""select i0, k as i1, round(power(sum(v * cos(2 * pi() * k * i1 / 64)) / 64, 2) + power(sum(v * sin(2 * pi() * k * i1 / 64)) / 64, 2), 6) * (case when k = 0 then 1 else 2 end) as v
from {EM}, range(0, 33) t(k) where i0 < 40 group by i0, k""")
def power_spectrum(spark, sf):
    a = sh.subscript(emb(spark, sf), slice(0, 40), slice(0, 64))
    p = sp.power(a, 1)
    return p.df.select("i0", "i1", (F.round(F.col("v") / F.when(F.col("i1") == 0, 1).otherwise(2), 6) * F.when(F.col("i1") == 0, 1).otherwise(2)).alias("v"))


@q()
def power_spectrum_whole(spark, sf):
    return out(sp.power(emb(spark, sf), 1), 6)


@q(f"select i0, i1, round(v, 6) as v from {EM}")
def fourier_round_trip(spark, sf):
    return out(sp.fftb(sp.fft(emb(spark, sf), 1), 1), 6)


@q(f"""with k as (select m, (1 + 2 * sum(cos(2 * pi() * f * (m - 0.5) / 64))) / 64 as d from range(-63, 64) a(m), range(1, 32) b(f) group by m)
select e.i0, j as i1, round(sum(e.v * k.d), 4) as v from {EM} e, range(0, 64) t(j), k where k.m = j - e.i1 group by e.i0, j""")
def fourier_shifted(spark, sf):
    return out(sp.fftshift(emb(spark, sf), 0.5, 1))


@q(f"""with k as (select m, -2 * sum(sin(2 * pi() * f * m / 64)) / 64 as d from range(-63, 64) a(m), range(1, 32) b(f) group by m)
select e.i0, j as i1, round(sum(e.v * k.d), 4) as v from {EM} e, range(0, 64) t(j), k where k.m = j - e.i1 group by e.i0, j""")
def hilbert_phase(spark, sf):
    return out(sp.hilbert(emb(spark, sf), 1))


@q(f"""with w as (select cast(i as bigint) as i, cast(n as bigint) as n, case when n = 0 then exp(-i / 4) else (1 - exp(-0.25)) * exp(-(i - n) / 4) end as w from range(0, 64) a(i), range(0, 64) b(n) where n <= i),
y as (select e.i0, w.i, sum(e.v * w.w) as v from {EM} e join w on w.n = e.i1 group by 1, 2) select y.i0, 63 - w.i as i1, round(sum(y.v * w.w), 4) as v from y join w on w.n = 63 - y.i group by 1, 2""")
def exponentially_smoothed(spark, sf):
    return out(win.esmooth2(emb(spark, sf), 4.0, 1))


# Images.

_NEAR = f"with m as {EM} select a.i0, a.i1, {{}} as v from m a join m b on abs(a.i0 - b.i0) <= 1 and abs(a.i1 - b.i1) <= 1 group by a.i0, a.i1"


@q(_NEAR.format("max((b.v > 0.2)::int)::bigint"))
def dilated(spark, sf):
    return im.dilate(emb(spark, sf).map(lambda v: (v > 0.2).cast("int"))).df.withColumn("v", F.col("v").cast("bigint"))


@q(_NEAR.format("min((b.v > -0.2)::int)::bigint"))
def eroded(spark, sf):
    return im.erode(emb(spark, sf).map(lambda v: (v > -0.2).cast("int"))).df.withColumn("v", F.col("v").cast("bigint"))


@q(f"with m as {EM} select a.i0, a.i1, round(sum(b.v - a.v), 5) as v from m a join m b on abs(a.i0 - b.i0) + abs(a.i1 - b.i1) = 1 group by a.i0, a.i1")
def laplacian(spark, sf):
    return out(im.laplace2d(emb(spark, sf)), 5)


@q(f"""with m as {EM}, d as (select i0, i1, lag(v) over x - 2 * v + lead(v) over x as dx, lag(v) over y - 2 * v + lead(v) over y as dy from m window x as (partition by i1 order by i0), y as (partition by i0 order by i1))
select i0, i1, (coalesce(dx, 0) < 0 and coalesce(dy, 0) < 0)::int::bigint as v from d""")
def hill_segments(spark, sf):
    return im.segment(emb(spark, sf)).df.withColumn("v", F.col("v").cast("bigint"))


@q(f"""with m as {EM}, d as (select i0, i1, (v > lag(v) over x and v > lead(v) over x)::int as a, (v > lag(v) over y and v > lead(v) over y)::int as b from m window x as (partition by i1 order by i0), y as (partition by i0 order by i1))
select i0, i1, (coalesce(a, 0) + coalesce(b, 0))::bigint as v from d""")
def extreme_directions(spark, sf):
    return im.esegment(emb(spark, sf), diagonal=False).df.withColumn("v", F.col("v").cast("bigint"))


@q()
def regions(spark, sf):
    return im.area(emb(spark, sf).map(lambda v: (v > 0.15).cast("int"))).df


@q()
def basins(spark, sf):
    return im.basin(emb(spark, sf)).df


@q(f"select i0, i1, round((v - lo) / (hi - lo) * 255, 4) as v from {EM}, (select min(v) as lo, max(v) as hi from {EM})")
def rescaled(spark, sf):
    return out(im.scale(emb(spark, sf)))


@q("select c_custkey, (x >= 0 and x + y < 400 and y >= 0)::int as inside from (select c_custkey, (c_custkey % 97) * 5.0 + 0.25 as x, (c_custkey % 89) * 5.0 + 0.25 as y from customer)")
def points_in_polygon(spark, sf):
    t = tab(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 97) * 5.0 + 0.25).alias("x"), ((F.col("c_custkey") % 89) * 5.0 + 0.25).alias("y"))
    return im.inpolygon(t, "x", "y", [(0.0, 0.0), (400.0, 0.0), (0.0, 400.0)]).select("c_custkey", "inside")


@q("""select a, b, n as pixels from (select a, b, count(*) as n from (select o_orderkey, case when o_totalprice > 250000 then 1 + o_custkey % 3 else 0 end as a, case when o_totalprice > 300000 then 1 + o_custkey % 4 else 0 end as b from orders) where a <> 0 and b <> 0 group by 1, 2)""")
def region_overlaps(spark, sf):
    t = tab(spark, sf, "orders")
    make = lambda p, k: NdArray.from_table(t, ["o_orderkey"], F.when(F.col("o_totalprice") > p, 1 + F.col("o_custkey") % k).otherwise(0))
    return im.areaconnect(make(250000, 3), make(300000, 4)).where("a != 0 and b != 0").select("a", "b", "pixels")


# Strings.


@q("""select p_partkey, strpos(p_name, 'e') - 1 as pos, length(p_name) as n, upper(p_name) as up, substr(p_name, 3, 4) as sub, (length(p_name) - length(replace(p_name, 'e', '')))::bigint as count, replace(p_name, ' ', '_') as rep,
string_split(p_name, ' ')[1] as word, lpad(cast(p_size as varchar), 5, ' ') as num, case when strpos(p_name, ' ') > 0 then substr(p_name, strpos(p_name, ' ') + 1) else '' end as rest from part""")
def strings(spark, sf):
    s = F.col("p_name")
    return tab(spark, sf, "part").select("p_partkey", st.strpos(s, "e").cast("bigint").alias("pos"), st.strlen(s).cast("bigint").alias("n"), st.upper(s).alias("up"), st.strsub(s, 2, 4).alias("sub"), st.strcount(s, "e").cast("bigint").alias("count"), st.strreplace(s, " ", "_").alias("rep"), F.get(st.strtok(s, " "), 0).alias("word"), st.istring(F.col("p_size"), 5).alias("num"), st.strskp(s, " ").alias("rest"))


@q("select c_custkey, cast(regexp_extract(c_name, '#0*([0-9]+)', 1) as bigint) as k, regexp_extract(c_name, '[rs].*') as brk, ltrim(c_name, 'Cu') as skip from customer")
def string_patterns(spark, sf):
    s = F.col("c_name")
    return tab(spark, sf, "customer").select("c_custkey", F.get(st.regex(s, "#0*([0-9]+)"), 1).cast("bigint").alias("k"), st.strpbrk(s, "rs").alias("brk"), st.skipc(s, "Cu").alias("skip"))


# Dates and astronomy.


@q("""select o_orderkey, round(epoch(o_orderdate) / 86400 + 2440587.5, 4) as jd, cast(julian(o_orderdate::date) as bigint) as jdn, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, strftime(o_orderdate, '%a %b %d %H:%M:%S %Y') as text from orders""")
def julian_days(spark, sf):
    t, c = F.col("o_orderdate"), lambda x: x.cast("bigint")
    j = dates.gregorian_to_jdn(c(F.year(t)), c(F.month(t)), c(F.day(t)))
    g = dates.jdn_to_gregorian(F.col("jdn"))
    return tab(spark, sf, "orders").select("o_orderkey", r4(dates.jd(t), "jd"), j.alias("jdn"), dates.ctime(t).alias("text")).withColumn("g", g).select("o_orderkey", "jd", "jdn", c(F.col("g.year")).alias("y"), c(F.col("g.month")).alias("m"), c(F.col("g.day")).alias("d"), "text")


@q("""with y as (select y, y % 19 as a, y // 100 as b, y % 100 as c from range(1600, 2400) t(y)), h as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from y),
l as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from h), m as (select *, (a + 11 * h + 22 * l) // 451 as m from l) select y, (h + l - 7 * m + 114) // 31 as month, (h + l - 7 * m + 114) % 31 + 1 as day from m""")
def easter_dates(spark, sf):
    return spark.range(1600, 2400).select(F.col("id").alias("y"), dates.easter(F.col("id")).alias("e")).select("y", F.col("e.month").cast("bigint").alias("month"), F.col("e.day").cast("bigint").alias("day"))


@q("""with recursive k(i0, m, e, n) as (select event_id, (event_id % 628) / 100.0 - 3.14, (event_id % 628) / 100.0 - 3.14 + sign((event_id % 628) / 100.0 - 3.14) * 0.425, 0 from events
union all select i0, m, e - (e - 0.5 * sin(e) - m) / (1 - 0.5 * cos(e)), n + 1 from k where n < 6) select i0, round(2 * atan(sqrt(3.0) * tan(e / 2)), 6) as v from k where n = 6""")
def kepler_anomalies(spark, sf):
    t = ev(spark, sf).df.select("i0", ((F.col("i0") % 628) / 100.0 - 3.14).alias("m"))
    return astro.kepler(t, "m", 0.5, "v").select("i0", r4("v", places=6))


@q("""with j as (select o_orderkey, epoch(o_orderdate) / 86400 + 2440587.5 as jd from orders), a as (select *, (jd - 2451545.0) / 36525 as t from j),
b as (select *, radians(357.52911 + 35999.05029 * t) as m, 0.016708634 - 0.000042037 * t as e from a), c as (select *, (1.914602 - 0.004817 * t) * sin(m) + 0.019993 * sin(2 * m) + 0.000289 * sin(3 * m) as c from b),
d as (select *, 280.46646 + 36000.76983 * t + c - 0.00569 as lam, 73.6667 + 1.3958333 * (jd - 2396758) / 36525 as k, 1.000001018 * (1 - e * e) / (1 + e * cos(m + radians(c))) as r from c),
f as (select *, radians(lam - k) as d, radians(7.25) as i, radians(23.439291 - 0.0130042 * t) as eps, (jd - 2398220) * (360 / 25.38) as theta from d),
g as (select *, degrees(atan2(-sin(d) * cos(i), -cos(d))) - theta as l from f)
select o_orderkey, round(degrees(atan(-cos(radians(lam)) * tan(eps)) + atan(-cos(d) * tan(i))), 4) as p, round(degrees(asin(sin(d) * sin(i))), 4) as b, round(l - floor(l / 360) * 360, 4) as l, round(959.63 / r, 4) as r from g""")
def sun_disk(spark, sf):
    return tab(spark, sf, "orders").select("o_orderkey", astro.solar_disk(dates.jd(F.col("o_orderdate"))).alias("s")).select("o_orderkey", *(r4(f"s.{c}", c) for c in "pblr"))


@q("""select o_orderkey, round(radians(x - floor(x / 360) * 360), 6) as v from (select o_orderkey, 280.46061837 + 360.98564736629 * d + 0.000387933 * (d / 36525) * (d / 36525) - power(d / 36525, 3) / 38710000 as x
from (select o_orderkey, epoch(o_orderdate) / 86400 + 2440587.5 - 2451545.0 as d from orders))""")
def sidereal_times(spark, sf):
    return tab(spark, sf, "orders").select("o_orderkey", r4(astro.sidereal_time(dates.jd(F.col("o_orderdate"))), "v", 6))


# Functions by pandas UDF.


@q("select l_orderkey, l_linenumber, round(gamma(l_quantity / 10 + 1), 4) as g, round(lgamma(l_quantity), 5) as lg from lineitem")
def gamma_functions(spark, sf):
    n = F.col("l_quantity")
    return tab(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r4(special.column(special.gamma, n / 10 + 1), "g"), r4(special.column(lambda x: special.gamma(x, True), n), "lg", 5))


@q()
def special_functions(spark, sf):
    x = F.col("l_quantity") / 10
    t = tab(spark, sf, "lineitem").select("l_quantity").distinct()
    return t.select("l_quantity", r4(special.column(special.erf, x), "erf"), r4(special.column(lambda v: special.bessel_j(0, v), x), "j0"), r4(special.column(lambda v: special.bessel_i(1, v), x), "i1"), r4(special.column(lambda v: special.igamma(2.5, v), x), "igamma"), r4(special.column(lambda v: special.voigt(0.1, v), x), "voigt"))


# Random, clusters, extension.


@q()
def random_draws(spark, sf):
    return out(rnd.randomn(spark, 42, 1000))


@q(f"""with s as (select vec_id, embedding from embeddings), c as (select embedding as c, vec_id as k from s where vec_id < 4), d as (select s.vec_id, c.k, sqrt(list_sum(list_transform(list_zip(s.embedding, c.c), lambda x: power(cast(x[1] as double) - cast(x[2] as double), 2)))) as dist from s, c)
select vec_id, arg_min(k, dist) as cluster, round(min(dist), 5) as distance from d group by 1""")
def nearest_centers(spark, sf):
    t = tab(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centers = np.array([r["embedding"] for r in t.where("vec_id < 4").orderBy("vec_id").collect()])
    return cl.assign(t, "embedding", centers).select("vec_id", F.col("cluster").cast("bigint").alias("cluster"), r4("distance", "distance", 5))


@q()
def clusters(spark, sf):
    t = tab(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centers = np.array([r["embedding"] for r in t.where("vec_id < 4").orderBy("vec_id").collect()])
    return cl.summary(cl.cluster(t, "embedding", centers, 10)[1]).select("cluster", "size", r4("rms", "rms"))


@q("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def hourly_events(spark, sf):
    return tumbling(tab(spark, sf, "events"), "ts", "event_type", "value").select("start", "event_type", "n", r4("total", "total", 3))


# Further operators.


@q("""with d as (select o_orderkey, epoch(o_orderdate) / 86400 - 10957.5 as t from orders), e as (select o_orderkey, t, t / 36525 as c, 2 * pi() * ((t + 0.5) - floor(t + 0.5) + 0.5 + 0.7790572732640 - 0.5 + 0.00273781191135448 * t + 0.5) as x from d)
select o_orderkey, round(x - floor(x / (2 * pi())) * 2 * pi(), 5) as era, round((84381.406 - 46.836769 * c - 0.0001831 * c * c + 0.00200340 * c * c * c) * pi() / 648000, 9) as obliquity from
(select o_orderkey, c, 2 * pi() * ((t + 2451545.0) - floor(t + 2451545.0) + 0.7790572732640 + 0.00273781191135448 * t) as x from e)""")
def earth_rotation(spark, sf):
    j = dates.jd(F.col("o_orderdate"))
    return tab(spark, sf, "orders").select("o_orderkey", r4(special.column(lambda t: sofa.era00(t), j), "era", 5), r4(special.column(lambda t: sofa.obl06(t), j), "obliquity", 9))


@q("""select s_suppkey, round(cos(a) * cos(b), 8) as x, round(sin(a) * cos(b), 8) as y, round(sin(b), 8) as z from (select s_suppkey, s_suppkey * 0.06 as a, s_nationkey * 0.1 - 1.2 as b from supplier)""")
def sphere_points(spark, sf):
    a, b = F.col("s_suppkey") * 0.06, F.col("s_nationkey") * 0.1 - 1.2
    return tab(spark, sf, "supplier").select("s_suppkey", *(r4(special.column(lambda p, q, k=k: sofa.s2c(p, q)[k], a, b), n, 8) for k, n in enumerate("xyz")))


@q("""with d as (select o_orderkey, cast(julian(o_orderdate::date) as bigint) as j from orders), y as (select *, (30 * (j - 1948440) + 10646) // 10631 as y from d),
m as (select *, least(12, ceil((j - (29 + 1 + (y - 1) * 354 + (3 + 11 * y) // 30 + 1948439)) / 29.5)::bigint + 1) as m from y)
select o_orderkey, y, m, j - (1 + ceil(29.5 * (m - 1))::bigint + (y - 1) * 354 + (3 + 11 * y) // 30 + 1948439) + 1 as d from m""")
def islamic_dates(spark, sf):
    t, c = F.col("o_orderdate"), lambda x: x.cast("bigint")
    j = dates.gregorian_to_jdn(c(F.year(t)), c(F.month(t)), c(F.day(t)))
    g = tab(spark, sf, "orders").select("o_orderkey", j.alias("j")).select("o_orderkey", dates.jdn_to_islamic(F.col("j")).alias("g"))
    return g.select("o_orderkey", *(c(F.col(f"g.{p}")).alias(p[0]) for p in ("year", "month", "day")))


@q("select o_orderkey, round(epoch(o_orderdate) - epoch(timestamp '1977-01-01') + (select count(*) from (values (timestamp '1978-01-01'), ('1979-01-01'), ('1980-01-01'), ('1981-07-01'), ('1982-07-01'), ('1983-07-01'), ('1985-07-01'), ('1988-01-01'), ('1990-01-01'), ('1991-01-01'), ('1992-07-01'), ('1993-07-01'), ('1994-07-01'), ('1996-01-01'), ('1997-07-01'), ('1999-01-01'), ('2006-01-01')) l(d) where d <= o_orderdate) + 1, 3) as tai from orders")
def atomic_seconds(spark, sf):
    return tab(spark, sf, "orders").select("o_orderkey", r4(dates.tai_from_date(F.col("o_orderdate").cast("timestamp")), "tai", 3))


@q(f"""with m as {EM}, d as (select i0, i1, v, lag(v) over (partition by i1 order by i0) as b, lead(v) over (partition by i1 order by i0) as a from m) select i0, i1, coalesce((v > a and v > b)::int, 0)::bigint as v from d""")
def maxima_along_direction(spark, sf):
    a = emb(spark, sf)
    return directions.maxdir(a, a.map(lambda v: F.lit(0.0))).df.withColumn("v", F.col("v").cast("bigint"))


@q(f"""with m as {EM}, d as (select i0, i1, v, lag(v) over (partition by i0 order by i1) as b, lead(v) over (partition by i0 order by i1) as a from m) select i0, i1, coalesce((a - 2 * v + b < 0)::int, 0)::bigint as v from d""")
def hills_along_direction(spark, sf):
    a = emb(spark, sf)
    return directions.segmentdir(a, a.map(lambda v: F.lit(1.5707963267948966))).df.withColumn("v", F.col("v").cast("bigint"))


@q(f"""with m as {EM}, g as (select r, t, round(250 + r * cos(t * 2 * pi() / 90))::bigint as x, round(32 + r * sin(t * 2 * pi() / 90))::bigint as y from range(0, 30) a(r), range(0, 90) b(t))
select r as i0, t as i1, round(coalesce(v, 0), 6) as v from g left join m on i0 = x and i1 = y""")
def polar_image(spark, sf):
    return out(im.to_polar(emb(spark, sf), (250.0, 32.0), 30, 90), 6)


@q(f"select a.i0, a.i1, round(0.3 * a.v + 0.7 * (a.v * a.v), 6) as v from {EM} a")
def faded(spark, sf):
    a = emb(spark, sf)
    return out(im.fade(a, a.map(lambda v: v * v), 0.3), 6)


@q(f"""with x as (select i0, v, avg(v) over w as m, count(*) over w as n, sum(v * v) over w as s from {EV} window w as (order by i0 rows between 2 preceding and 2 following)), y as (select *, (m * n - v) / (n - 1) as r, (s - v * v) / (n - 1) as q from x)
select i0, round(case when v - r > 0.25 * abs(r) and v - r > 3 * sqrt(greatest(0, q - r * r)) then r else v end, 4) as v from y""")
def despiked(spark, sf):
    return out(win.despike(ev(spark, sf), level=3.0))


@q("select c_custkey, rpad(c_mktsegment, 12, '.') as seg, printf('%05d|%.2f', c_nationkey, c_acctbal) as text, lower(hex(c_custkey)) as hex from customer")
def formatted(spark, sf):
    from lattica.sources.files import hex_dump

    return tab(spark, sf, "customer").select("c_custkey", F.rpad("c_mktsegment", 12, ".").alias("seg"), st.fstring("%05d|%.2f", F.col("c_nationkey"), F.col("c_acctbal")).alias("text"), hex_dump(F.col("c_custkey")).alias("hex"))


@q("select c_custkey, cast(regexp_extract(c_name, '([0-9]+)', 1) as bigint) as n, split_part(c_name, '#', 1) as word from customer")
def scanned(spark, sf):
    got = st.sscanf(F.translate("c_name", "#", " "), "%s %d")
    return tab(spark, sf, "customer").select("c_custkey", got.alias("r")).select("c_custkey", F.col("r.v1").alias("n"), F.col("r.v0").alias("word"))


@q(f"select v.id as i0, round(sum(case when c = 'w' then x end), 4) as v from (select event_id as id, 'w' as c, value as x from events) v group by 1")
def stored_and_read(spark, sf):
    """An array written as Parquet with its manifest in the shared folder, and read again."""
    import uuid

    from lattica.plans.lineage import shared
    from lattica.sources import files

    path = f"{shared(spark)}/arrays-{uuid.uuid4().hex}"
    files.store({"events": ev(spark, sf)}, path)
    return out(files.restore(spark, path)["events"])


@q("select round(sum(l_extendedprice) filter (where l_discount > 0.05), 2) as v, count(*) as n from lineitem where l_quantity < 24")
def evaluated_text(spark, sf):
    from lattica.plans.session import Workspace

    w = Workspace(spark)
    w.set("lines", tab(spark, sf, "lineitem"))
    return w.execute("select round(sum(l_extendedprice) filter (where l_discount > 0.05), 2) as v, count(*) as n from lines where l_quantity < 24")


@q("with recursive c(x) as (select 1 union all select x + 1 from c where x < 40) select cast(x as bigint) as k, cast(2 * x * x * x - 3 * x + 1 as double) as v from c")
def polynomials(spark, sf):
    return spark.range(1, 41).select(F.col("id").alias("k"), r4(el.poly(F.col("id").cast("double"), [1, -3, 0, 2]), "v", 3))


@q("""select k, round(x[1], 5) as lo, round(x[len(x)], 5) as hi from (select k, list_sort([-1.0 * k, 0.5 * k, 2.0 * k]) as x from range(1, 50) t(k))""")
def cubic_roots(spark, sf):
    k = F.col("id").cast("double")
    a, b, c = -1.5 * k, -1.5 * k * k, k * k * k
    got = spark.range(1, 50).select("id", el.root3(a, b, c).alias("x"))
    return got.select(F.col("id").alias("k"), r4(F.get("x", 0), "lo", 5), r4(F.element_at("x", -1), "hi", 5))


@q()
def monotone_curve(spark, sf):
    from lattica.ndarray import along_axis

    at = np.arange(0, 63, 0.5)
    return out(along_axis(emb(spark, sf), 1, lambda y: fit.monotone_interpolate(np.arange(len(y)), np.sort(y), at), len(at)))


@q(f"""with w as (select cast(n as bigint) as n, 0.5 - 0.5 * cos(2 * pi() * n / 15) as w from range(0, 16) t(n)), x as (select i0, f, n, v * w as v from {EM}, range(0, 7) t(f), w where i1 = 8 * f + n),
p as (select i0, f, k, power(sum(v * cos(2 * pi() * k * n / 16)), 2) + power(sum(v * sin(2 * pi() * k * n / 16)), 2) as p from x, range(0, 9) t(k) group by i0, f, k)
select i0, k as i1, round(avg(p) / (select sum(w * w) from w), 6) as v from p group by i0, k""")
def periodogram(spark, sf):
    from lattica.ndarray import along_axis

    return out(along_axis(emb(spark, sf), 1, lambda y: sp.welch(y, 16), 9), 6)


@q()
def symmetric_eigenvalues(spark, sf):
    a = emb(spark, sf)
    gram = red.mproduct(sh.transpose(a), a).numpy()
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate(sp.eigenvalues(gram))], "k bigint, v double")


@q()
def shifted_image(spark, sf):
    return out(im.shift3(emb(spark, sf), 0.5, -0.25))


@q(f"select i0, i1, round(v - avg(v) over (), 4) as v from {EM} where i0 < 60")
def poisson_solved(spark, sf):
    return out(im.antilaplace2d(im.laplace2d(sh.subscript(emb(spark, sf), slice(0, 60), slice(0, 64)))))


@q()
def poisson_solved_whole(spark, sf):
    return out(im.antilaplace2d(im.laplace2d(emb(spark, sf))))


@q()
def planet_places(spark, sf):
    j = dates.jd(F.col("o_orderdate"))
    t = tab(spark, sf, "orders").select("o_orderdate").distinct()
    return t.select("o_orderdate", *(r4(special.column(lambda d, n=n: astro.geocentric(n, d)[0], j), n) for n in ("sun", "mars", "jupiter")))


from lattica import standard_queries  # noqa: E402, F401  registers its queries
