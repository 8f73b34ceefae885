"""Registered core queries and their SQL twins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.frame import Span, TensorFrame
from tensorloom.functions import complexnum as cx
from tensorloom.functions import elementwise as fx
from tensorloom.operators import arrays, create, density, linalg, neighbors, solvers, spatial, stats, wide
from tensorloom.plans.select import quantiles
from tensorloom.plans.tables import ranked, settle
from tensorloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def c(name: str):
    return F.col(name)


def r(x, n: int = 6):
    """Rounded for comparison, without negative zeros."""
    return F.round(x, n) + F.lit(0.0)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a discount above 5 %: revenue summed, averaged and spread over axis 0."""
    x = table(spark, sf_dir, "lineitem").where(c("l_discount") > 0.05)
    x = x.withColumn("revenue", c("l_extendedprice") * (1 - c("l_discount")))
    out = wide.axis0(x, ["revenue"], ["sum", "mean", "std"])
    return out.select(F.round("revenue_sum", 2).alias("revenue_sum"), F.round("revenue_mean", 4).alias("revenue_mean"), F.round("revenue_std", 4).alias("revenue_std"))


def vectors(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """The embeddings as coordinates; vec_id is dense from 0."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    return TensorFrame.from_arrays(e, "vec_id", "embedding", (n, 64))


def series(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """events.value in event_id order; event_id is dense, from 0 or 1."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    return TensorFrame(e.select((c("event_id") - lo).alias("i0"), c("value").alias("v")), (hi - lo + 1,))


E_SQL = "(SELECT vec_id AS i0, unnest(range(len(embedding)))::BIGINT AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings)"
V_SQL = "(SELECT event_id - (SELECT min(event_id) FROM events) AS i0, value AS v FROM events)"

# -- element-wise ------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, round(l_extendedprice + l_tax, 6) AS added, round(l_extendedprice - l_discount, 6) AS taken, round(l_extendedprice * (1 - l_discount), 6) AS times, l_extendedprice / l_quantity AS parted, -l_quantity AS negated FROM lineitem")
def ew_arith_lineitem(spark, d):
    x = table(spark, d, "lineitem")
    p, q = c("l_extendedprice"), c("l_quantity")
    return x.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", F.round(p + c("l_tax"), 6).alias("added"), F.round(p - c("l_discount"), 6).alias("taken"), F.round(p * (1 - c("l_discount")), 6).alias("times"), fx.divide(p, q).alias("parted"), fx.negate(q).alias("negated"))


@query("SELECT p_partkey, (p_size // 7)::BIGINT AS quotient, (p_size % 7)::BIGINT AS remainder, ((-p_size) // 7)::BIGINT AS quotient_neg, ((-p_size) % 7)::BIGINT AS remainder_neg FROM part")
def ew_intdiv_mod_part(spark, d):
    s = c("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", fx.int_divide(s, F.lit(7)).alias("quotient"), fx.mod(s, 7).alias("remainder"), fx.int_divide(-s, F.lit(7)).alias("quotient_neg"), fx.mod(-s, 7).alias("remainder_neg"))


@query("SELECT p_partkey, (((p_size % -7) + -7) % -7)::BIGINT AS below, ((((-p_size) % 7) + 7) % 7)::BIGINT AS above FROM part")
def ew_floor_mod_part(spark, d):
    s = c("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", fx.floor_mod(s, -7).alias("below"), fx.floor_mod(-s, 7).alias("above"))


@query("SELECT event_id, greatest(20.0, least(80.0, value)) AS clamped, sign(value - 50)::INTEGER AS side, abs(value - 50) AS off, least(value, 30.0) AS low, greatest(value, 30.0) AS high, round((value-50)*(value-50), 6) AS squared FROM events")
def ew_clamp_events(spark, d):
    v = c("value")
    return table(spark, d, "events").select("event_id", fx.clamp(v, 20.0, 80.0).alias("clamped"), fx.sgn(v - 50).alias("side"), fx.absolute(v - 50).alias("off"), fx.minimum(v, 30.0).alias("low"), fx.maximum(v, 30.0).alias("high"), F.round(fx.square(v - 50), 6).alias("squared"))


@query("SELECT p_partkey, round(sin(p_retailprice), 8) AS s, round(cos(p_retailprice), 8) AS co, round(tan(p_retailprice), 4) AS t, round(atan(p_retailprice), 8) AS at, round(asin(1.0 / p_size), 8) AS asn, round(acos(1.0 / p_size), 8) AS acs, round(sinh(p_size / 50.0), 8) AS sh, round(cosh(p_size / 50.0), 8) AS ch, round(tanh(p_size / 50.0), 8) AS th, round(asinh(p_size), 8) AS ash, round(acosh(p_size), 8) AS ach, round(atanh(1.0 / (p_size + 1)), 8) AS ath, round(radians(p_size), 8) AS rad, round(degrees(p_size), 8) AS deg FROM part")
def ew_trig_part(spark, d):
    x, s, u = c("p_retailprice"), c("p_size").cast("double"), fx.UNIVERSAL
    out = {"s": u["sin"](x), "co": u["cos"](x), "at": u["arctan"](x), "asn": u["arcsin"](1 / s), "acs": u["arccos"](1 / s), "sh": u["sinh"](s / 50), "ch": u["cosh"](s / 50), "th": u["tanh"](s / 50), "ash": u["arcsinh"](s), "ach": u["arccosh"](s), "ath": u["arctanh"](1 / (s + 1)), "rad": u["degToRad"](s), "deg": u["radToDeg"](s)}
    return table(spark, d, "part").select("p_partkey", F.round(u["tan"](x), 4).alias("t"), *[F.round(e, 8).alias(k) for k, e in out.items()])


@query("SELECT event_id, CASE WHEN value > 0 THEN round(ln(value), 8)::VARCHAR WHEN value = 0 THEN '-inf' ELSE 'nan' END IS NOT NULL AS defined, coalesce(round(ln(nullif(greatest(value, 0), 0)), 8), -999) AS l, coalesce(round(log2(nullif(greatest(value, 0), 0)), 8), -999) AS l2, coalesce(round(log10(nullif(greatest(value, 0), 0)), 8), -999) AS l10, round(ln(1 + abs(value)), 8) AS l1, round(exp(value / 100), 8) AS e, round(exp(value / 1000) - 1, 8) AS em, round(sqrt(abs(value)), 8) AS sq, round(cbrt(value), 8) AS cb, round(pow(abs(value), 1.5), 4) AS pw FROM events")
def ew_log_guarded_events(spark, d):
    v = c("value")
    finite = lambda x: F.when(F.isnan(x) | (x == -fx.INF), -999.0).otherwise(F.round(x, 8))
    return table(spark, d, "events").select("event_id", fx.ln(v).isNotNull().alias("defined"), finite(fx.ln(v)).alias("l"), finite(fx.log2(v)).alias("l2"), finite(fx.log10(v)).alias("l10"), F.round(fx.log1p(F.abs(v)), 8).alias("l1"), F.round(fx.exp(v / 100), 8).alias("e"), F.round(fx.expm1(v / 1000), 8).alias("em"), F.round(fx.sqrt(F.abs(v)), 8).alias("sq"), F.round(fx.cbrt(v), 8).alias("cb"), F.round(fx.power(F.abs(v), 1.5), 4).alias("pw"))


@query("SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS f, ceil(o_totalprice)::DOUBLE AS ce, trunc(-o_totalprice)::DOUBLE AS tr, round(o_totalprice)::DOUBLE AS ro FROM orders")
def ew_round_family_orders(spark, d):
    p = c("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", fx.floor(p).alias("f"), fx.ceil(p).alias("ce"), fx.trunc(-p).alias("tr"), fx.round_half_away(p).alias("ro"))


@query("SELECT p_partkey, (p_size & 12)::BIGINT AS a, (p_size | 12)::BIGINT AS o, xor(p_size, 12)::BIGINT AS x, (~p_size)::BIGINT AS n, (p_size::BIGINT << 3) AS l, (p_size >> 2)::BIGINT AS r FROM part")
def ew_bitops_part(spark, d):
    s = c("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", fx.bitwise("and", s, F.lit(12)).alias("a"), fx.bitwise("or", s, F.lit(12)).alias("o"), fx.bitwise("xor", s, F.lit(12)).alias("x"), fx.bitwise("not", s).alias("n"), fx.shift_left(s, 3).alias("l"), fx.shift_right(s, 2).alias("r"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 8) AS sig, greatest(0.0, value - 50) AS rel, round(tanh((value - 50) / 10), 8) AS tan FROM events")
def ew_sigmoid_relu_tanh_events(spark, d):
    v = c("value") - 50
    return table(spark, d, "events").select("event_id", F.round(fx.sigmoid(v / 10), 8).alias("sig"), fx.relu(v).alias("rel"), F.round(F.tanh(v / 10), 8).alias("tan"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, round(CASE WHEN greatest(abs(l_discount), abs(l_tax)) = 0 THEN 0 ELSE abs(l_discount - l_tax) / greatest(abs(l_discount), abs(l_tax)) END, 8) AS rel, round((l_discount - l_tax) * (l_discount - l_tax), 8) AS sq FROM lineitem")
def ew_relative_error_lineitem(spark, d):
    a, b = c("l_discount"), c("l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", F.round(fx.relative_error(a, b), 8).alias("rel"), F.round(fx.squared_error(a, b), 8).alias("sq"))


@query("WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE ELSE value END AS x FROM events) SELECT event_id, NOT isnan(x) AND x > 50 AS gt, NOT isnan(x) AS eq, isnan(x) AS ne, isnan(x) AS bad, (NOT isnan(x) AND x > 50) <> isnan(x) AS either FROM t")
def ew_compare_nan_guard_events(spark, d):
    x = F.when(c("event_id") % 5 == 0, fx.NAN).otherwise(c("value"))
    t = table(spark, d, "events").select("event_id", x.alias("x"))
    gt = fx.compare(">", c("x"), 50.0)
    return t.select("event_id", gt.alias("gt"), fx.compare("==", c("x"), c("x")).alias("eq"), fx.compare("!=", c("x"), c("x")).alias("ne"), F.isnan("x").alias("bad"), fx.logical("xor", gt, F.isnan("x")).alias("either"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, round(l_quantity - avg(l_quantity) OVER (), 8) AS q, round(l_tax - avg(l_tax) OVER (), 8) AS t FROM lineitem")
def broadcast_center_lineitem(spark, d):
    x = wide.center(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return x.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", r(c("l_quantity"), 8).alias("q"), r(c("l_tax"), 8).alias("t"))


@query("SELECT p_partkey, round(CASE WHEN p_size = 25 THEN 1 ELSE sin(pi() * (p_size - 25) / 10.0) / (pi() * (p_size - 25) / 10.0) END, 8) AS sc, factorial((p_size % 15)::INTEGER)::BIGINT AS fac, round(1.0 / p_size, 8) AS rec FROM part")
def ew_sinc_fac_part(spark, d):
    s = c("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(fx.sinc((s - 25) / 10.0), 8).alias("sc"), fx.factorial(s % 15).alias("fac"), F.round(fx.reciprocal(s), 8).alias("rec"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, round(l_quantity * l_tax - l_discount * l_discount, 6) AS re, round(l_quantity * l_discount + l_discount * l_tax, 6) AS im, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS modulus, round(atan2(l_discount, l_quantity), 8) AS phase FROM lineitem")
def ew_complex_lineitem(spark, d):
    a, b = cx.complex_of(c("l_quantity"), c("l_discount")), cx.complex_of(c("l_tax"), c("l_discount"))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", a.alias("a"), b.alias("b"))
    p = cx.multiply(c("a"), c("b"))
    return t.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", F.round(p["re"], 6).alias("re"), F.round(p["im"], 6).alias("im"), F.round(cx.modulus(c("a")), 6).alias("modulus"), F.round(cx.phase(c("a")), 8).alias("phase"))


@query("SELECT event_id, CASE WHEN value = 0 THEN 'zero' ELSE 'normal' END AS kind, round(exp(-0.5 * ((value - 50) / 12) * ((value - 50) / 12)) / (12 * sqrt(2 * pi())), 10) AS g, CASE WHEN abs((value - 50) / 40) <= 1 THEN round(0.75 * (1 - ((value - 50) / 40) * ((value - 50) / 40)), 8) ELSE 0 END AS epa FROM events")
def ew_classify_density_events(spark, d):
    v = c("value")
    return table(spark, d, "events").select("event_id", fx.classify(v).alias("kind"), F.round(fx.gauss(v, 50.0, 12.0, True), 10).alias("g"), F.round(fx.KERNELS["epanechnikov"]((v - 50) / 40), 8).alias("epa"))


@query()
def erf_gamma_events(spark, d):
    v = c("value") / 20
    return table(spark, d, "events").select("event_id", fx.erf(v).alias("erf"), fx.erfc(v).alias("erfc"), fx.gamma(v).alias("gamma"), fx.lgamma(v).alias("lgamma"), fx.copysign(v, v - 2).alias("signed"), fx.almost_equal(v * 3, v + v + v).alias("same"))


@query("SELECT p_partkey, list_reverse([(p_size >> k) & 1 = 1 for k in range(6)])::VARCHAR AS bits FROM part")
def int2bit_part(spark, d):
    b = fx.int_to_bits(c("p_size"), 6)
    text = F.concat(F.lit("["), F.array_join(F.transform(b, lambda x: x.cast("string")), ", "), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", text.alias("bits"))


@query("SELECT event_id, round((sin(value + 1e-5) * (value + 1e-5) - sin(value - 1e-5) * (value - 1e-5)) / 2e-5, 3) AS slope FROM events")
def numerical_gradient_events(spark, d):
    return table(spark, d, "events").select("event_id", r(fx.numerical_gradient(lambda x: F.sin(x) * x, c("value")), 3).alias("slope"))


# -- reductions -------------------------------------------------------------------

_L4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue_sum, round(avg(l_extendedprice * (1 - l_discount)), 4) AS revenue_mean, round(stddev_samp(l_extendedprice * (1 - l_discount)), 4) AS revenue_std FROM lineitem WHERE l_discount > 0.05")
def masked_revenue_lineitem(spark, d):
    return entry(spark, d)


@query("SELECT " + ", ".join(f"round(sum({x}), 2) AS {x}_sum, round(avg({x}), 6) AS {x}_mean" for x in _L4) + " FROM lineitem")
def sum_mean_axis0_lineitem(spark, d):
    out = wide.axis0(table(spark, d, "lineitem"), _L4, ["sum", "mean"])
    return out.select(*[F.round(x, 2 if x.endswith("sum") else 6).alias(x) for x in out.columns])


@query("SELECT p_brand, (sum(p_size) // count(*))::BIGINT AS mean_size FROM part GROUP BY p_brand")
def int_mean_part(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.expr("sum(p_size) div count(*)").alias("mean_size"))


@query("SELECT " + ", ".join(f"round(var_samp({x}), 4) AS {x}_var, round(stddev_samp({x}), 6) AS {x}_std" for x in _L4) + " FROM lineitem")
def var_std_axis0_lineitem(spark, d):
    out = wide.axis0(table(spark, d, "lineitem"), _L4, ["var", "std"])
    return out.select(*[F.round(x, 4 if x.endswith("var") else 6).alias(x) for x in out.columns])


@query("SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders")
def minmax_orders(spark, d):
    return wide.axis0(table(spark, d, "orders"), ["o_totalprice"], ["min", "max"])


@query(f"SELECT i0, i1 AS best FROM {E_SQL} QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) = 1")
def argmax_first_embeddings(spark, d):
    at, _ = vectors(spark, d).argmax(1)
    return at.df.select("i0", c("v").alias("best"))


@query(f"SELECT i0, i1 AS best, round(v, 6) AS low FROM {E_SQL} QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v, i1) = 1")
def argmin_first_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(c("vec_id").alias("i0"), arrays.argmin(c("embedding")).alias("best"), F.round(F.array_min("embedding").cast("double"), 6).alias("low"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY o_orderpriority")
def percentile_median_iqr_orders(spark, d):
    out = quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.9, 0.5, 0.25, 0.75], ["p90", "med", "low", "high"])
    return out.select("o_orderpriority", F.round("p90", 4).alias("p90"), F.round("med", 4).alias("med"), F.round(c("high") - c("low"), 4).alias("iqr"))


@query(f"SELECT 0 AS i0, round(quantile_cont(v, 0.37), 8) AS v FROM {V_SQL}")
def percentile_events(spark, d):
    """Over one long axis: ranges are narrowed, nothing is gathered."""
    return series(spark, d).percentile(37).df.select("i0", r(c("v"), 8).alias("v"))


@query("SELECT bool_and(quality <> 0) AS all_good, bool_or(toxic <> 0) AS any_toxic, count(*) AS n FROM labels")
def all_any_labels(spark, d):
    return table(spark, d, "labels").agg(F.bool_and(c("quality") != 0).alias("all_good"), F.bool_or(c("toxic") != 0).alias("any_toxic"), F.count("*").alias("n"))


@query("SELECT p_brand, round(product(1 + p_size / 100000.0), 6) AS growth FROM part GROUP BY p_brand")
def product_small_part(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.product(1 + c("p_size") / 100000.0), 6).alias("growth"))


@query("SELECT round(avg((quality = toxic)::INTEGER), 8) AS accuracy FROM labels")
def accuracy_labels(spark, d):
    return table(spark, d, "labels").agg(F.round(wide.accuracy(c("quality"), c("toxic")), 8).alias("accuracy"))


@query("SELECT round(avg((l_discount - l_tax) * (l_discount - l_tax)), 8) AS mse, round(avg(abs(l_discount - l_tax)), 8) AS mae, round(avg(CASE WHEN greatest(abs(l_discount), abs(l_tax)) = 0 THEN 0 ELSE abs(l_discount - l_tax) / greatest(abs(l_discount), abs(l_tax)) END), 8) AS mre FROM lineitem")
def mse_mae_lineitem(spark, d):
    a, b = c("l_discount"), c("l_tax")
    return table(spark, d, "lineitem").agg(F.round(wide.mean_squared_error(a, b), 8).alias("mse"), F.round(wide.mean_absolute_error(a, b), 8).alias("mae"), F.round(wide.mean_relative_error(a, b), 8).alias("mre"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for a in _L4 for b in _L4))
def covariance_lineitem(spark, d):
    return wide.covariance(table(spark, d, "lineitem"), _L4).select("a", "b", r(c("cov"), 4).alias("cov"))


@query(f"SELECT a.i1 AS a, b.i1 AS b, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM {E_SQL} a JOIN {E_SQL} b USING (i0) GROUP BY a.i1, b.i1")
def covariance_embeddings(spark, d):
    e = table(spark, d, "embeddings").select(*[F.element_at("embedding", k + 1).cast("double").alias(str(k)) for k in range(64)])
    return wide.covariance(e, e.columns).select(c("a").cast("bigint").alias("a"), c("b").cast("bigint").alias("b"), r(c("cov")).alias("cov"))


@query(f"SELECT i0, round(ln(sum(exp(v - m))) + max(m), 8) AS lse FROM (SELECT *, max(v) OVER (PARTITION BY i0) AS m FROM {E_SQL}) GROUP BY i0")
def logsumexp_embeddings(spark, d):
    return table(spark, d, "embeddings").select(c("vec_id").alias("i0"), F.round(arrays.logsumexp(c("embedding")), 8).alias("lse"))


@query(f"SELECT i0, i1, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY i0), 8) AS p FROM (SELECT *, max(v) OVER (PARTITION BY i0) AS m FROM {E_SQL})")
def softmax_embeddings(spark, d):
    e = table(spark, d, "embeddings").select(c("vec_id").alias("i0"), F.posexplode(arrays.softmax(c("embedding"))).alias("i1", "p"))
    return e.select("i0", c("i1").cast("bigint").alias("i1"), F.round("p", 8).alias("p"))


@query(f"SELECT round(sum(v * v), 4) AS f FROM {E_SQL}")
def frobenius_embeddings(spark, d):
    e = vectors(spark, d)
    return e.frobenius(e).df.select(F.round("v", 4).alias("f"))


@query(f"SELECT i0, round(list_reduce(list(v ORDER BY i1), lambda s, x: s * 0.5 + x), 8) AS folded FROM {E_SQL} GROUP BY i0")
def fold_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    a = arrays.doubles(c("embedding"))
    return e.select(c("vec_id").alias("i0"), F.round(F.reduce(F.slice(a, 2, 63), F.element_at(a, 1), lambda s, x: s * 0.5 + x), 8).alias("folded"))


@query(f"SELECT i0, i1, round(v / sum(abs(v)) OVER (PARTITION BY i0), 6) + 0.0 AS v FROM {E_SQL}")
def apply_axis_embeddings(spark, d):
    return vectors(spark, d).apply_axis(lambda v: v / abs(v).sum(), 1).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT i0, i1, round(v - avg(v) OVER (PARTITION BY i0), 6) + 0.0 AS v FROM {E_SQL}")
def apply_axis_all_embeddings(spark, d):
    return vectors(spark, d).apply_axis(lambda v: v - v.mean(), 1).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT i0, round(v, 1) AS v FROM {E_SQL} WHERE i1 = 5")
def at_embeddings(spark, d):
    return vectors(spark, d).at(Span(), 5).df.select("i0", F.round("v", 1).alias("v"))


@query(f"SELECT i0, i1, CASE WHEN i0 BETWEEN 2 AND 8 AND i0 % 2 = 0 AND i1 BETWEEN 10 AND 20 THEN -1.0 ELSE v END AS v FROM {E_SQL}")
def slice_assign_embeddings(spark, d):
    return vectors(spark, d).put((Span(2, 8, 2), Span(10, 20)), -1.0).df


@query(f"SELECT i0, i1, CASE WHEN i0 >= 2 AND i0 % 2 = 0 AND i1 BETWEEN 10 AND 20 THEN -1.0 ELSE v END AS v FROM {E_SQL}")
def slice_assign_all_embeddings(spark, d):
    e = vectors(spark, d)
    return e.put((Span(2, e.shape[0] - 1, 2), Span(10, 20)), -1.0).df


@query(f"SELECT i0, i1, CASE i0 WHEN 3 THEN 30.0 WHEN 60 THEN 600.0 ELSE v END AS v FROM {E_SQL}")
def index_fill_embeddings(spark, d):
    return vectors(spark, d).index_fill(0, [3, 60], [30.0, 600.0]).df


@query(f"SELECT i0, i1, CASE i1 WHEN 3 THEN 30.0 WHEN 60 THEN 600.0 ELSE v END AS v FROM {E_SQL}")
def index_fill_all_embeddings(spark, d):
    return vectors(spark, d).index_fill(1, [3, 60], [30.0, 600.0]).df


@query(f"SELECT i0, i1, v - max(CASE WHEN i0 = 2 THEN v END) OVER (PARTITION BY i1) AS v FROM {E_SQL}")
def broadcast_column_embeddings(spark, d):
    """One row of the matrix is taken from all."""
    e = vectors(spark, d)
    return (e - e[Span(2, 2)]).df


@query(f"SELECT i0, i1, v - max(CASE WHEN i1 = 2 THEN v END) OVER (PARTITION BY i0) AS v FROM {E_SQL}")
def broadcast_column_all_embeddings(spark, d):
    e = vectors(spark, d)
    return (e - e[..., Span(2, 2)]).df


@query(f"SELECT i0, 0::BIGINT AS i1, round(stddev_samp(v), 6) AS v FROM {E_SQL} GROUP BY i0")
def axis_std_embeddings(spark, d):
    return vectors(spark, d).std(1).df.select("i0", "i1", F.round("v", 6).alias("v"))


@query(f"SELECT i0, 0::BIGINT AS i1, round(quantile_cont(v, 0.3), 6) + 0.0 AS v FROM {E_SQL} GROUP BY i0")
def axis_percentile_embeddings(spark, d):
    return vectors(spark, d).percentile(30, 1).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT 0::BIGINT AS i0, i1, bool_and(v <> 0) AS v FROM {E_SQL} GROUP BY i1")
def axis_all_embeddings(spark, d):
    return vectors(spark, d).all(0).df


# -- selection and shape ---------------------------------------------------------------


@query(f"SELECT (i0 - 4) // 3 AS i0, (i1 - 2) // 5 AS i1, v FROM {E_SQL} WHERE i0 BETWEEN 4 AND 100 AND (i0 - 4) % 3 = 0 AND i1 BETWEEN 2 AND 60 AND (i1 - 2) % 5 = 0")
def slice_step_embeddings(spark, d):
    return vectors(spark, d)[Span(4, 100, 3), Span(2, 60, 5)].df


@query(f"SELECT i0, 63 - i1 AS i1, v FROM {E_SQL} WHERE i0 <= 9")
def slice_reverse_embeddings(spark, d):
    return vectors(spark, d)[Span(0, 9), Span(-1, 0, -1)].df


@query(f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM {V_SQL} WHERE v > 90")
def masked_select_events(spark, d):
    return series(spark, d).masked_select(lambda v: v > 90).df


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 45")
def masked_axis_select_lineitem(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"SELECT p AS i0, i1, v FROM {E_SQL} JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 499)) t(p, k) ON i0 = k")
def index_select_embeddings(spark, d):
    return vectors(spark, d).index_select(0, [7, 3, 7, 499]).df


@query(f"SELECT i0, CASE WHEN v < 10 THEN -1 ELSE v END AS v FROM {V_SQL}")
def masked_fill_events(spark, d):
    return series(spark, d).masked_fill(lambda v: v < 10, -1.0).df


@query(f"SELECT 0::BIGINT AS i0, row_number() OVER (ORDER BY i0) - 1 AS i1, i0 AS v FROM {V_SQL} WHERE floor(v / 10) <> 0")
def nonzero_events(spark, d):
    return series(spark, d).map(lambda v: F.floor(v / 10)).nonzero().df


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS v FROM orders")
def ismember_orders(spark, d):
    o = table(spark, d, "orders")
    known = TensorFrame(table(spark, d, "customer").where("c_acctbal > 5000").select(F.lit(0).alias("i0"), c("c_custkey").alias("v")), (0,))
    return TensorFrame(o.select(c("o_orderkey").alias("i0"), c("o_custkey").alias("v")), (0,)).ismember(known).df.select(c("i0").alias("o_orderkey"), "v")


@query(f"SELECT i1 AS i0, i0 AS i1, v * 2 AS v FROM {E_SQL}")
def transpose_embeddings(spark, d):
    return (vectors(spark, d) * 2.0).transpose().df


@query(f"SELECT i1 AS i0, i0 AS i1, v FROM {E_SQL}")
def transpose_all_embeddings(spark, d):
    return vectors(spark, d).transpose().df


@query(f"SELECT (i0 * 64 + i1) // 128 AS i0, ((i0 * 64 + i1) // 16) % 8 AS i1, (i0 * 64 + i1) % 16 AS i2, v FROM {E_SQL}")
def reshape_embeddings(spark, d):
    return vectors(spark, d).reshape((-1, 8, 16)).df


@query(f"SELECT (i0 * 64 + i1) // 16 AS i0, ((i0 * 64 + i1) // 4) % 4 AS i1, (i0 * 64 + i1) % 4 AS i2, v FROM {E_SQL}")
def reshape_all_embeddings(spark, d):
    return vectors(spark, d).reshape((-1, 4, 4)).df


@query(f"SELECT i0, v FROM {V_SQL} UNION ALL SELECT i0 + (SELECT count(*) FROM events), -v FROM {V_SQL}")
def concat_events(spark, d):
    v = series(spark, d)
    return TensorFrame.concat([v, -v], 0).df


@query(f"SELECT 0::BIGINT AS i0, i0 AS i1, v FROM {V_SQL} UNION ALL SELECT 1, i0, v * 2 FROM {V_SQL}")
def stack_events(spark, d):
    v = series(spark, d)
    return TensorFrame.stack([v, v * 2.0], 0).df


@query("WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels) SELECT doc_id, (CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END)::BIGINT AS chunk FROM t")
def chunk_labels(spark, d):
    x = table(spark, d, "labels")
    n = x.count()
    t = TensorFrame(ranked(x.select("doc_id"), [c("doc_id")], "i0").select("i0", c("doc_id").alias("v")), (n,))
    return t.chunk_labels(7).select(c("v").alias("doc_id"), c("chunk").cast("bigint").alias("chunk"))


@query(f"SELECT (i0 + 5) % (SELECT count(*) FROM embeddings) AS i0, i1, v FROM {E_SQL}")
def roll_embeddings(spark, d):
    return vectors(spark, d).roll(5, 0).df


@query(f"SELECT i0, (i1 + 5) % 64 AS i1, v FROM {E_SQL}")
def roll_all_embeddings(spark, d):
    return vectors(spark, d).roll(5, 1).df


@query("SELECT (r_regionkey * 3 + k)::BIGINT AS i0, r_regionkey::BIGINT AS v, 'repeat' AS how FROM region, range(3) t(k) UNION ALL SELECT r_regionkey + 5 * k, r_regionkey, 'tile' FROM region, range(3) t(k)")
def repeat_tile_region(spark, d):
    k = c("r_regionkey").cast("bigint")
    t = TensorFrame(table(spark, d, "region").select(k.alias("i0"), k.alias("v")), (5,))
    return t.repeat_values(3, 0).df.withColumn("how", F.lit("repeat")).unionByName(t.tile(3).df.withColumn("how", F.lit("tile")))


_GRAM = f"(SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 6) AS v FROM {E_SQL} a JOIN {E_SQL} b USING (i0) GROUP BY a.i1, b.i1)"


def _gram(spark, d) -> TensorFrame:
    e = vectors(spark, d)
    return TensorFrame.einsum("ki,kj->ij", e, e).map(lambda v: F.round(v, 6))


@query(f"SELECT i0, v FROM {_GRAM} WHERE i1 - i0 = 2")
def diagonal_gram(spark, d):
    return create.diagonal(_gram(spark, d), 2).df


@query(f"SELECT i0, i1, CASE WHEN i1 >= i0 + 1 THEN v ELSE 0 END AS up, CASE WHEN i1 <= i0 THEN v ELSE 0 END AS down FROM {_GRAM}")
def triu_gram(spark, d):
    g = _gram(spark, d)
    return create.triu(g, 1).df.withColumnRenamed("v", "up").join(create.tril(g).df.withColumnRenamed("v", "down"), ["i0", "i1"])


@query("SELECT n_nationkey::BIGINT AS i0, r_regionkey::BIGINT AS i1, r_regionkey * 10 AS x, n_nationkey * 100 AS y FROM nation, region")
def meshgrid_nation_region(spark, d):
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    y = TensorFrame(n.select(c("n_nationkey").cast("bigint").alias("i0"), (c("n_nationkey") * 100).alias("v")), (25,))
    x = TensorFrame(g.select(c("r_regionkey").cast("bigint").alias("i0"), (c("r_regionkey") * 10).alias("v")), (5,))
    a, b = create.meshgrid(x, y)
    return a.df.withColumnRenamed("v", "x").join(b.df.withColumnRenamed("v", "y"), ["i0", "i1"])


@query(f"SELECT i0, i1 * 2 + k AS i1, CASE WHEN k = 0 THEN v ELSE 0 END AS v FROM {E_SQL}, range(2) t(k)")
def upsample_embeddings(spark, d):
    return vectors(spark, d).upsample(2).df


@query(f"SELECT i0, i1 * 2 + k AS i1, CASE WHEN k = 1 THEN v ELSE 0 END AS v FROM {E_SQL}, range(2) t(k)")
def upsample_all_embeddings(spark, d):
    return vectors(spark, d).upsample(2, phase=1).df


#: Suppliers in the order of their keys, with their nations as small whole numbers.
_SERIES_SQL = "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_nationkey AS k FROM supplier), n AS (SELECT count(*) AS n FROM s) "


def _supplier_series(spark, d):
    out = ranked(table(spark, d, "supplier"), [c("s_suppkey")], "i0").select("i0", c("s_nationkey").cast("bigint").alias("v"))
    return TensorFrame(out, (out.count(),))


@query(_SERIES_SQL + "SELECT a.i AS i0, b.i AS i1, round(1.0 / (a.i + b.i + 1), 10) AS hilbert, round(pow(a.k / 25.0, b.i), 8) AS vander, c.k::BIGINT AS circulant FROM s a, s b, n, s c WHERE c.i = (a.i - b.i + n) % n")
def special_matrices(spark, d):
    """Matrices of as many rows as there are suppliers, made of their nations."""
    k = _supplier_series(spark, d)
    out = create.beside(spark, hilbert=create.hilbert_filling(k.size), vander=create.vandermonde_filling(k / 25.0), circulant=create.circulant_filling(k))
    # A cell has little else to do: rounding by decimals would take most of the time.
    return out.select("i0", "i1", fx.round_decimals(c("hilbert"), 10).alias("hilbert"), fx.round_decimals(c("vander"), 8).alias("vander"), c("circulant").cast("bigint").alias("circulant"))


@query("WITH b AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS z, count(*) AS n FROM supplier) SELECT i AS i0, round(a + i * 0.5, 6) AS ar, round(a + i * ((z - a) / (n - 1)), 6) AS li, round(pow(2, i * (10.0 / (n - 1))), 6) AS lo, round(exp(i * (ln(1 + z - a) / (n - 1))), 5) AS ge FROM b, (SELECT unnest(range(n)) AS i FROM b)")
def ranges_and_spaces(spark, d):
    """Between the least and the greatest balance, a value for each supplier."""
    a, z, n = table(spark, d, "supplier").agg(F.min("s_acctbal"), F.max("s_acctbal"), F.count("*")).first()
    parts = {"ar": create.arange(spark, a, a + n * 0.5 - 0.25, 0.5), "li": create.linspace(spark, a, z, n), "lo": create.logspace(spark, 0, 10, n, base=2.0), "ge": create.geomspace(spark, 1.0, 1 + z - a, n)}
    out = None
    for k, t in parts.items():
        df = t.df.select("i0", F.round("v", 5 if k == "ge" else 6).alias(k))
        out = df if out is None else out.join(df, "i0")
    return out


# -- order and sets ------------------------------------------------------------------------


@query(f"SELECT i0, round(sum(v) OVER (ORDER BY i0 ROWS UNBOUNDED PRECEDING), 4) AS v FROM {V_SQL}")
def cumsum_events(spark, d):
    return series(spark, d).cumsum(chunk=1024).df.select("i0", F.round("v", 4).alias("v"))


@query(f"SELECT i0, i1, round(product(1 + v / 100) OVER (PARTITION BY i0 ORDER BY i1 ROWS UNBOUNDED PRECEDING), 8) AS v FROM {E_SQL}")
def cumprod_embeddings(spark, d):
    return vectors(spark, d).map(lambda v: 1 + v / 100).cumprod(1).df.select("i0", "i1", F.round("v", 8).alias("v"))


@query(f"SELECT i0, round(product(1 + v / 1e6) OVER (ORDER BY i0 ROWS UNBOUNDED PRECEDING), 7) AS v FROM {V_SQL}")
def cumprod_events(spark, d):
    return series(spark, d).map(lambda v: 1 + v / 1e6).cumprod(chunk=1024).df.select("i0", F.round("v", 7).alias("v"))


@query(f"SELECT i0 - 3 AS i0, round(v - 3 * lag(v) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w, 6) + 0.0 AS v FROM {V_SQL} WINDOW w AS (ORDER BY i0) QUALIFY i0 >= 3")
def diff_events(spark, d):
    return series(spark, d).diff(3, chunk=1024).df.select("i0", r(c("v")).alias("v"))


@query(f"WITH s AS (SELECT i0, v, v - lag(v) OVER (ORDER BY i0) AS st FROM {V_SQL}), m AS (SELECT *, ((st + 3) % 6 + 6) % 6 - 3 AS fold FROM s), f AS (SELECT *, CASE WHEN st IS NULL OR abs(st) < 3 THEN 0 ELSE (CASE WHEN fold = -3 AND st > 0 THEN 3 ELSE fold END) - st END AS fix FROM m) SELECT i0, round(v + sum(fix) OVER (ORDER BY i0 ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS v FROM f")
def unwrap_events(spark, d):
    return series(spark, d).unwrap(period=6.0, chunk=1024).df.select("i0", r(c("v")).alias("v"))


@query(f"SELECT i0, i1 - 2 AS i1, round(v - 2 * lag(v) OVER w + lag(v, 2) OVER w, 8) + 0.0 AS v FROM {E_SQL} WINDOW w AS (PARTITION BY i0 ORDER BY i1) QUALIFY i1 >= 2")
def diff2_embeddings(spark, d):
    return vectors(spark, d).diff(2).df.select("i0", "i1", r(c("v"), 8).alias("v"))


@query(f"WITH s AS (SELECT i0, i1, v * 20 AS v, v * 20 - lag(v * 20) OVER (PARTITION BY i0 ORDER BY i1) AS st FROM {E_SQL}), f AS (SELECT *, CASE WHEN st IS NULL OR abs(st) < 3 THEN 0 ELSE (CASE WHEN st - 6 * floor((st + 3) / 6) = -3 AND st > 0 THEN 3 ELSE st - 6 * floor((st + 3) / 6) END) - st END AS fix FROM s) SELECT i0, i1, round(v + sum(fix) OVER (PARTITION BY i0 ORDER BY i1 ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS v FROM f")
def unwrap_embeddings(spark, d):
    return vectors(spark, d).map(lambda v: v * 20).unwrap(period=6.0).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT i0 - 1 AS i0, round(1 * v + 2 * lag(v) OVER (ORDER BY i0) + 3 * lag(v, 2) OVER (ORDER BY i0), 6) AS v FROM {V_SQL} QUALIFY i0 >= 2".replace("i0 - 1 AS i0", "i0 - 2 AS i0"))
def convolve_events(spark, d):
    k = TensorFrame.from_nested(spark, [1.0, 2.0, 3.0])
    return series(spark, d).convolve(k, "valid").df.select("i0", F.round("v", 6).alias("v"))


@query(f"SELECT i0, round(1 * v + 2 * lead(v) OVER (ORDER BY i0) + 3 * lead(v, 2) OVER (ORDER BY i0), 6) AS v FROM {V_SQL} QUALIFY lead(v, 2) OVER (ORDER BY i0) IS NOT NULL")
def correlate_events(spark, d):
    k = TensorFrame.from_nested(spark, [1.0, 2.0, 3.0])
    return series(spark, d).correlate(k, "valid").df.select("i0", F.round("v", 6).alias("v"))


@query(f"SELECT a.i0 + b.j AS i0, round(sum(a.v * b.w), 4) AS v FROM {V_SQL} a, (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS j, p_retailprice / 1e6 AS w FROM part) b GROUP BY 1")
def convolve_long_events(spark, d):
    """The series of events by that of all prices: two long series, by blocks."""
    p = table(spark, d, "part")
    prices = ranked(p.select("p_partkey", (c("p_retailprice") / 1e6).alias("v")), [c("p_partkey")], "i0").select("i0", "v")
    return series(spark, d).convolve(TensorFrame(prices, (p.count(),)), "full").df.select("i0", F.round("v", 4).alias("v"))


@query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i0, p_retailprice AS v FROM part")
def sorted_parts(spark, d):
    p = table(spark, d, "part")
    return TensorFrame(p.select(c("p_partkey").alias("i0"), c("p_retailprice").alias("v")), (0,)).sorted(descending=True).df


@query("SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS i0, p_partkey AS v FROM part")
def argsort_parts(spark, d):
    p = table(spark, d, "part")
    return TensorFrame(p.select(c("p_partkey").alias("i0"), c("p_size").alias("v")), (0,)).argsort().df


@query("SELECT event_type AS v, row_number() OVER (ORDER BY f) - 1 AS i0 FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY event_type)")
def unique_first_seen_events(spark, d):
    e = table(spark, d, "events")
    n = e.agg(F.max("event_id")).first()[0] + 1
    return TensorFrame(e.select(c("event_id").alias("i0"), c("event_type").alias("v")), (n,)).unique().df


_SETS = "a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT c_custkey AS v FROM customer WHERE c_acctbal < 1000)"


@query(f"WITH {_SETS} SELECT 'union' AS op, v FROM (SELECT v FROM a UNION SELECT v FROM b) UNION ALL SELECT 'both', v FROM (SELECT v FROM a INTERSECT SELECT v FROM b) UNION ALL SELECT 'first', v FROM (SELECT v FROM a EXCEPT SELECT v FROM b) UNION ALL SELECT 'either', v FROM ((SELECT v FROM a EXCEPT SELECT v FROM b) UNION ALL (SELECT v FROM b EXCEPT SELECT v FROM a))")
def union_intersect_setdiff_keys(spark, d):
    a = TensorFrame(table(spark, d, "orders").select(c("o_orderkey").alias("i0"), c("o_custkey").alias("v")), (0,))
    b = TensorFrame(table(spark, d, "customer").where("c_acctbal < 1000").select(c("c_custkey").alias("i0"), c("c_custkey").alias("v")), (0,))
    parts = {"both": a.intersection(b), "first": a.set_diff(b), "either": a.set_diff(b, True)}
    out = a.df.select("v").union(b.df.select("v")).distinct().select(F.lit("union").alias("op"), "v")
    for k, t in parts.items():
        out = out.unionByName(t.df.select(F.lit(k).alias("op"), "v"))
    return out


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def topk_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


# -- contraction and distance -------------------------------------------------------------------


@query(f"SELECT a.i0, round(sum(a.v * b.v), 6) + 0.0 AS dot FROM {E_SQL} a JOIN {E_SQL} b ON a.i1 = b.i1 AND b.i0 = 0 GROUP BY a.i0")
def dot_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    first = F.broadcast(e.where("vec_id = 0").select(c("embedding").alias("q")))
    return e.crossJoin(first).select(c("vec_id").alias("i0"), r(arrays.dot(c("embedding"), c("q"))).alias("dot"))


@query(f"SELECT i0, round(sum(v * (i1 + 1)), 6) + 0.0 AS v FROM {E_SQL} GROUP BY i0")
def gemv_embeddings(spark, d):
    return (vectors(spark, d) @ create.arange(spark, 1.0, 65.0)).df.select("i0", r(c("v")).alias("v"))


@query(f"SELECT i0, i1, v + 0.0 AS v FROM {_GRAM}")
def gemm_gram_embeddings(spark, d):
    e = vectors(spark, d)
    return (e.transpose() @ e).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT a.i0, (b.i0 - 8) AS i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {E_SQL} a JOIN {E_SQL} b ON a.i1 = b.i1 WHERE b.i0 BETWEEN 8 AND 15 GROUP BY a.i0, b.i0")
def einsum_ij_jk(spark, d):
    e = vectors(spark, d)
    return TensorFrame.einsum("ij,kj->ik", e, e[Span(8, 15)]).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT 0::BIGINT AS i0, round(sum(v), 4) AS v FROM {_GRAM} WHERE i0 = i1")
def einsum_trace(spark, d):
    return TensorFrame.einsum("ii->", _gram(spark, d)).df.select("i0", F.round("v", 4).alias("v"))


@query(f"SELECT i0, i1, round(v * v, 8) AS v FROM {E_SQL}")
def einsum_hadamard(spark, d):
    e = vectors(spark, d)
    return TensorFrame.einsum("ij,ij->ij", e, e).df.select("i0", "i1", F.round("v", 8).alias("v"))


@query(f"WITH g AS (SELECT b.i1 AS j, sum(b.v * c.v) AS v FROM {E_SQL} b JOIN {E_SQL} c ON b.i0 = c.i0 AND c.i1 = 0 GROUP BY b.i1) SELECT a.i0, round(sum(a.v * g.v), 4) + 0.0 AS v FROM {E_SQL} a JOIN g ON a.i1 = g.j GROUP BY a.i0")
def einsum_three_operands(spark, d):
    e = vectors(spark, d)
    return TensorFrame.einsum("ij,kj,k->i", e, e, e[..., Span(0, 0)].squeeze(1)).df.select("i0", r(c("v"), 4).alias("v"))


_PAIR = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a, embeddings b WHERE b.vec_id = 1)"


@query(f"SELECT vec_id, round(list_sum([abs(p[1] - p[2]) for p in list_zip(x, y)]), 6) AS manhattan, round(sqrt(list_sum([(p[1] - p[2]) ** 2 for p in list_zip(x, y)])), 6) AS euclidean, round(list_sum([(p[1] - p[2]) ** 2 for p in list_zip(x, y)]), 6) AS squared, round(list_max([abs(p[1] - p[2]) for p in list_zip(x, y)]), 6) AS largest, round(list_sum([abs(p[1] - p[2]) ** 3 for p in list_zip(x, y)]) ** (1.0 / 3), 6) AS third FROM {_PAIR}")
def pairwise_metrics_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 1").select(c("embedding").alias("y")))
    m = lambda *a, **k: F.round(arrays.distance(c("embedding"), c("y"), *a, **k), 6)
    return e.crossJoin(one).select("vec_id", m("manhattan").alias("manhattan"), m().alias("euclidean"), m(squared=True).alias("squared"), m("minkowski", p=math.inf).alias("largest"), m("minkowski", p=3.0).alias("third"))


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum([(p[1] - p[2]) ** 2 for p in list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])])), 6) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def distance_matrix_embeddings(spark, d):
    """The stated query set against all rows."""
    e = table(spark, d, "embeddings")
    return neighbors.distance_matrix(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding").select("i", "j", fx.round_decimals(c("d"), 6).alias("d"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(f"WITH b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark WHERE item_id % 50 = 0), t AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT item_id, doc_id, round(1 - len(list_intersect(b.w, t.w)) / (len(b.w) + len(t.w) - len(list_intersect(b.w, t.w)))::DOUBLE, 8) AS d FROM b, t")
def jaccard_tokens_documents(spark, d):
    """Benchmark items as the stated query set, against all documents."""
    b = table(spark, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.array_distinct(arrays.tokenize(c("text"))).alias("w"))
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(arrays.tokenize(c("text"))).alias("x"))
    return t.crossJoin(F.broadcast(b)).select("item_id", "doc_id", F.round(arrays.distance(c("w"), c("x"), "jaccard"), 8).alias("d"))


@query("SELECT q.vec_id AS q, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(list_sum([(p[1] - p[2]) ** 2 for p in list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[])])), e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 5")
def knn_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    out = neighbors.knn(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, exclude_self=True)
    return out.select("q", "id", c("rank").cast("bigint").alias("rank"))


@query("SELECT event_id, round(sqrt((value - 50) ** 2 + (user_id % 100 - 50) ** 2), 6) AS d FROM events WHERE sqrt((value - 50) ** 2 + (user_id % 100 - 50) ** 2) < 10")
def ball_query_events(spark, d):
    e = table(spark, d, "events").select("event_id", "value", (c("user_id") % 100).alias("u"))
    return neighbors.ball_query(e, [50.0, 50.0], ["value", "u"], "event_id", 10.0).select("event_id", F.round("d", 6).alias("d"))


_POINTS = "(SELECT s_suppkey AS id, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier)"


def _points(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(c("s_suppkey").alias("id"), (c("s_acctbal") / 1000).alias("x"), c("s_nationkey").cast("double").alias("y"))


@query(f"SELECT a.id AS a_id, b.id AS b_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM {_POINTS} a, {_POINTS} b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.5")
def radius_join_supplier(spark, d):
    p = _points(spark, d)
    return neighbors.radius_join(p, p, ["x", "y"], "id", 1.5).select("a_id", "b_id", F.round("d", 6).alias("d"))


_CUSTOMERS = "(SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y, (c_custkey % 10)::DOUBLE AS z FROM customer)"
_DISTANCE = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def _customers(spark, d) -> DataFrame:
    x = F.array(c("c_acctbal") / 1000, c("c_nationkey").cast("double"), (c("c_custkey") % 10).cast("double"))
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), x.alias("x"))


@query(f"SELECT a.id AS q, b.id AS id, round({_DISTANCE}, 6) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DISTANCE}, b.id) AS rank FROM {_CUSTOMERS} a JOIN {_CUSTOMERS} b ON a.id <> b.id QUALIFY rank <= 3")
def kd_nearest_customers(spark, d):
    """The three nearest of every customer among all, by the kd-split."""
    points = _customers(spark, d)
    out = spatial.nearest(spatial.build_index(points, "id", "x", leaf=256), points, "id", "x", 3, exclude_self=True)
    return out.select("q", "id", F.round("d", 6).alias("d"), c("rank").cast("long").alias("rank"))


@query(f"SELECT a.id AS q, b.id AS id, round({_DISTANCE}, 6) AS d FROM {_CUSTOMERS} a JOIN {_CUSTOMERS} b ON a.id <> b.id WHERE {_DISTANCE} < 0.9")
def kd_within_customers(spark, d):
    points = _customers(spark, d)
    out = spatial.within(spatial.build_index(points, "id", "x", leaf=256), points, "id", "x", 0.9, exclude_self=True)
    return out.select("q", "id", fx.round_decimals(c("d"), 6).alias("d"))


# -- learning --------------------------------------------------------------------------------------


@query("WITH cs AS (SELECT vec_id AS k, embedding::DOUBLE[] AS m FROM embeddings WHERE vec_id < 4) SELECT e.vec_id, k::INTEGER AS label, round(list_sum([(p[1] - p[2]) ** 2 for p in list_zip(e.embedding::DOUBLE[], m)]), 6) AS d2 FROM embeddings e, cs QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum([(p[1] - p[2]) ** 2 for p in list_zip(e.embedding::DOUBLE[], m)]), k) = 1")
def kmeans_assign_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    centers = [[float(x) for x in row["embedding"]] for row in e.where("vec_id < 4").orderBy("vec_id").collect()]
    return neighbors.assign(e, "embedding", centers).select("vec_id", "label", F.round("d2", 6).alias("d2"))


@query()
def kmeans_fit_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return neighbors.kmeans(e, "vec_id", "embedding", 4)[2].select("vec_id", "label", "d2")


@query(f"SELECT a.id FROM {_POINTS} a, {_POINTS} b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.2 GROUP BY a.id HAVING count(*) >= 4")
def dbscan_core_points(spark, d):
    return density.dbscan(_points(spark, d), ["x", "y"], "id", 1.2, 4).where("core").select("id")


@query(f"WITH RECURSIVE n AS (SELECT a.id AS a, b.id AS b FROM {_POINTS} a, {_POINTS} b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.2), core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4), reach(id, root) AS (SELECT id, id FROM core UNION SELECT n.b, reach.root FROM reach JOIN n ON n.a = reach.id JOIN core ON core.id = n.b), roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), border AS (SELECT n.a AS id, min(r.root) AS root FROM n JOIN roots r ON r.id = n.b GROUP BY n.a) SELECT p.id, p.id IN (SELECT id FROM core) AS core, coalesce(r.root, b.root) AS root FROM {_POINTS} p LEFT JOIN roots r ON r.id = p.id LEFT JOIN border b ON b.id = p.id")
def dbscan_labels(spark, d):
    return density.dbscan(_points(spark, d), ["x", "y"], "id", 1.2, 4)


@query("WITH s AS (SELECT i * 20000.0 AS x FROM range(25) t(i)) SELECT x, round(sum(CASE WHEN abs(x - o_totalprice) <= 45000 THEN exp(-0.5 * ((x - o_totalprice) / 15000) ** 2) / sqrt(2 * pi()) ELSE 0 END) / (count(*) * 15000.0) * 1e6, 6) AS density FROM s, orders GROUP BY x")
def kde_orders(spark, d):
    at = spark.range(25).select((c("id") * 20000.0).alias("x"))
    return stats.kde(table(spark, d, "orders"), "o_totalprice", at, bandwidth=15000.0).select("x", F.round(c("density") * 1e6, 6).alias("density"))


_Z = "(x - o_totalprice) / 15000.0"
_KDE_SQL = {
    "box": f"CASE WHEN abs({_Z}) <= 0.5 THEN 1.0 ELSE 0.0 END",
    "triangular": f"CASE WHEN abs({_Z}) <= 1 THEN 1 - abs({_Z}) ELSE 0.0 END",
    "trigonometric": f"CASE WHEN abs({_Z}) <= 0.5 THEN 1 + cos(2 * pi() * {_Z}) ELSE 0.0 END",
    "epanechnikov": f"CASE WHEN abs({_Z}) <= 1 THEN 0.75 * (1 - ({_Z}) ** 2) ELSE 0.0 END",
}


@query("WITH s AS (SELECT i * 20000.0 + 7 AS x FROM range(25) t(i)) SELECT x, " + ", ".join(f"round(sum({y}) / (count(*) * 15000.0) * 1e6, 6) AS {k}" for k, y in _KDE_SQL.items()) + " FROM s, orders GROUP BY x")
def kde_kernels_orders(spark, d):
    """Every kernel of bounded support."""
    at = spark.range(25).select((c("id") * 20000.0 + 7).alias("x"))
    out = at
    for k in _KDE_SQL:
        one = stats.kde(table(spark, d, "orders"), "o_totalprice", at, kernel=k, bandwidth=15000.0)
        out = out.join(one.select("x", F.round(c("density") * 1e6, 6).alias(k)), "x")
    return out


@query("SELECT event_id, CASE WHEN abs(z) <= 0.5 THEN 1.0 ELSE 0.0 END AS box, CASE WHEN abs(z) <= 1 THEN 1 - abs(z) ELSE 0.0 END AS tri, CASE WHEN abs(z) <= 0.5 THEN round(1 + cos(2 * pi() * abs(z)), 8) ELSE 0.0 END AS trig FROM (SELECT event_id, (value - 50) / 40 AS z FROM events)")
def kernels_events(spark, d):
    z = (c("value") - 50) / 40
    return table(spark, d, "events").select("event_id", fx.KERNELS["box"](z).alias("box"), fx.KERNELS["triangular"](z).alias("tri"), F.round(fx.KERNELS["trigonometric"](z), 8).alias("trig"))


@query()
def pca_explained_variance(spark, d):
    p = linalg.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 5)
    rows = [(k, float(a), float(b), float(s)) for k, (a, b, s) in enumerate(zip(p.explained_variance, p.explained_variance_ratio, p.singular_values, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, ratio double, singular double")


@query()
def svd_embeddings(spark, d):
    _, s, _ = linalg.svd(table(spark, d, "embeddings"), "vec_id", "embedding", 64)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k int, singular double")


@query()
def qr_embeddings(spark, d):
    q, _ = linalg.tsqr(table(spark, d, "embeddings"), "vec_id", "embedding", 64)
    return q.select("vec_id", F.posexplode("q").alias("k", "q"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def lstsq_lineitem(spark, d):
    x = table(spark, d, "lineitem").select(F.array(F.lit(1.0), c("l_quantity")).alias("x"), c("l_extendedprice").alias("y"))
    s = linalg.least_squares(x, "x", "y", 2)["solution"]
    return spark.createDataFrame([(round(float(s[0]), 2), round(float(s[1]), 4))], "intercept double, slope double")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents")
def tokenize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(arrays.tokenize(c("text"))).cast("bigint").alias("n_tokens"))


@query("SELECT l.doc_id, e.vec_id, round(list_sum(e.embedding::DOUBLE[]), 4) AS s FROM labels l JOIN embeddings e ON l.doc_id % 500 = e.vec_id")
def embedding_lookup(spark, d):
    ids = table(spark, d, "labels").select("doc_id", (c("doc_id") % 500).alias("id"))
    out = arrays.embedding(ids, table(spark, d, "embeddings"), "id", "vec_id")
    return out.select("doc_id", c("id").alias("vec_id"), F.round(arrays.total(c("embedding")), 4).alias("s"))


@query("WITH t AS (SELECT vec_id % 7 AS id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS g FROM embeddings WHERE vec_id % 7 <> 3) SELECT id, pos, round(sum(g), 6) + 0.0 AS grad FROM t GROUP BY id, pos")
def embedding_backward(spark, d):
    g = table(spark, d, "embeddings").select((c("vec_id") % 7).alias("id"), "embedding")
    return arrays.embedding_backward(g, "id", "embedding", padding=3).select("id", "pos", r(c("grad")).alias("grad"))


@query("WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, list_max(embedding)::DOUBLE AS m FROM embeddings) SELECT round(avg(ln(list_sum([exp(v - m) for v in x])) + m - x[label + 1]), 8) AS loss FROM t")
def sparse_softmax_xent_embeddings(spark, d):
    return table(spark, d, "embeddings").agg(F.round(F.avg(arrays.softmax_cross_entropy(c("embedding"), c("label"))), 8).alias("loss"))


@query("WITH t AS (SELECT unnest(embedding)::DOUBLE AS x, (unnest(range(len(embedding))) = label)::INTEGER AS y, vec_id FROM embeddings) SELECT round(sum(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) / count(DISTINCT vec_id), 6) AS loss FROM t")
def sigmoid_xent_embeddings(spark, d):
    target = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k == c("label")).cast("double"))
    return table(spark, d, "embeddings").agg(F.round(F.sum(arrays.sigmoid_cross_entropy(c("embedding"), target)) / F.count("*"), 6).alias("loss"))


@query("SELECT vec_id, round(list_sum([p[1] * ((p[2] % 3) - 1) for p in list_zip(embedding::DOUBLE[], range(64))]) + 0.5, 6) AS y0, round(list_sum([p[1] * ((p[2] % 5) - 2) for p in list_zip(embedding::DOUBLE[], range(64))]) - 0.5, 6) AS y1 FROM embeddings")
def linear_layer_embeddings(spark, d):
    w = [[float(k % 3 - 1) for k in range(64)], [float(k % 5 - 2) for k in range(64)]]
    y = arrays.linear(c("embedding"), w, [0.5, -0.5])
    return table(spark, d, "embeddings").select("vec_id", y.alias("y")).select("vec_id", F.round(c("y")[0], 6).alias("y0"), F.round(c("y")[1], 6).alias("y1"))


@query("SELECT a.n_nationkey AS node, round(sum(b.n_nationkey * 0.1), 6) AS h FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_nationkey")
def gcn_layer_nation(spark, d):
    n = table(spark, d, "nation").select(c("n_nationkey").cast("bigint").alias("k"), "n_regionkey")
    edges = n.join(n.withColumnRenamed("k", "k2"), "n_regionkey").select(c("k").alias("i0"), c("k2").alias("i1"), F.lit(1.0).alias("v"))
    x = TensorFrame(n.select(c("k").alias("i0"), c("k").cast("double").alias("v")), (25,))
    h = TensorFrame.einsum("ij,j->i", TensorFrame(edges, (25, 25), sparse=True), x)
    return h.df.select(c("i0").cast("int").alias("node"), F.round(c("v") * 0.1, 6).alias("h"))


@query(f"WITH p AS (SELECT i0, i1 // 8 AS y, i1 % 8 AS x, v FROM {E_SQL}) SELECT i0, (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, round(max(v), 6) AS v FROM p GROUP BY i0, y // 2, x // 2")
def maxpool_embeddings(spark, d):
    """Vectors as 8 x 8 images, pooled 2 x 2."""
    img = vectors(spark, d).reshape((-1, 8, 8))
    at = lambda k: F.expr(f"i{k} div 2")
    return img.df.groupBy("i0", at(1).alias("y"), at(2).alias("x")).agg(F.round(F.max("v"), 6).alias("v"))


@query(f"WITH p AS (SELECT i0, i1 // 8 AS y, i1 % 8 AS x, v FROM {E_SQL}) SELECT a.i0, (a.y * 6 + a.x)::INTEGER AS k, round(sum(b.v * ((b.y - a.y) * 3 + (b.x - a.x) - 4)), 6) + 0.0 AS v FROM p a JOIN p b ON a.i0 = b.i0 AND b.y - a.y BETWEEN 0 AND 2 AND b.x - a.x BETWEEN 0 AND 2 WHERE a.y <= 5 AND a.x <= 5 GROUP BY a.i0, a.y, a.x")
def conv2d_embeddings(spark, d):
    """Vectors as 8 x 8 images under a 3 x 3 kernel."""
    import numpy as np

    from tensorloom.nn import kernels

    w = np.arange(9.0).reshape(1, 1, 3, 3) - 4
    y = kernels.batched(c("embedding"), lambda x: kernels.conv2d(x, w), (1, 8, 8))
    return table(spark, d, "embeddings").select(c("vec_id").alias("i0"), F.posexplode(y).alias("k", "v")).select("i0", "k", r(c("v")).alias("v"))


@query("SELECT count(*) AS n, round(sum(p_retailprice), 2) AS price, sum(p_size)::BIGINT AS size FROM part")
def csv_roundtrip(spark, d):
    import uuid

    from tensorloom.plans.tables import shared_dir
    from tensorloom.sources import files

    p = table(spark, d, "part")
    n = p.count()
    t = TensorFrame.from_wide(ranked(p, [c("p_partkey")], "row"), "row", ["p_size", "p_retailprice"], n)
    path = f"{shared_dir(spark)}/tensorloom-csv-{uuid.uuid4().hex}"
    files.write_csv(t, path)
    back = files.read_coordinates(spark, path).df
    part = lambda k: F.sum(F.when(c("i1") == k, c("v")))
    return back.agg(F.count(F.when(c("i1") == 0, 1)).alias("n"), F.round(part(1), 2).alias("price"), part(0).cast("bigint").alias("size"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def windowed_events(spark, d):
    from tensorloom.streaming.windows import windowed

    out = windowed(table(spark, d, "events"), "1 hour", None, None, "ts", "value", "event_type")
    return out.select("event_type", c("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "low", "high")


# -- whole frames --------------------------------------------------------------------


def _positive_rows(t: TensorFrame) -> TensorFrame:
    """Mask of the rows whose first element is positive."""
    return t[Span(), 0].squeeze(1).map(lambda v: v > 0)


@query(_SERIES_SQL + "SELECT a.i AS i0, b.i AS i1, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS eye, t.k::DOUBLE AS toeplitz, coalesce(h.k, 0)::DOUBLE AS hankel FROM s a CROSS JOIN s b JOIN s t ON t.i = abs(a.i - b.i) LEFT JOIN s h ON h.i = a.i + b.i")
def structured_matrices(spark, d):
    """As many rows as there are suppliers; diagonals and anti-diagonals hold their nations."""
    k = _supplier_series(spark, d)
    out = create.beside(spark, eye=create.identity_filling(k.size), toeplitz=create.toeplitz_filling(k), hankel=create.hankel_filling(k))
    return out.select("i0", "i1", *[c(name).cast("double").alias(name) for name in ("eye", "toeplitz", "hankel")])


@query("WITH u AS (SELECT n_nationkey AS i0, n_regionkey AS v FROM nation UNION ALL SELECT 25 + n_nationkey, n_nationkey FROM nation), f AS (SELECT v, min(i0) AS p FROM u GROUP BY v) SELECT (row_number() OVER (ORDER BY p) - 1)::BIGINT AS i0, v::BIGINT AS v FROM f")
def union_frames_nation(spark, d):
    n = table(spark, d, "nation").select(c("n_nationkey").cast("bigint").alias("i0"), c("n_regionkey").cast("bigint").alias("v"))
    a, b = TensorFrame(n, (25,)), TensorFrame(n.select("i0", c("i0").alias("v")), (25,))
    return a.union(b).df


@query(f"SELECT round(sum(v * v), 2) AS v FROM {V_SQL}")
def frame_dot_events(spark, d):
    x = series(spark, d)
    return x.dot(x).df.select(r(c("v"), 2).alias("v"))


@query(f"WITH e AS {E_SQL}, k AS (SELECT i0, row_number() OVER (ORDER BY i0) - 1 AS p FROM e WHERE i1 = 0 AND v > 0) SELECT p::BIGINT AS i0, i1, v FROM e JOIN k USING (i0)")
def masked_axis_select_embeddings(spark, d):
    t = vectors(spark, d)
    return t.masked_axis_select(_positive_rows(t), 0).df.select("i0", "i1", "v")


@query(f"WITH e AS {E_SQL}, k AS (SELECT i0 FROM e WHERE i1 = 0 AND v > 0) SELECT e.i0, e.i1, CASE WHEN k.i0 IS NOT NULL THEN -1.0 ELSE e.v END::DOUBLE AS v FROM e LEFT JOIN k USING (i0)")
def masked_axis_fill_embeddings(spark, d):
    t = vectors(spark, d)
    return t.masked_axis_fill(_positive_rows(t), 0, -1.0).df


@query(f"WITH e AS {E_SQL} SELECT i0, j::BIGINT AS i1, round(2 * sum(v * ((i1 + j) % 3)) + 0.5 * max(CASE WHEN i1 = j THEN v END), 6) AS v FROM e, range(4) t(j) GROUP BY i0, j")
def gemm_embeddings(spark, d):
    t = vectors(spark, d)
    w = TensorFrame.generate(spark, (64, 4), lambda i, j: ((i + j) % 3).cast("double"))
    return TensorFrame.gemm(2.0, t, w, 0.5, t[Span(), Span(0, 3)]).df.select("i0", "i1", r(c("v")).alias("v"))


@query(f"SELECT true AS same, false AS moved, true AS less, false AS greater, round(sum(v), 4) AS total FROM {E_SQL}")
def compare_frames_embeddings(spark, d):
    t = vectors(spark, d)
    more = t + 1.0
    row = (t.equals(t), t.equals(more), t.precedes(more), more.precedes(t), round(t.sum().item(), 4))
    return spark.createDataFrame([row], "same boolean, moved boolean, less boolean, greater boolean, total double")


@query(f"WITH e AS {E_SQL}, n AS (SELECT max(i0) + 1 AS n FROM e) SELECT a.i0 AS vec_id, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS d FROM e a, n JOIN e b ON a.i1 = b.i1 AND a.i0 = (b.i0 + 1) % n GROUP BY a.i0")
def pairwise_embeddings(spark, d):
    """Each vector with the one before it; the first with the last."""
    e = table(spark, d, "embeddings").select(c("vec_id").cast("bigint").alias("vec_id"), "embedding")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    before = e.select(((c("vec_id") + 1) % n).alias("vec_id"), "embedding")
    return neighbors.pairwise(e, before, "vec_id", "embedding").select("vec_id", r(c("d")).alias("d"))


@query(f"SELECT round(sum(v * v), 3) AS trace, 0.0::DOUBLE AS lu_off, 0.0::DOUBLE AS solve_off, 0.0::DOUBLE AS pinv_off FROM {E_SQL}")
def factorised_gram_embeddings(spark, d):
    """Eigenvalues of the 64 x 64 Gram matrix, and how far its factors, solution and inverse are off."""
    g = _gram(spark, d).collect()
    low, up = linalg.lu_permuted(g)
    rhs = g.sum(axis=1)
    off = [abs(low @ up - g).max(), abs(linalg.solve(g, rhs) - 1).max(), abs(linalg.pinv(g) @ rhs - 1).max()]
    row = (round(float(linalg.symeig(g)[0].sum()), 3), *[round(float(x), 6) + 0.0 for x in off])
    return spark.createDataFrame([row], "trace double, lu_off double, solve_off double, pinv_off double")


@query(f"SELECT i0, i1, v FROM {E_SQL}")
def split_concat_embeddings(spark, d):
    """Split along axis 1, each part given an axis more and rid of it, and joined again."""
    parts = [p.unsqueeze(1).squeeze(1) for p in vectors(spark, d).split(20, axis=1)]
    return TensorFrame.concat(parts, 1).df.select("i0", "i1", "v")


@query(f"SELECT i0, i1, trunc(v * 100)::BIGINT AS v FROM {E_SQL}")
def cast_embeddings(spark, d):
    return (vectors(spark, d) * 100.0).cast("bigint").df


@query("SELECT count(*) * 10 AS n, min(p_retailprice) AS low, max(p_retailprice) AS high, true AS inside, true AS level, true AS normal FROM part")
def random_frame(spark, d):
    """Ten numbers for each part between the least and the greatest price: their count, bounds and means within six standard errors."""
    low, high, n = table(spark, d, "part").agg(F.min("p_retailprice"), F.max("p_retailprice"), F.count("*")).first()
    u = create.random_uniform(spark, (n, 10), low, high, seed=7).df
    g = create.random_normal(spark, (n, 10), low, high - low, seed=8).df.agg((F.abs(F.avg("v") - low) < 6 * (high - low) / math.sqrt(10 * n)).alias("normal"))
    level = F.abs(F.avg("v") - (low + high) / 2) < 6 * (high - low) / math.sqrt(120 * n)
    return u.agg(F.count("*").alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.bool_and((c("v") >= low) & (c("v") < high)).alias("inside"), level.alias("level")).crossJoin(g)


@query(f"SELECT i0, round(list_reduce(list(v ORDER BY i1), lambda s, x: s * 0.5 + x), 8) AS folded FROM {E_SQL} GROUP BY i0")
def frame_fold_embeddings(spark, d):
    return vectors(spark, d).fold(0.0, lambda s, x: s * 0.5 + x, axis=1).df.select("i0", r(c("v"), 8).alias("folded"))


@query(f"SELECT i0, CASE WHEN v < 0.5 THEN -abs(v) ELSE abs(v) END AS signed, abs(v - 0.5) < 1e-15 AS half FROM {V_SQL}")
def copysign_events(spark, d):
    x = series(spark, d).df
    return x.select("i0", fx.copysign(c("v"), c("v") - 0.5).alias("signed"), fx.almost_equal(c("v"), F.lit(0.5)).alias("half"))


# -- matrices that no driver holds -----------------------------------------------------------

#: Suppliers (even numbers) and parts (odd numbers), linked by their line items.
_LINKS = "SELECT l_suppkey * 2 AS s, l_partkey * 2 + 1 AS p, count(*) AS w FROM lineitem GROUP BY l_suppkey, l_partkey"


def _links(spark, d):
    """(i, j, v): one for each line item of a supplier and a part, both ways."""
    s, p = (c("l_suppkey") * 2).cast("bigint"), (c("l_partkey") * 2 + 1).cast("bigint")
    both = F.explode(F.array(F.struct(s.alias("i"), p.alias("j")), F.struct(p.alias("i"), s.alias("j")))).alias("_e")
    return table(spark, d, "lineitem").where(s.isNotNull() & p.isNotNull()).select(both).select("_e.i", "_e.j", F.lit(1.0).alias("v"))


def _ends(spark, d):
    """(i, degree, quantity, dealt) per supplier and part: its line items, their quantities, and its parts of the two each deals between its ends at random."""
    share = F.pmod(F.xxhash64("l_partkey", "l_suppkey"), F.lit(1 << 21)) / (1 << 20)
    at = [F.struct((c("l_suppkey") * 2).cast("bigint").alias("i"), share.alias("x")), F.struct((c("l_partkey") * 2 + 1).cast("bigint").alias("i"), (2 - share).alias("x"))]
    each = table(spark, d, "lineitem").select(F.explode(F.array(*at)).alias("_e"), c("l_quantity").cast("double").alias("y"))
    return settle(each.groupBy("_e.i").agg(F.count("*").cast("double").alias("degree"), F.sum("y").alias("quantity"), F.sum("_e.x").alias("dealt")), "ends")


@query(
    f"WITH RECURSIVE e AS (SELECT s AS i, p AS j, w FROM ({_LINKS}) UNION ALL SELECT p, s, w FROM ({_LINKS})), "
    "b AS (SELECT i, sum(q) AS b, sum(w) AS d FROM (SELECT unnest([l_suppkey * 2, l_partkey * 2 + 1]) AS i, l_quantity::DOUBLE AS q, 1 AS w FROM lineitem) GROUP BY i), "
    "t AS (SELECT 0 AS step, i, 0.0::DOUBLE AS x FROM b UNION ALL SELECT t.step + 1, e.i, (any_value(b.b) + sum(e.w * t.x)) / (2 * any_value(b.d)) FROM t JOIN e ON e.j = t.i JOIN b ON b.i = e.i WHERE t.step < 60 GROUP BY t.step, e.i) "
    "SELECT i::BIGINT AS node, round(x, 5) AS level FROM t WHERE step = 60"
)
def graph_solve_lineitem(spark, d):
    """Quantities smoothed over the graph of suppliers and parts: (2 D - W) x = b, b the quantity at a node; SQL iterates the fixed point."""
    ends = _ends(spark, d)
    a = _links(spark, d).withColumn("v", -c("v")).unionByName(ends.select("i", c("i").alias("j"), (2 * c("degree")).alias("v")))
    b = ends.select("i", c("quantity").alias("v"))
    x, _ = solvers.conjugate_gradient(a, b, tolerance=1e-12)
    return x.select(c("i").alias("node"), r(c("v"), 5).alias("level"))


@query("WITH n AS (SELECT unnest([l_suppkey * 2, l_partkey * 2 + 1]) AS i FROM lineitem), d AS (SELECT i, count(*) AS d FROM n GROUP BY i) SELECT i::BIGINT AS node, 1.0::DOUBLE AS eigenvalue, round(sqrt(d / sum(d) OVER ()), 5) AS entry FROM d")
def graph_eigen_lineitem(spark, d):
    """The leading eigenpair of the normalised links: 1, and roots of shares of the degrees.

    Apart from each other, groups of suppliers and parts have such a pair each.  The first
    vector deals the two of each line item between its ends, so that the part in each
    group's vector is that of the group's degrees.
    """
    ends = _ends(spark, d)
    scale = ends.select("i", (1 / F.sqrt("degree")).alias("v"))
    start = ends.select("i", (c("dealt") / F.sqrt("degree")).alias("v"))
    values, vectors = solvers.eigenpairs(_links(spark, d), 1, scale=scale, start=start)
    return vectors.select(c("i").alias("node"), F.lit(round(float(values[0]), 8)).alias("eigenvalue"), r(F.get("e", 0), 5).alias("entry"))


@query("WITH m AS (SELECT c_nationkey AS k, avg(o_totalprice / 1000) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey), o AS (SELECT sum(m) / (count(*) + 1) AS x FROM m) SELECT 0::BIGINT AS j, round(x, 5) AS v FROM o UNION ALL SELECT (k + 1)::BIGINT, round(m - x, 5) + 0.0 FROM m, o")
def pinv_times_orders(spark, d):
    """Least squares of least norm: thousands of price by a common level (0) and one for each nation, a matrix short of full rank."""
    x = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    x = x.select(c("o_orderkey").cast("bigint").alias("i"), (c("c_nationkey") + 1).cast("bigint").alias("k"), (c("o_totalprice") / 1000).alias("y"))
    a = x.select("i", F.explode(F.array(F.lit(0).cast("bigint"), c("k"))).alias("j"), F.lit(1.0).alias("v"))
    found, _ = solvers.least_squares(a, x.select("i", c("y").alias("v")))
    return found.select("j", r(c("v"), 5).alias("v"))


@query("SELECT 'price' AS target, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'discount', round(regr_intercept(l_discount, l_quantity), 6), round(regr_slope(l_discount, l_quantity), 8), round(regr_r2(l_discount, l_quantity), 6) FROM lineitem")
def lstsq_two_targets_lineitem(spark, d):
    """Two right-hand sides against the same matrix, in one pass."""
    x = table(spark, d, "lineitem").select(F.array(F.lit(1.0), c("l_quantity")).alias("x"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"))
    names = ["price", "discount"]
    found = linalg.least_squares(x, "x", names, 2)
    total = x.agg(*[(F.var_pop(y) * F.count(y)).alias(y) for y in names]).first()
    rows = [(y, round(float(found["solution"][0, k]), 6 if k else 2), round(float(found["solution"][1, k]), 8 if k else 4), round(1 - float(found["residual"][k]) / total[y], 6) + 0.0) for k, y in enumerate(names)]
    return spark.createDataFrame(rows, "target string, intercept double, slope double, r2 double")


@query(f"SELECT i0, i1, v FROM {E_SQL}")
def npy_roundtrip_embeddings(spark, d):
    """Written as npy parts by all tasks, and read again by ranges."""
    import uuid

    from tensorloom.plans.tables import shared_dir
    from tensorloom.sources import npy

    path = f"{shared_dir(spark)}/tensorloom-npy-{uuid.uuid4().hex}"
    npy.write(vectors(spark, d), path, size=1 << 22)
    return npy.read(spark, path, size=1 << 20).df
