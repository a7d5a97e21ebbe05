"""Registry of queries: the operators applied to the driver's tables, and DuckDB SQL for the same rows.

The physical tables aren't among the driver's, so stand-ins take their place: the first
three elements of an embedding are a position, its label a frame; events of a user in order
of time are a series or a trajectory. Floats are rounded, as engines add in other orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import A2_PS_TO_CM2_S, A3_TO_CM3, AMU_A3_TO_G_CM3, BAR_A3_TO_EV, EV_A3_TO_GPA, KB, KB_SCATTERING, PLANCK
from ..functions import physics as P
from ..operators import fits, modes, pairs, series, tables, transport, vibration
from ..operators import kirkwood_buff as kb
from ..session import shared_folder
from ..sources import bundles, deck, dump, log, sinks
from ..sources import tables as sources

BOX, WIDTH, R_MAX, CUTOFF = 4.0, 0.05, 2.0, 0.45
RHO_FE, RHO_B = 0.5, 0.25
SHELLS = 2
N_BINS = pairs.n_bins(R_MAX, WIDTH)
K_POINTS, K_STEP = 16, 0.2
DT_S, T_VIB = 1e-15, 1500.0
DT_PS, T_TRANSPORT, VOLUME, FRAMES = 0.1, 1500.0, 4000.0, 20


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded, and -0 as 0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- stand-ins


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """Particles of two species; the label is the frame."""
    e = _t(spark, d, "embeddings")
    xyz = [(F.get("embedding", i).cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    box = [F.lit(BOX).alias(f"l{c}") for c in "xyz"]
    return e.select(F.col("label").alias("frame"), F.col("vec_id").alias("atom_id"), F.when(F.col("vec_id") % 3 == 0, "B").otherwise("Fe").alias("species"), *xyz, *box)


ATOMS = f"""atoms AS (SELECT label AS frame, vec_id AS atom_id, CASE WHEN vec_id % 3 = 0 THEN 'B' ELSE 'Fe' END AS species,
  embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"""
_mi = lambda c: f"((b.{c} - a.{c}) - round_even((b.{c} - a.{c}) / {BOX}::DOUBLE, 0) * {BOX}::DOUBLE)"
DIST = f"""{ATOMS}, dd AS (SELECT a.frame, a.atom_id AS i, b.atom_id AS j, a.species AS sa, b.species AS sb,
  {_mi("x")} AS dx, {_mi("y")} AS dy, {_mi("z")} AS dz FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom_id < b.atom_id),
dist AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM dd)"""
HIST = f"""{DIST}, hist AS (SELECT least(sa, sb) AS species_a, greatest(sa, sb) AS species_b,
  CASE WHEN dist = {WIDTH * N_BINS!r}::DOUBLE THEN {N_BINS - 1} ELSE floor(dist / {WIDTH}::DOUBLE)::BIGINT END AS bin, count(*)::BIGINT AS n
  FROM dist WHERE dist <= {WIDTH * N_BINS!r}::DOUBLE GROUP BY ALL),
census AS (SELECT frame, species, count(*) AS c FROM atoms GROUP BY ALL),
grid AS (SELECT unnest(range({N_BINS}))::BIGINT AS bin)"""
RDF_THIN = f"""{HIST}, tot AS (SELECT species, sum(c)::DOUBLE AS total, CASE species WHEN 'Fe' THEN {RHO_FE}::DOUBLE ELSE {RHO_B}::DOUBLE END AS rho FROM census GROUP BY species),
nf AS (SELECT count(DISTINCT frame)::DOUBLE AS f FROM atoms),
thin AS (SELECT a.species AS species_a, b.species AS species_b, g.bin, (g.bin + 0.5::DOUBLE) * {WIDTH}::DOUBLE AS r,
  (CASE WHEN a.species = b.species THEN 2 ELSE 1 END) * coalesce(h.n, 0) / (a.total / f)
  / (f * ({4 * math.pi!r}::DOUBLE * ((g.bin + 0.5::DOUBLE) * {WIDTH}::DOUBLE) * ((g.bin + 0.5::DOUBLE) * {WIDTH}::DOUBLE) * {WIDTH}::DOUBLE) * b.rho) AS g
  FROM tot a JOIN tot b ON a.species <= b.species, nf, grid g LEFT JOIN hist h ON h.species_a = a.species AND h.species_b = b.species AND h.bin = g.bin)"""


def densities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Fe", RHO_FE), ("B", RHO_B)], "species string, rho double")


def series_of(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    """The first frames of every user: running sums are unwrapped coordinates."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").withColumn("frame_idx", F.row_number().over(w) - 1).filter(F.col("frame_idx") < FRAMES)
    return e.select(
        F.lit("all").alias("run"), "frame_idx", F.col("user_id").alias("atom_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("species"),
        (F.lit(1.0) + F.col("user_id") % 3).alias("mass"), F.sum("value").over(w).alias("xu"), (-F.col("value")).alias("yu"), (F.col("value") * 0.5).alias("zu"),
    )


TRAJECTORY = f"""tr0 AS (SELECT user_id AS atom_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS species, 1::DOUBLE + user_id % 3 AS mass, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events),
tr1 AS (SELECT *, sum(value) OVER (PARTITION BY atom_id ORDER BY frame_idx) AS xu, -value AS yu, value * 0.5::DOUBLE AS zu FROM tr0 WHERE frame_idx < {FRAMES}),
tr AS (SELECT 'all' AS run, frame_idx, atom_id, species,
  xu - sum(mass * xu) OVER (PARTITION BY frame_idx) / sum(mass) OVER (PARTITION BY frame_idx) AS xu,
  yu - sum(mass * yu) OVER (PARTITION BY frame_idx) / sum(mass) OVER (PARTITION BY frame_idx) AS yu,
  zu - sum(mass * zu) OVER (PARTITION BY frame_idx) / sum(mass) OVER (PARTITION BY frame_idx) AS zu FROM tr1),
lags AS (SELECT unnest(range(1, greatest(2, floor((count(DISTINCT frame_idx) - 1) * 0.5))::BIGINT + 1))::INT AS lag FROM tr),
q AS (SELECT frame_idx, species, sum(xu) AS x, sum(yu) AS y, sum(zu) AS z FROM tr GROUP BY ALL),
dq AS (SELECT lag, a.frame_idx, a.species, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM q a, lags, q b WHERE b.species = a.species AND b.frame_idx = a.frame_idx + lag),
cc AS (SELECT a.lag, a.species AS species_a, b.species AS species_b, avg(a.x * b.x + a.y * b.y + a.z * b.z) AS c
  FROM dq a JOIN dq b ON a.lag = b.lag AND a.frame_idx = b.frame_idx AND a.species <= b.species GROUP BY ALL),
cs AS (SELECT lag, a.species, sum((b.xu - a.xu) ** 2 + (b.yu - a.yu) ** 2 + (b.zu - a.zu) ** 2) / count(DISTINCT a.frame_idx) AS c
  FROM tr a, lags, tr b WHERE b.atom_id = a.atom_id AND b.frame_idx = a.frame_idx + lag GROUP BY ALL)"""


def velocities(spark: SparkSession, d: str) -> DataFrame:
    """An embedding as a series of 64 velocities; the label is the run."""
    e = _t(spark, d, "embeddings")
    rows = e.select(F.col("label").alias("run"), F.col("vec_id").alias("atom_id"), (F.lit(1.0) + F.col("vec_id") % 2).alias("mass"), F.posexplode("embedding").alias("frame_idx", "v"))
    return rows.select("run", "atom_id", "mass", "frame_idx", F.col("v").cast("double").alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))


VDOS = f"""vv AS (SELECT label AS run, vec_id AS atom_id, 1::DOUBLE + vec_id % 2 AS mass, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings),
fb AS (SELECT unnest(range(33))::INT AS bin),
pw AS (SELECT run, atom_id, bin, mass * (sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * t / 63)) * cos(2 * pi() * bin * t / 64)) ** 2
  + sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * t / 63)) * sin(2 * pi() * bin * t / 64)) ** 2) AS p FROM vv, fb GROUP BY run, atom_id, bin, mass),
sp AS (SELECT run, bin, bin / (64 * {DT_S!r}::DOUBLE) * {PLANCK!r}::DOUBLE AS e_ev, avg(p) / 64 * {DT_S!r}::DOUBLE * (CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END) / {PLANCK!r}::DOUBLE AS s FROM pw GROUP BY run, bin),
sa AS (SELECT *, (e_ev - lag(e_ev) OVER w) * (s + lag(s) OVER w) / 2 AS part FROM sp WINDOW w AS (PARTITION BY run ORDER BY bin)),
vdos AS (SELECT run, bin, e_ev, s / sum(part) OVER (PARTITION BY run) AS vdos FROM sa)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Event values by user and hour about their mean: a curve that changes sign."""
    e = _t(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), (F.col("value") * 100).cast("bigint").alias("v"))
    return e.groupBy("user_id", "hour").agg((F.sum("v") - 1500 * F.count("*")).alias("y"))



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- tables and accuracy

LP = "lp AS (SELECT l_extendedprice::DOUBLE AS t, l_quantity::DOUBLE * p_retailprice::DOUBLE AS p FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _prices(spark, d):
    both = _t(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity").join(_t(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("l_extendedprice").cast("double").alias("t"), (F.col("l_quantity").cast("double") * F.col("p_retailprice").cast("double")).alias("p"))


@_query("parity_metrics", f"WITH {LP} SELECT round(sqrt(avg((p - t) ** 2)), 4) AS rmse, round(avg(abs(p - t)), 4) AS mae, count(*)::BIGINT AS n FROM lp")
def _parity(spark, d):
    return _round(tables.parity(_prices(spark, d), "t", "p"), 4, "rmse", "mae")


@_query("axis_limits", f"WITH {LP}, m AS (SELECT min(least(t, p)) AS lo, max(greatest(t, p)) AS hi FROM lp) SELECT round(lo - (hi - lo) * 0.05::DOUBLE, 6) AS lo, round(hi + (hi - lo) * 0.05::DOUBLE, 6) AS hi FROM m")
def _limits(spark, d):
    return _round(tables.axis_limits(_prices(spark, d), ["t", "p"]), 6, "lo", "hi")


def _texts(spark, d):
    a = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return tables.numeric_pairs(series_of(spark, d), a, F.col("value").cast("string"))


_PAIRS = "p AS (SELECT CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS a, value::VARCHAR AS b FROM events)"


@_query("numeric_pairs", f"WITH {_PAIRS} SELECT try_cast(a AS DOUBLE) AS a, try_cast(b AS DOUBLE) AS b FROM p WHERE try_cast(a AS DOUBLE) IS NOT NULL AND try_cast(b AS DOUBLE) IS NOT NULL")
def _pairs_clean(spark, d):
    return _texts(spark, d)[0]


@_query("numeric_pairs_counts", f"WITH {_PAIRS} SELECT count(*) FILTER (WHERE try_cast(a AS DOUBLE) IS NOT NULL AND try_cast(b AS DOUBLE) IS NOT NULL)::BIGINT AS kept, count(*) FILTER (WHERE try_cast(a AS DOUBLE) IS NULL OR try_cast(b AS DOUBLE) IS NULL)::BIGINT AS dropped FROM p")
def _pairs_counts(spark, d):
    return _texts(spark, d)[1]


@_query("derived_energies", f"""SELECT l_orderkey, l_linenumber, round(l_quantity::DOUBLE * (l_discount::DOUBLE * 1000 + 1) * {BAR_A3_TO_EV!r}::DOUBLE, 9) AS pv,
  round(l_extendedprice::DOUBLE + l_tax::DOUBLE + l_quantity::DOUBLE * (l_discount::DOUBLE * 1000 + 1) * {BAR_A3_TO_EV!r}::DOUBLE, 6) AS enthalpy,
  round(CASE WHEN l_discount > 0 THEN l_quantity::DOUBLE * {AMU_A3_TO_G_CM3!r}::DOUBLE / l_discount::DOUBLE END, 6) AS density FROM lineitem""")
def _energies(spark, d):
    li = _t(spark, d, "lineitem")
    c = lambda n: F.col(n).cast("double")
    v = c("l_discount") * 1000 + 1
    out = li.select("l_orderkey", "l_linenumber", P.pv(c("l_quantity"), v).alias("pv"), P.enthalpy(c("l_extendedprice"), c("l_tax"), c("l_quantity"), v).alias("enthalpy"), P.density(c("l_quantity"), c("l_discount")).alias("density"))
    return _round(_round(out, 9, "pv"), 6, "enthalpy", "density")


@_query("mixing_free_energy", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE * 10 AS x, 1000 + l_quantity::DOUBLE * 10 AS t FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 0 AND x < 1 THEN {KB!r}::DOUBLE * t * (x * ln(x) + (1 - x) * ln(1 - x)) ELSE 0 END, 9) + 0.0::DOUBLE AS f_config FROM s""")
def _mixing(spark, d):
    li = _t(spark, d, "lineitem")
    x, t = F.col("l_discount").cast("double") * 10, F.lit(1000) + F.col("l_quantity").cast("double") * 10
    return _round(li.select("l_orderkey", "l_linenumber", P.mixing_entropy_term(x, t).alias("f_config")), 9, "f_config")


@_query("endpoint_normalize", """WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice::DOUBLE AS raw, o_totalprice::DOUBLE / 1000 AS err, 10 AS n, (o_custkey % 11) / 10.0::DOUBLE AS x FROM orders),
  e AS (SELECT o_orderpriority, min(raw) / 10 AS e_fe, max(raw) / 10 AS e_b, min(err) / 10 AS err_fe, max(err) / 10 AS err_b FROM o GROUP BY 1)
  SELECT o_orderkey, round(raw / n - (1 - x) * e_fe - x * e_b, 6) AS norm, round(sqrt((err / n) ** 2 + ((1 - x) * err_fe) ** 2 + (x * err_b) ** 2), 6) AS norm_err FROM o JOIN e USING (o_orderpriority)""")
def _normalize(spark, d):
    raw = F.col("o_totalprice").cast("double")
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", raw.alias("raw"), (raw / 1000).alias("err"), F.lit(10).alias("n"), ((F.col("o_custkey") % 11) / F.lit(10.0)).alias("x"))
    e = o.groupBy("o_orderpriority").agg(*[(f(c) / 10).alias(n) for f, c, n in ((F.min, "raw", "e_fe"), (F.max, "raw", "e_b"), (F.min, "err", "err_fe"), (F.max, "err", "err_b"))])
    out = tables.endpoint_normalize(o, e, ["o_orderpriority"], "raw", "err", "n", "x").select("o_orderkey", "norm", "norm_err")
    return _round(out, 6, "norm", "norm_err")


@_query("formula_parse", """WITH f AS (SELECT p_partkey, 'Fe' || p_size || 'B' || (p_partkey % 7) || 'Fe' AS formula, p_size + 1 AS fe, p_partkey % 7 AS b FROM part)
  SELECT p_partkey, formula, fe::BIGINT AS fe_count, b::BIGINT AS b_count, round(b / (fe + b)::DOUBLE, 9) AS x_b, 'Fe_{' || (fe - 1) || '}B_{' || b || '}Fe' AS label FROM f""")
def _formulas(spark, d):
    f = F.concat(F.lit("Fe"), F.col("p_size"), F.lit("B"), F.col("p_partkey") % 7, F.lit("Fe"))
    out = _t(spark, d, "part").select("p_partkey", f.alias("formula"))
    n = P.element_counts(F.col("formula"))
    return _round(out.select("p_partkey", "formula", F.element_at(n, "Fe").alias("fe_count"), F.element_at(n, "B").alias("b_count"), P.mole_fraction(F.col("formula"), "B").alias("x_b"), P.subscript_label(F.col("formula")).alias("label")), 9, "x_b")


@_query("strict_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _strict(spark, d):
    left = _t(spark, d, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    return tables.strict_join(left, _t(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), ["k"]).select("n_name", "r_name")


_SHARES = "s AS (SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY ALL), p AS (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice::DOUBLE), 4) AS price FROM orders GROUP BY ALL)"


@_query("composite_join", f"WITH {_SHARES} SELECT o_orderpriority, o_orderstatus, n, price FROM s JOIN p USING (o_orderpriority, o_orderstatus)")
def _composite(spark, d):
    o = _t(spark, d, "orders")
    key = ["o_orderpriority", "o_orderstatus"]
    return o.groupBy(*key).agg(F.count("*").alias("n")).join(o.groupBy(*key).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("price")), key)


@_query("rounded_join", "WITH a AS (SELECT DISTINCT l_discount::DOUBLE AS x FROM lineitem), b AS (SELECT unnest(range(11)) AS i) SELECT x, i::BIGINT AS i FROM a JOIN b ON round_even(x * 100, 0)::BIGINT = i")
def _rounded(spark, d):
    a = _t(spark, d, "lineitem").select(F.col("l_discount").cast("double").alias("x")).distinct()
    b = spark.range(11).select((F.col("id") / 100 + 1e-4).alias("x"), F.col("id").alias("i"))
    return tables.rounded_join(a, b, "x")


@_query("dimension_lookup", "SELECT c_nationkey, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _dimension(spark, d):
    dim = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return tables.dimension(_t(spark, d, "customer").groupBy("c_nationkey").count(), dim, "c_nationkey", "n_name").select("c_nationkey", "n_name", F.col("count").alias("n"))


@_query("grid_of", "SELECT r_regionkey, n_nationkey FROM region, nation")
def _grid(spark, d):
    return tables.grid_of(_t(spark, d, "region").select("r_regionkey"), _t(spark, d, "nation").select("n_nationkey"))


@_query("zip_arrays", "SELECT vec_id, (unnest(range(64)))::INT AS i, round(unnest(embedding)::DOUBLE, 6) AS a, round(unnest(list_reverse(embedding))::DOUBLE, 6) AS b FROM embeddings")
def _zip(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"))
    out = tables.zip_arrays(e, "embedding", "other").select("vec_id", "i", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return _round(out, 6, "a", "b")


@_query("lists_by", "SELECT c_nationkey, to_json(list(c_custkey ORDER BY c_custkey))::VARCHAR AS keys FROM customer GROUP BY 1")
def _lists(spark, d):
    out = tables.lists_by(_t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey", ["c_name"])
    return out.select("c_nationkey", F.to_json("c_custkey").alias("keys"))


@_query("bounded_max", "SELECT l_suppkey, round(max(l_extendedprice) * 1.06::DOUBLE, 6) AS top FROM lineitem WHERE l_quantity <= 25 GROUP BY 1")
def _bounded(spark, d):
    return _round(tables.bounded_max(_t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 25.0), 6, "top")


@_query("stress_pressure", f"SELECT vec_id, round(-(embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE) / 3 * {EV_A3_TO_GPA!r}::DOUBLE, 6) + 0.0::DOUBLE AS p_gpa FROM embeddings")
def _stress(spark, d):
    return _round(_t(spark, d, "embeddings").select("vec_id", P.pressure_gpa(F.col("embedding").cast("array<double>")).alias("p_gpa")), 6, "p_gpa")


# --- series

_EV = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events)"
_BY, _ORDER = ["user_id"], ["ts", "event_id"]


@_query("block_average", f"""WITH {_EV}, b AS (SELECT user_id, (o - 5) // 10 AS b, sum(value) AS s, count(*) AS n FROM ev WHERE o >= 5 GROUP BY ALL)
  SELECT user_id, round(sum(s) / sum(n), 8) AS mean, round(CASE WHEN count(*) FILTER (WHERE n = 10) >= 2 THEN stddev_samp(CASE WHEN n = 10 THEN s / n END) / sqrt(count(*) FILTER (WHERE n = 10)) END, 8) AS err,
  sum(n)::BIGINT AS n, (count(*) FILTER (WHERE n = 10))::BIGINT AS n_blocks FROM b GROUP BY 1""")
def _blocks(spark, d):
    return _round(series.block_average(series_of(spark, d), _BY, _ORDER, "value", 5, 10), 8, "mean", "err")


@_query("skip_stride", f"WITH {_EV} SELECT user_id, event_id FROM ev WHERE o >= 4 AND (o - 4) % 3 = 0 AND o - 4 < 21")
def _strided(spark, d):
    return series.skip_stride(series_of(spark, d), _BY, _ORDER, 4, 3, 7).select("user_id", "event_id")


@_query("last_fraction", f"WITH {_EV}, s AS (SELECT user_id, event_id, o // 2 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE o % 2 = 0) SELECT user_id, event_id FROM s WHERE k >= round_even(0.5::DOUBLE * n, 0) AND k < round_even(1.0::DOUBLE * n, 0) AND k < round_even(0.5::DOUBLE * n, 0) + 9")
def _tail(spark, d):
    return series.last_fraction(series_of(spark, d), _BY, _ORDER, 0.5, 1.0, 2, 9).select("user_id", "event_id")


@_query("cumulative_trapezoid", f"""WITH {_EV} SELECT user_id, event_id, round(sum(value) OVER w * 0.5::DOUBLE - 0.25::DOUBLE * (first_value(value) OVER w + value), 6) + 0.0::DOUBLE AS run FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY o ROWS UNBOUNDED PRECEDING)""")
def _cumulative(spark, d):
    out = series.cumulative_trapezoid(series_of(spark, d), _BY, _ORDER, F.col("value"), F.lit(0.5), "run")
    return _round(out.select("user_id", "event_id", "run"), 6, "run")


@_query("trapezoid", f"WITH {_EV}, p AS (SELECT user_id, (o - lag(o) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY o)) SELECT user_id, round(coalesce(sum(a), 0), 6) AS area FROM p GROUP BY 1")
def _area(spark, d):
    rows = series.ordinal(series_of(spark, d), _BY, _ORDER, "o")
    return _round(series.trapezoid(rows, _BY, "o", {"area": F.col("value")}), 6, "area")


@_query("frame_spacing", "WITH p AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, round_even(median(d), 0)::BIGINT AS spacing FROM p WHERE d IS NOT NULL GROUP BY 1")
def _spacing(spark, d):
    return series.frame_spacing(series_of(spark, d), _BY, "event_id")


@_query("last_write", "SELECT user_id, event_type, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM events GROUP BY ALL")
def _last(spark, d):
    return series.last_write(series_of(spark, d), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


@_query("nearest", "SELECT user_id, arg_min(event_id, {'a': abs(value - 10::DOUBLE), 'b': event_id}) AS event_id FROM events GROUP BY 1")
def _nearest(spark, d):
    return series.nearest(series_of(spark, d), _BY, "value", 10.0, "event_id").select("user_id", "event_id")


_HOURS = "dy AS (SELECT user_id, floor(epoch(date_trunc('second', ts)) / 3600)::BIGINT AS hour, (sum(trunc(value * 100)::BIGINT) - 1500 * count(*))::BIGINT AS y FROM events GROUP BY ALL)"


@_query("sign_segments", f"""WITH {_HOURS}, f AS (SELECT *, CASE WHEN sign(y) <> lag(sign(y)) OVER w THEN 1 ELSE 0 END AS c FROM dy WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
  g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY hour) AS segment FROM f)
  SELECT user_id, segment::BIGINT AS segment, min(hour) AS first, max(hour) AS last, count(*)::BIGINT AS n, sign(min(y))::INT AS sign FROM g GROUP BY user_id, segment""")
def _segments(spark, d):
    return series.sign_segments(daily(spark, d), ["user_id"], "hour", "y")


@_query("transitions", f"WITH {_EV}, c AS (SELECT user_id, event_id, o, CASE WHEN o > 0 AND event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY o) THEN 1 ELSE 0 END AS c FROM ev) SELECT user_id, event_id, (1 + sum(c) OVER (PARTITION BY user_id ORDER BY o))::BIGINT AS type_id FROM c")
def _transitions(spark, d):
    return series.transitions(series_of(spark, d), _BY, _ORDER, "event_type").select("user_id", "event_id", "type_id")


@_query("thin_beyond", "WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, value > 10 ORDER BY event_id) - 1 AS r FROM events) SELECT user_id, event_id FROM r WHERE NOT value > 10 OR r % 3 = 0")
def _thin(spark, d):
    e = series_of(spark, d).withColumn("x", F.when(F.col("value") > 10, F.col("event_id") + 10_000_000).otherwise(-F.col("event_id")))
    return series.thin_beyond(e, _BY, "x", 0, 3).select("user_id", "event_id")


_PICK = "list_position(list_transform({s}, lambda x: abs(x - {g})), list_min(list_transform({s}, lambda x: abs(x - {g}))))"


@_query("nearest_frames", f"""WITH RECURSIVE {_EV}, l AS (SELECT user_id, list(floor(epoch(ts)) / 60 ORDER BY o) AS t FROM ev GROUP BY 1),
  r AS (SELECT user_id, t, 0 AS rank, t[len(t)] AS target, {_PICK.format(s="t", g="t[len(t)]")} AS p FROM l
    UNION ALL SELECT user_id, t, rank + 1, t[len(t)] - 60.0::DOUBLE * (rank + 1), {_PICK.format(s="t[1:p - 1]", g="(t[len(t)] - 60.0::DOUBLE * (rank + 1))")} FROM r WHERE rank < 9 AND p > 1)
  SELECT user_id, rank, target, (p - 1)::INT AS frame, t[p] AS time FROM r QUALIFY count(*) OVER (PARTITION BY user_id) = 10""")
def _frames(spark, d):
    e = series.ordinal(series_of(spark, d), _BY, _ORDER, "frame").withColumn("time", F.unix_timestamp("ts") / 60)
    return series.nearest_frames(e, _BY, "frame", "time", 10, 60.0)


# --- pairs


@_query("minimum_image", f"""WITH {ATOMS} SELECT atom_id, round(x - round_even(x / {BOX}::DOUBLE, 0) * {BOX}::DOUBLE, 9) + 0.0::DOUBLE AS dx, round(-1 + (((x + 1) % {BOX}::DOUBLE) + {BOX}::DOUBLE) % {BOX}::DOUBLE, 9) + 0.0::DOUBLE AS wx FROM atoms""")
def _image(spark, d):
    a = atoms(spark, d)
    return _round(a.select("atom_id", P.min_image(F.col("x"), F.lit(BOX)).alias("dx"), P.wrap(F.col("x"), F.lit(-1.0), F.lit(BOX)).alias("wx")), 9, "dx", "wx")


@_query("pair_distances", f"WITH {DIST} SELECT i AS atom_id_a, j AS atom_id_b, round(dist, 9) AS dist FROM dist")
def _distances(spark, d):
    return _round(pairs.pair_distances(atoms(spark, d)).select("atom_id_a", "atom_id_b", "dist"), 9, "dist")


@_query("pair_histogram", f"WITH {HIST} SELECT species_a, species_b, bin, n FROM hist")
def _histogram(spark, d):
    return pairs.pair_histogram(atoms(spark, d), WIDTH, R_MAX)


@_query("rdf_thin", f"WITH {RDF_THIN} SELECT species_a, species_b, bin, round(r, 9) AS r, round(g, 8) AS g FROM thin")
def _thin_rdf(spark, d):
    return _round(_round(pairs.rdf_thin(atoms(spark, d), WIDTH, R_MAX, densities(spark)), 9, "r"), 8, "g")


def _exact_sql(total: bool) -> str:
    src = HIST.replace("CASE WHEN vec_id % 3 = 0 THEN 'B' ELSE 'Fe' END AS species", "0 AS species") if total else HIST
    lo, hi = f"(bin * {WIDTH}::DOUBLE)", f"((bin + 1) * {WIDTH}::DOUBLE)"
    return f"""WITH {src}, ex AS (SELECT a.species AS species_a, b.species AS species_b, sum(CASE WHEN a.species = b.species THEN 0.5::DOUBLE * a.c * ((a.c - 1) / {BOX**3}::DOUBLE) ELSE a.c * (b.c / {BOX**3}::DOUBLE) END) AS e
  FROM census a JOIN census b ON a.frame = b.frame AND a.species <= b.species GROUP BY ALL),
  f AS (SELECT ex.species_a, ex.species_b, g.bin, coalesce(n, 0) AS n, e * ({4 * math.pi / 3!r}::DOUBLE * ({hi.replace("bin", "g.bin")} ** 3 - {lo.replace("bin", "g.bin")} ** 3)) AS norm
  FROM ex, grid g LEFT JOIN hist h ON h.species_a = ex.species_a AND h.species_b = ex.species_b AND h.bin = g.bin)
  SELECT species_a, species_b, bin, round((bin + 0.5::DOUBLE) * {WIDTH}::DOUBLE, 9) AS r, round(CASE WHEN norm > 0 THEN n / norm ELSE 0 END, 8) AS g FROM f"""


@_query("rdf_exact", _exact_sql(False))
def _exact(spark, d):
    return _round(_round(pairs.rdf_exact(atoms(spark, d), WIDTH, R_MAX), 9, "r"), 8, "g")


@_query("rdf_total", _exact_sql(True))
def _exact_total(spark, d):
    return _round(_round(pairs.rdf_exact(atoms(spark, d), WIDTH, R_MAX, "total"), 9, "r"), 8, "g")


_B = ATOMS.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 3 = 0")
BONDS = f"""{DIST.replace(ATOMS, _B)}, bonds AS (SELECT frame, i, j, dist FROM dist WHERE dist <= {CUTOFF}::DOUBLE),
cn AS (SELECT a.frame, a.atom_id, count(b.frame)::BIGINT AS cn FROM atoms a LEFT JOIN bonds b ON b.frame = a.frame AND (b.i = a.atom_id OR b.j = a.atom_id) GROUP BY ALL)"""


def _boron(spark, d):
    a = atoms(spark, d).filter("species = 'B'")
    return a, pairs.bonds(a, CUTOFF)


@_query("bonds", f"WITH {BONDS} SELECT frame, i, j, round(dist, 9) AS dist FROM bonds")
def _bonds(spark, d):
    return _round(_boron(spark, d)[1], 9, "dist")


@_query("coordination", f"WITH {BONDS} SELECT frame, atom_id, cn FROM cn")
def _cn(spark, d):
    return pairs.coordination(*_boron(spark, d))


@_query("frame_summary", f"WITH {BONDS} SELECT frame, (sum(cn) / 2)::BIGINT AS bonds, round(avg(cn), 9) AS mean_cn, min(cn) AS min_cn, max(cn) AS max_cn, count(*)::BIGINT AS n FROM cn GROUP BY 1")
def _summary(spark, d):
    return _round(pairs.frame_summary(pairs.coordination(*_boron(spark, d))), 9, "mean_cn")


@_query("cn_fraction", f"WITH {BONDS}, f AS (SELECT frame, avg((cn = 1)::INT) AS f FROM cn GROUP BY 1) SELECT round(avg(f), 9) AS mean_fraction, round(stddev_samp(f) / sqrt(count(*)), 9) AS sem, count(*)::BIGINT AS n_frames FROM f")
def _fraction(spark, d):
    return _round(pairs.fraction_with(pairs.coordination(*_boron(spark, d)), 1), 9, "mean_fraction", "sem")


@_query("adjacency", f"WITH {BONDS}, e AS (SELECT frame, i, j FROM bonds UNION ALL SELECT frame, j, i FROM bonds) SELECT a.frame, a.atom_id AS i, to_json(coalesce(list(j ORDER BY j) FILTER (WHERE j IS NOT NULL), []))::VARCHAR AS neighbours FROM atoms a LEFT JOIN e ON e.frame = a.frame AND e.i = a.atom_id GROUP BY ALL")
def _adjacency(spark, d):
    a, e = _boron(spark, d)
    return pairs.adjacency(e, a).withColumn("neighbours", F.to_json("neighbours"))


# --- reciprocal space and integrals

MODES = f"""{ATOMS}, ax AS (SELECT unnest(range(-{SHELLS}, {SHELLS} + 1))::DOUBLE AS v),
kg AS (SELECT a.v AS nx, b.v AS ny, c.v AS nz FROM ax a, ax b, ax c WHERE a.v <> 0 OR b.v <> 0 OR c.v <> 0),
md AS (SELECT frame, nx, ny, nz, species, sum(cos({2 * math.pi!r}::DOUBLE * (nx * x / {BOX} + ny * y / {BOX} + nz * z / {BOX}))) AS re,
  -sum(sin({2 * math.pi!r}::DOUBLE * (nx * x / {BOX} + ny * y / {BOX} + nz * z / {BOX}))) AS im FROM atoms, kg GROUP BY ALL),
fm AS (SELECT frame, nx, ny, nz, coalesce(sum(re) FILTER (WHERE species = 'Fe'), 0) AS fr, coalesce(sum(im) FILTER (WHERE species = 'Fe'), 0) AS fi,
  coalesce(sum(re) FILTER (WHERE species = 'B'), 0) AS br, coalesce(sum(im) FILTER (WHERE species = 'B'), 0) AS bi FROM md GROUP BY ALL),
sk AS (SELECT nx, ny, nz, avg((fr * fr + fi * fi) / {BOX**3}) AS s_ff, avg((fr * br + fi * bi) / {BOX**3}) AS s_fb, avg((br * br + bi * bi) / {BOX**3}) AS s_bb FROM fm GROUP BY ALL)"""
_XF = RHO_FE / (RHO_FE + RHO_B)


def _scc(x: str) -> str:
    return f"(({1 - _XF!r}::DOUBLE ** 2) * {x}s_ff - 2 * {1 - _XF!r}::DOUBLE * {_XF!r}::DOUBLE * {x}s_fb + ({_XF!r}::DOUBLE ** 2) * {x}s_bb) / {RHO_FE + RHO_B!r}::DOUBLE"


@_query("density_modes", f"WITH {MODES} SELECT frame, nx, ny, nz, species, round(re, 8) + 0.0::DOUBLE AS re, round(im, 8) + 0.0::DOUBLE AS im FROM md")
def _modes(spark, d):
    return _round(modes.density_modes(atoms(spark, d), SHELLS).drop("v"), 8, "re", "im")


@_query("partial_structure", f"WITH {MODES} SELECT nx, ny, nz, round(s_ff, 8) + 0.0::DOUBLE AS s_ff, round(s_fb, 8) + 0.0::DOUBLE AS s_fb, round(s_bb, 8) + 0.0::DOUBLE AS s_bb FROM sk")
def _structure(spark, d):
    return _round(modes.partial_structure(modes.density_modes(atoms(spark, d), SHELLS), "Fe", "B"), 8, "s_ff", "s_fb", "s_bb")


SHELL = f"""{MODES}, sh AS (SELECT round_even(sqrt((nx * {2 * math.pi / BOX!r}::DOUBLE) ** 2 + (ny * {2 * math.pi / BOX!r}::DOUBLE) ** 2 + (nz * {2 * math.pi / BOX!r}::DOUBLE) ** 2) * 100, 0) / 100 AS k,
  s_ff, s_fb, s_bb, {_scc("")} AS scc FROM sk)"""


def _shells(spark, d):
    return modes.reciprocal_structure(atoms(spark, d), "Fe", "B", (BOX, BOX, BOX), _XF, RHO_FE + RHO_B, SHELLS)


@_query("reciprocal_structure", f"WITH {SHELL} SELECT k, round(avg(s_ff), 8) + 0.0::DOUBLE AS s_ff, round(avg(s_fb), 8) + 0.0::DOUBLE AS s_fb, round(avg(s_bb), 8) + 0.0::DOUBLE AS s_bb, round(avg(scc), 8) + 0.0::DOUBLE AS scc, round(sqrt(count(*)), 8) AS w FROM sh GROUP BY k")
def _reciprocal(spark, d):
    return _round(_shells(spark, d), 8, "s_ff", "s_fb", "s_bb", "scc", "w")


@_query("thermodynamic_factor", f"""WITH {SHELL}, a AS (SELECT k, avg(scc) AS scc FROM sh GROUP BY k), g AS (SELECT k, {_XF!r}::DOUBLE * (1 - {_XF!r}::DOUBLE) / scc AS gamma, {KB_SCATTERING!r}::DOUBLE * 1500 / scc AS g2 FROM a)
  SELECT k, round(gamma, 8) AS gamma, round(g2, 8) AS g2, round((gamma - 1) / ({1 - _XF!r}::DOUBLE * (1 - {1 - _XF!r}::DOUBLE)), 8) AS excess FROM g""")
def _factor(spark, d):
    a = _shells(spark, d)
    g = a.select("k", P.thermodynamic_factor(F.lit(_XF), F.col("scc")).alias("gamma"), P.gibbs_curvature(F.col("scc"), F.lit(1500.0)).alias("g2"))
    return _round(g.withColumn("excess", P.excess_curvature(F.col("gamma"), F.lit(1 - _XF))), 8, "gamma", "g2", "excess")


@_query("oz_fit")
def _oz(spark, d):
    return fits.oz_fit(_shells(spark, d).withColumn("state", F.lit(1)), ["state"], w="w", k_max=5.0)


def _rdf(spark, d):
    g = pairs.rdf_thin(atoms(spark, d), WIDTH, R_MAX, densities(spark))
    name = F.when(F.col("species_a") != F.col("species_b"), "FeB").otherwise(F.concat("species_a", "species_b"))
    return g.select(name.alias("pair"), "r", "g")


_W = f"(1 - 1.5::DOUBLE * least(r / {R_MAX}::DOUBLE, 1) + 0.5::DOUBLE * least(r / {R_MAX}::DOUBLE, 1) ** 3)"
KBI = f"""{RDF_THIN}, rd AS (SELECT CASE WHEN species_a <> species_b THEN 'FeB' ELSE species_a || species_b END AS pair, r, {4 * math.pi!r}::DOUBLE * r * r * (g - 1) AS h FROM thin),
kp AS (SELECT unnest(range({K_POINTS}))::DOUBLE * {K_STEP}::DOUBLE AS k),
ig AS (SELECT pair, k, r, h, h * {_W} * CASE WHEN k * r = 0 THEN 1 ELSE sin(k * r) / (k * r) END AS w FROM rd, kp),
rn AS (SELECT pair, k, r, sum(h) OVER o * {WIDTH}::DOUBLE - 0.5::DOUBLE * {WIDTH}::DOUBLE * (first_value(h) OVER o + h) AS raw, sum(w) OVER o * {WIDTH}::DOUBLE - 0.5::DOUBLE * {WIDTH}::DOUBLE * (first_value(w) OVER o + w) AS kv
  FROM ig WINDOW o AS (PARTITION BY pair, k ORDER BY r ROWS UNBOUNDED PRECEDING)),
pl AS (SELECT pair, k, avg(raw) AS g_raw, avg(kv) AS g_k, max(r) AS r_plateau FROM rn WHERE r >= {R_MAX * 0.8!r}::DOUBLE AND r <= {R_MAX}::DOUBLE GROUP BY ALL)"""


@_query("kbi_pair", f"WITH {KBI} SELECT pair, round(g_raw, 7) AS g_raw, round(g_k, 7) AS g_kv, round(r_plateau, 7) AS r_plateau, round(abs(g_raw - g_k) / greatest(abs(g_k), 1e-12::DOUBLE), 7) AS disagreement FROM pl WHERE k = 0")
def _kbi(spark, d):
    return _round(kb.integrate_pair(_rdf(spark, d), WIDTH, R_MAX), 7, "g_raw", "g_kv", "r_plateau", "disagreement")


def _sinc(spark, d):
    return kb.sinc_plateau(_rdf(spark, d), spark.range(K_POINTS).select((F.col("id") * F.lit(K_STEP)).alias("k")), WIDTH, R_MAX)


@_query("kbi_sinc", f"WITH {KBI} SELECT pair, round(k, 6) AS k, round(g_k, 7) AS g_k FROM pl")
def _kbi_sinc(spark, d):
    return _round(_round(_sinc(spark, d), 6, "k"), 7, "g_k")


@_query("kbi_scc", f"""WITH {KBI}, s AS (SELECT k, {RHO_FE} + {RHO_FE**2} * max(g_k) FILTER (WHERE pair = 'FeFe') AS s_ff, {RHO_FE * RHO_B} * max(g_k) FILTER (WHERE pair = 'FeB') AS s_fb,
  {RHO_B} + {RHO_B**2} * max(g_k) FILTER (WHERE pair = 'BB') AS s_bb FROM pl GROUP BY k)
  SELECT round(k, 6) AS k, round(s_ff, 7) AS s_ff, round(s_fb, 7) AS s_fb, round(s_bb, 7) AS s_bb, round({_scc("")}, 7) AS scc FROM s""")
def _kbi_scc(spark, d):
    return _round(_round(kb.scc_from_integrals(_sinc(spark, d), RHO_FE, RHO_B), 6, "k"), 7, "s_ff", "s_fb", "s_bb", "scc")


# --- transport and vibration


def _centered(spark, d):
    rows = transport.centered(trajectory(spark, d))
    return rows, transport.lag_table(rows)


@_query("centered", f"WITH {TRAJECTORY} SELECT frame_idx::INT AS frame_idx, atom_id, round(xu, 6) + 0.0::DOUBLE AS xu, round(yu, 6) + 0.0::DOUBLE AS yu, round(zu, 6) + 0.0::DOUBLE AS zu FROM tr")
def _com(spark, d):
    return _round(_centered(spark, d)[0].select("frame_idx", "atom_id", "xu", "yu", "zu"), 6, "xu", "yu", "zu")


@_query("lag_correlations", f"WITH {TRAJECTORY} SELECT lag, species_a, species_b, round(c, 4) + 0.0::DOUBLE AS c FROM cc")
def _correlations(spark, d):
    return _round(transport.correlations(*_centered(spark, d)).drop("run"), 4, "c")


@_query("self_correlations", f"WITH {TRAJECTORY} SELECT lag, species, round(c, 4) + 0.0::DOUBLE AS c FROM cs")
def _self(spark, d):
    return _round(transport.self_correlations(*_centered(spark, d)).drop("run"), 4, "c")


_V = VOLUME * A3_TO_CM3
_SCALE = A2_PS_TO_CM2_S / (6 * KB * T_TRANSPORT * _V)


@_query("onsager", f"""WITH {TRAJECTORY}, mx AS (SELECT max(lag * {DT_PS}::DOUBLE) AS m FROM lags),
  f AS (SELECT species_a, species_b, regr_slope(c, lag * {DT_PS}::DOUBLE) AS s, regr_r2(c, lag * {DT_PS}::DOUBLE) AS r2 FROM cc, mx WHERE lag * {DT_PS}::DOUBLE BETWEEN 0.2::DOUBLE * m AND 0.8::DOUBLE * m GROUP BY ALL),
  g AS (SELECT species, regr_slope(c, lag * {DT_PS}::DOUBLE) AS s, regr_r2(c, lag * {DT_PS}::DOUBLE) AS r2 FROM cs, mx WHERE lag * {DT_PS}::DOUBLE BETWEEN 0.2::DOUBLE * m AND 0.8::DOUBLE * m GROUP BY ALL),
  n AS (SELECT species, count(DISTINCT atom_id) AS n FROM tr GROUP BY 1)
  SELECT species_a, species_b, round(f.s * {_SCALE / 1e20!r}::DOUBLE, 5) + 0.0::DOUBLE AS l, round(f.r2, 6) AS r2, round(g.s * {_SCALE / 1e20!r}::DOUBLE, 5) AS l_self,
    round(g.s * {_SCALE * KB * T_TRANSPORT * _V!r}::DOUBLE / n, 9) AS d_self, round(g.r2, 6) AS r2_self, round(f.s / g.s - 1, 6) AS factor
  FROM f LEFT JOIN g ON g.species = f.species_a AND f.species_a = f.species_b LEFT JOIN n ON n.species = g.species""")
def _onsager(spark, d):
    out = transport.onsager(trajectory(spark, d), T_TRANSPORT, VOLUME, DT_PS).drop("run")
    out = out.withColumns({"l": F.col("l") / 1e20, "l_self": F.col("l_self") / 1e20})
    return _round(_round(_round(out, 5, "l", "l_self"), 6, "r2", "r2_self", "factor"), 9, "d_self")


@_query("slope_fit", "SELECT l_suppkey, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 6) AS slope, round(regr_r2(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 6) AS r2 FROM lineitem GROUP BY 1")
def _slope(spark, d):
    li = _t(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return _round(transport.slope_fit(li, ["l_suppkey"], "q", "p"), 6, "slope", "r2")


def _spectrum(spark, d):
    return vibration.spectrum(velocities(spark, d), DT_S)


@_query("vdos", f"WITH {VDOS} SELECT run, bin, round(e_ev, 7) AS e_ev, round(vdos, 7) AS vdos FROM vdos")
def _vdos(spark, d):
    return _round(_spectrum(spark, d), 7, "e_ev", "vdos")


_KT = KB * T_VIB
_E = "greatest(e_ev, 1e-12::DOUBLE)"
_X = f"least(greatest({_E} / {_KT!r}::DOUBLE, 1e-12::DOUBLE), 1e3::DOUBLE)"


@_query("vib_thermo", f"""WITH {VDOS}, v AS (SELECT run, e_ev, vdos AS g, {_E} AS e, {_X} AS x FROM vdos WHERE bin > 0),
  t AS (SELECT run, e_ev, g, ln(exp(x / 2) - exp(-x / 2)) * g AS l2, (0.5::DOUBLE * e + {_KT!r}::DOUBLE * ln(1 - exp(-x))) * g AS f, (0.5::DOUBLE * e + e / (exp(x) - 1)) * g AS u, {KB!r}::DOUBLE * (x / (exp(x) - 1) - ln(1 - exp(-x))) * g AS s FROM v),
  p AS (SELECT run, e_ev - lag(e_ev) OVER w AS de, g + lag(g) OVER w AS g, l2 + lag(l2) OVER w AS l2, f + lag(f) OVER w AS f, u + lag(u) OVER w AS u, s + lag(s) OVER w AS s FROM t WINDOW w AS (PARTITION BY run ORDER BY e_ev))
  SELECT run, round(sum(de * g) / 2, 7) AS integral_g, round(sum(de * l2) / 2, 7) AS i_ln2sinh, round(sum(de * l2) / 2 * {_KT!r}::DOUBLE, 7) AS f_via_sinh_ev, round(sum(de * f) / 2, 7) AS f_ev, round(sum(de * u) / 2, 7) AS u_ev, round(sum(de * s) / 2, 9) AS s_ev_k FROM p GROUP BY run""")
def _thermo(spark, d):
    out = vibration.vibrational_thermo(_spectrum(spark, d).filter("bin > 0"), T_VIB).drop("s_kb", "consistency")
    return _round(_round(out, 9, "s_ev_k"), 7, "integral_g", "i_ln2sinh", "f_via_sinh_ev", "f_ev", "u_ev")


# --- curves

_POLY = [0.5, -1.0, 0.25, 0.125, -0.3]


@_query("polynomial_grid", "WITH g AS (SELECT r_regionkey, unnest(range(20)) / 19.0::DOUBLE AS x FROM region) SELECT r_regionkey, round(x, 9) AS x, round((((0.5::DOUBLE * x - 1) * x + 0.25::DOUBLE) * x + 0.125::DOUBLE) * x - 0.3::DOUBLE, 9) AS y FROM g")
def _polynomial(spark, d):
    f = _t(spark, d, "region").select("r_regionkey", F.array(*map(F.lit, _POLY)).alias("coefficients"))
    return _round(fits.evaluate(f, 0.0, 1.0, 20), 9, "x", "y")


@_query("signed_curvature", "WITH g AS (SELECT r_regionkey, unnest(range(20)) / 19.0::DOUBLE AS x FROM region) SELECT r_regionkey, round(x, 9) AS x, round((6 * x * x - 6 * x + 0.5::DOUBLE) / (1 + (2 * x ** 3 - 3 * x * x + 0.5::DOUBLE * x + 0.125::DOUBLE) ** 2) ** 1.5::DOUBLE, 9) + 0.0::DOUBLE AS c FROM g")
def _curvature(spark, d):
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i / F.lit(19.0)))
    g = _t(spark, d, "region").select("r_regionkey", x.alias("x"), F.array(*map(F.lit, _POLY)).alias("p"))
    return _round(g.select("r_regionkey", "x", P.signed_curvature(F.col("p"), F.col("x")).alias("c")), 9, "x", "c")


def _fitted(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg(F.col("l_extendedprice").cast("double")).alias("y"))
    return li.select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity").cast("double") / 50).alias("x"), (F.col("y") / 1e5).alias("y"))


_CUBIC = """q AS (SELECT l_returnflag AS flag, l_quantity / 50 AS x, avg(l_extendedprice) / 1e5::DOUBLE AS y FROM lineitem GROUP BY ALL),
  q1 AS (SELECT *, x - avg(x) OVER f AS p1, avg(x) OVER f AS a1 FROM q WINDOW f AS (PARTITION BY flag)),
  q2 AS (SELECT *, sum(x * p1 * p1) OVER f / sum(p1 * p1) OVER f AS a2, sum(p1 * p1) OVER f / count(*) OVER f AS b1 FROM q1 WINDOW f AS (PARTITION BY flag)),
  q3 AS (SELECT *, (x - a2) * p1 - b1 AS p2 FROM q2),
  q4 AS (SELECT *, sum(x * p2 * p2) OVER f / sum(p2 * p2) OVER f AS a3, sum(p2 * p2) OVER f / sum(p1 * p1) OVER f AS b2 FROM q3 WINDOW f AS (PARTITION BY flag)),
  q5 AS (SELECT *, (x - a3) * p2 - b2 * p1 AS p3 FROM q4),
  q6 AS (SELECT flag, avg(y) AS c0, sum(y * p1) / sum(p1 * p1) AS c1, sum(y * p2) / sum(p2 * p2) AS c2, sum(y * p3) / sum(p3 * p3) AS c3,
         any_value(a1) AS a1, any_value(a2) AS a2, any_value(a3) AS a3, any_value(b1) AS b1, any_value(b2) AS b2 FROM q5 GROUP BY flag),
  cubic AS (SELECT flag, c3 AS k3, c2 - c3 * (a1 + a2 + a3) AS k2, c1 - c2 * (a1 + a2) + c3 * (a1 * a2 - b1 + a3 * (a1 + a2) - b2) AS k1,
         c0 - c1 * a1 + c2 * (a1 * a2 - b1) + c3 * (b2 * a1 - a3 * (a1 * a2 - b1)) AS k0 FROM q6)"""


@_query("polynomial_fit", f"WITH {_CUBIC} SELECT flag, round(k3, 6) AS k3, round(k2, 6) AS k2, round(k1, 6) AS k1, round(k0, 6) AS k0 FROM cubic")
def _fit(spark, d):
    fit = fits.polynomial_fit(_fitted(spark, d), ["flag"], "x", "y", 3)
    return _round(fit.select("flag", *[F.get("coefficients", F.lit(i)).alias(f"k{3 - i}") for i in range(4)]), 6, "k3", "k2", "k1", "k0")


@_query("inflection", f"WITH {_CUBIC} SELECT flag, round(-k2 / (3 * k3), 5) AS x_inflection FROM cubic")
def _inflection(spark, d):
    return _round(fits.inflection(fits.polynomial_fit(_fitted(spark, d), ["flag"], "x", "y", 3), ["flag"]), 5, "x_inflection")


@_query("regions", f"""WITH {_CUBIC}, g AS (SELECT *, unnest(range(50)) / 49.0::DOUBLE AS x, -k2 / (3 * k3) AS xi FROM cubic)
  SELECT flag, round(x, 6) AS x, round(((k3 * x + k2) * x + k1) * x + k0, 6) AS y, CASE WHEN x <= xi THEN 'convex' ELSE 'concave' END AS region FROM g""")
def _regions(spark, d):
    f = fits.polynomial_fit(_fitted(spark, d), ["flag"], "x", "y", 3)
    return _round(fits.regions(fits.evaluate(f, 0.0, 1.0, 50), fits.inflection(f, ["flag"]), ["flag"]).select("flag", "x", "y", "region"), 6, "x", "y")


@_query("endpoints", """WITH t AS (SELECT p_brand AS brand, p_size AS x0, p_retailprice AS raw, p_partkey AS i FROM part),
  u AS (SELECT brand, (x0 - 1) / 49.0::DOUBLE AS x, raw / 10 - raw * raw / 1e6::DOUBLE AS d FROM t),
  s AS (SELECT brand, sum((1 - x) * (1 - x)) AS aa, sum((1 - x) * x) AS ab, sum(x * x) AS bb, sum((1 - x) * d) AS ad, sum(x * d) AS bd FROM u GROUP BY 1)
  SELECT brand, round((bb * ad - ab * bd) / (aa * bb - ab * ab), 6) AS e_a, round((aa * bd - ab * ad) / (aa * bb - ab * ab), 6) AS e_b FROM s WHERE aa * bb - ab * ab > 1e-6::DOUBLE""")
def _endpoints(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("brand"), ((F.col("p_size") - 1) / 49.0).alias("x"), F.col("p_retailprice").alias("raw"), F.lit(10).alias("n"))
    table = p.withColumn("norm", F.col("raw") * F.col("raw") / 1e6)
    wide = table.groupBy("brand").agg(F.sum((1 - F.col("x")) ** 2).alias("aa"), F.sum((1 - F.col("x")) * F.col("x")).alias("ab"), F.sum(F.col("x") ** 2).alias("bb")).filter("aa * bb - ab * ab > 1e-6")
    return _round(fits.endpoints(table, ["brand"], "raw", "n", "x", "norm").join(wide.select("brand"), "brand", "left_semi"), 6, "e_a", "e_b")


# --- sources and sinks: tables written in each format and read back


def _bundle(spark: SparkSession, texts: DataFrame) -> str:
    """A bundle with the text of each ``run``, for runs that grow with the tables."""
    folder = shared_folder(spark)
    bundles.write_bundle(texts.select(F.concat(F.lit(f"{folder}/run="), F.coalesce(F.col("run").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/run.txt")).alias("path"), "value"), folder)
    return folder


def _files(spark: SparkSession, texts: DataFrame) -> str:
    """One text file a ``run``, each in a folder of its own: for few runs (nations, labels)."""
    folder = shared_folder(spark)
    texts.select("run", "value").repartition("run").write.partitionBy("run").text(folder)
    return folder


def _run():
    return F.regexp_extract("run", "run=([^/]+)$", 1).cast("bigint")


@_query("csv_round_trip", "SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal, s_name FROM supplier")
def _csv(spark, d):
    folder = shared_folder(spark)
    sinks.write_csv(_t(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_name"), folder, {"s_acctbal": "%.2f"})
    return sources.read_csv(spark, folder, "s_suppkey bigint, s_acctbal double, s_name string")


@_query("log_read", f"""WITH {_EV} SELECT user_id, o::BIGINT AS row_idx, event_id::DOUBLE AS step, value AS pe, 2 * value AS ke, -value AS press, round((-value * event_id * {BAR_A3_TO_EV!r}::DOUBLE), 9) + 0.0::DOUBLE AS pv FROM ev""")
def _log(spark, d):
    e = series.ordinal(series_of(spark, d), _BY, _ORDER, "o")
    row = F.concat_ws(" ", "event_id", "value", 2 * F.col("value"), F.regexp_replace((-F.col("value")).cast("string"), "E", "D"), "event_id")
    lines = e.select("user_id", F.struct("o", row.alias("line")).alias("l")).groupBy(F.col("user_id").alias("run")).agg(F.sort_array(F.collect_list("l")).alias("l"))
    text = F.concat(F.lit("some banner\nStep PotEng KinEng Press Volume\n"), F.array_join("l.line", "\n"), F.lit("\nLoop time of 1\n1 2 3 4 5"))
    got = log.with_energies(log.read_log(spark, _bundle(spark, lines.select("run", text.alias("value"))), bundled=True))
    return _round(got.select(_run().alias("user_id"), "row_idx", "step", "pe", "ke", "press", "pv"), 9, "pv")


@_query("dump_read", """WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal, (c_custkey % 4) AS f FROM customer)
  SELECT c_nationkey, (dense_rank() OVER (PARTITION BY c_nationkey ORDER BY f) - 1)::INT AS frame_idx, f * 10 AS timestep, c_custkey AS atom_id, c_acctbal AS xu, 100 * (c_acctbal / 1000) AS yu, c_acctbal - 2 * 100 AS zu, 1e6::DOUBLE AS volume FROM c""")
def _dump(spark, d):
    c = _t(spark, d, "customer").withColumn("f", F.col("c_custkey") % 4)
    row = F.concat_ws(" ", "c_custkey", F.lit(1), "c_acctbal", F.col("c_acctbal") / 1000, "c_acctbal", F.lit(0), F.lit(0), F.lit(-2))
    frames = c.groupBy("c_nationkey", "f").agg(F.count("*").alias("n"), F.array_join(F.collect_list(row), "\n").alias("rows"))
    head = F.concat(F.lit("ITEM: TIMESTEP\n"), F.col("f") * 10, F.lit("\nITEM: NUMBER OF ATOMS\n"), "n", F.lit("\nITEM: BOX BOUNDS pp pp pp\n0 100\n0 1D2\n0.0 100.0\nITEM: ATOMS id type xu ysu z ix iy iz\n"), "rows")
    texts = frames.groupBy(F.col("c_nationkey").alias("run")).agg(F.array_join(F.collect_list(head), "\n").alias("value"))
    got = dump.read_atoms(spark, f"{_files(spark, texts)}/*/*.txt")
    return got.select(_run().cast("int").alias("c_nationkey"), "frame_idx", "timestep", "atom_id", "xu", "yu", "zu", "volume")


@_query("deck_read", "SELECT s_suppkey, s_nationkey / 1000.0::DOUBLE AS timestep, 5 AS dump_every, s_suppkey::DOUBLE AS temperature, 2.5::DOUBLE * s_nationkey AS mass, 'B' AS label FROM supplier")
def _deck(spark, d):
    s = _t(spark, d, "supplier")
    text = F.concat(F.lit("units metal\nvariable t equal "), "s_suppkey", F.lit("\nvariable n equal "), "s_nationkey", F.lit("\ntimestep ${n}/1000\nmass 1 2.5*v_n\npair_coeff * * model B\ndump 1 all custom 5 a.dump id type x y z\nfix 1 all nvt temp ${t} &\n $t 0.1\n"))
    got = deck.read_decks(spark, _bundle(spark, s.select(F.col("s_suppkey").alias("run"), text.alias("value"))), bundled=True)
    return got.select(_run().alias("s_suppkey"), "timestep", "dump_every", "temperature", F.element_at("masses", F.lit(1)).alias("mass"), F.element_at("labels", F.lit(1)).alias("label"))


@_query("xyz_read", """SELECT label AS run, vec_id, 2 AS n_atoms, embedding[1]::DOUBLE AS energy, embedding[2]::DOUBLE AS x, 'B' AS second FROM embeddings""")
def _xyz(spark, d):
    e = _t(spark, d, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(3)])
    one = F.concat(F.lit('2\nLattice="1 0 0 0 1 0 0 0 1" Properties=species:S:1:pos:R:3 config_type='), "vec_id", F.lit(" energy="), "e0", F.lit("\nFe "), F.concat_ws(" ", "e1", "e2", F.lit(0)), F.lit("\nB 0 0 0.5"))
    texts = e.groupBy(F.col("label").alias("run")).agg(F.array_join(F.collect_list(one), "\n").alias("value"))
    got = sources.read_xyz(spark, f"{_files(spark, texts)}/*/*.txt").filter("error is null")
    return got.select(F.regexp_extract("file", "run=([^/]+)/", 1).cast("int").alias("run"), F.col("config_type").cast("bigint").alias("vec_id"), "n_atoms", "energy", F.get(F.get("position", F.lit(0)), F.lit(0)).alias("x"), F.get("species", F.lit(1)).alias("second"))
