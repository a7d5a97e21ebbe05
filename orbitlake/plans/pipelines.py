"""End-to-end plans: run folders to thermodynamic and transport summaries, states to structure factors.

All runs of a root are one lazy plan; only decks (a few lines each) are looked at first.
A run folder is ``<temperature>_dir`` with a thermo log, a deck and a dump.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BOND_CUTOFF, FRAME_SPACING_PS, N_FRAMES
from ..functions.physics import density, free_energy, timestep_fs
from ..operators import fits, modes, pairs, series, transport, vibration
from ..operators import kirkwood_buff as kb
from ..sources import deck, dump, log
from ..sources.tables import run_temperature


@dataclass(frozen=True)
class Options:
    skip: int = 100
    block: int = 1000
    stride: int = 1
    skip_frames: int = 0
    max_frames: int | None = None
    log_name: str = "log.lammps"
    deck_name: str = "in.lammps"
    dump_name: str = "*.dump"
    rdf_width: float = 0.02
    corr_stride: int = 1
    origin_stride: int = 1
    max_lag_fraction: float = 0.5


def _decks(spark: SparkSession, root: str, o: Options) -> DataFrame:
    d = deck.read_decks(spark, f"{root}/*_dir/{o.deck_name}")
    named = run_temperature(F.col("run"))
    return d.withColumn("temperature", F.coalesce("temperature", named)).withColumn("dt_fs", timestep_fs(F.coalesce("timestep", F.lit(0.001)), F.col("units")))


def _atoms(spark: SparkSession, root: str, decks: DataFrame, o: Options, velocities: bool) -> DataFrame:
    """Atoms with mass and label; frames numbered after skip and stride, so a stride counts once. No masses: all 1."""
    path = f"{root}/*_dir/{o.dump_name}"
    a = dump.read_atoms(spark, path, o.stride, o.max_frames, velocities).join(F.broadcast(_dumps(spark, path, decks)), ["run", "file"])
    a = a.withColumn("frame_idx", (F.col("frame_idx") / o.stride).cast("int")).filter(F.col("frame_idx") >= o.skip_frames)
    a = a.withColumn("frame_idx", F.col("frame_idx") - o.skip_frames).join(decks.select("run", "masses", "labels"), "run")
    mass = F.when(F.size("masses") == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_element_at("masses", F.col("type")), F.raise_error(F.lit("an atom type without a mass")).cast("double")))
    label = F.coalesce(F.try_element_at("labels", F.col("type")), F.concat(F.lit("type"), F.col("type")))
    return a.withColumn("mass", mass).withColumn("species", label).drop("masses", "labels")


def _dumps(spark: SparkSession, path: str, decks: DataFrame) -> DataFrame:
    """``(run, file)``: a run's only dump, or of several the one that its deck names; none of them named is an error."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))  # no content is read
    files = listed.select(dump.run_of(F.col("path")).alias("run"), F.regexp_extract("path", dump.NAME, 1).alias("file"))
    named = files.join(decks.select("run", F.regexp_extract("dump_file", r"([^/]*)$", 1).alias("named")), "run", "left")
    per = named.groupBy("run").agg(F.collect_list("file").alias("files"), F.first("named").alias("named"))
    one = F.when(F.size("files") == 1, F.get("files", F.lit(0))).when(F.array_contains("files", F.coalesce("named", F.lit(""))), F.col("named"))
    return per.select("run", F.coalesce(one, F.raise_error(F.concat(F.lit("several dumps and none named by the deck in "), F.col("run"))).cast("string")).alias("file"))


def _spacing(frames: DataFrame, decks: DataFrame, stride: int = 1) -> DataFrame:
    """``(run, dt_ps)``: time between the frames kept: the deck's dump interval, else from their own time steps."""
    steps = frames.select("run", "frame_idx", "timestep").distinct()
    known = series.frame_spacing(steps, ["run"], "timestep").join(decks.select("run", "dt_fs", "dump_every"), "run", "right")
    return known.select("run", (F.coalesce(F.col("dump_every") * stride, "spacing") * F.col("dt_fs") / 1000).alias("dt_ps"))


def thermo_summary(spark: SparkSession, root: str, o: Options = Options(), vibrations: bool = False, dt_s: float | None = None) -> DataFrame:
    """One row a run, by temperature: potential energy, P·V and enthalpy with block errors, and with ``vibrations`` the
    vibrational entropy, T·S and F = H - T·S, whose error is that of H. The seconds between frames are ``dt_s`` if
    given, else those of each run's deck (dump interval, or the frames' own, times the time step)."""
    d = _decks(spark, root, o)
    rows = log.with_energies(log.read_log(spark, f"{root}/*_dir/{o.log_name}"))
    out = d.select("run", "temperature")
    for c in ("pe", "pv", "enthalpy"):
        b = series.block_average(rows, ["run"], ["row_idx"], c, o.skip, o.block)
        out = out.join(b.select("run", F.col("mean").alias(c), F.col("err").alias(f"{c}_err"), F.col("n").alias(f"{c}_n"), F.col("n_blocks").alias(f"{c}_blocks")), "run", "left")
    if vibrations or dt_s is not None:
        a = _atoms(spark, root, d, o, True)
        moving = transport.centered(a, ("vx", "vy", "vz"))
        number = a.groupBy("run").agg(F.count_distinct("atom_id").alias("n"))
        runs = {r["run"]: dt_s or r["dt_ps"] * 1e-12 for r in _spacing(a, d, o.stride).filter("dt_ps is not null").collect()}  # a row a run
        steps: dict[float, list[str]] = {}
        for name, dt in runs.items():
            steps.setdefault(dt, []).append(name)
        spectra = _union([vibration.spectrum(moving.filter(F.col("run").isin(names)), dt) for dt, names in steps.items()])
        g = vibration.total_spectrum(spectra, number).join(d.select("run", "temperature"), "run")
        s = vibration.entropy_by_run(g)
        out = out.join(s, "run", "left").withColumn("ts", F.col("temperature") * F.col("s_ev_k"))
        out = out.withColumn("free", free_energy(F.col("enthalpy"), F.col("temperature"), F.col("s_ev_k"))).withColumn("free_err", F.col("enthalpy_err"))
    return out.orderBy("temperature", "run")


def density_stats(spark: SparkSession, root: str, masses: DataFrame, o: Options = Options()) -> DataFrame:
    """``(run, mean, err, n, n_blocks)`` of the density over the log's positive volumes, after the skip; ``masses(run, mass)``."""
    v = log.read_log(spark, f"{root}/*_dir/{o.log_name}").filter("vol > 0").join(masses, "run")
    return series.block_average(v.withColumn("rho", density(F.col("mass"), F.col("vol"))), ["run"], ["row_idx"], "rho", o.skip, o.block)


def transport_summary(spark: SparkSession, root: str, o: Options = Options()) -> DataFrame:
    """Onsager coefficients of every pair of species in every run, with the density (of the log's volumes) and its block error."""
    d = _decks(spark, root, o)
    a = _atoms(spark, root, d, o, False)
    frames = a.groupBy("run", "frame_idx").agg(F.first("volume").alias("volume"), F.sum("mass").alias("mass"))
    runs = frames.groupBy("run").agg(F.avg("volume").alias("volume"), F.min_by("mass", "frame_idx").alias("mass")).join(_spacing(a, d, o.stride), "run").join(d.select("run", "temperature"), "run")
    rho = density_stats(spark, root, runs.select("run", "mass"), o)
    l = transport.onsager_by_run(a, runs.drop("mass"), o.max_lag_fraction, o.corr_stride, o.origin_stride)
    out = l.join(rho.select("run", F.col("mean").alias("density"), F.col("err").alias("density_err")), "run", "left").join(runs.drop("mass"), "run")
    return out.orderBy("temperature", "run", "species_a", "species_b")


def bond_samples(spark: SparkSession, root: str, label: str = "B", o: Options = Options(), cutoff: float = BOND_CUTOFF, count: int = N_FRAMES, spacing_ps: float = FRAME_SPACING_PS) -> DataFrame:
    """Coordination of one species in ``count`` frames from the end of each run, ``spacing_ps`` apart: ``(run, frame_idx, bonds, mean_cn, min_cn, max_cn, n)``."""
    d = _decks(spark, root, o)
    a = _atoms(spark, root, d, o, False)
    times = a.select("run", "frame_idx").distinct().join(_spacing(a, d, o.stride), "run").withColumn("time", F.col("frame_idx") * F.col("dt_ps"))
    chosen = series.nearest_frames(times, ["run"], "frame_idx", "time", count, spacing_ps).select("run", F.col("frame").alias("frame_idx"))
    some = a.filter(F.upper("species") == label.upper()).join(chosen, ["run", "frame_idx"]).withColumn("frame", F.struct("run", "frame_idx"))
    cn = pairs.coordination(some, pairs.bonds(some, cutoff))
    return pairs.frame_summary(cn).select("frame.*", "bonds", "mean_cn", "min_cn", "max_cn", "n").orderBy("run", "frame_idx")


def _state_atoms(spark: SparkSession, state, lo: float, stride: int, most: int | None) -> DataFrame:
    names = {int(t): s for t, s in state["type_to_species"].items()}
    a = dump.read_atoms(spark, state["dump"], stride)
    if lo > 0:
        frames = series.last_fraction(a.select("run", "frame_idx").distinct(), ["run"], ["frame_idx"], lo, 1.0, 1, most)
        a = a.join(frames.select("run", "frame_idx"), ["run", "frame_idx"], "left_semi")
    elif most is not None:
        a = a.filter(F.col("frame_idx") < stride * most)
    species = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return a.withColumn("species", F.try_element_at(species, F.col("type"))).filter("species is not null").withColumn("frame", F.col("frame_idx")).drop("x", "y", "z").withColumnsRenamed({"xu": "x", "yu": "y", "zu": "z"})


def reciprocal_grid(spark: SparkSession, states: Iterable, shells: int = 4, stride: int = 6, max_frames: int | None = 2500, last_fraction: float = 1.0) -> DataFrame:
    """S_cc(k) of every state and the fitted S_cc(0): ``(comp, t_k, p_gpa, x_b, k, s_ff, s_fb, s_bb, scc, w, a, b)``."""
    parts = []
    for s in states:
        rho = s["rho_Fe"] + s["rho_B"]
        a = _state_atoms(spark, s, 1.0 - last_fraction, stride, max_frames)
        k = modes.reciprocal_structure(a, "Fe", "B", tuple(s["L_mean"]), s["rho_Fe"] / rho, rho, shells)
        parts.append(_labelled(k, s))
    return _with_fit(_union(parts))


def integral_grid(spark: SparkSession, states: Iterable, width: float = 0.02, stride: int = 10, points: int = 150, k_max: float = 3.0, last_fraction: float = 1.0) -> DataFrame:
    """The same from Kirkwood–Buff integrals of g(r), weights 1."""
    parts = []
    for s in states:
        cut = min(s["L_mean"]) / 2
        rho = spark.createDataFrame([("Fe", float(s["rho_Fe"])), ("B", float(s["rho_B"]))], "species string, rho double")
        g = pairs.rdf_thin(_state_atoms(spark, s, 1.0 - last_fraction, stride, None), width, cut, rho)
        name = F.when(F.col("species_a") != F.col("species_b"), "FeB").otherwise(F.concat("species_a", "species_b"))
        grid = spark.range(points).select((F.col("id") * (k_max / (points - 1))).alias("k"))
        r_cut = min(cut, (pairs.n_bins(cut, width) - 0.5) * width)
        plateau = kb.sinc_plateau(g.select(name.alias("pair"), "r", "g"), grid, width, r_cut)
        parts.append(_labelled(kb.scc_from_integrals(plateau, s["rho_Fe"], s["rho_B"]).withColumn("w", F.lit(1.0)), s))
    return _with_fit(_union(parts))


def _labelled(df: DataFrame, s) -> DataFrame:
    x_b = s["rho_B"] / (s["rho_Fe"] + s["rho_B"])
    return df.select(F.lit(s["comp"]).alias("comp"), F.lit(float(s["T_K"])).alias("t_k"), F.lit(float(s["P_GPa"])).alias("p_gpa"), F.lit(float(x_b)).alias("x_b"), "k", "s_ff", "s_fb", "s_bb", "scc", "w")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_fit(curves: DataFrame) -> DataFrame:
    key = ["comp", "t_k", "p_gpa", "x_b"]
    return curves.join(fits.oz_fit(curves, key, w="w"), key, "left")
