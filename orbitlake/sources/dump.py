"""Particle dumps: text split at frame headers, so one row is one frame and files are read in parallel splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.physics import to_cartesian, unwrap, wrap

SEPARATOR = "ITEM: TIMESTEP\n"


FOLDER, NAME = r"^(?:file:/*(?=/))?(.*)/[^/]+$", r"([^/]+)$"


def run_of(file: Column) -> Column:
    """The run that a file belongs to: its folder's full path."""
    return F.regexp_extract(file, FOLDER, 1)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, lineSep=SEPARATOR).select(F.col("_metadata.file_path").alias("path"), F.col("value"), F.monotonically_increasing_id().alias("at"))
    return text.filter(F.trim("value") != "")


def frame_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, at, frame_idx)``: frames of each file numbered by timestep, then by place; no text is sorted."""
    narrow = _texts(spark, path).select("path", "at", F.trim(F.substring_index("value", "\n", 1)).cast("bigint").alias("timestep"))
    return narrow.select("path", "at", (F.row_number().over(Window.partitionBy("path").orderBy("timestep", "at")) - 1).alias("frame_idx"))


def read_frames(spark: SparkSession, path: str, stride: int = 1, max_frames: int | None = None) -> DataFrame:
    """``(run, file, frame_idx, timestep, n_atoms, lo, hi, lengths, tilt, volume, columns, rows)``.

    ``run`` is the full path of the file's folder and ``file`` the file's name; frames are numbered by file. The frames
    wanted are chosen by number before any text is split. A frame without a box, the atom header, ids or types, or
    with fewer rows than atoms, is an error.
    """
    wanted = frame_numbers(spark, path).filter(F.col("frame_idx") % stride == 0)
    if max_frames is not None:
        wanted = wanted.filter(F.col("frame_idx") < stride * max_frames)
    lines = _texts(spark, path).join(wanted, ["path", "at"]).withColumn("l", F.split("value", r"\r?\n"))
    header = F.get("l", 7)
    number = lambda s: F.translate(s, "Dd", "EE").try_cast("double")
    bounds = lambda k: F.array(*[number(F.get(F.split(F.trim(F.get("l", i)), r"\s+"), k)) for i in (4, 5, 6)])
    columns = F.split(F.trim(F.regexp_replace(header, "^ITEM: ATOMS", "")), r"\s+")
    where = F.concat(F.lit(" in "), F.col("path"), F.lit(" at timestep "), F.trim(F.get("l", 0)))
    blank = F.trim(F.get("l", 0)) == ""  # the optimiser may look at what precedes the first header before it is left out
    fail = lambda ok, message, value: F.when(ok | blank, value).otherwise(F.raise_error(F.concat(F.lit(message), where)))
    frames = lines.select(
        run_of(F.col("path")).alias("run"),
        F.regexp_extract("path", NAME, 1).alias("file"),
        "frame_idx",
        "path",
        F.trim(F.get("l", 0)).cast("bigint").alias("timestep"),
        F.trim(F.get("l", 2)).cast("int").alias("n_atoms"),
        fail(F.startswith(F.get("l", 3), F.lit("ITEM: BOX BOUNDS")), "a frame without box bounds", bounds(0)).alias("lo"),
        bounds(1).alias("hi"),
        F.transform(bounds(2), lambda t: F.coalesce(t, F.lit(0.0))).alias("tilt"),
        fail(F.startswith(header, F.lit("ITEM: ATOMS")) & F.array_contains(columns, "id") & F.array_contains(columns, "type"), "a frame without the atom header, ids or types", columns).alias("columns"),
        "l",
    )
    rows = F.filter(F.slice("l", F.lit(9), F.col("n_atoms")), lambda r: F.size(F.split(F.trim(r), r"\s+")) >= F.size("columns"))
    frames = frames.withColumn("lengths", F.zip_with("hi", "lo", lambda h, o: h - o))
    frames = frames.withColumn("volume", F.aggregate("lengths", F.lit(1.0), lambda a, x: a * x)).withColumn("rows", rows)
    complete = F.when((F.size("rows") == F.col("n_atoms")) | blank, F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("a frame with missing rows"), where)).cast("array<string>"))
    return frames.withColumn("rows", complete).drop("path", "l")


def count_frames(spark: SparkSession, path: str) -> int:
    return spark.read.text(path, lineSep=SEPARATOR).filter(F.trim("value") != "").count()


def _unwrapped(field, axis: int, name: str) -> Column:
    """One coordinate by precedence: xu, xsu, x+ix, xs+ix, then the wrapped x and xs as they are."""
    lo, length = F.get("lo", axis), F.get("lengths", axis)
    x, s, i = field(name), field(f"{name}s"), field(f"i{name}")
    return F.coalesce(
        field(f"{name}u"),
        to_cartesian(field(f"{name}su"), lo, length),
        unwrap(x, i, length),
        to_cartesian(s + i, lo, length),
        x,
        to_cartesian(s, lo, length),
        F.raise_error(F.lit("no coordinates in the dump")).cast("double"),
    )


def read_atoms(spark: SparkSession, path: str, stride: int = 1, max_frames: int | None = None, velocities: bool = False, single: bool = False) -> DataFrame:
    """``(run, file, frame_idx, timestep, atom_id, type, xu, yu, zu, x, y, z, lx, ly, lz, volume[, vx, vy, vz])``.

    ``velocities`` need ``vx`` or ``v_x``; ``single`` rounds positions to 32 bits.
    """
    frames = read_frames(spark, path, stride, max_frames)
    # an inner explode would let its inferred filter, with the errors in it, run ahead of the choice of frames
    each = frames.select("run", "file", "frame_idx", "timestep", "lo", "lengths", "volume", "columns", F.explode_outer("rows").alias("row")).filter("row is not null")
    each = each.withColumn("m", F.map_from_arrays("columns", F.slice(F.split(F.trim("row"), r"\s+"), F.lit(1), F.size("columns"))))
    field = lambda name: F.translate(F.try_element_at("m", F.lit(name)), "Dd", "EE").cast("double")
    out = each.select(
        "run", "file", "frame_idx", "timestep",
        F.element_at("m", "id").cast("bigint").alias("atom_id"),
        F.element_at("m", "type").cast("int").alias("type"),
        *[_unwrapped(field, a, n).alias(f"{n}u") for a, n in enumerate("xyz")],
        *[F.get("lengths", a).alias(f"l{n}") for a, n in enumerate("xyz")],
        *[F.get("lo", a).alias(f"_lo{n}") for a, n in enumerate("xyz")],
        "volume",
        *([F.coalesce(field(f"v{n}"), field(f"v_{n}"), F.raise_error(F.lit("no velocities in the dump")).cast("double")).alias(f"v{n}") for n in "xyz"] if velocities else []),
    )
    if single:
        out = out.withColumns({f"{n}u": F.col(f"{n}u").cast("float").cast("double") for n in "xyz"})
    return out.withColumns({n: wrap(F.col(f"{n}u"), F.col(f"_lo{n}"), F.col(f"l{n}")) for n in "xyz"}).drop("_lox", "_loy", "_loz")
