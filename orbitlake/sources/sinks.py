"""Outputs: text tables in fixed formats, reports and wide matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import finite, number_or_na


def formatted(df: DataFrame, formats: dict[str, str], missing: str = "N/A") -> DataFrame:
    """Columns as text in the formats given (``%.6f`` …); what isn't finite becomes ``missing``."""
    return df.select(*[F.when(finite(F.col(c)), F.format_string(f, c)).otherwise(F.lit(missing)).alias(c) for c, f in formats.items()])


def write_tsv(df: DataFrame, path: str, order: list[str], formats: dict[str, str]) -> None:
    """Tab-separated summary in one ordered file: a summary has one row a run."""
    text = df.orderBy(*order).select(*[number_or_na(F.col(c), formats[c]).alias(c) if c in formats else F.col(c).cast("string").alias(c) for c in df.columns])
    text.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str, formats: dict[str, str], by: list[str] | None = None) -> None:
    """Comma-separated export, empty where a number isn't finite, a folder for each value of ``by``."""
    text = df.withColumns({c: F.when(finite(F.col(c)), F.format_string(f, c)) for c, f in formats.items()})
    writer = text.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).csv(path, header=True, nullValue="")


def wide(df: DataFrame, row: list[str], column: str, value: str, columns: list | None = None) -> DataFrame:
    """Long to wide: one column a value of ``column`` (name them to spare a pass)."""
    return df.groupBy(*row).pivot(column, columns).agg(F.first(value))


def bond_matrix(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Dense 0/1 matrix of one frame's bonds, for output only."""
    ids = [r["atom_id"] for r in atoms.select("atom_id").distinct().orderBy("atom_id").collect()]
    both = edges.select("frame", "i", "j").unionByName(edges.select("frame", F.col("j").alias("i"), F.col("i").alias("j"))).withColumn("b", F.lit(1))
    base = atoms.select("frame", F.col("atom_id").alias("i")).join(both, ["frame", "i"], "left")
    return base.groupBy("frame", "i").pivot("j", ids).agg(F.max("b")).fillna(0)


def report(df: DataFrame, formats: dict[str, str]) -> str:
    """``name: value`` lines of a one-row result."""
    row = formatted(df, formats).first()
    return "\n".join(f"{c}: {row[c]}" for c in formats) + "\n"


def write_cache(df: DataFrame, folder: str, **parameters) -> str:
    """Parquet under a path that names every parameter, so no result is taken for another's."""
    path = "/".join([folder, *[f"{k}={v}" for k, v in sorted(parameters.items())]])
    df.write.mode("overwrite").parquet(path)
    return path


def write_columns(df: DataFrame, path: str, columns: list[str], fmt: str = "%.18e") -> None:
    """Space-separated numbers under a header line, in the order of the first column, as one file: a curve is small."""
    text = df.orderBy(columns[0]).select(F.concat_ws(" ", *[F.format_string(fmt, F.col(c).cast("double")) for c in columns]).alias(" ".join(columns)))
    text.coalesce(1).write.mode("overwrite").option("quote", "").csv(path, header=True)


def write_nonempty(df: DataFrame, path: str, formats: dict[str, str]) -> bool:
    """``write_csv`` unless there is no row; whether it was written."""
    if not df.limit(1).count():
        return False
    write_csv(df, path, formats)
    return True


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def correlation_columns(labels: list[str]) -> list[str]:
    return ["time_ps", *[f"C_{a}_{b}_A2" for a in labels for b in labels], *[f"Cself_{a}_A2" for a in labels]]


def correlation_table(full: DataFrame, own: DataFrame, labels: list[str], dt_ps: float) -> DataFrame:
    """One run's ``correlations`` (a ≤ b) and ``self_correlations``, a row a lag: ``time_ps``, every ordered pair, every species."""
    a, b = sorted(("species_a", "species_b"))
    name = lambda x, y: F.concat(F.lit("C_"), F.col(x), F.lit("_"), F.col(y), F.lit("_A2"))
    cells = full.select("lag", name(a, b).alias("k"), "c").unionByName(full.filter(F.col(a) != F.col(b)).select("lag", name(b, a).alias("k"), "c"))
    cells = cells.unionByName(own.select("lag", F.concat(F.lit("Cself_"), F.col("species"), F.lit("_A2")).alias("k"), "c"))
    names = correlation_columns(labels)
    return cells.groupBy("lag").pivot("k", names[1:]).agg(F.first("c")).select((F.col("lag") * dt_ps).alias("time_ps"), *names[1:])


def onsager_report(rows: DataFrame, labels: list[str], window: tuple[float, float]) -> str:
    """The text report of one run of ``onsager_by_run``: both matrices, then a line a species; N/A where a value is missing."""
    cells = {(r["species_a"], r["species_b"]): r for r in rows.collect()}  # a few pairs of species
    cell = lambda a, b: cells.get((a, b)) or cells.get((b, a))
    show = lambda v, fmt: "N/A" if v is None else format(v, fmt)
    matrix = lambda c, fmt: [" ".join(show(cell(a, b)[c], fmt) for b in labels) for a in labels]
    own = [(a, cells[a, a]) for a in labels]
    lines = [
        "# L_ij in 1/(eV cm s), centre-of-mass frame", f"# fit window {window[0]:.6g} to {window[1]:.6g} ps", "# labels: " + " ".join(labels),
        "L_full", *matrix("l", ".8e"), "R2_full", *matrix("r2", ".6f"), "# type L_self D_self_cm2_s R2_self correlation_factor",
        *[f"{a} {show(r['l_self'], '.8e')} {show(r['d_self'], '.8e')} {show(r['r2_self'], '.6f')} {show(r['factor'], '.8e')}" for a, r in own],
    ]
    return "\n".join(lines) + "\n"
