"""Small tables, state lists, run folders and structures."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SCHEMA = "comp string, T_K double, P_GPa double, rho_Fe double, rho_B double, L_mean array<double>, type_to_species map<string,string>, dump string, v2_ratio_B_over_Fe double, expected_v2_ratio double, detection_method string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header under an explicit schema; NaN and empty texts are null."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, nullValue="", nanValue="NaN", mode="FAILFAST")
    return df.withColumns({f.name: F.nullif(F.col(f.name), F.lit(float("nan"))) for f in df.schema.fields if f.dataType.typeName() == "double"})


def read_first_two(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns of a CSV as text ``(a, b)``, whatever their names; fewer columns are an error."""
    df = spark.read.csv(path, header=True)
    if len(df.columns) < 2:
        raise ValueError("two columns are needed")
    return df.select(F.col(f"`{df.columns[0]}`").alias("a"), F.col(f"`{df.columns[1]}`").alias("b"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of thermodynamic states."""
    return spark.read.json(path, schema=STATE_SCHEMA, multiLine=True)


def binary_states(states: DataFrame, temperature: float, pressure: float) -> DataFrame:
    """States that hold both species at (T, P), compared as integers of a thousandth; in order of x_B."""
    milli = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
    rows = states.filter((F.col("rho_Fe") > 0) & (F.col("rho_B") > 0) & (milli("T_K") == round(temperature * 1000)) & (milli("P_GPa") == round(pressure * 1000)))
    return rows.withColumn("x_B", F.col("rho_B") / (F.col("rho_Fe") + F.col("rho_B"))).orderBy("x_B")


def run_temperature(path: Column) -> Column:
    """The temperature in a folder name like ``1500_dir``; null elsewhere."""
    return F.regexp_extract(path, r"(?:^|/)([0-9]+(?:\.[0-9]+)?)_dir(?:/|$)", 1).try_cast("double")


def run_folders(root: str) -> list[tuple[float, str]]:
    """``(temperature, path)`` of the run folders below ``root``, by temperature."""
    named = [(d.name.removesuffix("_dir"), d) for d in os.scandir(root) if d.is_dir() and d.name.endswith("_dir")]
    return sorted((float(t), d.path) for t, d in named if t.replace(".", "", 1).isdecimal() and t[0] != "." and t[-1] != ".")


def target_folders(root: str) -> list[str]:
    """The ``*_dir`` folders below ``root``, else ``root`` itself."""
    return sorted(d.path for d in os.scandir(root) if d.is_dir() and d.name.endswith("_dir")) or [root]


def find_upwards(folder: str, name: str, levels: int = 3) -> str | None:
    """The file in the folder or in one of its nearest ancestors."""
    for _ in range(levels + 1):
        if os.path.exists(path := os.path.join(folder, name)):
            return path
        folder = os.path.dirname(os.path.abspath(folder))
    return None


def read_config(path: str, **overrides) -> dict:
    """A flat ``key: value`` file of numbers, lists and words; ``overrides`` that aren't None win."""
    out: dict = {}
    with open(path) as f:
        for line in f:
            key, colon, value = line.partition("#")[0].partition(":")
            if colon and key.strip():
                items = [x.strip() for x in value.strip().strip("[]").split(",")]
                parsed = [_scalar(x) for x in items]
                out[key.strip()] = parsed if value.strip().startswith("[") else parsed[0]
    return out | {k: v for k, v in overrides.items() if v is not None}


def _scalar(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text.strip("'\""))


_INFO = re.compile(r'([A-Za-z_]\w*)=(?:"([^"]*)"|(\S+))')
_XYZ = "file string, struct_id int, n_atoms int, lattice array<double>, energy double, stress array<double>, config_type string, pbc array<boolean>, species array<string>, position array<array<double>>, force array<array<double>>, error string"


def _structure(lines: list[str], at: int) -> tuple:
    n = int(lines[at])
    info = {k: a or b for k, a, b in _INFO.findall(lines[at + 1])}
    kinds = info.get("Properties", "species:S:1:pos:R:3").split(":")
    spot, place = {}, 0
    for name, _, width in zip(kinds[::3], kinds[1::3], kinds[2::3], strict=True):
        spot[name] = slice(place, place + int(width))
        place += int(width)
    rows = [line.split() for line in lines[at + 2 : at + 2 + n]]
    if len(rows) < n or any(len(r) < place for r in rows):
        raise ValueError("missing atoms or columns")
    numbers = lambda key: [float(x) for x in info[key].split()] if key in info else None
    vector = lambda key: [[float(x) for x in r[spot[key]]] for r in rows] if key in spot else None
    return (
        n, numbers("Lattice"), float(info["energy"]) if "energy" in info else None, numbers("stress"), info.get("config_type"),
        [x == "T" for x in info["pbc"].split()] if "pbc" in info else None,
        [r[spot["species"]][0] for r in rows], vector("pos"), vector("forces"),
    )


def parse_xyz(text: str) -> Iterator[tuple]:
    """Structures of an extended XYZ text, ``error`` last. A malformed one gives a row of nulls with its error and line;
    reading goes on at the next line that holds just a number and is followed by properties."""
    lines = text.splitlines()
    begins = lambda i: lines[i].strip().isdigit() and i + 1 < len(lines) and "=" in lines[i + 1]
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        try:
            found = _structure(lines, at)
            yield (*found, None)
            at += found[0] + 2
        except (ValueError, IndexError, KeyError) as e:
            yield (*[None] * 9, f"line {at + 1}: {e}")
            at = next((i for i in range(at + 1, len(lines)) if begins(i)), len(lines))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """One row a structure, those that are malformed with an ``error`` and else null; a file is one task, files run side by side."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    columns = [c.strip().split(" ")[0] for c in re.split(r",\s*(?=\w+ )", _XYZ)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"], strict=True):
                yield pd.DataFrame([(name, i, *s) for i, s in enumerate(parse_xyz(text))], columns=columns).astype({"n_atoms": "Int32"})

    return files.mapInPandas(run, _XYZ)


def parse_poscar(text: str) -> dict:
    """Lattice (9 numbers, scaled), species, counts and fractional or Cartesian positions."""
    lines = text.splitlines()
    scale = float(lines[1])
    lattice = [[scale * float(x) for x in lines[i].split()[:3]] for i in (2, 3, 4)]
    species, counts = lines[5].split(), [int(x) for x in lines[6].split()]
    at = 8 if lines[7].strip()[:1] in "Ss" else 7
    mode = lines[at].strip()[:1].lower()
    rows = [[float(x) for x in line.split()[:3]] for line in lines[at + 1 : at + 1 + sum(counts)]]
    return {"comment": lines[0].strip(), "lattice": lattice, "species": species, "counts": counts, "cartesian": mode in ("c", "k"), "positions": rows}


def parse_cif(text: str) -> dict:
    """Cell lengths and angles, lattice rows, and the species and fractional positions of the listed atom sites.

    Symmetry is not applied: sites are those the file lists.
    """
    scalar = {m[1].lower(): float(m[2]) for m in re.finditer(r"^\s*_cell_(length_[abc]|angle_\w+)\s+([-+.\dEe]+)", text, re.M | re.I)}
    lengths = [scalar[f"length_{c}"] for c in "abc"]
    angles = [scalar.get(f"angle_{n}", 90.0) for n in ("alpha", "beta", "gamma")]
    ca, cb, cg = (math.cos(math.radians(x)) for x in angles)
    sg = math.sin(math.radians(angles[2]))
    cx, cy = cb, (ca - cb * cg) / sg
    lattice = [[lengths[0], 0.0, 0.0], [lengths[1] * cg, lengths[1] * sg, 0.0], [lengths[2] * cx, lengths[2] * cy, lengths[2] * math.sqrt(max(1 - cx * cx - cy * cy, 0.0))]]
    names: list[str] = []
    sites = []
    for line in (raw.strip() for raw in text.splitlines()):
        if line.lower() == "loop_":
            names = []
        elif line.startswith("_"):
            names = [*names, line.split()[0].lower()]
        elif "_atom_site_fract_x" in names and line and not line.startswith("#"):
            row = dict(zip(names, line.split(), strict=False))
            symbol = row.get("_atom_site_type_symbol") or row.get("_atom_site_label", "")
            sites.append((re.match("[A-Za-z]*", symbol)[0], [float(row[f"_atom_site_fract_{c}"].partition("(")[0]) for c in "xyz"]))
    return {"lengths": lengths, "angles": angles, "lattice": lattice, "species": [n for n, _ in sites], "positions": [x for _, x in sites]}


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """POSCAR and CIF files (told by ``.cif``) as ``(file, lattice, species, positions, cartesian)``, one row a file and one species an atom."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["file"], pdf["value"], strict=True):
                if name.lower().endswith(".cif"):
                    s = parse_cif(text) | {"cartesian": False}
                else:
                    s = parse_poscar(text)
                    s["species"] = [e for e, n in zip(s["species"], s["counts"], strict=True) for _ in range(n)]
                rows.append((name, s["lattice"], s["species"], s["positions"], s["cartesian"]))
            yield pd.DataFrame(rows, columns=["file", "lattice", "species", "positions", "cartesian"])

    return files.mapInPandas(run, "file string, lattice array<array<double>>, species array<string>, positions array<array<double>>, cartesian boolean")


def read_energies(spark: SparkSession, path: str, value: str, temperature: float | None = None, **equal: str) -> DataFrame:
    """``(temperature_K, x_B, …equal, value)`` of a figure's table: rows of one temperature, and of the given texts, ordered and each key once (the last row wins)."""
    raw = spark.read.csv(path, header=True).withColumn("_at", F.monotonically_increasing_id())
    keys = [c for c in ("formula", "composition", "temperature_K", "x_B", *equal) if c in raw.columns]
    rows = raw
    for name, text in equal.items():
        rows = rows.filter(F.col(name) == text)
    number = lambda c: F.col(c).cast("double").alias(c) if c in ("temperature_K", "x_B") else F.col(c)
    rows = rows.select(*[number(c) for c in keys], F.col(value).cast("double").alias(value), "_at")
    if temperature is not None:
        rows = rows.filter(F.rint(F.col("temperature_K") * 1000) == round(temperature * 1000))
    return rows.groupBy(*keys).agg(F.max_by(value, "_at").alias(value)).orderBy(*keys)


def output_path(folder: str, name: str) -> str:
    """Where a run's output goes: in its folder; of an absolute name only the last part counts."""
    return os.path.join(folder, os.path.basename(name) if os.path.isabs(name) else name)


def species_counts(structures: DataFrame, key: str = "struct_id") -> DataFrame:
    """``(key, species, n, first)`` from an array column ``species``; ``first`` is the place of its first atom."""
    each = structures.select(key, F.posexplode("species").alias("i", "species"))
    return each.groupBy(key, "species").agg(F.count("*").alias("n"), F.min("i").alias("first"))
