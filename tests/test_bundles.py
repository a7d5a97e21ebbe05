"""Texts of many runs in the files of a bundle."""

from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orbitlake.plans import catalog
from orbitlake.sources import bundles, deck, log


def _bundle(spark, folder, members):
    bundles.write_bundle(spark.createDataFrame(members, "path string, value string"), folder)
    return bundles.read_texts(spark, folder, bundled=True)


def test_members_are_whole(spark, tmp_path):
    members = [("/a/run=1/x.txt", "one\n\ntwo\r\n"), ("/a/run=2/x.txt", ""), ("/a/run=3/x.txt", "ä\nö"), ("/a/run=3/x.txt", "ä\nö"), ("/a/run=4/x.txt", None)]
    got = sorted((r.path, r.value) for r in _bundle(spark, str(tmp_path / "b"), members).collect())
    assert got == sorted((p, v or "") for p, v in members)


@pytest.mark.parametrize("member", [("/a/x.txt", "a\x1eb"), ("/a\n/x.txt", "a"), (None, "a")])
def test_members_that_would_break_a_bundle_are_errors(spark, tmp_path, member):
    with pytest.raises(PySparkException):
        _bundle(spark, str(tmp_path / "b"), [member])


def test_bundle_and_files_give_the_same_decks(spark, tmp_path):
    text = "units metal\ntimestep 0.002\nmass 1 10\npair_coeff * * model B\nfix 1 all nvt temp 300 &\n 300 0.1\n"
    for i in range(3):
        (tmp_path / f"f/run={i}").mkdir(parents=True)
        (tmp_path / f"f/run={i}/in.txt").write_text(text + f"timestep 0.00{i + 1}")
    bundles.write_bundle(bundles.read_texts(spark, str(tmp_path / "f/*/*.txt")), str(tmp_path / "b"))
    one, two = (sorted(map(repr, d.collect())) for d in (deck.read_decks(spark, str(tmp_path / "f/*/*.txt")), deck.read_decks(spark, str(tmp_path / "b"), bundled=True)))
    assert one == two and len(one) == 3


def _written(spark, monkeypatch, query, folder, sf_dir):
    """Rows of the query, and files that it writes."""
    monkeypatch.setattr(catalog, "shared_folder", lambda s: f"file://{folder}")
    rows = catalog.QUERIES[query](spark, sf_dir).count()
    return rows, len([p for p in Path(urlparse(f"file://{folder}").path).rglob("*.txt")])


def test_decks_take_no_file_a_run(spark, tmp_path, monkeypatch):
    rows, files = _written(spark, monkeypatch, "deck_read", tmp_path / "d", "/root/testdata/sf0.01")
    assert rows == 100 and 0 < files <= 16


def test_logs_take_no_file_a_run(spark, tmp_path, monkeypatch):
    rows, files = _written(spark, monkeypatch, "log_read", tmp_path / "l", "/root/testdata/sf0.01")
    assert rows == 10_000 and 0 < files <= 16  # of 150 users


def test_bundle_and_files_give_the_same_logs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "_ROWS", 3)  # texts of several rows, several texts a batch
    rows = [f"{i} {-i}.5 1D2 x nan" for i in range(4)]
    for i in range(5):
        (tmp_path / f"f/run={i}").mkdir(parents=True)
        (tmp_path / f"f/run={i}/log.txt").write_text("\n".join(["banner", "Step PotEng KinEng Press Volume", *rows[:i], "Loop time of 1", "9 9 9 9 9"]))
    bundles.write_bundle(bundles.read_texts(spark, str(tmp_path / "f/*/*.txt")), str(tmp_path / "b"))
    one, two = (sorted(map(repr, d.collect())) for d in (log.read_log(spark, str(tmp_path / "f/*/*.txt")), log.read_log(spark, str(tmp_path / "b"), bundled=True)))
    assert one == two and len(one) == 10
    last = log.read_log(spark, str(tmp_path / "f/run=4/*.txt")).filter("row_idx = 3").first()
    assert (last.step, last.pe, last.ke, last.press, last.vol) == (3.0, -3.5, 100.0, None, None)
