"""End-to-end plans on synthetic runs."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.plans import pipelines
from orbitlake.sources import dump

from test_sources import frame


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    for t in (1500, 900):
        d = top / f"{t}_dir"
        d.mkdir()
        rng = np.random.default_rng(t)
        v = rng.normal(size=(40, 10, 3))
        x = rng.uniform(0, 6, (10, 3)) + np.cumsum(v, axis=0) * 0.1
        (d / "run.dump").write_text("".join(frame(100 * k, "id type xu yu zu vx vy vz", [(i + 1, 1 + i % 2, *x[k, i], *v[k, i]) for i in range(10)], (0.0, 6.0)) for k in range(40)))
        (d / "log.lammps").write_text("Step PotEng KinEng Press Volume\n" + "".join(f"{k} {-10 - k % 7} 1.0 100 216\n" for k in range(60)) + "Loop time\n")
        (d / "in.lammps").write_text("units metal\ntimestep 0.001\nmass 1 10.81\nmass 2 55.845\npair_coeff * * m B Fe\n" + (f"velocity all create {t} 1\n" if t == 1500 else ""))
    return str(top)


def test_thermo(spark, root):
    got = pipelines.thermo_summary(spark, root, pipelines.Options(skip=10, block=10), dt_s=1e-13).collect()
    assert [r.temperature for r in got] == [900.0, 1500.0]
    for r in got:
        assert r.pe == pytest.approx(np.mean([-10 - k % 7 for k in range(10, 60)])) and r.pe_blocks == 5
        assert r.enthalpy == pytest.approx(r.pe + 1 + r.pv) and r.free == pytest.approx(r.enthalpy - r.ts) and r.s_ev_k > 0 and r.free_err == r.enthalpy_err


def test_transport(spark, root):
    got = pipelines.transport_summary(spark, root, pipelines.Options(skip=10, block=10)).collect()
    assert [(r.temperature, r.species_a, r.species_b) for r in got][:3] == [(900.0, "B", "B"), (900.0, "B", "Fe"), (900.0, "Fe", "Fe")]
    assert all(r.dt_ps == pytest.approx(0.1) and r.density == pytest.approx(5 * (10.81 + 55.845) * 1.6605390666 / 216) for r in got)
    assert all((r.l_self is None) == (r.species_a != r.species_b) for r in got)


def test_bonds(spark, root):
    got = pipelines.bond_samples(spark, root, count=5, spacing_ps=0.5).collect()
    assert [(r.run, r.frame_idx) for r in got] == [(run, 39 - 5 * k) for run in (f"{root}/1500_dir", f"{root}/900_dir") for k in (4, 3, 2, 1, 0)] and all(r.n == 5 for r in got)


def test_structure(spark, root):
    state = {"comp": "FeB", "T_K": 1500.0, "P_GPa": 0.0, "rho_Fe": 5 / 216, "rho_B": 5 / 216, "L_mean": [6.0] * 3, "type_to_species": {"1": "B", "2": "Fe"}, "dump": f"{root}/1500_dir/run.dump"}
    k = pipelines.reciprocal_grid(spark, [state, state | {"T_K": 900.0}], shells=1, stride=2, last_fraction=0.5)
    assert k.groupBy("t_k").count().collect()[0][1] == 3 and k.filter(F.col("s_ff") <= 0).count() == 0
    g = pipelines.integral_grid(spark, [state], width=0.1, stride=4, points=10)
    assert g.count() == 10 and g.filter("scc is null or isnan(scc)").count() == 0


def test_runs_of_several_compositions_stay_apart(spark, root, tmp_path):
    for comp in ("1_9", "2_8"):
        shutil.copytree(root, tmp_path / comp)
        (tmp_path / comp / "1500_dir" / "other.dump").write_text((tmp_path / comp / "900_dir" / "run.dump").read_text())
        deck = tmp_path / comp / "1500_dir" / "in.lammps"
        deck.write_text(deck.read_text() + "dump d all custom 50 run.dump id type xu yu zu\n")
    o = pipelines.Options(skip=10, block=10)
    one = {r.temperature: r for r in pipelines.thermo_summary(spark, root, o, vibrations=True).collect()}
    got = pipelines.thermo_summary(spark, str(tmp_path / "*"), o, vibrations=True).collect()
    assert [(r.run.split("/")[-2], r.temperature) for r in got] == [("1_9", 900.0), ("2_8", 900.0), ("1_9", 1500.0), ("2_8", 1500.0)]
    assert all(r.pe == one[r.temperature].pe for r in got) and all(r.s_ev_k == pytest.approx(one[900.0].s_ev_k) for r in got[:2])
    frames = dump.read_frames(spark, str(tmp_path / "*" / "*_dir" / "*.dump")).groupBy("run", "file").agg(F.count("*").alias("n"), F.max("frame_idx").alias("m")).collect()
    assert len(frames) == 6 and {(r.n, r.m) for r in frames} == {(40, 39)}
    assert {(r.run.split("/")[-2], r.dt_ps) for r in pipelines.transport_summary(spark, str(tmp_path / "*"), o).filter("temperature = 1500").collect()} == {("1_9", 0.05), ("2_8", 0.05)}
