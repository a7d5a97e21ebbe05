import numpy as np
import pytest

from orbitlake.operators import modes, pairs, transport, vibration
from orbitlake.sources import deck, dump, log, sinks, tables


def frame(step, header, rows, box=(0.0, 10.0), tilt=""):
    lines = [f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{len(rows)}\nITEM: BOX BOUNDS pp pp pp"]
    lines += [f"{box[0]} {box[1]}{tilt}"] * 3
    lines += [f"ITEM: ATOMS {header}", *[" ".join(map(str, r)) for r in rows]]
    return "\n".join(lines) + "\n"


@pytest.fixture
def run_dir(tmp_path):
    d = tmp_path / "1500_dir"
    d.mkdir()
    return d


@pytest.mark.parametrize(
    "header, row, want",
    [
        ("id type xu yu zu", (12.0, -1.0, 3.0), (12.0, -1.0, 3.0)),
        ("id type xsu ysu zsu", (1.2, -0.1, 0.3), (12.0, -1.0, 3.0)),
        ("id type x y z ix iy iz", (2.0, 9.0, 3.0, 1, -1, 0), (12.0, -1.0, 3.0)),
        ("id type xs ys zs ix iy iz", (0.2, 0.9, 0.3, 1, -1, 0), (12.0, -1.0, 3.0)),
        ("id type x y z", (2.0, 9.0, "3.0D0"), (2.0, 9.0, 3.0)),
        ("id type xs ys zs", (0.2, 0.9, 0.3), (2.0, 9.0, 3.0)),
    ],
)
def test_coordinate_precedence(spark, run_dir, header, row, want):
    (run_dir / "a.dump").write_text(frame(0, header, [(1, 2, *row)]))
    r = dump.read_atoms(spark, str(run_dir / "a.dump")).first()
    assert (r.run, r.file, r.atom_id, r.type) == (str(run_dir), "a.dump", 1, 2)
    assert np.allclose([r.xu, r.yu, r.zu], want)
    assert np.allclose([r.x, r.y, r.z], np.mod(want, 10))
    assert r.volume == pytest.approx(1000)


def test_frames_order_stride_and_velocity(spark, run_dir):
    text = "".join(frame(10 * k, "id type xu yu zu vx vy v_z" if k == 0 else "type id v_x v_y v_z xu yu zu", [(2, 1, 1, 1, 1, 4, 5, 6), (1, 1, 2, 2, 2, 7, 8, 9)] if k == 0 else [(1, 1, 4, 5, 6, 1, 1, 1)], tilt=" 0.5") for k in range(1, 6))
    (run_dir / "a.dump").write_text(text)
    frames = dump.read_frames(spark, str(run_dir / "a.dump"))
    assert frames.count() == dump.count_frames(spark, str(run_dir / "a.dump")) == 5
    assert frames.first().tilt == [0.5, 0.5, 0.5]
    got = dump.read_atoms(spark, str(run_dir / "a.dump"), stride=2, max_frames=2, velocities=True).orderBy("frame_idx").collect()
    assert [r.timestep for r in got] == [10, 30] and got[0].vx == 4


def test_bad_dumps_fail(spark, run_dir):
    (run_dir / "a.dump").write_text(frame(0, "id xu yu zu", [(1, 1, 1, 1)]))
    with pytest.raises(Exception, match="atom header"):
        dump.read_atoms(spark, str(run_dir / "a.dump")).collect()
    (run_dir / "a.dump").write_text(frame(0, "id type q", [(1, 1, 1)]))
    with pytest.raises(Exception, match="no coordinates"):
        dump.read_atoms(spark, str(run_dir / "a.dump")).collect()


LOG = """banner
Step PotEng KinEng Press Volume
0 -1.0 0.5 1.0D+01 100
100 -2.0 bad 10 100
xx yy
200 -3.0 0.5 10 100
Loop time of 3
300 -9 9 9 9
Step pe ke pressure vol
400 -4.0 0.5 10 100
WARNING: lost
500 -5 0 0 0
"""


def test_log(spark, run_dir):
    (run_dir / "log.lammps").write_text(LOG)
    rows = log.with_energies(log.read_log(spark, str(run_dir / "log.lammps"))).orderBy("row_idx").collect()
    assert [r.step for r in rows] == [0, 100, 200, 400]
    assert [r.pe for r in rows] == [-1, -2, -3, -4] and rows[1].ke is None and rows[1].enthalpy is None
    assert rows[0].pv == pytest.approx(1000 * 6.24150913e-7)


def test_deck(spark, run_dir):
    text = """units metal # comment
variable T equal 1500
variable half equal v_T/2
timestep 0.001
mass 1 10.81
mass 2 55.845
pair_coeff * * model.pt B Fe
velocity all create ${T} 1
fix 1 all npt temp $T &
  1700 0.1
dump d all custom v_half*0+10 out_$T.dump id type
"""
    d = deck.parse_deck(text, "x.dump")
    assert (d.units, d.timestep, d.temperature, d.dump_every, d.dump_file) == ("metal", 0.001, 1600.0, 10, "out_1500.dump")
    assert d.masses == {1: 10.81, 2: 55.845} and d.labels == {1: "B", 2: "Fe"} and d.variables["half"] == 750
    assert deck.evaluate("__import__('os')", {}) is None and deck.evaluate("2*(3+1)", {}) == 8
    assert deck.unique_labels([1, 2], {1: "B", 2: "B"}) == {1: "B_type1", 2: "B_type2"}
    assert deck.parse_pair("Na-O", deck.parse_labels("1:O,2=Na")) == (1, 2)
    assert deck.parse_deck("variable temp equal 900").temperature == 900
    (run_dir / "in.lammps").write_text(text)
    row = deck.read_decks(spark, str(run_dir / "in.lammps")).first()
    assert row.run == str(run_dir) and row.masses[2] == 55.845 and row.labels[1] == "B"


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n,3\nNaN,4\n")
    assert [r.x for r in tables.read_csv(spark, str(tmp_path / "a.csv"), "x double, y double").orderBy("y").collect()] == [1.0, None, None]
    assert tables.read_first_two(spark, str(tmp_path / "a.csv")).columns == ["a", "b"]
    (tmp_path / "s.json").write_text('[{"comp":"a","T_K":1500,"P_GPa":0,"rho_Fe":1,"rho_B":3},{"comp":"b","T_K":1500,"P_GPa":0,"rho_Fe":1,"rho_B":0}]')
    assert [(r.comp, r.x_B) for r in tables.binary_states(tables.read_states(spark, str(tmp_path / "s.json")), 1500, 0).collect()] == [("a", 0.75)]
    for name in ("1800_dir", "900.5_dir", "x_dir"):
        (tmp_path / name).mkdir()
    assert [t for t, _ in tables.run_folders(str(tmp_path))] == [900.5, 1800.0]
    assert len(tables.target_folders(str(tmp_path))) == 3
    assert tables.find_upwards(str(tmp_path / "x_dir"), "a.csv") == str(tmp_path / "a.csv")
    (tmp_path / "c.yaml").write_text("T: [1200, 1500]\nk: 0.8 # note\nname: oz\n")
    assert tables.read_config(str(tmp_path / "c.yaml"), k=1.0, name=None) == {"T": [1200, 1500], "k": 1.0, "name": "oz"}


def test_structures(spark, tmp_path):
    one = '2\nLattice="1 0 0 0 1 0 0 0 1" Properties=species:S:1:pos:R:3:magmom:R:1:forces:R:3 energy=-1.5 pbc="T F T"\nFe 0 0 0 2 .1 .2 .3\nB .5 .5 .5 0 0 0 0\n'
    (tmp_path / "a.xyz").write_text(one + one)
    rows = tables.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("struct_id").collect()
    assert len(rows) == 2 and rows[1].species == ["Fe", "B"] and rows[0].force[0] == [0.1, 0.2, 0.3] and rows[0].pbc == [True, False, True] and rows[0].stress is None
    p = tables.parse_poscar("c\n2.0\n1 0 0\n0 1 0\n0 0 1\nFe B\n1 2\nDirect\n0 0 0\n.5 .5 .5\n.1 .1 .1\n")
    assert p["lattice"][0] == [2, 0, 0] and p["counts"] == [1, 2] and len(p["positions"]) == 3 and not p["cartesian"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2.0, 1.5), (1.0, float("nan"))], "t double, e double")
    sinks.write_tsv(df, str(tmp_path / "o"), ["t"], {"t": "%.2f", "e": "%.6f"})
    part = next((tmp_path / "o").glob("part-*"))
    assert part.read_text() == "t\te\n1.00\tN/A\n2.00\t1.500000\n"
    sinks.write_csv(df, str(tmp_path / "c"), {"e": "%.4f"}, ["t"])
    assert sorted(p.name for p in (tmp_path / "c").glob("t=*")) == ["t=1.0", "t=2.0"]
    assert sinks.report(df.filter("t = 2"), {"e": "%.3f"}) == "e: 1.500\n"
    path = sinks.write_cache(df, str(tmp_path / "k"), dr=0.02, stride=10)
    assert path.endswith("dr=0.02/stride=10") and spark.read.parquet(path).count() == 2
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "i int, c string, v double")
    assert sinks.wide(long, ["i"], "c", "v").columns == ["i", "a", "b"]


def test_trajectory_chain(spark, run_dir):
    """A dump through the structure, transport and vibration operators, against numpy."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    n, steps = 8, 24
    v = rng.normal(size=(steps, n, 3))
    x = np.cumsum(v, axis=0)
    text = "".join(frame(10 * k, "id type xu yu zu vx vy vz", [(i + 1, 1 + i % 2, *x[k, i], *v[k, i]) for i in rng.permutation(n)]) for k in range(steps))
    (run_dir / "a.dump").write_text(text)
    a = dump.read_atoms(spark, str(run_dir / "a.dump"), velocities=True).cache()
    parts = a.withColumn("frame", F.col("frame_idx")).withColumn("species", F.col("type"))
    box = 10.0
    want = np.zeros(25)
    for k in range(steps):
        for i in range(n):
            for j in range(i):
                d = x[k, i] - x[k, j]
                d -= np.rint(d / box) * box
                b = int(np.sqrt((d * d).sum()) // 0.2)
                if b < 25:
                    want[b] += 1
    got = np.zeros(25)
    for r in pairs.pair_histogram(parts, 0.2, 5.0).collect():
        got[r.bin] += r.n
    assert (got == want).all()
    k = np.array([1, 0, 2.0])
    rho = [np.exp(-2j * np.pi * (x[:, i % 2 :: 2] / box) @ k).sum(1) for i in range(2)]
    s = modes.partial_structure(modes.density_modes(parts, 2), 1, 2).filter("nx = 1 and ny = 0 and nz = 2").first()
    assert np.allclose([s.s_ff, s.s_fb, s.s_bb], [np.mean(np.real(p * q.conj())) / 1000 for p, q in ((rho[0], rho[0]), (rho[0], rho[1]), (rho[1], rho[1]))])
    t = a.withColumn("mass", F.lit(1.0)).withColumn("species", F.col("type"))
    rows = transport.centered(t)
    c = x - x.mean(1, keepdims=True)
    q = [c[:, 0::2].sum(1), c[:, 1::2].sum(1)]
    got = {(r.lag, r.species_a, r.species_b): r.c for r in transport.correlations(rows, transport.lag_table(rows)).collect()}
    assert max(key[0] for key in got) == 11
    for lag in (1, 5, 11):
        d0, d1 = q[0][lag:] - q[0][:-lag], q[1][lag:] - q[1][:-lag]
        assert got[lag, 1, 2] == pytest.approx((d0 * d1).sum(1).mean())
    own = {(r.lag, r.species): r.c for r in transport.self_correlations(rows, transport.lag_table(rows)).collect()}
    d = c[5:, 0::2] - c[:-5, 0::2]
    assert own[5, 1] == pytest.approx((d * d).sum((1, 2)).mean())
    g = vibration.spectrum(t.withColumn("mass", F.lit(2.0)), 1e-15).orderBy("bin").collect()
    w = np.hanning(steps)[:, None, None]
    p = (np.abs(np.fft.rfft(v * w, axis=0)) ** 2).sum(2).mean(1)
    p[1:-1] *= 2
    e = 4.135667696e-15 * np.fft.rfftfreq(steps, 1e-15)
    assert np.allclose([r.vdos for r in g], p / np.trapezoid(p, e)) and np.allclose([r.e_ev for r in g], e)


def test_cif_and_counts(spark):
    text = "data_x\n_cell_length_a 2.0\n_cell_length_b 3.0\n_cell_length_c 4.0\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 120\nloop_\n_symmetry_equiv_pos_as_xyz\nx,y,z\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nFe1 0.0 0.0 0.0(2)\nB2 0.5 0.5 0.5\n"
    c = tables.parse_cif(text)
    assert c["species"] == ["Fe", "B"] and c["positions"][1] == [0.5] * 3
    assert np.allclose(c["lattice"], [[2, 0, 0], [-1.5, 3 * np.sqrt(0.75), 0], [0, 0, 4]])
    df = spark.createDataFrame([(1, ["B", "Fe", "B"])], "struct_id int, species array<string>")
    assert sorted((r.species, r.n, r["first"]) for r in tables.species_counts(df).collect()) == [("B", 2, 0), ("Fe", 1, 1)]


def test_truncated_dump_fails(spark, run_dir):
    text = frame(0, "id type xu yu zu", [(k, 1, 1, 1, 1) for k in range(1, 4)])
    for cut in (text.rstrip("\n").rpartition("\n")[0], text.rstrip("\n").rpartition("\n")[0] + "\n", text.rstrip()[:-2]):
        (run_dir / "a.dump").write_text(cut)
        with pytest.raises(Exception, match="missing rows.*a.dump at timestep 0"):
            dump.read_atoms(spark, str(run_dir / "a.dump")).collect()


def test_log_of_volumes(spark, run_dir):
    (run_dir / "log.lammps").write_text("Step Temp Volume\n0 1500 100.5\n1 1500 1.0D2\nLoop time\n2 1 1\n")
    assert [(r.step, r.vol, r.pe) for r in log.read_log(spark, str(run_dir / "log.lammps")).orderBy("row_idx").collect()] == [(0.0, 100.5, None), (1.0, 100.0, None)]


def test_xyz_reports_malformed_structures(spark, tmp_path):
    one = '2\nLattice="1 0 0 0 1 0 0 0 1" Properties=species:S:1:pos:R:3 energy=-1.5\nA 0 0 0\nB 0 0 1\n'
    (tmp_path / "a.xyz").write_text(one + one.replace("B 0 0 1", "B 0 x 1") + one + one.replace("2\n", "5\n", 1) + one)
    rows = tables.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("struct_id").collect()
    assert [(r.n_atoms, r.error is None) for r in rows] == [(2, True), (None, False), (2, True), (None, False), (2, True)]
    assert rows[1].error.startswith("line 5:") and rows[2].energy == -1.5


def test_structures_and_figure_tables(spark, tmp_path):
    (tmp_path / "a.vasp").write_text("c\n2.0\n1 0 0\n0 1 0\n0 0 1\nFe B\n1 2\nDirect\n0 0 0\n0.5 0.5 0.5\n0.1 0.1 0.1\n")
    (tmp_path / "b.cif").write_text("data_x\n_cell_length_a 2.0\n_cell_length_b 3.0\n_cell_length_c 4.0\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nFe1 0.0 0.0 0.0\n")
    a, b = tables.read_structures(spark, str(tmp_path)).orderBy("file").collect()
    assert a.species == ["Fe", "B", "B"] and a.lattice[0] == [2.0, 0.0, 0.0] and b.species == ["Fe"] and b.lattice[1][1] == pytest.approx(3.0)
    (tmp_path / "e.csv").write_text("formula,temperature_K,x_B,pressure,v\nFe,1500.0,0.1,0 GPa,1\nFe,1500.0,0.1,0 GPa,2\nFe,1800.0,0.1,0 GPa,3\nFe,1500.0,0.2,10 GPa,4\n")
    got = tables.read_energies(spark, str(tmp_path / "e.csv"), "v", 1500.0, pressure="0 GPa").collect()
    assert [(r.temperature_K, r.x_B, r.v) for r in got] == [(1500.0, 0.1, 2.0)]
    assert tables.output_path("/a", "/x/b.txt") == "/a/b.txt" and tables.output_path("/a", "c/b.txt") == "/a/c/b.txt"


def test_reports_and_exports(spark, tmp_path):
    full = spark.createDataFrame([(k, a, b, float(k)) for k in (1, 2) for a, b in (("B", "B"), ("B", "Fe"), ("Fe", "Fe"))], "lag int, species_a string, species_b string, c double")
    own = spark.createDataFrame([(k, s, 10.0 * k) for k in (1, 2) for s in ("B", "Fe")], "lag int, species string, c double")
    wide = sinks.correlation_table(full, own, ["B", "Fe"], 0.5)
    sinks.write_columns(wide, str(tmp_path / "c"), wide.columns)
    lines = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "time_ps C_B_B_A2 C_B_Fe_A2 C_Fe_B_A2 C_Fe_Fe_A2 Cself_B_A2 Cself_Fe_A2" and [float(x) for x in lines[2].split()] == [1.0, 2, 2, 2, 2, 20, 20]
    rows = spark.createDataFrame([("B", "B", 1.0, 0.9, 2.0, 3.0, 0.8, -0.5), ("B", "Fe", 4.0, None, None, None, None, None), ("Fe", "Fe", 5.0, 0.7, 2.5, 3.5, 0.6, 1.0)], "species_a string, species_b string, l double, r2 double, l_self double, d_self double, r2_self double, factor double")
    text = sinks.onsager_report(rows, ["B", "Fe"], (1.0, 4.0)).splitlines()
    assert text[4:6] == ["1.00000000e+00 4.00000000e+00", "4.00000000e+00 5.00000000e+00"] and text[7] == "0.900000 N/A" and text[-1].startswith("Fe 2.50000000e+00")
    assert not sinks.write_nonempty(rows.limit(0), str(tmp_path / "n"), {}) and not (tmp_path / "n").exists()
    assert sinks.write_nonempty(rows, str(tmp_path / "n"), {"l": "%.2f"}) and [r.l for r in sinks.preview(rows, ["l"], 2).collect()] == [1.0, 4.0]
