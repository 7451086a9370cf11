import struct

import numpy as np
import pytest

from lumenframe.functions import text as X
from lumenframe.operators import field as G
from lumenframe.operators import spectral
from lumenframe.sources import binary as B
from lumenframe.sources import files as S
from lumenframe.sources import sinks


def blob_map(spark, h=6, w=7, n=24, seed=0):
    wn = np.linspace(1000, 1800, n)
    k = np.exp(-(((wn - 1350) / 60) ** 2))
    rng = np.random.default_rng(seed)
    rows = [("m", i * w + j, i, j, wn.tolist(), (np.exp(-((i - 2.5) ** 2 + (j - 3) ** 2) / 6) * k * 40 + rng.normal(0, 0.3, n)).tolist()) for i in range(h) for j in range(w)]
    return spectral.points(spark.createDataFrame(rows, "acq_id string, pt int, i int, j int, wavenumber array<double>, intensities array<double>"))


def dense(field, vox):
    out = np.zeros(len(vox))
    for r in field:
        w, x, y, z = np.array(r.q) / np.linalg.norm(r.q)
        rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        p = rot @ np.diag(np.exp(-2 * np.array(r.ls))) @ rot.T
        e = np.array([[v.x, v.y, v.z] for v in vox]) - np.array(r.mu)
        out += np.exp(r.la) * np.exp(-0.5 * np.einsum("ni,ij,nj->n", e, p, e))
    return out


def test_box_join_agrees_with_dense_evaluation(spark):
    vol = G.volume(blob_map(spark), channel_bin=2)
    f = G.seed_field(vol, share=0.05)
    got = G.evaluate(f, vol).collect()
    assert len(got) == 6 * 7 * 12
    assert np.abs(np.array([r.fit for r in got]) - dense(f.collect(), got)).max() < 5e-2 * max(r.fit for r in got)
    assert G.report(f, vol).first().n_params == 11 * f.count()


def test_tiles_agree_with_one_tile(spark, monkeypatch):
    vol = G.volume(blob_map(spark), channel_bin=2)
    f = G.seed_field(vol, share=0.05)
    whole = {(r.i, r.j): r.fit for r in G.evaluate_pixels(f, vol).collect()}
    sums = {r.gid: r.wxy for r in G.moments(f, vol).collect()}
    step = {r.gid: r.mu + r.ls + r.q + [r.la] for r in G.fit(vol, f, steps=2, at_once=1, grow_every=0).collect()}
    monkeypatch.setattr(G, "TILE", 3)
    parts = {(r.i, r.j): r.fit for r in G.evaluate_pixels(f, vol).collect()}
    assert parts.keys() == whole.keys() and all(np.allclose(parts[p], whole[p], atol=1e-12) for p in whole)
    assert all(np.isclose(r.wxy, sums[r.gid], atol=1e-12) for r in G.moments(f, vol).collect())
    assert all(np.allclose(step[r.gid], r.mu + r.ls + r.q + [r.la], atol=1e-9) for r in G.fit(vol, f, steps=2, at_once=1, grow_every=0).collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_need_no_row_for_each_voxel(spark, monkeypatch):
    vol = G.volume(blob_map(spark), channel_bin=2)
    f = G.seed_field(vol, share=0.05)
    vox = G.evaluate(f, vol).collect()
    error = lambda on: np.mean([(r.v - r.fit) ** 2 for r in vox if r.is_eval == on])
    monkeypatch.setattr(G, "TILE", 3)
    got = G.scores(f, vol)
    assert "posexplode" not in _plan(got)
    for r in (got.first(), G.scores(f, vol, G._pixels_in_tiles(vol, G.REACH)).first()):
        assert (r.psnr_train, r.psnr_eval) == pytest.approx((-10 * np.log10(error(False)), -10 * np.log10(error(True))), abs=1e-9)


def test_boxes_hold_only_pixels_of_the_mask():
    rng = np.random.default_rng(2)
    i, j = np.divmod(np.flatnonzero(rng.random(120) < 0.4), 12)
    zs, par = np.sort(rng.random(15)), np.concatenate([rng.random((9, 3)), np.log(rng.uniform(0.05, 0.2, (9, 3))), rng.normal(size=(9, 4)), rng.normal(size=(9, 1))], 1)
    tile = G._Tile(i, j, 1 / 11, 1 / 9, zs)
    boxes = list(tile.boxes(par))
    assert all(phi.ndim == 2 and len(phi) == len(g) for g, _, phi, _ in boxes) and sum(len(g) for g, *_ in boxes) <= 9 * len(i)
    e = np.stack(np.broadcast_arrays((j / 11)[:, None], (i / 9)[:, None], zs[None, :]), -1).reshape(-1, 3)
    v, fit, shapes = rng.random((len(i), 15)), 0.0, []
    for p in par:
        rot = G.rotations(p[None, 6:10])[0]
        d = e - p[:3]
        inside = (np.abs(d) <= G.TRUNC * np.sqrt((rot**2) @ np.exp(2 * p[3:6]))).all(axis=1)
        shapes.append((d, inside * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, rot @ np.diag(np.exp(-2 * p[3:6])) @ rot.T, d))))
        fit = fit + np.exp(p[10]) * shapes[-1][1]
    assert np.allclose(tile.fit(par).ravel(), fit, atol=1e-12)
    for got, (d, phi) in zip(tile.moments(par, v), shapes):
        w = (fit - v.ravel()) * phi
        assert np.allclose(got, [w.sum(), *(w @ d), *(w @ d**2), w @ (d[:, 0] * d[:, 1]), w @ (d[:, 0] * d[:, 2]), w @ (d[:, 1] * d[:, 2])], atol=1e-12)


def test_plateau_reads_the_history_once(spark):
    rows = [("a", 20, 10.0), ("a", 40, 11.9), ("a", 60, 11.7), ("a", 80, 12.0), ("b", 20, 5.0), ("b", 40, None), ("c", 20, None), ("c", 40, 3.0), (None, 20, 1.0)]
    got = G.plateau(spark.createDataFrame(rows, "acq_id string, iter int, psnr_eval double"))
    assert {(r.acq_id, r.iter) for r in got.collect()} == {("a", 40), ("c", 40)}
    assert "Join" not in _plan(got)


def test_a_round_of_the_fit_shuffles_no_pixels(spark):
    vol = G.volume(blob_map(spark), channel_bin=2)
    seen = []
    G.fit(vol, G.seed_field(vol, share=0.05), steps=2, at_once=1, grow_every=0, history=seen)
    for line in _plan(seen[0]).splitlines():
        assert "Exchange" not in line or "zs" not in line
    state = G.cut(G.seed_field(vol).selectExpr("*", "array_repeat(0D, 11) am", "array_repeat(0D, 11) av", "0D pull"))
    dealt = G._stored(G._pixels_in_tiles(vol, G.REACH))
    assert _plan(G.descend(state, dealt, vol.grid, 5, 0, 1)).count("Exchange hashpartitioning(acq_id") == 1


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    pts, target = rng.uniform(0, 1, (200, 3)), rng.uniform(0, 1, 200)
    par = np.concatenate([rng.uniform(0.3, 0.7, 3), np.log(rng.uniform(0.2, 0.4, 3)), rng.normal(size=4), [np.log(0.7)]])

    def value(p):
        w, x, y, z = p[6:10] / np.linalg.norm(p[6:10])
        rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        e = pts - p[:3]
        phi = np.exp(-0.5 * np.einsum("ni,ij,nj->n", e, rot @ np.diag(np.exp(-2 * p[3:6])) @ rot.T, e))
        r = np.exp(p[10]) * phi - target
        return 0.5 * r @ r + G.LAM_A * np.exp(p[10]) + G.LAM_S * (p[3:6] ** 2).sum(), r * phi, e

    _, w, e = value(par)
    s = np.array([[w.sum(), *(w @ e), *(w @ e**2), w @ (e[:, 0] * e[:, 1]), w @ (e[:, 0] * e[:, 2]), w @ (e[:, 1] * e[:, 2])]])
    got = G.gradients(par[None, :3], par[None, 3:6], par[None, 6:10], par[10:], s)[0]
    for i in range(11):
        d = np.zeros(11)
        d[i] = 1e-6
        assert got[i] == pytest.approx((value(par + d)[0] - value(par - d)[0]) / 2e-6, rel=1e-4, abs=1e-6)


def test_fit_gains_three_decibels_in_sixty_steps(spark):
    vol = G.volume(blob_map(spark, 14, 16, 90), channel_bin=2)
    f = G.seed_field(vol, share=0.012)
    history = []
    done = G.fit(vol, f, steps=60, history=history)
    a, b = G.report(f, vol).first(), G.report(done, vol).first()
    assert b.psnr_train > a.psnr_train + 3 and b.psnr_eval > a.psnr_eval and b.ssim_train > a.ssim_train
    assert 0 < b.resid_over_noise < a.resid_over_noise and b.compression_full > b.compression
    rows = [h.first() for h in history]
    assert [r["iter"] for r in rows] == [20, 40, 60] and rows[-1].psnr_train > rows[0].psnr_train and rows[-1].loss < rows[0].loss
    assert G.gradient_norm(done, vol).first().norm >= 0
    band = {(r.i, r.j): r.value for r in G.render_band(done, vol, 1350.0, 20.0).collect()}
    assert max(band, key=band.get) in {(i, j) for i in (1, 2, 3, 4) for j in (2, 3, 4)} or max(band.values()) > 0
    assert {r.band for r in G.residual_summary(G.band_maps(done, vol)).collect()} <= {"d1", "gd2"}
    assert G.withheld_error(done, vol).count() == 14 * 16


def test_growth_pruning_and_saved_fields(spark, tmp_path):
    vol = G.volume(blob_map(spark), channel_bin=2)
    f = G.seed_field(vol, share=0.05)
    n = f.count()
    assert G.prune(f, share=2.0).count() == n
    zero = G.F.array_repeat(G.F.lit(0.0), 11)
    state = f.withColumns({"am": zero, "av": zero, "pull": G.F.col("gid").cast("double"), "n0": G.F.lit(n).cast("long")})
    grown = G.grow(state, vol, 40).collect()
    chosen = sum(r.pull >= np.quantile(range(n), 0.88) for r in state.collect())
    assert len(grown) == n + chosen and len({r.gid for r in grown}) == len(grown)
    G.save_field(f, str(tmp_path / "f"))
    again = G.load_field(spark, str(tmp_path / "f"))
    assert np.allclose(G.report(again, vol).first()[1:], G.report(f, vol).first()[1:], rtol=1e-9)
    s = G.accessors(f).first()
    assert np.isclose(np.linalg.norm(s.quaternion), 1) and s.amplitude > 0 and min(s.covariance[:3]) > 0
    assert G.shape_statistics(f, vol.grid).first().ratio_median >= 1
    mask = vol.pixels.where("i BETWEEN 2 AND 3 AND j BETWEEN 2 AND 4").select("acq_id", "i", "j")
    assert G.mask_box(mask).first()[1:] == (1, 4, 1, 5)
    assert G.volume(blob_map(spark), channel_bin=2, mask=mask).pixels.count() == 6
    none = G.volume(blob_map(spark).limit(0))
    assert G.report(G.seed_field(none), none).count() == 0 and G.fit(none, G.seed_field(none), steps=2).count() == 0


def test_matrix_maps_and_their_faults(spark, tmp_path):
    wn = np.linspace(1000, 1800, 60)
    good = "\t\t" + "\t".join(f"{v:.2f}" for v in wn) + "\n" + "".join(f"{j}\t{i}\t" + "\t".join(["1.5"] * 60) + "\n" for i in range(4) for j in range(5))
    (tmp_path / "map.txt").write_text(good)
    (tmp_path / "short.txt").write_text("\t\t" + "\t".join(str(i) for i in range(31)) + "\n" + "0\t0\t" + "\t".join(["1"] * 31) + "\n")
    (tmp_path / "words.txt").write_text("This is a remark\n")
    (tmp_path / "fit.txt").write_text("idx\tG intensity\tG w\tG a\tD3 i\n" + "".join(f"{i}\t" + "\t".join(["2.0"] * 9) + "\n" for i in (1, 2, 3)) + "4\t" + "\t".join(["nan"] * 9) + "\n")
    (tmp_path / "two.txt").write_text("3 30\n1 10\n2 20\n")
    lines = S.read_lines(spark, str(tmp_path))
    name = lambda p: p.rsplit("/", 1)[1]
    assert {name(r.path): r.kind for r in S.classify(lines).collect()} == {"map.txt": "matrix_like", "short.txt": "matrix_like", "words.txt": "note", "fit.txt": "fit_table", "two.txt": "two_column"}
    pts, faults = S.read_matrix_maps(lines)
    assert pts.count() == 20 and {name(r.path): r.reason for r in faults.collect()}["short.txt"] == "axis is not plausible"
    assert pts.where("pt = 7").first().v == [1.5] * 60
    fit = S.read_fit_tables(lines.where("path like '%fit.txt'"))
    assert fit.count() == 3 and S.contiguous(fit).first().contiguous and S.fit_quality(fit).first().g_ok
    two = S.read_two_column(lines.where("path like '%two.txt'")).first()
    assert two.w == [1.0, 2.0, 3.0] and two.v == [10.0, 20.0, 30.0]
    assert {name(r.path): r.route for r in S.list_files(spark, str(tmp_path)).collect()}["map.txt"] == "text"


def record(tag, word=b"\xf6\x7f\x00\x00"):
    return struct.pack("<II", 1, 1) + b"\x01" + tag + word + struct.pack("<II", 0, 0)


def test_binary_readers(spark, tmp_path):
    y = np.arange(5, dtype="<f4")
    head = bytearray(544)
    head[1] = 0x4B
    struct.pack_into("<idd", head, 4, 5, 100.0, 500.0)
    (tmp_path / "ok.spc").write_bytes(bytes(head) + y.tobytes())
    (tmp_path / "uneven.spc").write_bytes(bytes([0x80]) + bytes(head[1:]) + y.tobytes())
    (tmp_path / "short.SPC").write_bytes(b"\0" * 100)
    got = {r.path.rsplit("/", 1)[1]: r for r in B.read_binary(spark, str(tmp_path), "spc").collect()}
    assert got["ok.spc"].status == "ok" and got["ok.spc"].w == [100.0, 200.0, 300.0, 400.0, 500.0] and got["ok.spc"].v == [[0.0, 1.0, 2.0, 3.0, 4.0]]
    assert got["uneven.spc"].status == "failed" and got["short.SPC"].status == "failed"

    ny, nx, wn = 4, 6, np.linspace(1000, 1800, 32).astype("<f4")
    field = np.hypot(*np.meshgrid(np.arange(nx) - 2, np.arange(ny) - 1))
    cube = (field[:, :, None] * np.linspace(1, 2, 32)).astype("<f4")
    xs, ys = np.arange(nx, dtype="<f4"), np.arange(ny, dtype="<f4")
    data = B.MAGIC + b"".join(record(b"tam") + a.tobytes() for a in (cube.swapaxes(0, 1).copy(), wn, xs, ys)) + record(b"axi")
    (tmp_path / "m.l6m").write_bytes(data)
    (tmp_path / "bad.l6m").write_bytes(b"nothing" * 20)
    (tmp_path / "empty.l6s").write_bytes(B.MAGIC + b"\0" * 512)
    got = {r.path.rsplit("/", 1)[1]: r for r in B.read_binary(spark, str(tmp_path), "vendor").collect()}
    assert (got["m.l6m"].status, got["m.l6m"].nx, got["m.l6m"].ny) == ("ok", nx, ny)
    assert np.allclose(np.array(got["m.l6m"].v).reshape(ny, nx, 32), cube)
    assert "not a LabSpec 6 file" in got["bad.l6m"].reason and got["empty.l6s"].status == "failed"


def test_scrub_leaks_and_codes(spark):
    df = spark.createDataFrame([(1, "RUN ZZZ10001 on 26 AUG 2026\nhost 10.0.0.1 and a@b.example"), (2, None), (3, "")], "doc_id int, text string")
    rules = [("ZZZ10001", "S01"), ("ZZZ1000", "S02")]
    once = df.select(X.scrub(df.text, rules).alias("t"))
    twice = once.select(X.scrub(once.t, rules).alias("t"))
    assert once.first().t.startswith("RUN S01 on date\n") and once.collect() == twice.collect()
    assert {(r.id, r.kind, r.line_no, r.token) for r in X.leaks(df, "doc_id", "text").collect()} == {(1, "ip", 2, "10.0.0.1"), (1, "address", 2, "a@b.example")}
    assert X.leaks(df, "doc_id", "text", allowed=("10.0.0.1", "a@b.example")).count() == 0
    codes = X.identity_codes(spark.createDataFrame([("10",), ("9",), ("b",), (None,), (" 9 ",), ("",)], "token string"), "specimen", "S", 2)
    assert [(r.token, r.code) for r in codes.orderBy("code").collect()] == [("9", "S01"), ("10", "S02"), ("b", "S03")]
    assert spark.range(1).select(X.word_count(X.F.lit("% all\nTwo \\emph{words} -- $x$"))).first()[0] == 3


def test_graphml_roundtrip(spark, tmp_path):
    import xml.etree.ElementTree as ET

    n = spark.createDataFrame([("a", "acquisition"), ("b", None)], "id string, ntype string")
    e = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, weight double")
    sinks.write_graphml(n, e, str(tmp_path / "g.xml"))
    root = ET.parse(tmp_path / "g.xml").getroot()
    assert len([x for x in root.iter() if x.tag.endswith("node")]) == 2 and len([x for x in root.iter() if x.tag.endswith("edge")]) == 1
    with pytest.raises(ValueError):
        sinks.write_graphml(n, e, str(tmp_path / "h.xml"), limit=0)
    sinks.write_manifest(n, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2


def test_stream_ingest_drops_repeats(spark, tmp_path):
    from lumenframe.streaming import ingest

    df = spark.sql("SELECT 'a' acq_id, 1 pt, timestamp '2025-01-01 10:00:00' loaded_at UNION ALL SELECT 'a', 1, timestamp '2025-01-01 11:00:00' UNION ALL SELECT 'a', 2, timestamp '2025-01-02 10:00:00'")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.first_arrivals(ingest.stream_table(spark, str(tmp_path / "in"), str(tmp_path / "in")), ["acq_id", "pt"], "loaded_at")
    q = s.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM seen").count() == 2


def test_every_file_of_any_format_gives_points_a_fault_or_a_kind(spark, tmp_path):
    from lumenframe.plans import ingest

    w = [1000.0 + 10 * k for k in range(20)]
    formats = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}
    files, lines = [("empty", "comma", ".", False)], []
    for name, c in formats.items():
        for mark in ".," if name in ("tab", "semicolon") else ".":
            for note in (False, True):
                f = f"{name}{'d' if mark == ',' else ''}{'x' if note else ''}"
                files.append((f, name, mark, note))
                cell = lambda v: str(v).replace(".", mark)  # noqa: B023, E731
                lines.append((f, 1, c.join(["", ""] + [cell(v) for v in w] + ["note"] * note)))
                lines += [(f, n, c.join([f'"{cell(n / 2)}"', "1"] + [cell(v + n) for v in w] + [f'"a{c}b"'] * note)) for n in (2, 3)]
                lines.append((f, 4, "# a remark"))
    files.append(("cut", "pipe", ".", False))
    lines += [("cut", 1, "||" + "|".join(map(str, w))), ("cut", 2, "1|2|3"), ("cut", 3, '"1|2'), ("stray", 1, "x")]
    spark.createDataFrame(files, "file_id string, delim string, decimal_mark string, has_note boolean").write.parquet(f"{tmp_path}/raw_files.parquet")
    spark.createDataFrame(lines, "file_id string, line_no int, raw string").write.parquet(f"{tmp_path}/raw_lines.parquet")
    good = {f[0] for f in files} - {"empty", "cut"}
    got = ingest.matrix_maps(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.pt, r.x, r.y) for r in got) == sorted((f, p, (p + 2) / 2, 1.0) for f in good for p in (0, 1))
    assert all(r.w == w and r.v == [v + r.pt + 2 for v in w] for r in got)
    assert {r.path: r.reason for r in ingest.map_faults(spark, str(tmp_path)).collect()} == {"empty": "header is not numeric", "cut": "coordinate count"}
    assert {r.path: r.kind for r in ingest.classes(spark, str(tmp_path)).collect()} == {f: "matrix_like" for f in good | {"cut"}} | {"empty": "unknown"}
