"""The codec on a drawn sequence: each point has a set of attributes that change, by random walks or swings; the others stand still."""

import json
import math
import os

import numpy as np
import pytest

from trackloom.config import ATTRS, Bounds
from trackloom.functions.arrow import plane_entropy, planes, unplanes, unzz, zz
from trackloom.operators import codec, tracks
from trackloom.sources import container, splat


def synthetic(t, n, seed=5):
    """Arrays of records by frame. Which attributes of a point move is drawn (none for a third of them); alpha and scale never do."""
    rng = np.random.default_rng(seed)
    walks, turns, fades = rng.random((3, n, 1)) < rng.choice([0.0, 0.5, 0.9], n)[:, None]
    start, pace = rng.uniform(-2, 2, (n, 3)), rng.normal(0, 0.03, (n, 3))
    axis, colour, drift = rng.normal(0, 1, (n, 4)), rng.integers(0, 256, (n, 3)), rng.integers(-9, 10, (n, 3))
    scale, alpha = rng.lognormal(-4, 1, (n, 3)), rng.integers(0, 256, (n, 1))
    out, place = [], start
    for f in range(t):
        q = axis + turns * 0.2 * np.sin(f / 4 + axis[:, ::-1])
        r = np.zeros(n, splat.RECORD)
        r["p"], r["s"] = place, scale
        r["c"] = np.hstack([np.clip(colour + fades * (drift * f // 2), 0, 255), alpha])
        r["q"] = np.clip(np.round(q / np.linalg.norm(q, axis=1, keepdims=True) * 128), -128, 127) + 128
        out.append(r)
        place = place + walks * (pace + rng.normal(0, 0.01, (n, 3)))
    return out


def write(path, frames, fps=20.0, manifest=True):
    os.makedirs(path, exist_ok=True)
    for k, r in enumerate(frames):
        r.tofile(f"{path}/frame_{k:04d}.splat")
    if manifest:
        with open(f"{path}/frames.json", "w") as f:
            json.dump({"fps": fps, "frames": [{"file": f"frame_{k:04d}.splat", "timestamp": k / fps} for k in range(len(frames))]}, f)


BOUNDS = Bounds(0.004, 0.03, 3, 5, 2)


@pytest.fixture(scope="module")
def encoded(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("seq"))
    frames = synthetic(21, 330)
    write(path, frames)
    container.register(spark)
    df = spark.read.format("splat").load(path)
    report = codec.encode(df, f"{path}/out", BOUNDS, gop=8, fps=20.0, perm_path=f"{path}/perm")
    return path, frames, df, report


def test_bounds_hold_for_every_frame(spark, encoded):
    path, frames, df, report = encoded
    rows = {r.attr: r for r in codec.verify(spark, f"{path}/out", df).collect()}
    assert set(rows) == set(ATTRS) and all(r.ok and r.rows == 21 * 330 for r in rows.values())
    perm = np.fromfile(f"{path}/perm", "<u4")
    assert sorted(perm) == list(range(330))
    back = codec.decode(spark, f"{path}/out").orderBy("frame", "ord").toPandas()
    pos = back[["x", "y", "z"]].to_numpy().reshape(21, 330, 3)
    rgb = back[["r", "g", "b"]].to_numpy().reshape(21, 330, 3)
    for f, r in enumerate(frames):
        assert np.abs(pos[f] - r["p"][perm]).max() <= 0.004 + 1e-6
        assert np.abs(rgb[f] - r["c"][perm][:, :3]).max() <= 3


def test_standing_points_are_static(encoded):
    _, _, _, report = encoded
    assert report["static"]["alpha"] == report["static"]["scale"] == 1.0 and report["static"]["pos"] >= 0.33
    assert report["input_bytes"] == 21 * 330 * 32 and report["ratio"] > 1


def test_header_tiles_the_file(encoded):
    path, *_ = encoded
    h = codec.info(f"{path}/out")
    assert (h["n"], h["t"], h["gop"], h["fps"]) == (330, 21, 8, 20.0)
    assert [(g["f0"], g["f1"]) for g in h["gops"]] == [(0, 7), (8, 15), (16, 20)]
    at = h["static_section"]["offset"] + h["static_section"]["len"]
    for g in h["gops"]:
        assert g["offset"] == at
        at += g["len"]
    assert at == os.path.getsize(f"{path}/out") == h["file_bytes"]
    masks = [g["mask"] for g in h["groups"]]
    assert masks == sorted(masks) and sum(g["count"] for g in h["groups"]) == 330
    assert h["gops"][2]["t1"] == 20 / 20


def test_one_group_decodes_alone(spark, encoded):
    path, *_ = encoded
    whole = codec.decode(spark, f"{path}/out").where("frame = 17").orderBy("ord").collect()
    assert codec.decode(spark, f"{path}/out", (17, 17)).orderBy("ord").collect() == whole


def test_exact_hold_and_other_groups_keep_the_bins(spark, encoded, tmp_path):
    path, _, df, _ = encoded
    codec.encode(df, f"{tmp_path}/b", BOUNDS, gop=7, hold_mode="exact", check=False)
    a, b = (codec.decode(spark, p).orderBy("frame", "ord").toPandas().to_numpy() for p in (f"{path}/out", f"{tmp_path}/b"))
    assert (a == b).mean() > 0.999  # exact ties apart


def test_pushdown(spark, encoded):
    path, *_ = encoded
    pack = spark.read.format("trackpack").load(f"{path}/out")
    assert pack.where("gop = 2").rdd.getNumPartitions() == 1
    keys = pack.where("kind = 0")
    assert keys.count() == pack.where("kind < 1").count() > 0
    data = container.read_range(f"{path}/out", **{"at": container.read_header(f"{path}/out")["gops"][0]["offset"], "size": container.read_header(f"{path}/out")["gops"][0]["len"]})
    assert container.keys_length(data) < len(data)
    assert [s["kind"] for s in container.read_chunk(data, True)] == [0] * len(container.read_chunk(data, True))
    assert spark.read.format("splat").load(path).where("frame >= 20").rdd.getNumPartitions() == 1


def test_frame_files_round_trip(spark, encoded, tmp_path):
    path, frames, df, _ = encoded
    out = f"{tmp_path}/copy"
    df.repartition(5, "frame").sortWithinPartitions("frame", "splat_id").write.format("splat").option("fps", 20).mode("append").save(out)
    assert all(np.fromfile(f"{out}/frame_{k:04d}.splat", splat.RECORD).tobytes() == r.tobytes() for k, r in enumerate(frames))
    assert splat.fps(out) == 20.0 and splat.sequences(str(tmp_path)) == ["copy"]


def test_bad_directories(tmp_path):
    with pytest.raises(ValueError):
        splat.frame_files(str(tmp_path))
    (tmp_path / "a.splat").write_bytes(b"x" * 33)
    with pytest.raises(ValueError):
        splat.checked(splat.frame_files(str(tmp_path)))
    (tmp_path / "a.splat").write_bytes(b"x" * 32)
    (tmp_path / "b.splat").write_bytes(b"x" * 64)
    with pytest.raises(ValueError):
        splat.checked(splat.frame_files(str(tmp_path)))
    assert splat.fps(str(tmp_path)) == 30.0 and splat.fps(str(tmp_path), 12) == 12.0
    with pytest.raises(ValueError):
        container.read_header(str(tmp_path / "a.splat"))
    for bad in ({"pos_m": 0}, {"rgb": -1}):
        with pytest.raises(ValueError):
            Bounds(**bad)


def test_denoise_is_flagged_and_verified(spark, encoded, tmp_path):
    _, _, df, _ = encoded
    codec.encode(df.where("frame < 6"), f"{tmp_path}/d", BOUNDS, gop=3, denoise=True)
    assert codec.info(f"{tmp_path}/d")["denoised"]


def test_streams():
    rng = np.random.default_rng(8)
    v = np.concatenate([np.arange(-3, 4), rng.integers(-(2**30), 2**30, 50)])
    assert zz(v).tolist() == [2 * x if x >= 0 else -2 * x - 1 for x in v.tolist()] and (unzz(zz(v)) == v).all()
    sym = rng.geometric(0.01, 7000) % 700
    s = container.pack_stream(2, 1, sym, 3)
    back, end = container.read_stream(container.stream_head(s) + s["payload"], 0)
    assert s["width"] == 2 and (back["symbols"] == sym).all() and end == 11 + len(s["payload"])
    assert (unplanes(planes(sym, 4), 4) == sym).all() and plane_entropy(bytes(100)) == 0
    with pytest.raises(ValueError):
        container.read_stream((container.stream_head(s) + s["payload"])[:-1], 0)


def test_sign_canonicalization(spark):
    assert tracks.flip(np.array([10, -128, 3, 0])).tolist() == [-10, 127, -3, 0]
    rng = np.random.default_rng(1)
    q = rng.integers(-128, 128, (9, 5, 4))
    rows = [(e, t, *map(int, q[t, e])) for t in range(9) for e in range(5)]
    df = spark.createDataFrame(rows, "e long, t long, q0 long, q1 long, q2 long, q3 long")
    a, b = (sorted(map(tuple, f(df, "e", "t").collect())) for f in (tracks.canonicalize, tracks.canonicalize_sql))
    c = tracks.canonical_signs(q)
    assert a == b == sorted((e, t, *map(int, c[t, e])) for t in range(9) for e in range(5))


def test_importers(spark, tmp_path):
    import struct

    from trackloom.sources import importers

    rng = np.random.default_rng(2)
    np.savez(tmp_path / "a.npz", means3D=rng.normal(size=(3, 7, 3)).astype("f4"), rgb_colors=rng.random((3, 7, 3)).astype("f4"), unnorm_rotations=rng.normal(size=(3, 7, 4)).astype("f4"), log_scales=np.full((7, 3), -2, "f4"), logit_opacities=np.zeros((7, 1), "f4"))
    rows = importers.from_npz(spark, str(tmp_path / "a.npz"), 2).collect()
    assert len(rows) == 14 and {r.a for r in rows} == {128} and abs(rows[0].sx - math.exp(-2)) < 1e-6
    ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n" + struct.pack("<fffBBB", 1, 2, 3, 4, 5, 6) * 2
    (tmp_path / "p.ply").write_bytes(ply)
    got = importers.from_ply(spark, str(tmp_path / "p.ply")).collect()
    assert len(got) == 2 and (got[0].x, got[0].r, got[0].q0, got[0].a) == (1.0, 4, 255, 255)
    w = np.zeros((2, 16), "<u4")
    w[:, :3] = np.array([1, 2, 3], "<f4").view("<u4")
    h = w.view("<f2")
    h[:, 6], h[:, 10:13], h[:, 16], h[:, 31] = 1, 0.5, 2, 0
    w.view("u1").reshape(2, 64)[:, 28:32] = (9, 8, 7, 255)
    meta = json.dumps([]).encode()
    (tmp_path / "m").write_bytes(struct.pack("<II", importers.MOTION_MAGIC, len(meta)) + meta + w.tobytes())
    got = sorted(importers.from_motion(spark, str(tmp_path / "m"), 3).collect())
    assert len(got) == 6 and got[0].x == 1.0 and got[-1].x == 3.0 and (got[0].a, got[0].q0) == (255, 255)


def test_views(spark):
    from trackloom.operators import view

    v = view.look_at((0, 0, -3), (0, 0, 0))
    assert np.allclose(v @ [0, 0, 0, 1], [0, 0, 3, 1]) and np.allclose(view.invert(v) @ v, np.eye(4))
    assert np.allclose(view.translate(np.eye(4), (1, 2, 3))[:3, 3], (1, 2, 3))
    assert np.allclose(view.rotate(np.eye(4), math.pi / 2, (0, 0, 1))[:2, :2], [[0, -1], [1, 0]], atol=1e-12)
    assert view.invert(np.zeros((4, 4))) is None
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1), (1, 0.0, 0.0, 1.0, 0), (2, 0.0, 0.0, -5.0, 0), (3, 0.0, 0.0, 2.0, 1)], "id long, x double, y double, z double, alpha int")
    got = {r.id: (r.bucket, r.place) for r in view.depth_order(df, (0.0, 0.0, 1.0)).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1][1])] == [0, 1, 2, 3]


def test_cached_encode_and_keys(encoded, tmp_path):
    _, _, df, _ = encoded
    few = df.where("frame < 3")
    a = codec.encode_cached(few, str(tmp_path), "clip", gop=1, pos_mm=5.0)
    assert os.path.basename(a) == "clip_gop5_pos_mm5-0"
    before = os.stat(a).st_mtime_ns
    assert codec.encode_cached(few, str(tmp_path), "clip", gop=5, pos_mm=5.0) == a and os.stat(a).st_mtime_ns == before
    assert json.loads(codec.report_json({"ratio": 2.0})) == {"ratio": 2.0}


def test_view_changes():
    from trackloom.operators.view import same_view

    assert same_view((0, 0, 1), (0, 0.05, 0.999), 3, 3) and not same_view((0, 0, 1), (0, 0, 1), 3, 4) and not same_view((0, 0, 1), (0, 1, 0), 3, 3)
