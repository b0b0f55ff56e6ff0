"""Micro-fixtures, configuration, and that the optional part can be missing."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions import scalar
from trackloom.functions.arrow import half_bits, half_value
from trackloom.functions.ordering import neighbours, ordinals, running_sums
from trackloom.operators import hold


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_quantizers(spark):
    cases = [(0, 9, 0), (4, 9, 0), (5, 9, 1), (-4, 9, 0), (-5, 9, -1), (255, 9, 28), (-128, 3, -43), (127, 3, 42), (255, 17, 15)]
    assert values(spark, *(scalar.quantize_int(F.lit(v), s) for v, s, _ in cases)) == [w for *_, w in cases]
    assert values(spark, *(scalar.quantize(F.lit(v), 1.0) for v in (2.5, -2.5, 0.49999999999999994, 1e300, -1e300))) == [3, -3, 0, 2**31 - 1, -(2**31)]


def test_zigzag_and_morton(spark):
    v = [*range(-4, 5), 32_767, -32_768, 123_456_789, -987_654_321]
    z = values(spark, *(scalar.zigzag(F.lit(x)) for x in v))
    assert z == [abs(x) * 2 - (x < 0) for x in v] and values(spark, *(scalar.unzigzag(F.lit(x)) for x in z)) == v
    at = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 5, 7)]
    assert values(spark, *(scalar.morton(*(F.lit(c).cast("long") for c in p)) for p in at)) == [1, 2, 4, 431]
    full, low = 2**21 - 1, (1 << 58) - 1
    big = values(spark, *(scalar.sort_key(F.lit(0), scalar.morton(*(F.lit(full if k == j else 0).cast("long") for k in range(3)))) for j in range(3)))
    assert big == [164703072086692425, 41175768021673106, 82351536043346212] and max(big) <= low
    assert values(spark, scalar.sort_key(F.lit(16), F.lit(0).cast("long"))) == [4611686018427387904]


@pytest.mark.parametrize("bound", [0, 1, 4, 16, 32])
def test_hold_equals_quantize_at_the_codecs_step(bound):
    rng = np.random.default_rng(bound)
    v = rng.integers(-300, 300, (60, 50, 2)).astype(float)
    step = 2 * bound + 1
    assert (hold.fold_tracks(v, step, bound, True) == np.floor((v + bound) / step)).all()


def test_halves():
    x = np.array([0.0, 1.0, -2.5, 32000.0, 1e9, 1e-9, 6e-5, np.pi], np.float32)
    back = half_value(half_bits(x))
    assert back[:4].tolist() == [0, 1, -2.5, 32000] and np.isinf(back[4]) and abs(back[5]) < 1e-7
    assert np.abs(back[6:] - x[6:]).max() <= np.pi / 1024 and (np.abs(back) <= np.abs(x) + 1e-12)[:4].all()


def test_orders(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000 % 300).alias("key"), F.col("id"))
    rows = sorted(ordinals(df, "key", "id", ranges=5).collect(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(1000)) and [(r.key, r.id) for r in rows] == sorted((r.key, r.id) for r in rows)
    o = ordinals(df, "key", "id")
    assert all((r.ord == 0) == (r.prev_key is None) for r in neighbours(o, "ord", ["key"]).collect())
    total, want = 0, {}
    for r in rows:
        total += r.id
        want[r.ord] = total
    assert {r.ord: r.sum_id for r in running_sums(o, "ord", ["id"], 64).collect()} == want
    assert ordinals(df.limit(0), "key", "id").count() == 0
    one = spark.range(500).select(F.lit(1.5).alias("key"), F.col("id"))  # one key: its ranges are cut by the tie
    assert [r.id for r in sorted(ordinals(one, "key", "id", ranges=6).collect(), key=lambda r: r.ord)] == list(range(500))


def test_configuration():
    b = config.Bounds()
    s = b.steps
    assert (s.pos, s.base_pos, s.rgb, s.rot) == (0.004, 0.002, 9, 1) and s.scale_log == 2 * s.base_scale_log
    assert config.clamp_request(pos_mm=0, gop=1000, zstd_level=3) == {"pos_mm": 0.1, "gop": 300, "zstd_level": 3}
    assert [config.human_bytes(x) for x in (999, 1500, 2_500_000, 3e9)] == ["999 B", "1.50 KB", "2.50 MB", "3.00 GB"]
    with pytest.raises(ValueError):
        config.check_gop(0)


def test_the_rest_works_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("trackloom", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "trackloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_rest_works_without_a_library_of_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {root!r}]; import __spark_entry__ as e; assert 'quantize_float' in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True)


def test_workers_elsewhere_get_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from trackloom.plans import catalog\n"
        "assert catalog.queries()['hold_in_buckets'](s, '/root/testdata/sf0.001').count() == 6000\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
