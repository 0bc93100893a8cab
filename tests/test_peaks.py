"""True peaks of several versions of a signal, over blocks far smaller than a track."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from soundgrid.operators import peaks


def brute(x, factors):
    """Sample and true peak per factor of a sparse two-channel signal {frame: (l, r)}."""
    end = max(x) + peaks.TAIL_FRAMES
    out = []
    for f in factors:
        v = np.zeros((end + 1, 2))
        for at, lr in x.items():
            v[at] = np.array(lr) * f
        inter = max(np.abs(np.convolve(v[:, c], p)[: end + 1]).max() for c in range(2) for p in peaks.TRUE_PEAK_PHASES)
        out.append((np.abs(v).max(), max(inter, np.abs(v).max())))
    return np.array(out)


@pytest.mark.parametrize("block", [16, 64, 1 << 16])
def test_versions_over_blocks(spark, block):
    rng = np.random.default_rng(block)
    places = {1: range(300), 2: range(0, 900, 7), 3: sorted(rng.choice(2000, 80, replace=False)), 4: [5], 5: [15, 16, 31, 48, 60], 6: range(40, 64), 7: [0, 9, 700]}
    tracks = {k: {int(p): tuple(rng.normal(size=2).tolist()) for p in v} for k, v in places.items()}
    rows = [(k, p, l / 2, r / 2, 0.5) for k, v in tracks.items() for p, (l, r) in v.items() for _ in range(2)]  # two samples a frame
    df = spark.createDataFrame(rows, "track_id int, frame long, l double, r double, g double")
    factors = [F.lit(1.0), F.col("g"), F.when(F.col("g") > 0, 2.0 * F.col("g") + 1.0)]
    got = {r.track_id: np.array([r.sample_peaks, r.true_peaks]).T for r in peaks.true_peaks(df, ["track_id"], "frame", ["l", "r"], factors, ["g"], block).collect()}
    assert got.keys() == tracks.keys()
    for k, v in tracks.items():
        assert np.allclose(got[k], brute(v, [1.0, 0.5, 2.0]), atol=1e-12), k


def test_no_row_is_copied_per_tap(spark):
    df = spark.range(100).selectExpr("id % 2 AS track_id", "id AS frame", "1D AS l", "1D AS r")
    plan = peaks.true_peak(df, ["track_id"], "frame", ["l", "r"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and all(f"p{i}" not in plan for i in range(4))
