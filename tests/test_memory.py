"""Steps on spectra read their frames once, and hold few of them dense, however large a batch is."""
import re

import numpy as np

from soundgrid.operators import pcm

K = ["track_id"]


def test_frames_are_transformed_once(spark):
    df = spark.range(2000).selectExpr("id % 2 AS track_id", "id AS frame", "1D AS l", "1D AS r")
    frames = pcm.stft_frames(pcm.chunks(df, K, 64), K, 4)
    plan = pcm.long_term_spectrum(frames, K, 64, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(m) for m in ("MapInPandas", "MapInArrow")) == 1


def test_slices_cover_a_batch():
    for count, n in ((0, 4096), (1, 4096), (10_000, 4096), (10_000, 1 << 20)):
        got = [np.arange(count)[s] for s in pcm._slices(count, n)]
        assert np.array_equal(np.concatenate([*got, np.zeros(0, int)]), np.arange(count))
        assert all(len(g) * n <= max(n, 1 << 19) for g in got)


def test_frames_over_blocks_of_chunks(spark):
    """Each frame holds its own chunks, also where blocks meet and after the last chunk."""
    ch = spark.range(9000).selectExpr("id % 1 AS track_id", "id AS chunk", "9000 * 8L AS frames", "8L AS n", "array(0) AS pos", "array(id + 0D) AS l", "array(0D) AS r")
    got = {r.frame: sorted((p.slot, p.l[0]) for p in r.parts) for r in pcm.stft_frames(ch, K, 4).collect()}
    assert got == {f: [(c - f + 3, float(c)) for c in range(max(0, f - 3), min(f, 8999) + 1)] for f in range(9003)}


def test_tempo_scores_are_summed_where_they_arise(spark):
    from soundgrid.operators import onsets

    hist = spark.range(100).selectExpr("id % 2 AS track_id", "id AS bin", "1D AS salience", "1L AS pairs")
    plan = onsets.tempo_scores(hist, K)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [re.sub(r"#\d+L?", "", m) for m in moved] == ["track_id"]
