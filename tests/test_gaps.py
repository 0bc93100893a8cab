"""Greedy gaps over runs without a break, in blocks far smaller than the run."""
import random

import pytest

from soundgrid.operators import windows


def brute(places, gap):
    kept = []
    for p in sorted(places):
        if not kept or p - kept[-1] >= gap:
            kept.append(p)
    return kept


@pytest.mark.parametrize("block", [16, 64])
def test_one_unbroken_run(spark, block):
    r = random.Random(block)
    tracks = {
        1: list(range(1500)), 2: list(range(0, 3000, 7)), 3: sorted(r.sample(range(4000), 900)), 4: [5], 5: [0, 9, 10, 900, 909],
        6: [11 * i for i in range(400)], 7: sorted({13 * i + i % 3 for i in range(500)}), 8: list(range(40)) + list(range(2000, 2040)),
    }
    df = spark.createDataFrame([(k, p) for k, v in tracks.items() for p in v], "track_id int, pos long")
    got: dict[int, list[int]] = {}
    for x in windows.greedy_gap(df, ["track_id"], "pos", 10, block).collect():
        got.setdefault(x["track_id"], []).append(x["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(v, 10) for k, v in tracks.items()}
    assert windows.greedy_gap(df.limit(0), ["track_id"], "pos", 10, block).count() == 0
