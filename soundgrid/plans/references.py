"""Reference levels of comparable segments: weights, medians, targets, groups.

Groups are at most the 64 segments of one track.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundgrid.operators import kernels

# Fixed values of the comparison profile.
GROUP = {"harmonic": 0.85, "timbre": 0.80, "alignment": 0.82, "combined": 0.85}
PAIR = {"harmonic": 0.92, "timbre": 0.90, "alignment": 0.90, "combined": 0.92}
SEPARATION, MARGIN, DEADBAND, CAP = 0.08, 0.12, 1.0, 0.40


def water_fill(members: DataFrame, group: list[str], order: str, quality: str) -> DataFrame:
    """Member weights in proportion to utility, none above 0.40.

    At most two members can reach the cap, so three passes of sums are exact.
    """
    w = Window.partitionBy(*group)
    d = members.withColumns({"_u": 0.5 + 0.5 * F.col(quality), "_cap": F.lit(False), "_left": F.lit(1.0)})
    for _ in range(2):
        total = F.sum(F.when(~F.col("_cap"), F.col("_u"))).over(w)
        d = d.withColumn("_over", F.when(~F.col("_cap") & (F.col("_left") * F.col("_u") / total > CAP), F.col(order)))
        d = d.withColumn("_first", F.min("_over").over(w))
        hit = F.col("_first").isNotNull()
        d = d.withColumns({"_cap": F.col("_cap") | (hit & (F.col(order) == F.col("_first"))), "_left": F.col("_left") - F.when(hit, CAP).otherwise(0.0)})
    share = F.col("_left") * F.col("_u") / F.sum(F.when(~F.col("_cap"), F.col("_u"))).over(w)
    return d.withColumn("weight", F.when(F.col("_cap"), CAP).otherwise(share)).drop("_u", "_cap", "_left", "_over", "_first")


def weighted_lower_median(members: DataFrame, group: list[str], order: str, value: str, weight: str, out: str) -> DataFrame:
    """First value, by value then order, where the running weight reaches one half."""
    w = Window.partitionBy(*group).orderBy(value, order).rowsBetween(Window.unboundedPreceding, 0)
    d = members.withColumn("_c", F.sum(weight).over(w))
    half = F.when(F.round(F.col("_c"), 12) >= 0.5, F.struct(F.col(value), F.col(order)))
    return d.groupBy(*group).agg(F.coalesce(F.min(half)[value], F.max(value)).alias(out))


def target(level: Column, reference: Column, confidence: Column, deadband: float = DEADBAND) -> tuple[Column, Column]:
    """Correction towards the reference beyond the dead band, and the same times confidence."""
    diff = reference - level
    raw = F.signum(diff) * F.greatest(F.lit(0.0), F.abs(diff) - deadband)
    return raw, raw * confidence


def groups(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Complete-linkage groups and leftover mutual pairs of each track.

    `scores` has a, b and the four scores of every compared pair. One track's pair
    table (at most 2016 rows) is one small task.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.schema if f.name in keys)
    schema += ", kind string, grp int, seg int, quality double, confidence double"

    def smooth(x: float) -> float:
        x = min(1.0, max(0.0, x))
        return x * x * (3 - 2 * x)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        segs = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {s: i for i, s in enumerate(segs)}
        n = len(segs)
        c, ok, pair_ok = np.zeros((n, n)), np.zeros((n, n), bool), np.zeros((n, n), bool)
        for r in pdf.itertuples(index=False):
            i, j = at[r.a], at[r.b]
            c[i, j] = c[j, i] = r.combined
            ok[i, j] = ok[j, i] = all(getattr(r, k) >= v for k, v in GROUP.items())
            pair_ok[i, j] = pair_ok[j, i] = all(getattr(r, k) >= v for k, v in PAIR.items())
        rows, used, number = [], set(), 0
        for g in kernels.complete_linkage(n, ok, c):
            if len(g) < 3:
                continue
            inside = c[np.ix_(g, g)]
            off = ~np.eye(len(g), dtype=bool)
            cohesion = float(inside[off].min())
            rest = [k for k in range(n) if k not in g]
            separation = cohesion - (float(c[np.ix_(g, rest)].max()) if rest else 0.0)
            if separation < SEPARATION:
                continue
            confidence = smooth((cohesion - GROUP["combined"]) / 0.10) * smooth((separation - SEPARATION) / 0.12)
            for k, m in enumerate(g):
                q = min(1.0, max(0.0, (float(inside[k][off[k]].min()) - GROUP["combined"]) / 0.10))
                rows.append(("group", number, segs[m], q, confidence))
                used.add(m)
            number += 1
        free = [i for i in range(n) if i not in used]
        for i in free:
            for j in free:
                if j <= i or not pair_ok[i, j]:
                    continue
                others_i, others_j = np.delete(c[i], [i, j]), np.delete(c[j], [i, j])
                second = max(others_i.max(initial=0.0), others_j.max(initial=0.0))
                margin = float(c[i, j] - second)
                if margin < MARGIN:
                    continue
                confidence = smooth((c[i, j] - PAIR["combined"]) / 0.06) * smooth((margin - MARGIN) / 0.12)
                rows += [("pair", number, segs[i], 1.0, confidence), ("pair", number, segs[j], 1.0, confidence)]
                number += 1
        out = pd.DataFrame(rows, columns=["kind", "grp", "seg", "quality", "confidence"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return scores.groupBy(*keys).applyInPandas(one, schema)
