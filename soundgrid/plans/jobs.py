"""End-user jobs over a whole catalogue, and the stage contract they are built from."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.operators import cells, loudness, pcm, peaks
from soundgrid.session import materialise


@dataclass(frozen=True)
class Stage:
    """A named step DataFrame -> DataFrame with the columns it needs and adds."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()
    enabled: bool = True


def chain(stages: list[Stage], order: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Compose the enabled stages for df.transform, in the order given by name.

    The order must be a permutation of the names, and every stage's needs must be
    met when its turn comes; both are checked while the plan is built.
    """
    by_name = {s.name: s for s in stages}
    order = order or [s.name for s in stages]
    if len(by_name) != len(stages) or sorted(order) != sorted(by_name):
        raise ValueError("the order is not a permutation of the stages")

    def run(df: DataFrame) -> DataFrame:
        for s in (by_name[n] for n in order):
            if not s.enabled:
                continue
            missing = [c for c in s.needs if c not in df.columns]
            if missing:
                raise ValueError(f"stage {s.name} needs {missing}")
            df = df.transform(s.run)
        return df

    return run


def output_report(samples: DataFrame, keys: list[str], hop: int, rate: int | None = None) -> DataFrame:
    """Loudness, range, true peak and stereo measures per track; K-weighted when a rate is given.

    Every part is an aggregation by track; they meet in joins on the track key. The
    timeline is written once: gates, maxima and range all read it.
    """
    hops = cells.extents(samples, keys, "frame").agg(F.sum(F.expr(f"(frames - 1) div {hop} + 1"))).first()[0] or 0  # one number
    if rate is None:
        t = loudness.timeline(samples, keys, hop, hops)
    else:
        e = pcm.weighted_energy(pcm.chunks(samples, keys, hop), keys, hop, rate)
        t = loudness.from_hops(e.withColumnRenamed("chunk", "hop"), keys, hop, hops)
    t = materialise(t)
    integrated = loudness.integrated(t, keys).select(*keys, F.col("lufs").alias("integrated"))
    maxima = t.groupBy(*keys).agg(scalar.lufs(F.max("m_power")).alias("momentary"), scalar.lufs(F.max("s_power")).alias("short_term"))
    lra = loudness.loudness_range(t, keys).select(*keys, "lra")
    tp = peaks.true_peak(samples, keys, "frame", ["l", "r"]).select(*keys, "true_peak")
    l, r = F.col("l"), F.col("r")
    st = samples.groupBy(*keys).agg(
        (F.max("frame") + 1).alias("frames"), F.sum(l * l).alias("_ll"), F.sum(r * r).alias("_rr"), F.sum(l * r).alias("_lr"),
        F.sum(scalar.mid(l, r) ** 2).alias("_m"), F.sum(scalar.side(l, r) ** 2).alias("_s"))
    d = st.join(integrated, keys, "left").join(maxima, keys, "left").join(lra, keys, "left").join(tp, keys, "left")
    return d.select(
        *keys, "frames", "integrated", "momentary", "short_term", "lra", "true_peak", scalar.amplitude_db(F.col("true_peak")).alias("true_peak_db"),
        scalar.meter_correlation(F.col("_ll"), F.col("_rr"), F.col("_lr")).alias("correlation"),
        (F.col("_m") / F.col("frames")).alias("mid_power"), (F.col("_s") / F.col("frames")).alias("side_power"))


def batch_plan(report: DataFrame, keys: list[str], name: str, target_db: float, extension: str = ".wav") -> DataFrame:
    """Gain, output name and failure of every track of a batch, all at once."""
    d = report.withColumn("target", F.concat(F.col(name), F.lit(extension)))
    clash = d.groupBy(F.lower("target").alias("_t")).agg(F.count("*").alias("_n"))
    d = d.join(clash, F.lower("target") == F.col("_t"))
    failure = F.when(F.col("_n") > 1, "name_collision").when(F.col("integrated").isNull(), "no_loudness")
    return d.select(
        *keys, "target", scalar.normalise_gain(F.col("true_peak"), target_db).alias("gain"), failure.alias("failure"))
