"""Scores of windows against an exponentially decayed reference of their channel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to
from tidelens.operators import forecast
from tidelens.operators.windows import DECAY, Sliding, summaries

#: Readings before a channel is scored, and the least sigma of a reference.
WARMUP, FLAT = 120, 1e-9
SCORED = "channel string, start_ms bigint, end_ms bigint, n bigint, window_mean double, reference_mean double, reference_sigma double, mean_z double, dispersion_z double, score double"


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """The windows of a channel in order: each is scored against the ones before it, then folded into the reference.

    Blocks are combined by weight, mean and sum of squares about it, as decayed Welford updates would be.
    """
    pdf = pdf.sort_values("start_ms")
    weight = mean = m2 = 0.0
    count, out = 0, []
    for r in pdf.itertuples(index=False):
        sigma = np.sqrt(max(m2 / (weight - 1), 0.0)) if weight > 1 else 0.0
        if count >= WARMUP and sigma > FLAT:
            mz = abs(r.mean - mean) / sigma * np.sqrt(r.n)
            dz = abs(np.sqrt(r.var) / sigma - 1) * np.sqrt(r.n / 2)
            out.append((r.channel, r.start_ms, r.end_ms, r.n, r.mean, mean, sigma, mz, dz, max(mz, dz)))
        old = DECAY**r.n * weight
        total, delta = old + r.dw, r.dmean - mean
        m2 = DECAY**r.n * m2 + r.dm2 + delta * delta * old * r.dw / total
        mean += delta * r.dw / total
        weight, count = total, count + r.n
    return pd.DataFrame(out, columns=[x.split()[0] for x in SCORED.split(", ")])


def zscores(readings: DataFrame, windows: Sliding) -> DataFrame:
    """Scores of all windows that are not thin and whose reference is warm and not flat.

    Only window summaries, six numbers a window, are grouped by channel; the fold over a channel's windows is
    sequential by definition.
    """
    return summaries(readings, windows).groupBy("channel").applyInPandas(_fold, SCORED)


def onsets(readings: DataFrame, scores: DataFrame, windows: Sliding) -> DataFrame:
    """``scores`` with ``onset_ms``: the first reading three sigma off the reference mean, else the one farthest off.

    The asked windows are dealt to their panes, so a reading is not repeated but where such a window has it.
    """
    points = readings.select("channel", floor_to("event_ts_ms", windows.slide).alias("pane"), "event_ts_ms", "arrival", "value")
    off = F.abs(F.col("value") - F.col("reference_mean"))
    asked = scores.select("channel", "start_ms", "reference_mean", "reference_sigma", F.explode(F.sequence("start_ms", F.col("start_ms") + (windows.size - windows.slide), F.lit(windows.slide).cast("bigint"))).alias("pane"))
    hit = points.join(asked, ["channel", "pane"]).withColumn("off", off)
    at = F.struct("event_ts_ms", "arrival")
    found = hit.groupBy("channel", "start_ms").agg(
        F.min(F.when(F.col("off") >= 3 * F.col("reference_sigma"), F.col("event_ts_ms"))).alias("first"),
        F.min_by(F.col("event_ts_ms"), F.struct(-F.col("off"), at)).alias("farthest"),
    )
    return scores.join(found, ["channel", "start_ms"]).withColumn("onset_ms", F.coalesce("first", "farthest")).drop("first", "farthest")


#: Detectors by name: from readings and windows to ``channel, start_ms, end_ms, score`` and what else they tell.
DETECTORS: dict[str, Callable[[DataFrame, Sliding], DataFrame]] = {
    "zscore": zscores,
    "residual": lambda readings, windows: forecast.residual_scores(readings, windows, max(1, windows.size // 48)),
}


def score_with(name: str, readings: DataFrame, windows: Sliding) -> DataFrame:
    """The scores of a registered detector, with its name in ``detector``."""
    if name not in DETECTORS:
        raise ValueError(f"no detector {name}; there are {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name](readings, windows).withColumn("detector", F.lit(name))
