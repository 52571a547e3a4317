"""Streaming twins: running statistics and a Kalman filter whose state Spark keeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.motion import Kalman

STATE = "x0 double, x1 double, p00 double, p01 double, p11 double, past array<double>"


def running_stats(events: DataFrame, key: str, value: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, population variance, min and max by key and window of event time."""
    v = F.col(value).cast("double")
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))


def kalman_stream(series: DataFrame) -> DataFrame:
    """key, t, z, x of a stream (key, t, z), in the order of t within each trigger."""

    def run(key, batches, state):
        pdf = pd.concat(list(batches)).sort_values("t")
        z, out, k = pdf["z"].to_numpy(float), [], None
        if state.exists:
            x0, x1, a, b, c, past = state.get
            k = Kalman(x0, x1)
            k.p, k.past = np.array([[a, b], [b, c]]), list(past)
        for v in z:
            if k is None:
                k = Kalman(v, 0.0)
                out.append(v)
            else:
                out.append(k.update(v))
        state.update((float(k.x[0]), float(k.x[1]), float(k.p[0, 0]), float(k.p[0, 1]), float(k.p[1, 1]), [float(p) for p in k.past]))
        yield pdf.assign(x=out)[["key", "t", "z", "x"]]

    return series.groupBy("key").applyInPandasWithState(run, "key string, t long, z double, x double", STATE, "append", "NoTimeout")
