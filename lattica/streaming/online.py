"""Online quantization on the sphere as a structured stream: state per run, one pass over points as they arrive.

The state of a run is its centers and its step number; a batch's points are taken by (ts, point_id), and each moves the
nearest center by gamma0 (t + 1)^-decay of the way. Every key's centers are emitted after each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import SphereKernel

STATE = "t long, centers array<array<double>>"
OUT = "run_slot int, t long, cid int, x array<double>"


def online_quantization(points: DataFrame, k: int, gamma0: float = 1.0, decay: float = 0.6) -> DataFrame:
    """points: a stream of (run_slot int, ts timestamp, point_id long, x array<double>)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel = SphereKernel()
        t, centers = state.get if state.exists else (0, [])
        centers = [np.array(c, float) for c in centers]
        rows = pd.concat(list(batches)).sort_values(["ts", "point_id"])
        for x in rows["x"]:
            x = np.array(x, float)
            if len(centers) < k:
                centers.append(x)  # the first k points are the first centers
                continue
            kernel.drift(centers[kernel.nearest(centers, x)], x, min(1.0, gamma0 * (t + 1) ** -decay), None)
            t += 1
        state.update((int(t), [[float(v) for v in c] for c in centers]))
        yield pd.DataFrame({"run_slot": key[0], "t": t, "cid": range(len(centers)), "x": [[float(v) for v in c] for c in centers]})

    return points.groupBy("run_slot").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def energy_per_window(points: DataFrame, energy: str = "energy", late: str = "10 minutes", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Mean energy by event-time window and run, with a watermark for late rows; tumbling, or sliding if slide is given."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return points.withWatermark("ts", late).groupBy(window, "run_slot").agg(F.avg(energy).alias("energy"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "run_slot", "energy", "n")
