"""Call stacks from live branch and loss streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackweave.operators import stack_fold as fold
from stackweave.operators.branches import classify_branches
from stackweave.operators.stacks import FRAME_FIELDS, ROW_FIELDS, fold_columns

_ROW, _LOSS = 0, 1
_OUTPUT = "tid long, n long, " + ", ".join(f"{c} long" for c in FRAME_FIELDS)


def tagged_rows(branches: DataFrame, locations: DataFrame, losses: DataFrame) -> DataFrame:
    """Branches and losses of all threads in one stream, as integers."""
    rows = classify_branches(branches, locations).select(
        "tid", F.lit(_ROW).alias("tag"), *fold_columns())
    zero = F.lit(0).cast("long")
    lost = losses.select("tid", F.lit(_LOSS).alias("tag"),
                         *[{"time": F.col("time"), "cpu": F.col("cpu")}.get(name, zero).alias(name)
                           for name in ROW_FIELDS])
    return rows.unionByName(lost)


def _step(idle_ms: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Hold rows until the watermark has passed them, then fold them in id order."""
        stored = pickle.loads(state.get[0]) if state.exists else ([], [], None, 0)
        rows, losses, fold_state, emitted = stored
        for batch in batches:
            is_row = batch["tag"] == _ROW
            rows.extend(batch.loc[is_row, ROW_FIELDS].itertuples(index=False, name=None))
            losses.extend(batch.loc[~is_row, ["time", "cpu"]].itertuples(index=False, name=None))
        passed = state.getCurrentWatermarkMs()

        def due(time: int) -> bool:
            return time // 1_000_000 < passed

        ready = sorted(row for row in rows if due(row[1]))
        lost = sorted(loss for loss in losses if due(loss[0]))
        rows = [row for row in rows if not due(row[1])]
        losses = [loss for loss in losses if not due(loss[0])]
        fold_state = fold_state or (-1, -1, 0, 0, [], [])
        latest = max([fold_state[3], *(row[1] for row in ready)])
        quiet = not rows and not losses and latest // 1_000_000 + idle_ms < passed
        frames, fold_state = fold.fold_open(ready, lost, fold_state, quiet)
        if quiet:
            state.remove()
        else:
            waiting = [r[1] for r in rows] + [loss[0] for loss in losses]
            wake = min(waiting) // 1_000_000 + 1 if waiting else fold_state[3] // 1_000_000 + idle_ms + 1
            state.update((pickle.dumps((rows, losses, fold_state, emitted + len(frames))),))
            state.setTimeoutTimestamp(max(wake, passed + 1))
        columns = list(zip(*frames)) if frames else [()] * len(FRAME_FIELDS)
        data = {"tid": [key[0]] * len(frames), "n": range(emitted + 1, emitted + 1 + len(frames))}
        data.update(zip(FRAME_FIELDS, columns))
        yield pd.DataFrame(data, dtype="int64")

    return step


def stream_reconstruct_stacks(branches: DataFrame, locations: DataFrame, losses: DataFrame,
                              delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Frames with raw depths, numbered per thread, as they close.

    Rows wait for the watermark (`delay` behind the latest time), so losses and rows merge in time
    order. A thread without rows for `idle_ms` counts as ended. One thread's rows are folded in
    order by one task, batch by batch; a trigger limit bounds the batch.
    """
    rows = tagged_rows(branches, locations, losses).withColumn(
        "at", F.timestamp_millis(F.call_function("div", F.col("time"), F.lit(1_000_000).cast("long"))))
    return (rows.withWatermark("at", delay).groupBy("tid")
            .applyInPandasWithState(_step(idle_ms), _OUTPUT, "blob binary", "append",
                                    GroupStateTimeout.EventTimeTimeout))
