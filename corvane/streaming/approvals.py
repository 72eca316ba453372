"""The approval workflow over a stream of actions: one small state a request."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import last_wins
from ..operators.workflow import TRANSITIONS, attempts
from ..session import shared_dir

ACTIONS = sorted({action for _, action in TRANSITIONS})
OUT = "app_id long, status string, n_actions long, n_illegal long"


def approvals(actions: DataFrame) -> DataFrame:
    """Each request's status after every micro-batch, of a stream of actions(app_id, seq, action).
    Actions of one batch are taken in order of seq; later batches are later actions. Late ones are
    always accepted, so there is no watermark. A batch holds 9 bytes an action of one request; the
    source's limits of a batch bound them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, bad = state.get if state.exists else ("NONE", 0, 0)
        parts = [(b["seq"].to_numpy(), pd.Index(ACTIONS).get_indexer(b["action"]).astype(np.int8)) for b in batches]
        order = np.argsort(np.concatenate([seq for seq, _ in parts]), kind="stable")
        for code in np.concatenate([codes for _, codes in parts])[order]:
            action = ACTIONS[code] if code >= 0 else None
            after = TRANSITIONS.get((status, action))
            status, n, bad = after or status, n + 1, bad + (after is None)
        state.update((status, n, bad))
        yield pd.DataFrame({"app_id": [key[0]], "status": [status], "n_actions": [n], "n_illegal": [bad]})

    return actions.groupBy("app_id").applyInPandasWithState(step, OUT, "status string, n long, bad long", "update", GroupStateTimeout.NoTimeout)


def decisions(applications: DataFrame, actions: DataFrame) -> DataFrame:
    """workflow.decided over a stream of actions; applications is a table. Each request's status and
    counts after every micro-batch."""
    tried = attempts(applications, actions)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, bad, denied, stale = state.get if state.exists else ("NONE", 0, 0, 0, 0)
        rows = [r for b in batches for r in b[["seq", "action", "expected", "allowed", "skips"]].itertuples(index=False)]
        text = lambda x: x if isinstance(x, str) else None
        for _, action, expected, allowed, skips in sorted(rows, key=lambda r: (r[0], text(r[1]) or "", text(r[2]) or "", r[3])):
            after, n = TRANSITIONS.get((status, action)), n + 1
            if text(expected) is not None and expected != status:
                stale += 1
            elif after is None:
                bad += 1
            elif not allowed:
                denied += 1
            else:
                status = "PENDING_L2" if after == "PENDING_L1" and skips else after
        state.update((status, n, bad, denied, stale))
        yield pd.DataFrame({"app_id": [key[0]], "status": [status], "n_actions": [n], "n_illegal": [bad], "n_denied": [denied], "n_stale": [stale]})

    out = f"{OUT}, n_denied long, n_stale long"
    return tried.groupBy("app_id").applyInPandasWithState(step, out, "status string, n long, bad long, denied long, stale long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, key: list[str]) -> DataFrame:
    """Runs what is there and returns the newest row of each key; micro-batches are written with
    their number, so that one that is repeated overwrites itself."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/corvane/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return last_wins(spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows"), key, "batch").drop("batch")
