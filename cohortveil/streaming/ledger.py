"""The session budget over requests that arrive as a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "user string, request_id string, ts timestamp, cost long, spent long, accepted boolean"
STATE = "spent long"


def stream_budget(requests: DataFrame, budget: int, window: str = "24 hours") -> DataFrame:
    """Accept or refuse each arriving request within its user's budget.

    ``requests``: user, request_id, ts, cost.  A repeated request id inside the
    window is dropped.  A user's spending is forgotten once event time has moved
    a window past their last request.  Within a micro-batch a user's requests are taken by time.
    """
    idle = int(pd.Timedelta(window).total_seconds() * 1000)

    def charge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, latest = (state.get[0] if state.exists else 0), state.getCurrentWatermarkMs()
        for batch in batches:
            batch = batch.sort_values(["ts", "request_id"])
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            accepted, running = [], []
            for cost in batch["cost"]:
                fits = spent + int(cost) <= budget
                spent += int(cost) if fits else 0
                accepted.append(fits)
                running.append(spent)
            yield batch.assign(spent=running, accepted=accepted)[
                ["user", "request_id", "ts", "cost", "spent", "accepted"]]
        state.update((spent,))
        state.setTimeoutTimestamp(latest + idle)

    fresh = requests.withWatermark("ts", window).dropDuplicatesWithinWatermark(["request_id"])
    return fresh.groupBy("user").applyInPandasWithState(
        charge, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
