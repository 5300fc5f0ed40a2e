"""A budget kept on a stream: entries in order of time, per key, while what was spent before them stays below a cap."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "k string, ts timestamp, id long, cost double, spent_before double"
_STATE = "spent double, waiting string"


def _below(costs: pd.Series, spent: float, cap: float) -> pd.Series:
    """Which entries, in order, have less than the cap spent before them."""
    return costs.shift(fill_value=spent).cumsum() < cap


def _affordable(entries: list[tuple], spent: float, cap: float) -> list[tuple]:
    """Entries in order, up to where the cap is reached."""
    kept = []
    for entry in sorted(map(tuple, entries)):
        if not spent < cap:
            break
        kept.append(entry)
        spent += entry[2]
    return kept


def budgeted(stream: DataFrame, *, key: Column, ts: str, entry_id: str, cost: Column, cap: float, late: str) -> DataFrame:
    """k, ts, id, cost, spent_before of the entries within the budget of their key; append mode.

    An entry's turn comes when the watermark has passed its time, as until then an earlier one can still come;
    entries of one time go by id. Entries that come later than allowed are left out by Spark. State per key: what
    is spent, and the entries whose turn hasn't come; once the cap is reached no entry waits any more, nor does one
    wait behind others whose costs reach it: earlier entries only add to these. Costs aren't negative, and a null one is 0; entries without time or id are left out. So the result is that of a running sum
    over the whole table, whatever the batches, and after a restart from its checkpoint, too.
    """
    rows = stream.select(key.cast("string").alias("k"), F.col(ts).cast("timestamp").alias("ts"), F.col(entry_id).cast("long").alias("id"), F.coalesce(cost.cast("double"), F.lit(0.0)).alias("cost"))
    rows = rows.where("ts IS NOT NULL AND id IS NOT NULL").withWatermark("ts", late)

    def taken(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, text = state.get if state.exists else (0.0, "[]")
        waiting = json.loads(text)
        if not state.hasTimedOut:
            for f in frames:
                f = f.assign(ts=f["ts"].astype("datetime64[us]").astype("int64")).sort_values(["ts", "id", "cost"])
                f = f[_below(f["cost"], spent, cap)]
                waiting += zip(f["ts"].tolist(), f["id"].tolist(), f["cost"].tolist())
                waiting = _affordable(waiting, spent, cap)
        passed = state.getCurrentWatermarkMs() * 1000
        out, rest = [], []
        for at, number, price in sorted(map(tuple, waiting)):
            if at > passed:
                rest.append((at, number, price))
            elif spent < cap:
                out.append((k[0], at, number, price, spent))
                spent += price
        rest = rest if spent < cap else []
        state.update((spent, json.dumps(rest)))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, passed // 1000 + 1))
        if out:
            frame = pd.DataFrame(out, columns=["k", "ts", "id", "cost", "spent_before"])
            yield frame.assign(ts=pd.to_datetime(frame["ts"], unit="us"))

    return rows.groupBy("k").applyInPandasWithState(taken, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def append_to(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming query over what is there, append its rows to Parquet files, and read these."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
