"""Per-key state over streams, with the contracts of the older API."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def map_with_state(stream: DataFrame, key: str, value: str, start: tuple, state_schema: str, out_schema: str, step: Callable[[object, tuple, Iterable], tuple[tuple, list[tuple]]], timeout_ms: int | None = None) -> DataFrame:
    """Rows of step(key, state, values) -> (new state, output rows) for keys with input; with a timeout, step gets no values once a key has been idle, and its state is dropped."""
    names = [c.split()[0] for c in out_schema.split(",")]

    def run(k, frames, state: GroupState):
        old = tuple(state.get) if state.exists else start
        if state.hasTimedOut:
            _, rows = step(k[0], old, [])
            state.remove()
        else:
            values = pd.concat(list(frames))[value].tolist()
            new, rows = step(k[0], old, values)
            state.update(new)
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=names)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", kind)


class UpdateStateByKey:
    """State of every key, visited in each batch whether the key has input or not, as the oldest stateful operator has it.

    update(values, state or None) gives the new state or None to drop the key. The state is a table in the shared folder that
    each batch rewrites; use as foreachBatch's function, snapshot() is the state after the last batch.
    """

    def __init__(self, key: str, value: str, update: Callable[[list, object], object], state_type: str = "double"):
        self.key, self.value, self.update, self.type, self.path = key, value, update, state_type, None

    def __call__(self, batch: DataFrame, number: int) -> None:
        from tessera.operators.lineage import scratch

        spark, update = batch.sparkSession, self.update
        new = batch.select(self.key, self.value)
        old = spark.read.parquet(self.path) if self.path else spark.createDataFrame([], f"k {dict(new.dtypes)[self.key]}, s {self.type}")

        def both(k, a, b):
            state = update(a.iloc[:, 1].tolist(), b.s.iloc[0] if len(b) else None)
            return pd.DataFrame({"k": [k[0]], "s": [state]}) if state is not None else pd.DataFrame({"k": [], "s": []})

        out = new.groupBy(self.key).cogroup(old.groupBy("k")).applyInPandas(both, old.schema)
        path = scratch(spark, f"state-{number}")
        out.write.parquet(path)
        self.path = path

    def snapshot(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)


class Sessions:
    """Session windows over batches that come in order of time, as foreachBatch's function: rows of a key less than gap seconds apart are one session.

    Each batch's sessions are written once, as (key, last: time of the last row, n: rows), by the executors into the shared folder. Those that a
    later batch may extend go into the next batch as one row each, and count there; all others are never touched again.
    """

    def __init__(self, key: str, time: str, gap: int):
        self.key, self.time, self.gap, self.path, self.batches = key, time, gap, None, {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        from tessera.operators.lineage import scratch

        spark = batch.sparkSession
        self.path = self.path or scratch(spark, "sessions")
        rows = batch.select(self.key, F.col(self.time).alias("last"), F.lit(1).cast("long").alias("n"))
        if before := [k for k in self.batches if k < number]:
            rows = rows.union(self._written(spark, max(before), True))
        # session_window also joins what is exactly its gap apart
        found = rows.groupBy(self.key, F.session_window("last", f"{self.gap - 1}.999999 seconds")).agg(F.max("last").alias("last"), F.sum("n").alias("n"))
        found.drop("session_window").write.mode("overwrite").parquet(f"{self.path}/{number}")
        self.batches[number] = rows.schema, None
        self.batches[number] = rows.schema, self._written(spark, number).agg(F.unix_micros(F.max("last"))).first()[0]

    def _written(self, spark, number: int, still_open: bool | None = None) -> DataFrame:
        schema, high = self.batches[number]
        out = spark.read.schema(schema).parquet(f"{self.path}/{number}")
        ahead = F.unix_micros("last") + self.gap * 1_000_000 >= F.lit(high)
        return out if still_open is None else out.filter(ahead if still_open else ~ahead)

    def sessions(self, spark) -> DataFrame | None:
        """All sessions after the last batch; None where there was no batch."""
        last = max(self.batches, default=None)
        return functools.reduce(DataFrame.union, [self._written(spark, k, None if k == last else False) for k in self.batches]) if self.batches else None
