"""Rules along a key, told for each event of a stream as it comes.

The rules are those of the batch folds (``operators.ordered``); a key's state is kept in
Spark's state store, so that a query that stops and starts again from its checkpoint says
what one fold over all events says. The state store must be RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Decide(StatefulProcessor):
    """A step for each row of a key, in order of time within a batch; state that is over is cleared by a timer."""

    def __init__(self, order: list[str], step: Callable[[dict, dict], object], result: str, over: Callable[[dict], float | None] | None):
        self.order, self.step, self.result, self.over = order, step, result, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def _held(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._held()
        for row in sorted((r.asDict() for r in rows), key=lambda r: tuple(r[c] for c in self.order)):
            yield Row(**row, **{self.result: self.step(state, row)})
        self.state.update((json.dumps(state),))
        if self.over is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if (at := self.over(state)) is not None:
                self.handle.registerTimer(int(at * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def decided(
    events: DataFrame, key: str, time: str, tie: str, step: Callable[[dict, dict], object], result: str, kind: T.DataType, late: str = "10 minutes", over: Callable[[dict], float | None] | None = None
) -> DataFrame:
    """Stream of ``events`` with what ``step`` says of each: rows of a batch in order of ``time`` and ``tie``, batches as they come.

    ``over`` tells from a key's state when (in seconds of event time) it says nothing any
    more; once the watermark, ``late`` behind, passes that, the state goes. Events without a
    key or time are not told. Rows of one key in one batch are sorted in memory: bound the
    batch (``maxFilesPerTrigger`` or the like).
    """
    rows = events.where(events[key].isNotNull() & events[time].isNotNull()).withWatermark(time, late)
    schema = T.StructType([*events.schema.fields, T.StructField(result, kind)])
    return rows.groupBy(key).transformWithState(_Decide([time, tie], step, result, over), schema, "Append", "EventTime")
