"""Causal depth of a stream, event by event: an event waits until its last parent is placed, then goes out once.

The state of a history is kept as maps (in RocksDB): depths of placed events, what waiting events still lack, and
who waits for whom. Repeated events change nothing; an event below one that never comes stays in the state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import HISTORY

# what runs in Python workers travels with its code, so workers need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: The session setting that stateful operators of this kind need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_OUT = T.StructType([T.StructField(HISTORY, T.StringType()), T.StructField("id", T.StringType()), T.StructField("depth", T.LongType())])


class DepthProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getMapState("depth", "id string", "depth bigint")
        self.waits = handle.getMapState("waits", "id string", "missing int, deepest bigint")
        self.kids = handle.getMapState("kids", "parent string", "children array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int]] = []
        for pdf in rows:
            for id_, parents in zip(pdf["id"], pdf["parents"], strict=True):
                if self.depth.containsKey((id_,)) or self.waits.containsKey((id_,)):
                    continue
                deepest, missing = -1, []
                for p in parents:
                    if self.depth.containsKey((p,)):
                        deepest = max(deepest, self.depth.getValue((p,))[0])
                    else:
                        missing.append(p)
                if not missing:
                    self._place(id_, deepest + 1, out)
                    continue
                self.waits.updateValue((id_,), (len(missing), deepest))
                for p in missing:
                    known = list(self.kids.getValue((p,))[0]) if self.kids.containsKey((p,)) else []
                    self.kids.updateValue((p,), ([*known, id_],))
        yield pd.DataFrame({HISTORY: [key[0]] * len(out), "id": [i for i, _ in out], "depth": [d for _, d in out]}).astype({HISTORY: "object", "id": "object", "depth": "int64"})

    def _place(self, id_: str, depth: int, out: list[tuple[str, int]]) -> None:
        queue = [(id_, depth)]
        for i, d in queue:  # grows as waiting events become free
            self.depth.updateValue((i,), (d,))
            out.append((i, d))
            if not self.kids.containsKey((i,)):
                continue
            for child in self.kids.getValue((i,))[0]:
                missing, deepest = self.waits.getValue((child,))
                deepest = max(deepest, d)
                if missing == 1:
                    self.waits.removeKey((child,))
                    queue.append((child, deepest + 1))
                else:
                    self.waits.updateValue((child,), (missing - 1, deepest))
            self.kids.removeKey((i,))

    def close(self) -> None:
        pass


def stream_depth(events: DataFrame) -> DataFrame:
    """A stream of (history_id, id, depth), each event once, as soon as its ancestry is complete."""
    return events.select(HISTORY, "id", "parents").groupBy(HISTORY).transformWithStateInPandas(statefulProcessor=DepthProcessor(), outputStructType=_OUT, outputMode="Append", timeMode="None")
