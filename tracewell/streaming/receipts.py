"""The receipt checks over a stream: sequence and id state per log, exactly as the batch form finds them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINDINGS = "log string, code string, line long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReceiptChecks(StatefulProcessor):
    """Per log, a map of the ids seen (each written once, when it is new) and the sequence of the last receipt, if it had one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "line long")
        self.last = handle.getValueState("last", "sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        state = self.last.get()
        last = state[0] if state is not None else None
        out = []
        batch = pd.concat(list(rows)).sort_values("line", kind="stable")  # a log's part of one trigger
        for line, id_, sequence in batch[["line", "id", "sequence"]].itertuples(index=False):
            if id_ is not None and not pd.isna(id_):
                if self.seen.containsKey((id_,)):
                    out.append((key[0], "BUNDLE_EVENT_DUPLICATE_ID", line))
                else:
                    self.seen.updateValue((id_,), (int(line),))
            sequence = None if sequence is None or pd.isna(sequence) else int(sequence)
            if last is not None and sequence is not None and sequence <= last:
                out.append((key[0], "BUNDLE_EVENT_SEQUENCE", line))
            last = sequence
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["log", "code", "line"])

    def close(self) -> None:
        pass


def findings(receipts: DataFrame) -> DataFrame:
    """receipts: a streaming (log, line, id, sequence) of valid receipts, whose lines rise from one trigger to the next. Sequence,
    not wall clock, is their order, so no watermark applies. A null id repeats none; a null sequence is not compared, nor is the receipt
    after it with any. State is kept in RocksDB, which the session is set to, and what a trigger writes follows its new ids."""
    receipts.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return receipts.groupBy("log").transformWithStateInPandas(ReceiptChecks(), FINDINGS, "append", "none")
