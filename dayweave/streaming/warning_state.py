"""Streaming fast-rise warnings, with days that arrive late or out of order.

Input rows are smoothed days ``(entity, pos, strain)``.  A day waits in a map state
until a day ``lateness`` positions newer has been seen for its entity; then it
joins the chain of judged days in the order of positions.  A day is judged when
the next one joins, which is what the batch version does with its last row.  A day
that arrives after a newer one has joined is too late: it comes out as a row of its
own, marked and counted, and changes nothing else.

State per entity: one row and at most ``lateness`` waiting days (a gap in the
positions makes it fewer).  The state store is RocksDB, see ``build_session``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dayweave.operators.warnings import (
    COOL_CODE,
    COOL_DOWN,
    RISE_CODE,
    RISE_LIMIT,
    WARN_BIG,
)

OUTPUT = "entity string, pos long, rise double, warning double, days_since long, sequence long, late boolean, n_late long"
CHAIN = "pos long, strain double, before double, cool long, on boolean, since long, sequence long, newest long, n_late long"
START = (-1, None, None, 0, False, 0, 1, -1, 0)


class WarningProcessor(StatefulProcessor):
    """Holds days back for ``lateness`` positions, then judges them in order."""

    def __init__(self, head: int, limit: float, cool: int, lateness: int):
        self.head, self.limit, self.cool, self.lateness = head, limit, cool, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", CHAIN)
        self.waiting = handle.getMapState("waiting", "pos long", "strain double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *judged, newest, n_late = self.chain.get() if self.chain.exists() else START
        out = []
        for frame in rows:
            for pos, strain in zip(frame["pos"].tolist(), frame["strain"].tolist(), strict=True):
                if pos <= judged[0]:
                    n_late += 1
                    out.append((key[0], pos, None, None, None, None, True, n_late))
                else:
                    self.waiting.updateValue((pos,), (None if pd.isna(strain) else float(strain),))
                    newest = max(newest, pos)
        ready = sorted(pos for (pos,) in self.waiting.keys() if pos <= newest - self.lateness)  # noqa: SIM118
        for pos in ready:
            (strain,) = self.waiting.getValue((pos,))
            self.waiting.removeKey((pos,))
            if judged[0] >= 0:
                done, judged = self._judge(judged)
                out.append((key[0], *done, False, n_late))
            judged = [pos, strain, judged[1], *judged[3:]]
        self.chain.update((*judged, newest, n_late))
        frame = pd.DataFrame(out, columns=["entity", "pos", "rise", "warning", "days_since", "sequence", "late", "n_late"])
        yield frame.astype({"rise": "float64", "warning": "float64", "days_since": "Int64", "sequence": "Int64"})

    def _judge(self, judged: list) -> tuple[tuple, list]:
        """The newest day of the chain, now that the next one is known to exist."""
        pos, strain, before, left, on, since, sequence = judged
        known = pos > self.head and strain is not None and before is not None
        up = known and strain - before >= self.limit
        rise, warning = (RISE_CODE if up else 0.0), 0.0
        if pos < self.head:
            return (pos, rise, warning, None, None), judged
        if up:
            left = self.cool
        elif left:
            rise, left = COOL_CODE, left - 1
        warning = WARN_BIG if rise >= COOL_CODE else 0.0
        begins = warning > 0 and not on
        since = 1 if begins else since + 1
        sequence += int(begins)
        return (pos, rise, warning, since, sequence), [pos, strain, before, left, warning > 0, since, sequence]

    def close(self) -> None:
        pass


def warning_stream(days: DataFrame, head: int, limit: float = RISE_LIMIT, cool: int = COOL_DOWN, lateness: int = 0) -> DataFrame:
    """``entity, pos, rise, warning, days_since, sequence, late, n_late``: every finished day once, and every too late one.

    Days may come up to ``lateness`` positions after a newer one; a day given twice
    while it waits keeps its last value.  Too late days have ``late`` set and
    null results; ``n_late`` is their number so far for the entity.
    """
    processor = WarningProcessor(head, limit, cool, lateness)
    rows = days.select("entity", "pos", "strain")
    return rows.groupBy("entity").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="none")
