"""What runs say of themselves, as their log lines arrive.

Lines are taken apart by column expressions; a state for each run keeps what
they say. The batch twin is ``operators.runlog.summary``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prismara.operators import runlog

STATE = "support_source string, effective_angle double, angle_source string, processed long, skipped long, fallback_masks long, capturing boolean"
OUTPUT = "run string, support_source string, effective_angle double, angle_source string, processed long, skipped long, fallback_masks long, pinhole string"
_START = (None, None, None, 0, 0, 0, False)


class RunState(StatefulProcessor):
    """The fields of a run; once it announces its cameras, messages that give no field are theirs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getValueState("fields", STATE)
        self.pinhole = handle.getListState("pinhole", "message string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        source, angle, angle_source, processed, skipped, fallback, capturing = self.fields.get() or _START
        said: list[tuple[str]] = []
        for r in sorted(rows, key=lambda r: r.line_no):
            if r.kind == "support_source":
                source = r.first.strip()
            elif r.kind in ("mask_angle", "manual_angle"):
                angle, angle_source = float(r.first), "mask-derived" if r.kind == "mask_angle" else "manual"
            elif r.kind == "done":
                processed, skipped = int(r.first), int(r.second)
            elif r.kind == "fallback_masks":
                fallback = int(r.first)
            elif capturing:
                if r.message is not None:
                    said.append((r.message,))
            elif r.kind == "pinhole_start":
                capturing = True
        self.fields.update((source, angle, angle_source, processed, skipped, fallback, capturing))
        if said:
            self.pinhole.appendList(said)
        lines = [m[0] for m in self.pinhole.get()] if capturing else []
        yield Row(run=key[0], support_source=source, effective_angle=angle, angle_source=angle_source, processed=processed, skipped=skipped, fallback_masks=fallback, pinhole="\n".join(lines) if lines else None)

    def close(self) -> None:
        pass


def run_states(lines: DataFrame, run: str = "run") -> DataFrame:
    """A stream of ``OUTPUT``: of each run that a batch has lines of, all that it has said so far.

    ``lines`` is a stream of ``run``, ``line_no`` and ``line``; a run's lines
    arrive in order from batch to batch and in any order within one. Rows of a
    null run are one run. The state store must be RocksDB's
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    told = runlog.facts(lines.select(F.col(run).cast("string").alias("run"), "line_no", "line"), ("run",))
    return told.groupBy("run").transformWithState(RunState(), OUTPUT, "Update", "None")
