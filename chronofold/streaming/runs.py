"""Run states kept up to date from a stream of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofold.model import SUCCESSORS
from chronofold.sources.log import SequenceError, append

OUTPUT = "run_id string, sequence long, state string, ts long, rejected long"
STATE = "state string, sequence long, ts long, rejected long"


def run_states(events: DataFrame) -> DataFrame:
    """Per run and micro-batch its state after the batch: run_id, sequence, state, ts, rejected.

    Events have run_id, sequence, ts and new_state. Within a run they are applied in sequence
    order over the whole micro-batch; one that is late, stale or illegal is counted as rejected
    and changes nothing. The order across runs is checked by ``guarded_append``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, ts, rejected = state.get if state.exists else ("", -1, 0, 0)
        # Plain arrays: most runs have few events a batch, for which frames cost more than the steps.
        parts = [[b[c].to_numpy() for c in ("sequence", "ts", "new_state")] for b in batches]
        sequences, times, states = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(sequences, kind="stable")
        for number, time, new in zip(sequences[order].tolist(), times[order].tolist(), states[order].tolist(), strict=True):
            legal = new == "Scheduled" if not now else new in SUCCESSORS.get(now, ())
            if number <= last or not legal:
                rejected += 1
            else:
                now, last, ts = new, number, time
        state.update((now, last, ts, rejected))
        yield pd.DataFrame({"run_id": [key[0]], "sequence": [last], "state": [now or None], "ts": [ts], "rejected": [rejected]})

    slim = events.select("run_id", "sequence", "ts", "new_state")
    return slim.groupBy("run_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def guarded_append(path: str, refused: Callable[[DataFrame, int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends a batch to the log if it comes after it.

    A batch that was already written, as after a restart, is left out; any other that overlaps
    the log goes to ``refused`` or raises.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        try:
            append(batch, path)
        except SequenceError as e:
            written = batch.sparkSession.read.parquet(path).select("sequence")
            if batch.join(written, "sequence", "left_anti").isEmpty():
                return
            if refused is None:
                raise
            refused(batch, batch_id, str(e))

    return write


def expiring_leases(leases: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Latest expiry per run and owner of a stream of lease events (column ``at``: event time), late ones bounded by a watermark."""
    return leases.withWatermark("at", delay).groupBy(F.window("at", "1 minute"), "run_id", "owner").agg(F.max("expiry").alias("expiry"))
