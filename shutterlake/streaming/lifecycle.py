"""Files on their way through the queue: keyed state over a stream of what happens to them.

Each file has a generation. A result carries the generation that it was begun in;
one that comes after the file was taken again, cancelled or removed is stale and
changes nothing. A failed or cancelled file that is retried starts anew in the next
generation. Whether a file waits for analysis or for cleaning is told by its report.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "generation int, status string, reported boolean, error string, attempts int"
OUT = "file_id string, seq long, " + STATE
_ENDED = ("done", "failed", "cancelled")


@dataclass
class File:
    generation: int = 0
    status: str = "absent"
    reported: bool = False
    error: str | None = None
    attempts: int = 0

    def step(self, kind: str, generation: int | None, error: str | None) -> bool:
        """Take one event; whether it changed the file."""
        current = self.status != "absent" and generation == self.generation
        if kind == "add" and self.status == "absent":
            self.status = "pending"
        elif kind == "analyzed" and current and self.status == "pending" and not self.reported:
            self.reported = True
        elif kind == "started" and current and self.status == "pending" and self.reported:
            self.status, self.attempts = "processing", self.attempts + 1
        elif kind == "cleaned" and current and self.status == "processing":
            self.status = "done"
        elif kind == "failed" and current and self.status not in _ENDED:
            self.status, self.error = "failed", error or "unknown"
        elif kind == "cancel" and self.status in ("pending", "processing"):
            self.status, self.generation = "cancelled", self.generation + 1
        elif kind == "retry" and self.status in ("failed", "cancelled"):
            self.status, self.error, self.generation = "pending", None, self.generation + 1
        elif kind == "remove" and self.status != "absent":
            self.status, self.reported, self.error, self.generation = "absent", False, None, self.generation + 1
        else:
            return False
        return True


def _changes(file: File, rows: Iterable[tuple], file_id: str) -> list[tuple]:
    return [(file_id, seq, *astuple(file)) for seq, kind, generation, error in rows if file.step(kind, generation, error)]


def lifecycle(events: DataFrame) -> DataFrame:
    """One row for each event that changed its file: file_id, seq and the state after it.

    ``events`` is a stream of (file_id, seq, kind, generation, error); kinds are add,
    analyzed, started, cleaned, failed, cancel, retry and remove. Events of a batch are
    taken by ``seq``; repeated ones change nothing. Rows with a null file_id or kind
    are left out. The state is a few values a file and lives in the checkpoint.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file = File(*state.get) if state.exists else File()
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        listed = [(int(s), k, None if pd.isna(g) else int(g), e) for s, k, g, e in zip(rows["seq"], rows["kind"], rows["generation"], rows["error"], strict=True)]
        out = _changes(file, listed, key[0])
        state.update(astuple(file))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in OUT.split(", ")])

    rows = events.where("file_id is not null and kind is not null and seq is not null").select("file_id", "seq", "kind", "generation", "error")
    return rows.groupBy("file_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def waiting(states: DataFrame) -> DataFrame:
    """(file_id, next) of the latest states: what each pending file waits for."""
    from pyspark.sql import functions as F

    last = states.groupBy("file_id").agg(F.max_by(F.struct("status", "reported"), "seq").alias("s"))
    return last.where("s.status = 'pending'").select("file_id", F.when(F.col("s.reported"), "clean").otherwise("analyze").alias("next"))
