"""A store of additive log counts, merged per micro-batch under its number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wayside.operators.snapshots import COUNTS, merge_counts
from wayside.sources.sinks import append_once, committed, marked, publish

#: Batches that are kept by themselves before they are folded into the base.
FOLD = 32


@dataclass(frozen=True)
class CountStore:
    """Counts under ``path``: a published base and the batches after it.

    A batch is added once, however often it is tried.  What is read is the newest
    base and the complete batches behind it, so reading costs the number of
    (user, school, kind) keys and at most ``fold`` small batches, not the log.
    """

    spark: SparkSession
    path: str
    fold: int = FOLD

    def _base(self) -> int | None:
        versions = marked(self.spark, f"{self.path}/base")
        return versions[-1] if versions else None

    def add(self, counts: DataFrame, batch: int) -> bool:
        """Add the counts of a batch; False if they are there already."""
        base = self._base()
        if base is not None and batch <= base:
            return False
        return append_once(counts, f"{self.path}/batches", batch)

    def read(self, upto: int | None = None) -> DataFrame:
        """Counts of all complete batches (up to a number)."""
        base, batches = self._base(), f"{self.path}/batches"
        late = [b for b in marked(self.spark, batches) if (base is None or b > base) and (upto is None or b <= upto)]
        parts = [committed(self.spark, batches, COUNTS, batches=late)]
        if base is not None:
            parts.append(self.spark.read.schema(COUNTS).parquet(f"{self.path}/base/version={base}"))
        return merge_counts(*parts)

    def compact(self, batch: int) -> bool:
        """Fold all batches up to ``batch`` into a new base, if there are enough of them behind the last one."""
        base = self._base()
        waiting = [b for b in marked(self.spark, f"{self.path}/batches") if (base is None or b > base) and b <= batch]
        return len(waiting) >= self.fold and publish(self.read(batch), f"{self.path}/base", batch)
