"""The reference data of a consumer that runs on: the last generation that can be read."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators.sinks import published, read_generation
from ..plans.jobs import Reference


class LastGood:
    """Gives the newest generation that can be read; what is damaged or gone is passed over.

    ``make`` turns the entries and the time they were built at into the reference. A call
    looks at the manifest alone; entries are read and checked when a new generation is
    named. One that fails is told in ``error`` and tried again at the next call, as it may
    be under repair; until then the reference in use stays, or on a start the newest older
    one that can be read. Without any the error is raised.
    """

    def __init__(self, spark: SparkSession, root: str, make: Callable[[DataFrame, int], Reference]) -> None:
        self.spark, self.root, self.make = spark, root, make
        self.held: Reference | None = None
        self.error: str | None = None

    def __call__(self) -> Reference:
        failed = None
        for row in published(self.spark, self.root):
            if self.held is not None and row["built_at"] <= (self.held.built_at or 0):
                break
            try:
                self.held = self.make(read_generation(self.spark, self.root, built_at=row["built_at"]), row["built_at"])
                break
            except (ValueError, OSError, PySparkException) as e:
                failed = failed or str(e)
        self.error = failed
        if self.held is None:
            raise ValueError(failed or f"{self.root}: nothing published")
        return self.held

    def age(self, now: float | None = None) -> float | None:
        """Seconds since the generation in use was built."""
        built = self.held.built_at if self.held else None
        return None if built is None else (time.time() if now is None else now) - built
