"""How many tasks a read is spread over; Spark's own scheduler does the rest."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ENV, MOST = "TESSERAE_PARALLELISM", 1024
_chosen: int | None = None


def _checked(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError(f"parallelism must be an int, got {type(n).__name__}")
    if n < 1:
        raise ValueError("parallelism must be at least 1")
    return min(n, MOST)


def set_parallelism(n: int | str) -> None:
    """A number of tasks, or "ALL_CPUS"."""
    global _chosen
    _chosen = _checked(os.cpu_count() or 1) if n == "ALL_CPUS" else _checked(n)


def get_parallelism(spark: SparkSession | None = None) -> int:
    """What was set, else the environment's value, else what Spark runs at once (1 without a session)."""
    if _chosen is not None:
        return _chosen
    said = os.environ.get(ENV, "").strip()
    if said == "ALL_CPUS":
        return min(os.cpu_count() or 1, MOST)
    if said.isdigit() and int(said):
        return min(int(said), MOST)
    return max(1, spark.sparkContext.defaultParallelism) if spark else 1
