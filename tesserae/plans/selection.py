"""Arguments of a read: what n, b, y and x may be, and which part of a grid they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid


def pick(selection, name: str, total: int) -> list[int] | range | None:
    """None: all. A tuple (start, stop): a half-open range, which is not spelled out. A list: these, in order; repeats stay."""
    if selection is None:
        return None
    if isinstance(selection, tuple):
        if len(selection) != 2:
            raise ValueError(f"{name}: a tuple is (start, stop)")
        start, stop = selection
        if not 0 <= start < stop <= total:
            raise ValueError(f"{name}: ({start}, {stop}) is not within 0 and {total}")
        return range(start, stop)
    if isinstance(selection, list):
        chosen = [int(i) for i in selection]
        if not chosen:
            raise ValueError(f"{name}: nothing is selected")
        for i in chosen:
            if not 0 <= i < total:
                raise ValueError(f"{name}: {i} is not within 0 and {total}")
        return chosen
    raise TypeError(f"{name}: a tuple or a list is expected, not {type(selection).__name__}")


def window(selection, name: str, total: int) -> tuple[int, int]:
    """None: all. Else a tuple (start, stop)."""
    if selection is None:
        return 0, total
    if not isinstance(selection, tuple) or len(selection) != 2:
        raise TypeError(f"{name}: a tuple (start, stop) is expected")
    start, stop = selection
    if not 0 <= start < stop <= total:
        raise ValueError(f"{name}: ({start}, {stop}) is not within 0 and {total}")
    return start, stop


#: Pairs of integers that are sent to all executors at most.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Request:
    """A checked selection on a grid."""

    grid: Grid
    bands: list[int] | range | None
    y: tuple[int, int]
    x: tuple[int, int]

    @classmethod
    def of(cls, grid: Grid, b=None, y=None, x=None) -> Request:
        return cls(grid, pick(b, "b", grid.bands), window(y, "y", grid.height), window(x, "x", grid.width))

    @property
    def all_bands(self) -> list[int] | range:
        return self.bands if self.bands is not None else range(self.grid.bands)

    @property
    def rows(self) -> tuple[int, int]:
        """Grid rows that the window meets."""
        return self.y[0] // self.grid.tile_length, -(-self.y[1] // self.grid.tile_length)

    @property
    def cols(self) -> tuple[int, int]:
        return self.x[0] // self.grid.tile_width, -(-self.x[1] // self.grid.tile_width)

    @property
    def extent(self) -> tuple[int, int, int]:
        return len(self.all_bands), self.y[1] - self.y[0], self.x[1] - self.x[0]

    def meets(self, row: str = "row", col: str = "col") -> Column:
        """The condition that prunes frames: plain comparisons, which reach the scan."""
        (r0, r1), (c0, c1) = self.rows, self.cols
        return (F.col(row) >= r0) & (F.col(row) < r1) & (F.col(col) >= c0) & (F.col(col) < c1)

    def frames(self, spark) -> DataFrame:
        """The frames that the request needs, each once."""
        return self.grid.index(spark, self.rows, self.cols, self.all_bands)


def among(df: DataFrame, key: str, chosen: list[int] | range | None) -> DataFrame:
    """The rows whose key is chosen: a range is two comparisons, a few are listed, more are joined."""
    if chosen is None:
        return df
    if isinstance(chosen, range):
        return df.where((F.col(key) >= chosen.start) & (F.col(key) < chosen.stop))
    keys = sorted(set(chosen))
    if len(keys) <= 64:
        return df.where(F.col(key).isin(keys))
    rows = df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` bigint")
    return df.join(F.broadcast(rows) if len(keys) <= MOST_BROADCAST else rows, key, "left_semi")


def ordered(df: DataFrame, key: str, chosen: list[int] | range | None, out: str) -> DataFrame:
    """Adds `out`, the place of each row's key among the chosen ones; rows repeat as keys do, others go.

    A range is arithmetic. A few places are an array beside each row's key, more are broadcast, and very many are joined.
    """
    if chosen is None:
        return df.withColumn(out, F.col(key).cast("int"))
    if isinstance(chosen, range):
        return among(df, key, chosen).withColumn(out, (F.col(key) - chosen.start).cast("int"))
    places: dict[int, list[int]] = {}
    for i, k in enumerate(chosen):
        places.setdefault(k, []).append(i)
    if len(places) <= 64:
        lookup = F.lit(None).cast("array<int>")
        for k in sorted(places, reverse=True):
            lookup = F.when(F.col(key) == k, F.array(*map(F.lit, places[k]))).otherwise(lookup)
        return df.where(F.col(key).isin(*places)).withColumn(out, F.explode(lookup))
    rows = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(chosen)], f"{key} int, {out} int")
    return df.join(F.broadcast(rows) if len(chosen) <= MOST_BROADCAST else rows, key)
