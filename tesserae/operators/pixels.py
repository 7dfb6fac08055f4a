"""Between pixels (one row per sample) and frames (one row per frame with an array): columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, div, edge, frame_index, label
from ..plans.layout import Layout
from ..plans.selection import MOST_BROADCAST, Request, ordered


def cut(pixels: DataFrame, grid: Grid, by: list[str] = [], value: str = "v") -> DataFrame:  # noqa: B006
    """Frames of pixels (b, y, x, value): (by, frame_index, row, col, band, h, w, data), data in C order.

    A frame is at most a tile (times the bands), so no group grows with the image.
    """
    row, col = div(F.col("y"), grid.tile_length).cast("int").alias("row"), div(F.col("x"), grid.tile_width).cast("int").alias("col")
    spot = F.struct("b", "y", "x", F.col(value).alias("v")) if grid.unit == "cell" else F.struct("y", "x", F.col(value).alias("v"))
    keys = [*by, row, col, *([F.col("b").alias("band")] if grid.unit == "tile" else [])]
    out = pixels.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(spot)), lambda s: s["v"]).alias("data"))
    if grid.unit == "cell":
        out = out.withColumn("band", F.lit(None).cast("int"))
    at = frame_index(F.col("row"), F.col("col"), F.coalesce(F.col("band"), F.lit(0)), grid.across, grid.per_position)
    return out.select(*by, at.alias("frame_index"), "row", "col", F.col("band").cast("int").alias("band"), edge(F.col("row"), grid.tile_length, grid.height).alias("h"), edge(F.col("col"), grid.tile_width, grid.width).alias("w"), "data")


def checked(frames: DataFrame, grid: Grid) -> DataFrame:
    """The frames; one whose data has another length than its shape raises when it is read."""
    bad = F.size("data") != F.col("h") * F.col("w") * F.lit(grid.bands if grid.unit == "cell" else 1)
    return frames.withColumn("data", F.when(bad, F.raise_error(F.concat(F.lit("the frame at "), label(F.col("row"), F.col("col")), F.lit(" has the wrong number of samples")))).otherwise(F.col("data")))


def place(frames: DataFrame, request: Request, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Pixels of the request from frames: (keys, b, y, x, v), places counted from the request's origin.

    Frames outside the window are pruned by row, column and band, and a frame's samples outside it are cut
    off before rows are made; a cell frame is opened once and its planes dealt to all places that ask for its band.
    """
    g = request.grid
    (y0, y1), (x0, x1) = request.y, request.x
    near = checked(frames.where(request.meets()), g)
    if g.unit == "tile":
        near = ordered(near, "band", request.bands, "b")
        planes = F.array(F.lit(0))
    else:
        some = sorted(set(request.all_bands))
        planes = F.sequence(F.lit(some[0]), F.lit(some[-1])) if some == list(range(some[0], some[-1] + 1)) else F.array(*map(F.lit, some))
    # The part of each frame that the window meets: rows top to bottom, columns left to right.
    top, left = F.col("row") * g.tile_length, F.col("col") * g.tile_width
    spans = {"y_from": F.greatest(F.lit(0), y0 - top), "y_to": F.least("h", y1 - top), "x_from": F.greatest(F.lit(0), x0 - left), "x_to": F.least("w", x1 - left)}
    own = [*keys, *(["b"] if g.unit == "tile" else [])]
    part = near.select(*own, (top - y0).alias("top"), (left - x0).alias("left"), "h", "w", "data", planes.alias("planes"), *(v.cast("int").alias(k) for k, v in spans.items()))
    rows = "flatten(transform(sequence(y_from, y_to - 1), i -> slice(data, cast((p * h + i) * w + x_from + 1 as int), x_to - x_from)))"
    whole = "y_from = 0 AND x_from = 0 AND y_to = h AND x_to = w AND size(planes) * h * w = size(data)"
    part = part.withColumn("data", F.expr(f"CASE WHEN {whole} THEN data ELSE flatten(transform(planes, p -> {rows})) END"))
    pixel = part.select(*own, "top", "left", "planes", "y_from", "y_to", "x_from", "x_to", F.posexplode("data").alias("i", "v"))
    wide, size = F.expr("x_to - x_from"), F.expr("(x_to - x_from) * (y_to - y_from)")
    inner = F.col("i") % size
    y, x = F.col("top") + F.col("y_from") + div(inner, wide), F.col("left") + F.col("x_from") + inner % wide
    band = [] if g.unit == "tile" else [F.expr("get(planes, cast(i div ((x_to - x_from) * (y_to - y_from)) as int))").cast("int").alias("band")]
    out = pixel.select(*own, *band, y.cast("int").alias("y"), x.cast("int").alias("x"), "v")
    if g.unit == "cell":
        out = ordered(out, "band", request.bands, "b").drop("band")
    return out.select(*keys, "b", "y", "x", "v")


def filled(pixels: DataFrame, holes: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """Pixels (b, y, x, value) with zeros at the holes (y, x) in all bands, so that every frame is whole."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(grid.bands - 1))).alias("b")
    return pixels.select("b", "y", "x", value).unionByName(holes.select(bands, "y", "x", F.lit(0).cast(pixels.schema[value].dataType).alias(value)))


def unfilled(pixels: DataFrame, holes: DataFrame, y: int = 0, x: int = 0) -> DataFrame:
    """What was read from row y and column x on, without the holes: a few are broadcast, very many are joined."""
    count = holes.limit(MOST_BROADCAST + 1).count()
    if not count:
        return pixels
    near = holes.select((F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"))
    return pixels.join(F.broadcast(near) if count <= MOST_BROADCAST else near, ["y", "x"], "left_anti").select(pixels.columns)


def window(pixels: DataFrame, request: Request, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The same selection on pixels that were never cut."""
    (y0, y1), (x0, x1) = request.y, request.x
    near = pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).withColumnRenamed("b", "band")
    out = ordered(near, "band", request.bands, "b")
    return out.select(*keys, "b", (F.col("y") - y0).cast("int").alias("y"), (F.col("x") - x0).cast("int").alias("x"), "v")


def position(layout: Layout, n: Column | None = None) -> Column:
    """Where a sample goes in the flat output."""
    s = layout.strides
    out = F.col("b") * F.lit(s["b"]) + F.col("y") * F.lit(s["y"]) + F.col("x") * F.lit(s["x"])
    return (out if n is None else out + n * F.lit(s["n"])).cast("bigint")
