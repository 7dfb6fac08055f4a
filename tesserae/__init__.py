"""Tiled rasters and tensors as Spark DataFrames.

An image is a grid of independently compressed frames. A compact header, kept next to
the image's path in any table, says where every frame is; queries for "these images,
these bands, this window, this axis order" become DataFrame plans that touch only the
frames that intersect.
"""

from importlib import import_module

__version__ = "0.1.0"
#: Names and where they live; they are loaded when first asked for, so that Python workers load only what they use.
_HOME = {
    "FrameTable": "operators.frames",
    "Grid": "functions.grid",
    "HeaderView": "operators.header",
    "frames": "operators.frames",
    "get_parallelism": "threads",
    "read": "operators.read",
    "set_parallelism": "threads",
    "write": "sources.writer",
}
__all__ = [*_HOME, "__version__"]


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
