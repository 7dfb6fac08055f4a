"""Output layouts: which axis order a read's result has, and where each sample goes.

A pattern such as "n y x b" or "b (y x)" lists the axes n, b, y and x once each, in
output order; parentheses join neighbouring axes into one output dimension.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

AXES = "nbyx"
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Layout:
    """The output's shape, how far apart neighbours along each axis are, and whether the order is the usual one."""

    shape: tuple[int, ...]
    strides: dict[str, int]
    native: bool

    @property
    def size(self) -> int:
        out = 1
        for n in self.shape:
            out *= n
        return out


def default_pattern(images: int) -> str:
    """By the number of images selected: a list of one has no n axis."""
    return "n b y x" if images > 1 else "b y x"


def groups(pattern: str) -> list[str]:
    """The axes of each output dimension, e.g. ["n", "b", "yx"]."""
    text = pattern.replace(" ", "")
    if unknown := re.search(r"[^nbyx()]", text):
        raise ValueError(f"unknown axis '{unknown[0]}' (the axes are n, b, y and x)")
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth > 1:
            raise ValueError("parentheses cannot be nested")
        if depth < 0:
            raise ValueError("unbalanced ')'")
    if depth:
        raise ValueError("unbalanced '('")
    if "()" in text:
        raise ValueError("empty group '()'")
    found = [m.strip("()") for m in re.findall(r"\([nbyx]+\)|[nbyx]", text)]
    flat = "".join(found)
    if not flat:
        raise ValueError("empty pattern")
    for axis in AXES:
        if flat.count(axis) > 1:
            raise ValueError(f"axis '{axis}' is used more than once")
    if missing := [a for a in "byx" if a not in flat]:
        raise ValueError(f"the pattern lacks {', '.join(missing)}: it must have b, y and x")
    return found


def compile_layout(pattern: str, n: int, b: int, y: int, x: int) -> Layout:
    extent = dict(zip(AXES, (n, b, y, x), strict=True))
    if min(extent.values()) < 1:
        raise ValueError("extents must be positive")
    dims = groups(pattern)
    flat = "".join(dims)
    if n > 1 and "n" not in flat:
        raise ValueError("several images need n in the pattern")
    strides, step = dict.fromkeys(AXES, 0), 1
    for axis in reversed(flat):
        strides[axis] = step
        step *= extent[axis]
        if step > MOST:
            raise ValueError("the result's size overflows 64 bits")
    shape = []
    for dim in dims:
        size = 1
        for axis in dim:
            size *= extent[axis]
        shape.append(size)
    return Layout(tuple(shape), strides, flat in ("nbyx", "byx"))
