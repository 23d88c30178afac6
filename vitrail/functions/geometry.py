"""Rectangle and colour algebra as column expressions, all inside code generation.

A box is four columns x, y, w, h; `Box("a_")` names them with a prefix, `Box(struct)` takes them from a struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @classmethod
    def array(cls, values: Column) -> Box:
        return cls(*(values[k] for k in range(4)))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def _zero() -> Column:
    return F.lit(0)


def exact(share: float) -> Column:
    """A share as a decimal, as SQL reads it: 0.35 of 180 is 63, which the product of doubles falls short of."""
    return F.lit(Decimal(str(share)))


def overlap(a: Box, b: Box) -> Column:
    """Shared area; touching or apart gives 0."""
    wide = F.greatest(_zero(), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    return wide * F.greatest(_zero(), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def meets(a: Box, b: Box) -> Column:
    """Strict intersection, as a conjunction that a join can use."""
    return (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)


def contains(outer: Box, inner: Box, slack: int = 2) -> Column:
    """Every side of `inner` lies in `outer` widened by `slack` (which may be negative)."""
    low = (inner.x >= outer.x - slack) & (inner.y >= outer.y - slack)
    return low & (inner.right <= outer.right + slack) & (inner.bottom <= outer.bottom + slack)


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area, 0.0 when apart."""
    shared = overlap(a, b)
    return F.when(shared > 0, shared / (a.area + b.area - shared)).otherwise(F.lit(0.0))


def near(a: Box, b: Box, slack: int = 2) -> Column:
    """All four sides agree within `slack`."""
    pairs = ((a.x, b.x), (a.y, b.y), (a.right, b.right), (a.bottom, b.bottom))
    out = F.lit(True)
    for p, q in pairs:
        out = out & (F.abs(p - q) <= slack)
    return out


def intersects(a: Box, b: Box) -> Column:
    """Strict intersection that asks for positive size of `a` only."""
    return (a.w > 0) & (a.h > 0) & meets(a, b)


def touches_edge(a: Box, width: Column, height: Column, slack: int = 1) -> Column:
    return (a.x <= slack) | (a.y <= slack) | (a.right >= width - slack) | (a.bottom >= height - slack)


def clipped_outline(kind: Column, a: Box, width: Column, height: Column) -> Column:
    """An outline of more than 2 % of the picture that touches its edge."""
    return (kind == "outline") & (a.area > exact(0.02) * width * height) & touches_edge(a, width, height)


def local_box(bounds: Box, screen: Box, width: Column, height: Column) -> Column:
    """Bounds on a screen as whole pixels of its picture, clipped; null if nothing is left or a number isn't finite.

    Rounding is half to even.
    """
    numbers = [bounds.x, bounds.y, bounds.w, bounds.h]
    finite = F.lit(True)
    for n in numbers:
        d = n.cast("double")
        finite = finite & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    px = lambda v, o, size, span: F.bround((v - o) * size / span, 0).cast("bigint")
    left = F.greatest(_zero(), px(bounds.x, screen.x, width, screen.w))
    top = F.greatest(_zero(), px(bounds.y, screen.y, height, screen.h))
    right = F.least(width, px(bounds.right, screen.x, width, screen.w))
    bottom = F.least(height, px(bounds.bottom, screen.y, height, screen.h))
    some = finite & (bounds.w > 0) & (bounds.h > 0) & (right > left) & (bottom > top)
    box = F.struct(left.cast("bigint").alias("x"), top.cast("bigint").alias("y"), (right - left).cast("bigint").alias("w"), (bottom - top).cast("bigint").alias("h"))
    return F.when(some, box)


def affine(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """a*x + c*y + e and b*x + d*y + f for six numbers [a, b, c, d, e, f]."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def unmapped(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """The point that an affine map [a, b, c, d, e, f] takes to (x, y); nulls if the map has no inverse."""
    det = F.nullif(m[0] * m[3] - m[1] * m[2], F.lit(0.0))
    dx, dy = x - m[4], y - m[5]
    return (m[3] * dx - m[2] * dy) / det, (m[0] * dy - m[1] * dx) / det


def affine_box(b: Box, m: Column) -> Box:
    """A box under an affine map; sizes don't become negative."""
    x, y = affine(b.x, b.y, m)
    right, bottom = affine(b.right, b.bottom, m)
    return Box(x, y, F.greatest(F.lit(0.0), right - x), F.greatest(F.lit(0.0), bottom - y))


#: The standard display scales.
SCALES = (1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0)


def display_scale(target: Box, raw: Box) -> Column:
    """The standard scale by which both sides of `raw` come within two pixels of `target`; null if none."""
    fits = F.filter(F.array(*(F.lit(s) for s in SCALES)), lambda s: (F.abs(target.w - raw.w * s) <= 2) & (F.abs(target.h - raw.h * s) <= 2))
    return F.when((F.least(target.w, target.h) > 0) & (raw.w >= 100) & (raw.h >= 12), F.get(fits, F.lit(0)))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    return F.concat(F.lit("#"), F.lower(F.concat(part(r), part(g), part(b))))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def channels(colour: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of '#rrggbb' in either case; nulls if it isn't one."""
    good = F.when(F.coalesce(colour, F.lit("")).rlike("^#?[0-9a-fA-F]{6}$"), F.regexp_replace(colour, "^#", ""))
    return tuple(F.conv(F.substring(good, k, 2), 16, 10).cast("int") for k in (1, 3, 5))


def colorref(value: Column) -> Column:
    """A 0x00BBGGRR number as '#rrggbb'; null outside 0 to 0xFFFFFF."""
    v = value.cast("bigint")
    byte = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(255))
    return F.when((v >= 0) & (v <= 0xFFFFFF), hex_colour(byte(0), byte(8), byte(16)))


def luminance(colour: Column) -> Column:
    """Relative luminance of '#rrggbb' (sRGB)."""
    linear = []
    for c in channels(colour):
        s = c / 255.0
        linear.append(F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4)))
    return luma(*linear)


def contrast_ratio(a: Column, b: Column) -> Column:
    low, high = F.least(luminance(a), luminance(b)), F.greatest(luminance(a), luminance(b))
    return (high + 0.05) / (low + 0.05)


def readable(front: Column, back: Column, least: float = 4.4) -> Column:
    """The colour to draw in: `front` if it stands out enough, else a fixed dark or light one (grey or white where little contrast is asked for)."""
    light = luminance(back)
    if least <= 3:
        other = F.when(light >= 0.45, "#666666").otherwise("#ffffff")
    else:
        other = F.when((light + 0.05) / 0.05 >= 1.05 / (light + 0.05), "#171717").otherwise("#ffffff")
    return F.when(contrast_ratio(front, back) >= least, front).otherwise(other)
