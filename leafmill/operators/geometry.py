"""Boxes in percent of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The page size in points where none is known; the smallest and largest size in percent.
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
MIN_SIZE, MAX_SIZE = 1.0, 90.0
#: Fixed value: the widest a symbol gets by a centred resize, in percent.
MAX_SYMBOL = 60.0
BOX_TYPES = ["text", "rectangle", "ellipse", "symbol", "signature", "whiteout", "blackout", "blur"]
BOX_SIDES = ["left", "top", "width", "height"]


def to_points(elements: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """elements with x, y, w, h in points, y upwards from the page's foot; doc and page_index find the page's size."""
    rows = elements.join(page_sizes, ["doc", "page_index"], "left")
    wide, high = F.coalesce("page_w", F.lit(PAGE_WIDTH)), F.coalesce("page_h", F.lit(PAGE_HEIGHT))
    return rows.select(*elements.columns, (F.col("left") / 100 * wide).alias("x"), (high - F.col("top") / 100 * high).alias("y"), (F.col("width") / 100 * wide).alias("w"), (F.col("height") / 100 * high).alias("h"))


def affine_box(m: list[Column], x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """Smallest x, y and largest x, y of a box's corners under [a b c d e f]: x' = ax + cy + e, y' = bx + dy + f."""
    a, b, c, d, e, f = m
    xs = [a * x + c * y + e for x in (x0, x1) for y in (y0, y1)]
    ys = [b * x + d * y + f for x in (x0, x1) for y in (y0, y1)]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def height_percent(width: Column, ratio: Column, page_w: Column, page_h: Column) -> Column:
    """The height that keeps an aspect ratio (height by width), as both are shares of different sides."""
    return width * ratio * (page_w / page_h)


def clamp_elements(elements: DataFrame, patches: DataFrame) -> DataFrame:
    """elements after one patch each (id, handle, dx, dy), handle `move` or sides such as `top-left`.

    A move stays on the page. A resize keeps the opposite edge and a size of 1..90 percent that stays on the page. Unknown
    ids and elements without a patch are left alone.
    """
    rows = elements.join(patches, "id", "left")
    handle = F.coalesce("handle", F.lit(""))
    dx, dy = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    held = lambda size, room: F.greatest(F.lit(MIN_SIZE), F.least(F.lit(MAX_SIZE), room, size))
    has = lambda side: handle.contains(side)
    w, h, x, y = F.col("width"), F.col("height"), F.col("left"), F.col("top")
    new_w = F.when(has("right"), held(w + dx, 100 - x)).when(has("left"), held(w - dx, x + w)).otherwise(w)
    new_h = F.when(has("bottom"), held(h + dy, 100 - y)).when(has("top"), held(h - dy, y + h)).otherwise(h)
    moved = lambda at, by, size: at + F.greatest(-at, F.least(100 - size - at, by))
    new_x = F.when(handle == "move", moved(x, dx, w)).when(has("left"), x - (new_w - w)).otherwise(x)
    new_y = F.when(handle == "move", moved(y, dy, h)).when(has("top"), y - (new_h - h)).otherwise(y)
    others = [c for c in elements.columns if c not in BOX_SIDES]
    return rows.select(*others, new_x.alias("left"), new_y.alias("top"), new_w.alias("width"), new_h.alias("height"))


def resize_centred(elements: DataFrame, patches: DataFrame, ratio: str = "ratio", least: str = "least") -> DataFrame:
    """elements after one centred resize each (id, dw, least, ratio, page_w, page_h): the aspect ratio is kept, the box stays on the page.

    The width is `least` to MAX_SYMBOL percent; the box keeps its centre unless it would leave the page. Elements without a
    patch, or without one of their sides, are left alone; an unknown page size is the default one.
    """
    rows = elements.join(patches.select("id", "dw", F.col(least).alias("_least"), F.col(ratio).alias("_ratio"), "page_w", "page_h"), "id", "left")
    held = F.greatest(F.col("_least"), F.least(F.lit(MAX_SYMBOL), F.col("width") + F.col("dw")))
    high = height_percent(held, F.col("_ratio"), F.coalesce("page_w", F.lit(PAGE_WIDTH)), F.coalesce("page_h", F.lit(PAGE_HEIGHT)))
    centred = lambda at, old, new: F.greatest(F.lit(0.0), F.least(100 - new, at + (old - new) / 2))
    patched = F.col("dw").isNotNull()
    for side in BOX_SIDES:
        patched = patched & F.col(side).isNotNull()
    new = {"width": held, "height": high, "left": centred(F.col("left"), F.col("width"), held), "top": centred(F.col("top"), F.col("height"), high)}
    return rows.select(*[F.when(patched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in elements.columns])


def object_bounds(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes of a group; boxes with an unknown side take no part in that side."""
    ends = boxes.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    return ends.select(*keys, "left", "top", (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))


def validate_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep their type's rule, and the others with the first rule broken."""
    finite = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(c) != float("inf")), F.lit(False))
    needed = {kind: BOX_SIDES for kind in BOX_TYPES} | {"text": ["left", "top"], "line": ["x1", "y1", "x2", "y2"]}
    sides = [s for s in ("left", "top", "width", "height", "x1", "y1", "x2", "y2") if s in elements.columns]
    rule = F.when(F.col("id").isNull(), "id").when(F.col("page_index").isNull(), "page_index").when(~F.coalesce(F.col("type").isin(list(needed)), F.lit(False)), "type")
    for side in ("left", "top", "width", "height", "x1", "y1", "x2", "y2"):
        kinds = [k for k, v in needed.items() if side in v]
        rule = rule.when(F.col("type").isin(kinds) & (~finite(side) if side in sides else F.lit(True)), side)
    marked = elements.withColumn("rule", rule)
    return marked.where("rule is null").drop("rule"), marked.where("rule is not null")
