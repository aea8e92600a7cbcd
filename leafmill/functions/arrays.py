"""Column expressions over arrays of any size within a row, in linear time or close to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with all before it, by doubling steps: n log n in all."""

    def scan(all_: Column) -> Column:
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(all_))).cast("int"))
        back = lambda k: F.call_function("shiftleft", F.lit(1), k - 1)
        step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= back(k), join(F.get(acc, i - back(k)), x)).otherwise(x))
        return F.when(F.size(all_) > 1, F.aggregate(steps, all_, step)).otherwise(all_)

    return bound(values, scan)


#: Characters of a block in byte_place().
BLOCK = 256


def with_places(text: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(place), where place(n) is the byte at which the text's character n (from 0) begins, for n up to its length.

    Texts of one byte a character need no more; in others blocks of BLOCK characters are counted once, so that a place costs
    no more than a block.
    """
    wide = F.octet_length(text) > F.char_length(text)
    blocks = F.when(wide, F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1)))

    def found(b: Column) -> Column:
        ends = running(F.transform(b, lambda x: F.octet_length(x).cast("long")), lambda a, x: a + x)
        return bound(ends, lambda e: use(lambda n: F.when(b.isNull(), n).otherwise(before(b, e, n))))

    def before(b: Column, ends: Column, n: Column) -> Column:
        k = F.floor(n / BLOCK).cast("int")
        whole = F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("long"))
        return whole + F.coalesce(F.octet_length(F.substring(F.get(b, k), F.lit(1), (n % BLOCK).cast("int"))), F.lit(0))

    return bound(blocks, found)


def pieces_joined(text: Column, spans: Column, cut: Callable[[Column, Column], Column]) -> Column:
    """text with each span (start, end in characters, in order, apart) replaced by cut(span, the old piece); linear in the text.

    Spans are clamped to the text. The text is cut as bytes, so a piece costs its own length and not its place.
    """

    def rebuilt(own: Column, raw: Column, size: Column, place) -> Column:
        clamp = lambda x: F.greatest(F.lit(0).cast("long"), F.least(x, size))
        piece = lambda a, b: bound(F.struct(place(a).alias("a"), place(b).alias("b")), lambda x: F.substring(raw, (x["a"] + 1).cast("int"), F.greatest(x["b"] - x["a"], F.lit(0).cast("long")).cast("int"))).cast("string")
        end = lambda i: F.when(i > 0, clamp(F.get(own, i - 1)["end"])).otherwise(F.lit(0).cast("long"))
        parts = F.transform(own, lambda s, i: F.concat(piece(end(i), clamp(s["start"])), cut(s, piece(clamp(s["start"]), clamp(s["end"])))))
        return F.concat(F.array_join(parts, ""), piece(end(F.size(own)), size))

    size = F.char_length(text).cast("long")
    return bound(spans, lambda own: bound(text.cast("binary"), lambda raw: bound(size, lambda n: with_places(text, lambda place: rebuilt(own, raw, n, place)))))
