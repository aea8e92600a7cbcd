"""Column expressions that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_label(size: Column) -> Column:
    """Bytes as `12 B`, `1.5 KB`, `15 KB`; one decimal under ten; nothing for negative or non-finite sizes."""
    n = size.cast("double")
    steps = [(1024.0, "KB"), (1024.0**2, "MB"), (1024.0**3, "GB")]
    shown = lambda unit, name: F.when(n / unit < 10, F.format_string(f"%.1f {name}", n / unit)).otherwise(F.format_string(f"%.0f {name}", n / unit))
    return (
        F.when(n.isNull() | F.isnan(n) | (n < 0) | (n == float("inf")), "").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < steps[1][0], shown(*steps[0])).when(n < steps[2][0], shown(*steps[1])).otherwise(shown(*steps[2]))
    )


def name_date(name: Column) -> Column:
    """The first yyyy-mm-dd (or _ or .) of a file name; months and days beyond the calendar roll over."""
    part = lambda i: F.regexp_extract(name, r"(\d{4})[-_.](\d{2})[-_.](\d{2})", i)
    number = lambda i: part(i).try_cast("int")
    return F.when(part(1) != "", F.date_add(F.add_months(F.try_to_date(F.concat(part(1), F.lit("-01-01"))), number(2) - 1), number(3) - 1))


def base_name(name: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.pdf$", ""), F.lit("")), F.lit(default))


def natural_key(name: Column) -> Column:
    """A key whose order compares runs of digits as numbers, whatever their length, and ignores case and accents of any script.

    A run of digits gets its length, without leading zeros, ahead; the Unicode collation does the rest.
    """
    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", "")
    numbered = lambda x: F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))
    return F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), numbered(x)).otherwise(x)), ""), "UNICODE_CI_AI")


def rgb(colour: Column, fallback: str = "#000000") -> Column:
    """struct<r,g,b> of a six-digit hexadecimal colour as shares of 255; black where it is none, the fallback where it is empty."""
    shape = "^#?([0-9A-Fa-f]{2})([0-9A-Fa-f]{2})([0-9A-Fa-f]{2})$"
    given = F.coalesce(F.nullif(colour, F.lit("")), F.lit(fallback))
    share = lambda i: F.coalesce(F.conv(F.nullif(F.regexp_extract(given, shape, i), F.lit("")), 16, 10).cast("double") / 255, F.lit(0.0))
    return F.struct(*[share(i).alias(c) for i, c in ((1, "r"), (2, "g"), (3, "b"))])


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)
