"""Scripts, fonts and cells of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hebrew letters and presentation forms; strong characters and right-to-left ones.
HEBREW = r"[\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}]"
STRONG = r"[A-Za-z\x{0591}-\x{07FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
RTL = r"[\x{0591}-\x{07FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
NEUTRAL = r"^[0-9\s/\-.:,()+]+$"
#: Families with Hebrew letters, families of handwriting, and the stand-ins.
HEBREW_FONTS = ["Arimo", "Tinos", "Cousine", "Assistant", "Heebo", "Gveret Levin", "Playpen Sans Hebrew"]
HANDWRITING_FALLBACK, TEXT_FALLBACK = "Gveret Levin", "Arimo"
#: The most cells of a field; ascent and descent of families by em, the line height, the least padding and the slack.
MAX_CELLS = 60
METRICS = [
    ("Arimo", 0.905, 0.212), ("Tinos", 0.891, 0.216), ("Cousine", 0.833, 0.300), ("Assistant", 1.021, 0.287), ("Heebo", 1.048, 0.421), ("Caveat", 0.960, 0.300),
    ("Dancing Script", 0.920, 0.280), ("Great Vibes", 0.851, 0.401), ("Gveret Levin", 0.990, 0.310), ("Pacifico", 1.303, 0.453), ("Playpen Sans Hebrew", 1.070, 0.460), ("Sacramento", 0.930, 0.529),
]
LINE_HEIGHT, LEAST_PADDING, SLACK = 1.05, 0.12, 0.06


def box_padding(texts: DataFrame, metrics: DataFrame) -> DataFrame:
    """texts with padding: the em above and below that a family (family, ascent, descent; a few rows) needs beyond its line; the least one if unknown."""
    over = F.greatest(F.lit(0.0), (F.col("ascent") + F.col("descent") - LINE_HEIGHT) / 2) + SLACK
    rows = texts.join(F.broadcast(metrics), "family", "left")
    return rows.withColumn("padding", F.coalesce(F.greatest(F.lit(LEAST_PADDING), over), F.lit(LEAST_PADDING))).drop("ascent", "descent")


def text_direction(docs: DataFrame, fallback: str | None = None) -> DataFrame:
    """doc_id, dir: of the first strong character; digits and marks alone run left to right; else the stored fallback."""
    first = F.regexp_extract(F.coalesce("text", F.lit("")), f"({STRONG})", 1)
    stored = F.col(fallback) if fallback else F.lit(None).cast("string")
    way = F.when(first.rlike(RTL), "rtl").when(first != "", "ltr").when(F.col("text").rlike(NEUTRAL), "ltr").otherwise(F.coalesce(stored, F.lit("ltr")))
    return docs.select("doc_id", way.alias("dir"))


def font_fallback(texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """id, requested, resolved: one family for a whole text; fonts is the catalogue (family, hebrew, handwriting), a few rows."""
    family = F.coalesce(F.nullif(F.col("requested"), F.lit("")), F.lit(TEXT_FALLBACK))
    wanted = texts.select("id", "requested", family.alias("family"), F.coalesce(F.col("text").rlike(HEBREW), F.lit(False)).alias("written"))
    rows = wanted.join(F.broadcast(fonts), "family", "left")  # a few families: a shuffle by them would fill as many tasks
    stand_in = F.when(F.coalesce("handwriting", F.lit(False)), HANDWRITING_FALLBACK).otherwise(TEXT_FALLBACK)
    return rows.select("id", "requested", F.when(~F.col("written") | F.coalesce("hebrew", F.lit(False)), F.col("family")).otherwise(stand_in).alias("resolved"))


def charset_gaps(docs: DataFrame, charsets: DataFrame) -> DataFrame:
    """lang, ch, docs: characters that a language's documents hold but its declared set (lang, ch) does not."""
    found = docs.select("lang", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("ch")).where("ch <> ''").groupBy("lang", "ch").agg(F.count("*").alias("docs"))
    return found.join(charsets, ["lang", "ch"], "left_anti")


def cell_layout(fields: DataFrame) -> DataFrame:
    """id, idx, ch, center of fields (id, text, cells, rtl): one character a cell, blanks kept, overflow dropped.

    A count given is rounded and held to 1..60 (0 counts as none); without one there are as many cells as characters.
    """
    chars = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r?\n", ""), ""), lambda c: c != "")
    given = F.nullif(F.col("cells"), F.lit(0))
    count = F.when(given.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(MAX_CELLS), F.floor(given + 0.5).cast("int")))).otherwise(F.greatest(F.lit(1), F.size("chars")))
    rows = fields.withColumn("chars", chars).withColumn("count", count).select("id", "chars", "count", "rtl", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("idx"))
    center = (F.col("idx") + 0.5) / F.col("count")
    return rows.select("id", "idx", F.coalesce(F.get("chars", F.col("idx")), F.lit("")).alias("ch"), F.when(F.col("rtl"), 1 - center).otherwise(center).alias("center"))
