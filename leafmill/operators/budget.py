"""Sizes of renditions and the best one that fits a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scale and quality of the presets.
PRESETS = [("low", 2.0, 0.8), ("medium", 1.5, 0.6), ("high", 1.0, 0.4)]
#: Scales tried in turn, quality bounds, bisection steps, bytes of overhead a page.
TIERS = [1.5, 1.1, 0.85, 0.65, 0.5]
QUALITY_LOW, QUALITY_HIGH, STEPS, PAGE_BYTES = 0.05, 0.92, 6, 300


def modelled_bytes(chars: Column, scale: Column, quality: Column) -> Column:
    """The size model of these tables: ceil(chars * scale^2 * (0.1 + quality)), growing with quality."""
    return F.ceil(chars * scale * scale * (F.lit(0.1) + quality)).cast("long")


def size_presets(docs: DataFrame) -> DataFrame:
    """doc_id, level, bytes, saving (share of n_chars saved) of the three presets."""
    presets = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(s).alias("scale"), F.lit(q).alias("quality")) for n, s, q in PRESETS])
    rows = docs.select("doc_id", "n_chars", F.explode(presets).alias("p"))
    size = modelled_bytes(F.col("n_chars"), F.col("p.scale"), F.col("p.quality"))
    return rows.select("doc_id", "p.level", size.alias("bytes"), F.when(F.col("n_chars") > 0, 1 - size / F.col("n_chars")).alias("saving"))


def renditions(docs: DataFrame) -> DataFrame:
    """doc_id, tier, k, quality, bytes: 5 scales by the 64 qualities that six bisection steps can reach."""
    grid = 2**STEPS
    tiers = F.array(*[F.struct(F.lit(i + 1).alias("tier"), F.lit(s).alias("scale")) for i, s in enumerate(TIERS)])
    rows = docs.select("doc_id", "n_chars", F.explode(tiers).alias("t")).select("doc_id", "n_chars", "t.*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"))
    quality = F.lit(QUALITY_LOW) + F.col("k") * (QUALITY_HIGH - QUALITY_LOW) / grid
    return rows.select("doc_id", "tier", "k", quality.alias("quality"), modelled_bytes(F.col("n_chars"), F.col("scale"), quality).alias("bytes"))


def fit_to_budget(docs: DataFrame, sizes: DataFrame, target: int) -> DataFrame:
    """doc_id, tier, quality, bytes, met_target of each document (doc_id, n_chars, pages).

    A document within the target passes unchanged (tier 0). Otherwise the first tier whose smallest rendition fits the
    target less 300 bytes a page (at least 1), at the highest quality that fits; if none fits, the smallest of all.
    Small documents never meet the candidates.
    """
    small = docs.where(F.col("n_chars") <= target).select("doc_id", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("quality"), F.col("n_chars").alias("bytes"), F.lit(True).alias("met_target"))
    large = docs.where(F.col("n_chars") > target).select("doc_id", "pages", F.greatest(F.lit(1), target - PAGE_BYTES * F.col("pages")).alias("budget"))
    rows = large.join(sizes, "doc_id").withColumn("fits", F.col("bytes") <= F.col("budget"))
    order = [F.desc("fits"), F.when(F.col("fits"), F.col("tier")), F.when(F.col("fits"), -F.col("k")), "bytes", "tier", "k"]
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("n = 1")
    total = F.col("bytes") + PAGE_BYTES * F.col("pages")
    return small.unionByName(best.select("doc_id", "tier", "quality", total.alias("bytes"), (total <= target).alias("met_target")))


def fit_own(docs: DataFrame, target: int) -> DataFrame:
    """fit_to_budget() of the modelled sizes, within the row: sizes grow with quality, so a tier is chosen by its smallest rendition."""
    grid = 2**STEPS
    quality = lambda k: F.lit(QUALITY_LOW) + k * (QUALITY_HIGH - QUALITY_LOW) / grid
    size = lambda scale, k: modelled_bytes(F.col("n_chars"), scale, quality(k))
    tiers = F.array(*[F.struct(F.lit(i + 1).alias("tier"), F.lit(s).alias("scale")) for i, s in enumerate(TIERS)])
    smallest = F.transform(tiers, lambda t: F.struct(size(t["scale"], F.lit(0)).alias("bytes"), t["tier"].alias("tier"), t["scale"].alias("scale")))
    rows = docs.withColumn("budget", F.greatest(F.lit(1), target - PAGE_BYTES * F.col("pages"))).withColumn("_smallest", F.when(F.col("n_chars") > target, smallest))
    fits = F.array_min(F.transform(F.filter("_smallest", lambda c: c["bytes"] <= F.col("budget")), lambda c: F.struct(c["tier"].alias("tier"), c["scale"].alias("scale"))))
    least = F.array_min("_smallest")
    rows = rows.withColumn("_fit", fits).withColumn("_tier", F.coalesce("_fit", F.when(least.isNotNull(), F.struct(least["tier"].alias("tier"), least["scale"].alias("scale")))))
    best = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: size(F.col("_tier.scale"), k) <= F.col("budget")))
    rows = rows.withColumn("_k", F.when(F.col("_tier").isNotNull(), F.coalesce(F.when(F.col("_fit").isNotNull(), best), F.lit(0))))
    total = F.coalesce(size(F.col("_tier.scale"), F.col("_k")) + PAGE_BYTES * F.col("pages"), F.col("n_chars"))
    return rows.select("doc_id", F.coalesce("_tier.tier", F.lit(0)).alias("tier"), quality(F.col("_k")).alias("quality"), total.alias("bytes"), (total <= target).alias("met_target"))
