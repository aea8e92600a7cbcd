"""Chat formatting: cumulative snapshots collapse into the longest conversations, which are rendered; Spark SQL only.

A conversation log often holds a dialogue again after each turn. Rolling hashes name every prefix of turns: the running
exclusive-or of each turn's hash with its position, 2 x 64 bits. A conversation whose full hash is a proper prefix of
another is dropped by an anti-join; of equal conversations the smallest id stays.

The turns are dealt once, by ranges of (conversation, turn, role, text), and written in that order. A conversation may
span several ranges; at most one run of turns in a range continues from the one before it, so what positions and hashes
must add to a run is a table of as many rows as there are ranges. From there on only keys and hashes are shuffled, and
texts come back for the conversations that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT, hot_keys, stored

#: Turns of a rendered part.
BLOCK_TURNS = 1_024
#: A range of the turns gets the high bits of monotonically_increasing_id().
RANGE_BITS = 33
CONV = ["no_id", "conv"]
RUN = [*CONV, "range"]


def ordered(turns: DataFrame) -> DataFrame:
    """The distinct turns, written in order of conversation, turn, role, text (null first): no_id, conv, role, text, at, range."""
    rows = turns.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", "text")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows fall into one range, so they are folded there without another exchange
    rows = rows.repartitionByRange(n, *rows.columns).dropDuplicates().sortWithinPartitions(*rows.columns)
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", RANGE_BITS).cast("int"))
    return stored(rows.drop("turn"), "chat-turns")


def _spanning(rows: DataFrame, value: Column) -> DataFrame:
    """RUN and `sum` of the runs of conversations that stand first or last in a range: two conversations a range at most."""
    edges = rows.groupBy("range").agg(F.min(F.struct(*CONV)).alias("low"), F.max(F.struct(*CONV)).alias("high"))
    edges = edges.select(F.explode(F.array("low", "high")).alias("c")).select("c.*").distinct()
    return rows.join(F.broadcast(edges), CONV, "left_semi").groupBy(*RUN).agg(value.alias("sum"))


def _carried(rows: DataFrame, total, value: Column, out: str) -> DataFrame:
    """RUN and `out`, an aggregate of the conversation's runs in earlier ranges: one run a range at most has any."""
    before = Window.partitionBy(*CONV).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return _spanning(rows, total(value)).withColumn(out, total(F.col("sum")).over(before)).where(F.col(out).isNotNull()).select(*RUN, out)


def prefixes(rows: DataFrame) -> DataFrame:
    """no_id, conv, range, at, pos (from 1), last, h1, h2 of every turn of ordered().

    h1 and h2 name the turns up to pos; last says that the conversation ends there.
    """
    own = Window.partitionBy(*RUN).orderBy("at")
    turn = [F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    keys = rows.select(*RUN, "at", *[F.xxhash64(F.lit(k), *turn).alias(f"t{k}") for k in (1, 2)])
    keys = keys.withColumn("pos", F.row_number().over(own)).withColumn("last", F.lead("at").over(own).isNull())
    keys = keys.join(F.broadcast(_carried(rows, F.sum, F.lit(1).cast("long"), "turns_before")), RUN, "left").withColumn("pos", F.col("pos") + F.coalesce("turns_before", F.lit(0).cast("long")))
    later = _spanning(rows, F.count("*")).withColumn("next", F.lead("range").over(Window.partitionBy(*CONV).orderBy("range"))).where("next is not null").select(*RUN, "next")
    keys = keys.join(F.broadcast(later), RUN, "left").withColumn("last", F.col("last") & F.col("next").isNull())
    for k in (1, 2):
        keys = keys.withColumn(f"x{k}", F.xxhash64(F.lit(k), "pos", f"t{k}"))
    keys = stored(keys.select(*RUN, "at", "pos", "last", "x1", "x2", *[F.bit_xor(f"x{k}").over(own).alias(f"r{k}") for k in (1, 2)]), "chat-keys")
    for k in (1, 2):
        keys = keys.join(F.broadcast(_carried(keys, F.bit_xor, F.col(f"x{k}"), f"b{k}")), RUN, "left")
    return keys.select(*RUN, "at", "pos", "last", *[F.col(f"r{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0).cast("long"))).alias(f"h{k}") for k in (1, 2)])


def maximal(keys: DataFrame) -> DataFrame:
    """no_id, conv, n_turns of the conversations of prefixes() that no other one continues; of equal ones, that with the smallest id."""
    whole = keys.where("last").groupBy("pos", "h1", "h2").agg(F.min(F.struct(*CONV)).alias("c"))
    proper = keys.where("not last").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("c.*", F.col("pos").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text: each maximal conversation, rendered in parts of at most BLOCK_TURNS turns.

    turns: conv_id, turn, role, text; other columns are ignored. A null role renders as `unknown`, a null text as
    nothing; rows without a conv_id are one conversation; a row that repeats another of its conversation is taken once,
    and turns of one number stand in order of role and text; an empty table gives no rows.
    """
    rows = ordered(turns)
    keys = prefixes(rows)
    starts = keys.where("pos = 1").select(*CONV, F.col("at").alias("first"))
    kept = stored(maximal(keys).join(starts, CONV), "chat-kept")
    total = rows.count()
    rows = rows.join(F.broadcast(_carried(rows, F.sum, F.lit(1).cast("long"), "turns_before")), RUN, "left")
    # a run that continues begins with its range
    place = F.coalesce(F.col("at") - F.shiftleft(F.col("range").cast("long"), RANGE_BITS) + F.col("turns_before"), F.col("at") - F.col("first"))
    long, short = F.broadcast(hot_keys(kept, total, "n_turns")), kept.where(F.col("n_turns") * HOT <= total)
    parts = []
    for some in (long, short):
        met = rows.join(some, CONV).withColumn("part", F.floor(place / BLOCK_TURNS))
        texts = F.array_sort(F.collect_list(F.struct("at", rendered(F.col("role"), F.col("text")).alias("t"))))
        parts.append(met.groupBy(*CONV, "part", "n_turns").agg(texts.alias("all")))
    both = parts[0].unionByName(parts[1])
    return both.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), "part", "n_turns", F.array_join(F.col("all.t"), "").alias("text"))
