"""Edit logs (session, ts, event_id, action, element, page_index, value) folded, undone and reverted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranks import with_rank


def fold_edits(log: DataFrame) -> DataFrame:
    """session, element, page_index, value of the elements that are left.

    ADD starts an element afresh, UPDATE changes the value of a live one field by field (null changes nothing), DELETE and
    CLEAR_PAGE (of the page it stands on) end it. Updates of unknown elements do nothing. Order is (ts, event_id).
    """
    order = F.struct("ts", "event_id")
    clears = log.where("action = 'CLEAR_PAGE'").groupBy("session", "page_index").agg(F.max(order).alias("cleared"))
    ends = log.where("action = 'DELETE'").groupBy("session", "element").agg(F.max(order).alias("deleted"))
    own = Window.partitionBy("session", "element")
    adds = log.where("action in ('ADD', 'UPDATE')").withColumn("at", order)
    rows = adds.withColumn("added", F.max(F.when(F.col("action") == "ADD", F.col("at"))).over(own)).where("added is not null and at >= added")
    now = rows.groupBy("session", "element").agg(F.max("added").alias("added"), F.max_by("page_index", F.when(F.col("action") == "ADD", F.col("at"))).alias("page_index"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"))
    # an update after the element's end is dropped: the last addition decides whether it lives
    live = now.join(ends, ["session", "element"], "left").join(clears, ["session", "page_index"], "left")
    gone = F.coalesce(F.col("deleted") > F.col("added"), F.lit(False)) | F.coalesce(F.col("cleared") > F.col("added"), F.lit(False))
    return live.where(~gone).select("session", "element", "page_index", "value")


def fold_records(log: DataFrame, fields: list[str], page: str = "page_index") -> DataFrame:
    """session, element and a column for each field: the records that are left of a log whose `patch` maps fields to values.

    ADD starts a record afresh. UPDATE sets the fields that its patch names, to null where it says null, and leaves the others.
    DELETE ends a record, and so does CLEAR_PAGE of the page on which it stands at that time. Updates of unknown records do
    nothing. Order is (ts, event_id). Each field's last patch is an aggregate, so a record of any number of patches is
    gathered nowhere; only changes of pages are put in order.
    """
    at, add = F.struct("ts", "event_id"), F.col("action") == "ADD"
    names = lambda field: add | ((F.col("action") == "UPDATE") & F.map_contains_key("patch", field))
    last = lambda field: F.max_by(F.struct(F.col("patch")[field].alias("v")), F.when(names(field), at)).alias(field)
    own = log.where("action in ('ADD', 'UPDATE', 'DELETE')").groupBy("session", "element")
    now = own.agg(F.max(F.when(add, at)).alias("added"), F.max(F.when(F.col("action") == "DELETE", at)).alias("deleted"), *map(last, fields))
    live = now.where("added is not null and (deleted is null or deleted < added)").select("session", "element", *[F.col(f)["v"].alias(f) for f in fields])
    return live.join(_cleared(log.where("action in ('ADD', 'UPDATE')").where(names(page)), log.where("action = 'CLEAR_PAGE'"), page), ["session", "element"], "left_anti")


def _cleared(moves: DataFrame, clears: DataFrame, page: str) -> DataFrame:
    """session, element of the records that stood on a page when it was cleared, since they were added last.

    The next clearing after a record comes to a page is found in one sorted pass over a page, not in a join of all pairs.
    """
    at = F.struct("ts", "event_id")
    own = Window.partitionBy("session", "element")
    rows = moves.select("session", "element", F.col("patch")[page].alias("_page"), at.alias("at"), F.max(F.when(F.col("action") == "ADD", at)).over(own).alias("added"), F.lead(at).over(own.orderBy("ts", "event_id")).alias("until"))
    stays = rows.where("added is not null and at >= added").drop("added")
    none = lambda kind: F.lit(None).cast(kind)
    cleared = clears.select("session", none("string").alias("element"), F.col("page_index").cast("string").alias("_page"), at.alias("at"), none(dict(stays.dtypes)["until"]).alias("until"))
    both = stays.unionByName(cleared).where("_page is not null")
    later = Window.partitionBy("session", "_page").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("next", F.min(F.when(F.col("element").isNull(), F.col("at"))).over(later)).where("element is not null and next is not null")
    return found.where("until is null or next < until").select("session", "element").distinct()


def undo_match(log: DataFrame) -> DataFrame:
    """session, event_id, undone_by, noop: each undo takes back the latest action not yet undone.

    With +1 for an action and -1 for an undo, the depth is the running sum less its lowest value so far under 0; an undo
    that sets a new lowest value finds nothing to undo. Pairs stand next to each other among the rows of one level.
    """
    own = Window.partitionBy("session").orderBy("ts", "event_id")
    rows = log.select("session", "ts", "event_id", (F.col("action") == "UNDO").alias("undo")).withColumn("s", F.sum(F.when(F.col("undo"), -1).otherwise(1)).over(own))
    lowest = F.least(F.lit(0), F.min("s").over(own))
    before = F.least(F.lit(0), F.coalesce(F.min("s").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("depth", F.col("s") - lowest).withColumn("noop", F.col("undo") & (F.col("s") < before))
    level = Window.partitionBy("session", "level").orderBy("ts", "event_id")
    live = rows.withColumn("level", F.when(F.col("noop"), None).otherwise(F.when(F.col("undo"), F.col("depth") + 1).otherwise(F.col("depth"))))
    nxt = F.when(F.lead("undo").over(level) & ~F.col("undo") & F.col("level").isNotNull(), F.lead("event_id").over(level))
    return live.select("session", "event_id", nxt.alias("undone_by"), "noop")


def revert_selected(elements: DataFrame, log: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """elements (element, pos, value) without the rows that the chosen actions created and with those they deleted, at the
    end; the log (action_id, element, snapshot: array of elements or null for a creation) without the chosen actions."""
    picked = log.join(chosen, "action_id", "left_semi")
    made = picked.where("snapshot is null").select("element")
    back = picked.where("snapshot is not null").select("action_id", F.posexplode("snapshot").alias("n", "e")).select("e.element", F.struct(F.lit(1).alias("part"), F.col("action_id").alias("a"), F.col("n").cast("long").alias("b")).alias("pos"), "e.value")
    kept = elements.join(made, "element", "left_anti").select("element", F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("pos"), "value")
    return kept.unionByName(back.join(kept.select("element"), "element", "left_anti")), log.join(chosen, "action_id", "left_anti")


def action_feed(log: DataFrame, n: int) -> DataFrame:
    """The n newest actions of each session with their place."""
    place = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def recent_top10(items: DataFrame, owner: str, at: str = "ts", tie: str = "event_id", n: int = 10) -> DataFrame:
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.desc(tie)))).where(F.col("rank") <= n)


def id_seed(elements: DataFrame) -> DataFrame:
    """next_id (decimal): one more than the largest number of ids shaped el-<n>, 0 if there is none; numbers of up to 37 digits."""
    digits = F.regexp_extract("id", r"^el-0*([0-9]+)$", 1)
    largest = F.max(F.when(digits != "", digits.cast("decimal(37,0)")))
    return elements.agg((F.coalesce(largest, F.lit(-1)) + 1).alias("next_id"))


def assign_ids(rows: DataFrame, next_id: int, keys: list) -> DataFrame:
    """rows with id el-<n>, numbered from next_id in the order of keys."""
    return with_rank(rows, keys, "_n").withColumn("id", F.concat(F.lit("el-"), (F.col("_n") + next_id - 1).cast("string"))).drop("_n")
