"""The driver's tables with declared schemas, and the inputs that the jobs derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.functions.arrays import bound

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}
PAGE_LINES = 10
ELEMENT_TYPES = ["text", "rectangle", "ellipse", "line", "symbol", "signature", "whiteout", "blackout", "blur"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored; SCHEMAS says which columns the jobs rely on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_drift(stored: DataFrame, declared: str | StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(column, state, declared type, stored type) of each column that is missing, extra or retyped in what is stored."""
    want = {f.name: f.dataType.simpleString() for f in _schema(declared)}
    have = {f.name: f.dataType.simpleString() for f in stored.schema}
    states = [(c, "missing" if c not in have else "retyped", t, have.get(c)) for c, t in want.items() if have.get(c) != t]
    return states + [(c, "extra", None, t) for c, t in have.items() if c not in want]


def as_declared(stored: DataFrame, declared: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Rows in the declared columns and types, and the rows as stored, with `uncast`, of which a value can't be cast.

    A missing column is null, an extra one is left out; a null is a value of every type. Columns that are stored as declared
    are not looked at, so their filters still reach the files.
    """
    retyped = {c: t for c, state, t, _ in schema_drift(stored, declared) if state == "retyped"}
    value = lambda c, t: F.col(f"`{c}`").try_cast(t) if c in retyped else F.col(f"`{c}`") if c in stored.columns else F.lit(None).cast(t)
    bad = [F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(), F.lit(c)) for c, t in retyped.items()]
    marks = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    fine = stored.where(F.size(marks) == 0) if bad else stored
    return fine.select(*[value(f.name, f.dataType).alias(f.name) for f in _schema(declared)]), stored.withColumn("uncast", marks).where(F.size("uncast") > 0)


def _schema(declared: str | StructType) -> StructType:
    return declared if isinstance(declared, StructType) else StructType.fromDDL(declared)


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table, registered as a view of its name."""
    found = {name: table(spark, sf_dir, name) for name in SCHEMAS}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def page_texts(text: Column, lines: int = PAGE_LINES) -> Column:
    """The pages of a text: `lines` consecutive lines each; a null text is one empty page. The text is split once."""
    cut = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    pages = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / lines).cast("int")), lambda p: F.array_join(F.slice(all_, p * lines + 1, lines), "\n"))
    return bound(cut, pages)


def doc_pages(docs: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """source, doc_id, page_no (from 1), text of the pages of each document."""
    return docs.select("source", "doc_id", F.posexplode(page_texts(F.col("text"), lines)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def n_pages(text: Column, lines: int = PAGE_LINES) -> Column:
    """How many pages page_texts() has, without making them."""
    return F.floor((F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)) - 1) / lines).cast("int") + 1


def page_counts(docs: DataFrame, lines: int = PAGE_LINES, more: list[str] = []) -> DataFrame:  # noqa: B006
    """source, doc_id, pages (and more columns of docs) without making the pages."""
    return docs.select("source", "doc_id", *more, n_pages(F.col("text"), lines).alias("pages"))


def event_key(events: DataFrame) -> Column:
    """The number k of an event's props."""
    return F.get_json_object("props", "$.k").cast("int")


def elements(lineitem: DataFrame) -> DataFrame:
    """Placed elements in percent of a page; rows returned have no width."""
    kind = F.element_at(F.array(*map(F.lit, ELEMENT_TYPES)), (F.col("l_linenumber") % 9 + 1).cast("int"))
    return lineitem.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("page_index"), F.concat(F.lit("el-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), kind.alias("type"),
        (F.col("l_partkey") % 101).cast("double").alias("left"), (F.col("l_suppkey") * 7 % 101).cast("double").alias("top"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("width"), (F.col("l_tax") * 100 + 1).alias("height"),
    )


ACTIONS = {"click": "ADD", "view": "UPDATE", "purchase": "DELETE", "signup": "CLEAR_PAGE", "error": "UNDO"}


def edit_log(events: DataFrame, *more: str) -> DataFrame:
    """session, ts, event_id, action, element, page_index, value."""
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ACTIONS.items()])
    k = event_key(events)
    return events.select(F.col("user_id").alias("session"), "ts", "event_id", action.alias("action"), F.concat(F.lit("el-"), (k % 10).cast("string")).alias("element"), (k % 5).alias("page_index"), "value", *more)


#: Fields of an element's record that record_log() patches.
RECORD_FIELDS = ["page_index", "value", "colour", "size"]


def record_log(events: DataFrame) -> DataFrame:
    """session, ts, event_id, action, element, page_index (of a cleared page), patch: the fields that an action sets, by name.

    An added element has a page, a value, a colour and for the most part a size; an update sets one or two fields, some to null.
    """
    k, text = event_key(events), lambda c: c.cast("string")
    name = lambda field, v: (F.lit(field), v)
    value, page = name("value", text(F.col("value"))), name("page_index", text(F.col("event_id") % 5))
    whole = [*page, *value, *name("colour", F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), k % 3 + 1))]
    added = F.when(F.col("event_id") % 3 > 0, F.create_map(*whole, *name("size", text(k % 7)))).otherwise(F.create_map(*whole))
    changed = F.when(F.col("event_id") % 4 == 0, F.create_map(*name("value", F.when(F.col("event_id") % 5 > 0, value[1])))).when(F.col("event_id") % 4 == 1, F.create_map(*name("colour", F.when(k % 2 == 1, F.lit("black")))))
    changed = changed.when(F.col("event_id") % 4 == 2, F.create_map(*page)).otherwise(F.create_map(*name("size", text(k % 9)), *value))
    log = edit_log(events.withColumn("_patch", F.when(F.col("event_type") == "click", added).when(F.col("event_type") == "view", changed)), "_patch")
    return log.drop("value").withColumnRenamed("_patch", "patch")
