"""State of many keys in one place: keys are dealt into buckets, and a batch reads and writes a bucket's state once.

A stateful processor in Python asks the JVM for each state it touches. With a group a key that is several calls a row and a
data frame a key; with a group a bucket it is a few calls and one frame for thousands of rows. A batch rewrites the buckets
it touches, whose size is the live state by the number of buckets.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Buckets of a stream; fixed as long as its checkpoint lives, as its shuffle partitions are.
BUCKETS = 1024
#: Stands for a null among whole numbers on the way to Python, where a column with nulls would become one of doubles; sorts last.
NONE = 2**63 - 1
PANDAS = {"long": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean", "string": "object"}


def in_buckets(rows: DataFrame, key: str, processor: StatefulProcessor, mode: str = "None", buckets: int = BUCKETS) -> DataFrame:
    """What a processor with a SCHEMA gives for rows in buckets of their keys. A time c goes to it as c_micros."""
    columns = []
    for c, kind in rows.dtypes:
        if kind in ("bigint", "int"):
            columns.append(F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c))
        elif kind.startswith("timestamp"):
            columns.append(F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(NONE)).alias(f"{c}_micros"))
            columns += [F.col(c)] if c == "ts" else []  # the watermark's column
        else:
            columns.append(F.coalesce(c, F.lit(False)).alias(c) if kind == "boolean" else F.col(c))
    dealt = rows.select(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"), *columns)
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, processor.SCHEMA, "Append", mode)


def values(frames: Iterator[pd.DataFrame], columns: list[str], order: list[str] | None = None) -> Iterable[tuple]:
    """The columns' values row by row, nulls as None, sorted by `order` or as they come."""
    found = pd.concat(list(frames))
    if order:
        found = found.sort_values(order, kind="stable")
    plain = lambda c: [None if v == NONE else v for v in c.tolist()] if c.dtype.kind == "i" else [None if v != v else v for v in c.tolist()]
    return zip(*[plain(found[c]) for c in columns], strict=True)


class Bucket(StatefulProcessor):
    """Base of processors by bucket: the state is a dictionary from keys to values that JSON can hold, empty ones aside."""

    SCHEMA: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "entries string")

    def load(self) -> dict:
        return dict(json.loads(self.kept.get()[0])) if self.kept.exists() else {}

    def store(self, state: dict) -> None:
        if state:
            self.kept.update((json.dumps(list(state.items()), separators=(",", ":")),))
        else:
            self.kept.clear()

    def wake(self, before: int | None, then: int | None) -> None:
        """A bucket has one timer, for what expires first."""
        if before != then:
            if before is not None:
                self.handle.deleteTimer(before)
            if then is not None:
                self.handle.registerTimer(then)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        kinds = [c.split(" ") for c in self.SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pd.DataFrame({name: pd.Series(list(v), dtype=PANDAS[kind]) for (name, kind), v in zip(kinds, columns, strict=True)})

    def close(self) -> None:
        pass
