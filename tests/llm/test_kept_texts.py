"""Pairs go to the hashed texts, which lie in buckets; what is left of a text is a bit an element."""

import random

import numpy as np

from leafmill.llm import order_minhash
from leafmill.llm.shared import join_keyed
from leafmill.sources.store import keyed_table


def test_what_is_left_of_a_text_is_a_bit_an_element():
    rng = random.Random(2)
    a, b, c = (np.array([rng.randrange(50) for _ in range(400)], np.uint64) for _ in range(3))
    b[:200] = a[:200]
    c[100:300] = a[100:300]
    own = order_minhash.elements([a])[0]
    once = order_minhash.left_over(None, a, b)
    twice = order_minhash.left_over(once, a, c)
    assert len(twice) == -(-len(own) // 8)
    want = own[~np.isin(own, np.concatenate([order_minhash.elements([t])[0] for t in (b, c)]))]
    assert own[order_minhash.bits(twice, len(own))].tolist() == want.tolist() and len(want)
    assert order_minhash.left_over(None, a, a) == b""


def test_pairs_go_to_the_texts_which_are_not_shuffled(spark):
    parts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = spark.createDataFrame([(i, f"word{i} and some more words {i}".encode()) for i in range(3000)], "key long, raw binary")
        texts, drop = keyed_table(order_minhash._hashed_texts(raw), "test_texts", "key")
        edges = spark.range(1500).selectExpr("id AS place", "id AS key", "id + 1500 AS other", "CAST(NULL AS BINARY) AS rest")
        found = order_minhash._verified(edges, texts, 0.8)
        assert found.count() == 1500
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the pairs, then the pairs with one text; no table of texts
        drop()
        assert not [t for t in spark.catalog.listTables() if t.name.startswith(("test_texts", "omh_texts"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", parts)


def test_tables_without_hot_keys_are_joined_once(spark):
    parts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).selectExpr("id % 2000 AS k", "id AS v")
        found = join_keyed(rows, rows.groupBy("k").count().withColumnRenamed("count", "n"), ["k"], 4000)
        assert found.count() == 4000
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 0
        some = spark.range(4000).selectExpr("IF(id < 100, -1, id) AS k", "id AS v")
        assert join_keyed(some, some.groupBy("k").count().withColumnRenamed("count", "n"), ["k"], 4000).count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", parts)
