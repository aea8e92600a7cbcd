"""Nearest neighbours where one id holds many rows."""

import numpy as np

from leafmill.llm import multi_index


def test_an_id_of_many_rows_does_not_hide_the_others(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(460, 16))
    x[60:] = x[0] + 0.01 * rng.normal(size=(400, 16))  # 400 rows of one id, right beside the query
    ids = [*range(60), *[999] * 400]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x.astype(np.float32), strict=True)], "vec_id long, embedding array<float>").coalesce(1)
    found = sorted((r["rank"], r.vec_id) for r in multi_index.neighbours(df, df.where("vec_id = 0")).collect())
    assert [rank for rank, _ in found] == list(range(1, 11))
    d = ((x[1:60] - x[0]) ** 2).sum(1)
    assert len({i for _, i in found} & {999, *(np.argsort(d)[:9] + 1).tolist()}) >= 9


def test_an_exact_search_gives_k_ids():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    ids = np.array([*range(20), *[77] * 280])
    codes = multi_index.encoded(x, multi_index.learn(x))
    shard = multi_index.Shard([ids[i : i + 1] for i in range(300)], x, codes, 0)
    for i in range(0, 300, 23):
        best = {}
        for other, d in zip(ids.tolist(), np.sqrt(((x - x[i]) ** 2).sum(1)).tolist(), strict=True):
            if other != ids[i]:
                best[other] = min(d, best.get(other, np.inf))
        want = sorted(best, key=lambda o: (best[o], o))[:10]
        assert shard.nearest(ids[i], x[i], codes[i], 16, 10)[0].tolist() == want


def test_the_sample_takes_each_row_of_an_id_by_itself(spark):
    rng = np.random.default_rng(8)
    rows = [(1, [float(v)]) for v in rng.normal(size=2000)] + [(2, [0.5])] * 2000 + [(i, [float(i)]) for i in range(10, 2010)]
    found = multi_index.sampled(spark.createDataFrame(rows, "id long, v array<double>"), 400).collect()
    assert 100 < sum(r.id == 1 for r in found) < 300
    assert sum(r.id == 2 for r in found) <= 1
