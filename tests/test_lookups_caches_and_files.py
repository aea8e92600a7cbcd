"""Look-ups of style modules, stale caches, reads against a declared schema, and the sink by key."""

from leafmill.operators import site as S
from leafmill.sources.store import shared_dir, write_by_key
from leafmill.sources.tables import as_declared, schema_drift


def test_lookups_of_odd_sources(spark):
    sources = [
        ("/src/a/x.tsx", "import s from './../b/m.module.css'\nimport t from \"/src/t.module.css\";\n<p class={s['one']} id={s.two} /> s.one t.any\ns.two + other.two"),
        ("/src/a/again.tsx", "import s from './none.module.css'\nimport s from '../b/m.module.css'\ns.one"),
        ("/src/a/plain.tsx", "s.two"),
        ("/src/a/null.tsx", None),
        ("/src/a/empty.tsx", ""),
    ]
    modules = [("/src/b/m.module.css", ".one{} /* .two{}\n */ .-x:hover{}"), ("/src/b/m.module.css", ".one{}"), ("/src/c/m.module.css", ".two{}"), ("/src/t.module.css", None)]
    found = S.undefined_lookups(spark.createDataFrame(sources, "file string, text string"), spark.createDataFrame(modules, "module string, css string"))
    assert sorted(map(tuple, found.collect())) == [
        ("/src/a/x.tsx", 2, "t", "module", "/src/t.module.css"),
        ("/src/a/x.tsx", 3, "s", "two", "/src/b/m.module.css"),
        ("/src/a/x.tsx", 3, "t", "any", "/src/t.module.css"),
        ("/src/a/x.tsx", 4, "s", "two", "/src/b/m.module.css"),
    ]
    none = S.undefined_lookups(spark.createDataFrame([], "file string, text string"), spark.createDataFrame([], "module string, css string"))
    assert none.count() == 0


def test_stale_caches_leave_foreign_prefixes(spark):
    rows = [("o", "leaf-1", 1), ("o", "leaf-2", 2), ("o", "leaf-2", 2), ("o", "leaf-0", 2), ("o", "theirs-1", 0), ("p", "leaf-1", 1), (None, "leaf-a", 1), (None, "leaf-b", 3), ("o", None, 9)]
    found = S.stale_caches(spark.createDataFrame(rows, "origin string, name string, created int"), "leaf-")
    assert {tuple(r) for r in found.collect()} == {("o", "leaf-1"), ("o", "leaf-0"), (None, "leaf-a")}


def test_a_retyped_file_is_read_as_declared(spark, tmp_path):
    path = str(tmp_path / "retyped")
    spark.createDataFrame([("1", 1.5, "x"), ("two", 2.0, "y"), (None, 3.0, "z")], "id string, score double, extra string").write.parquet(path)
    stored = spark.read.parquet(path)
    declared = "id long, score double, note string"
    assert schema_drift(stored, declared) == [("id", "retyped", "bigint", "string"), ("note", "missing", "string", None), ("extra", "extra", None, "string")]
    fine, broken = as_declared(stored, declared)
    assert fine.schema.simpleString() == "struct<id:bigint,score:double,note:string>"
    assert {tuple(r) for r in fine.collect()} == {(1, 1.5, None), (None, 3.0, None)}
    assert [(r.id, r.extra, r.uncast) for r in broken.collect()] == [("two", "y", ["id"])]
    same, none = as_declared(stored, stored.schema)
    assert same.count() == 3 and none.count() == 0 and none.columns == ["id", "score", "extra", "uncast"]


def test_the_sink_by_key_prunes(spark, tmp_path):
    path = str(tmp_path / "by_key")
    rows = spark.range(1000).selectExpr("id", "CAST(id % 4 AS INT) AS shelf", "repeat('x', 10) AS text")
    write_by_key(rows, path, "shelf")
    write_by_key(rows, path, "shelf")
    back = spark.read.schema(rows.schema).parquet(path)
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = back.where("shelf = 2")
    assert one.count() == 250 and len(one.inputFiles()) == 4
    assert "PartitionFilters: [isnotnull(shelf" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert shared_dir(spark)
