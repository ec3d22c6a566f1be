"""Registration, SQL twins and the stages together."""

import corpus_pipeline
from brute import contamination, groups
from holdfast.llm import queries

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], SF)
        out.write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert tables[-1].columns == columns
    rows = [[(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()] for t in tables[:5]]
    assert len(rows[1]) > 0.97 * len(rows[0])
    first = sorted(rows[1])
    assert {d for d, _ in rows[2]} == {d for (d, _), (_, c) in zip(first, groups(first, 5, 80)) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, t in rows[2] for n, hit, _ in [contamination(t, items)] if hit and 20 * hit >= n}
    assert dirty and {d for d, _ in rows[3]} == {d for d, _ in rows[2]} - dirty
    assert set(rows[4]) == set(rows[3])
    assert tables[5].count() == len(rows[4])
    starts = [(r.start, r.n_tokens) for r in tables[5].orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert corpus_pipeline.run(spark, SF).count() == len(rows[4])


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = docs.limit(0).union(
        spark.createDataFrame([(i, t, None, None, 0) for i, t in [(None, None), (1, None), (1, None), (2, ""), (3, "word"), (3, "word"), (None, "x y")]], docs.schema)
    )
    for table in (docs.limit(0), odd):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert i == 4 or out.columns == docs.columns, name
            if table is not odd:
                assert not rows
            elif i == 1:  # rows of one id and text are one, but for those without words
                assert sorted(str(r.text) for r in rows) == ["", "None", "None", "None", "word", "x y"]
            elif i >= 2:
                assert len(rows) >= 7, name
    (tmp_path / "sf").mkdir()
    items.limit(0).write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == 0
