import json

import pytest
from pyspark.sql import functions as F

from holdfast.operators import summary as S
from holdfast.session import land, scratch_path, shared_dir
from holdfast.sources import readers as R
from holdfast.sources import sinks as W


def write(path, data: bytes):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_bom_and_header_trim(spark, tmp_path):
    p = write(tmp_path / "a.csv", "﻿ TOC , S2\n1,2\n".encode())
    assert R.trim_headers(R.read_csv(spark, p)).columns == ["TOC", "S2"]


@pytest.mark.parametrize("encoding, header", [("utf-8", "Tmax (°C)"), ("utf-8-sig", "Tmax (°C)"), ("latin-1", "Tmax (°C)"), ("cp1252", "Tmax (°C)")])
def test_encodings_in_the_header(spark, tmp_path, encoding, header):
    p = write(tmp_path / "a.csv", f"{header},TOC\n430,1.5\n".encode(encoding))
    df = R.read_csv_any_encoding(spark, p)
    assert df.columns == [header, "TOC"] and tuple(df.first()) == ("430", "1.5")


def test_a_file_with_both_encodings(spark, tmp_path):
    rows = [("São 1", "utf-8"), ("São 2", "cp1252"), ("plain", "utf-8"), ("5 € – x", "cp1252"), ("Ω 日本", "utf-8"), ("", "utf-8")]
    p = write(tmp_path / "mixed.csv", "Ort (°),TOC\n".encode("cp1252") + b"".join(f"{v},{i}\n".encode(e) for i, (v, e) in enumerate(rows)))
    df = R.read_csv_any_encoding(spark, p)
    assert df.columns == ["Ort (°)", "TOC"]
    assert [r[0] or "" for r in df.orderBy(df.TOC.cast("int")).collect()] == [v for v, _ in rows]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1


def test_encoding_in_the_values(spark, tmp_path):
    p = write(tmp_path / "a.csv", "well,TOC\nSão 1,1\nB,2\n".encode("latin-1"))
    assert [r[0] for r in R.read_csv_any_encoding(spark, p).collect()] == ["São 1", "B"]
    assert dict(R.read_csv_any_encoding(spark, p, infer=True).dtypes)["TOC"] == "int"


def test_characters_of_cp1252(spark, tmp_path):
    p = write(tmp_path / "a.csv", "TOC–wt,note\n1,€5 “x”\n".encode("cp1252"))
    df = R.read_csv_any_encoding(spark, p)
    assert df.columns == ["TOC–wt", "note"] and tuple(df.first()) == ("1", "€5 “x”")


def test_scratch_is_never_on_one_machine_of_a_cluster(spark, monkeypatch):
    from holdfast import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    monkeypatch.setattr(session, "_home_folder", lambda s: "file:/root/.holdfast")
    monkeypatch.setattr(session, "_on_one_machine", lambda s, f: f.startswith("file:"))
    with pytest.raises(ValueError, match="shared"):
        session.shared_dir(Elsewhere)


def test_find_dataset(spark, tmp_path):
    write(tmp_path / "raw.csv", b"x" * 900)
    write(tmp_path / "deep" / "Train_small.csv", b"x")
    want = write(tmp_path / "deep" / "er" / "merged_clean.csv", b"x" * 10)
    write(tmp_path / "final_all.txt", b"x" * 5000)
    write(tmp_path / "clean_final.csv", b"x" * 5)
    assert R.find_dataset(spark, str(tmp_path)).endswith(want)
    with pytest.raises(FileNotFoundError):
        R.find_dataset(spark, str(tmp_path), "*.tsv")


def test_find_dataset_written_in_parts(spark, tmp_path):
    write(tmp_path / "merged_all.csv", b"x" * 2000)
    spark.range(1000).repartition(4).write.option("header", True).csv(str(tmp_path / "final_clean.csv"))
    spark.range(10).write.option("header", True).csv(str(tmp_path / "clean_final.csv"))
    found = R.find_dataset(spark, str(tmp_path))  # each part is smaller than the one file, all are larger
    assert found.endswith("final_clean.csv") and R.read_csv(spark, found).count() == 1000


def test_discovery_has_no_table_in_one_task(spark, tmp_path, monkeypatch):
    from holdfast.plans import catalog

    table = spark.range(0, 900, numPartitions=6).select(F.col("id").alias("sample_id"), (F.col("id") / 7).alias("toc"))
    monkeypatch.setattr(catalog, "samples", lambda *_: table)
    monkeypatch.setattr(catalog, "scratch_path", lambda *_: str(tmp_path / "found"))
    assert catalog.dataset_discovery(spark, "").count() == 600
    for name in ("notes", "old_dataset_toc", "dataset_toc"):
        assert len(list((tmp_path / "found" / f"{name}.csv").glob("part-*.csv"))) == 6


def test_read_table_formats(spark, tmp_path):
    df = spark.range(3)
    df.write.orc(str(tmp_path / "a.orc"))
    df.write.json(str(tmp_path / "a.json"))
    df.write.parquet(str(tmp_path / "a"))
    assert all(R.read_table(spark, str(tmp_path / n)).count() == 3 for n in ("a.orc", "a.json", "a"))
    with pytest.raises(Exception):
        R.read_table(spark, str(tmp_path / "absent"))


def predictions(spark, seeds):
    return spark.createDataFrame([(i, 1.0, 0.5, float(s), False, "A", s) for s in seeds for i in range(3)], R.PREDICTION_SCHEMA)


def test_predictions_are_replaced_by_run(spark, tmp_path):
    path = str(tmp_path / "p")
    W.write_predictions(predictions(spark, [0, 1]), path)
    W.write_predictions(predictions(spark, [1]).withColumn("y_full", F.lit(9.0)), path)
    got = {r["seed"]: r["y_full"] for r in R.read_predictions(spark, path).collect()}
    assert got == {0: 0.0, 1: 9.0}
    plan = R.read_predictions(spark, path, seeds=[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [seed" in plan.replace("isnotnull(seed", "[seed") or "seed" in plan.split("PartitionFilters")[1][:80]
    W.write_predictions(predictions(spark, [5]), path, clean=True)
    assert {r["seed"] for r in R.read_predictions(spark, path).collect()} == {5}


def test_reports_and_bundle(spark, tmp_path):
    deltas = spark.createDataFrame([(1, 0.1, 0.3, 0.2), (0, 0.2, 0.1, -0.1), (2, 0.2, 0.2, 0.0)], "seed int, r2_base double, r2_full double, delta_r2 double")
    W.write_report(deltas, str(tmp_path / "d"))
    assert len(list((tmp_path / "d").glob("*.csv"))) == 1
    bundle = W.plot_bundle(deltas, S.seed_picks(deltas), key="k", label="l", source="s")
    row = bundle.first()
    assert row["seeds"] == [0, 1, 2] and row["delta_r2"] == [-0.1, 0.2, 0.0]
    assert (row["best_seed"], row["worst_seed"], row["median_seed"]) == (1, 0, 2)
    pairs = spark.createDataFrame([(s, i, 1.0, 2.0, 3.0) for s in range(3) for i in range(2)], "seed int, sample_id bigint, y_true double, y_base double, y_full double")
    W.write_bundle(bundle, S.diagnostic_rows(pairs, S.seed_picks(deltas)), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "diagnostics")).count() == 6
    meta = json.loads(next((tmp_path / "b" / "meta").glob("*.json")).read_text())
    assert meta["best_seed"] == 1 and meta["generated_at"].endswith("Z")
    with pytest.raises(ValueError):
        W.plot_bundle(deltas.drop("delta_r2"), S.seed_picks(deltas), key="k", label="l", source="s")


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = land(spark.range(4), scratch_path(spark, "x"))
    assert df.count() == 4 and "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
