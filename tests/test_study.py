from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import holdfast as h
from holdfast.operators import boosting as B
from holdfast.operators import metrics as A
from holdfast.operators import summary as S
from holdfast.plans import study

TINY = h.Booster(max_depth=2, max_iter=2, max_bins=16)


@pytest.fixture(scope="module")
def logs(sample_table):
    return h.prepare_multi_basin(sample_table.select("sample_id", "ac", "gr", "k", "th", "u", "rd", "rs", "toc"))


def test_multi_basin_study(spark, logs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("mb"))
    cfg = h.multi_basin(logs.settings, n_repeats=2, target=logs.target, use_external_booster=False, booster=TINY, seeds_per_block=1)
    cfg = cfg.but(refine=replace(cfg.refine, epochs=2))
    r = h.run_ablation(logs.table, cfg, out)
    rows = logs.table.count()
    sizes = r.sizes.collect()
    assert len(sizes) == 4 and all(s["n_train"] + s["n_val"] + s["n_test"] == rows for s in sizes)
    p = r.predictions.cache()
    assert p.groupBy("setting", "seed").count().where(f"count != {sizes[0]['n_test']}").count() == 0
    # both settings share the split of a seed
    ids = [{x["sample_id"] for x in p.where(f"setting = '{s}' and seed = 1").collect()} for s in ("Full", "NoRes")]
    assert ids[0] == ids[1]
    assert p.where("setting = 'NoRes' and y_base != y_full").count() == 0
    assert p.where("y_base < 0 or y_full < 0").count() == 0
    assert {c for c in r.deltas.columns} == {"seed", "r2_base", "r2_full", "delta_r2"} and r.deltas.count() == 2
    # stored tables give the same summaries again
    again = S.ablation_summary(A.metrics(spark.read.parquet(f"{out}/predictions")))
    assert [tuple(x) for x in again.select("setting", "mode", "n_repeats").collect()] == [
        tuple(x) for x in r.summary.select("setting", "mode", "n_repeats").collect()]
    nets = r.networks.collect()
    assert {(x["setting"], x["seed"]) for x in nets} == {("Full", 0), ("Full", 1)}
    assert all(x["violation"] >= 0 and x["loss_last"] > 0 for x in nets)
    full = r.metrics.where("mode = 'full'")
    assert r.best_runs == {x["setting"]: x["seed"] for x in S.best_seed(full).collect()}
    h.write_reports(r, out, key="k", label="l", source="s")
    assert spark.read.parquet(f"{out}/plot_cache/diagnostics").where("y_base IS NULL OR y_full IS NULL").count() == 0
    best = spark.read.parquet(f"{out}/models/best_Full")
    assert {(x["seed"], x["tree"]) for x in best.collect()} == {(r.best_runs["Full"], 0), (r.best_runs["Full"], 1)}
    # the stored trees give the stored predictions of NoRes again
    trees = r.models.where("setting = 'NoRes'").withColumn("run", F.col("seed"))
    again = B.score(logs.table, trees, [0, 1]).select("sample_id", F.posexplode("margins").alias("seed", "margin"))
    both = p.where("setting = 'NoRes'").join(again, ["sample_id", "seed"])
    assert both.count() == 2 * sizes[0]["n_test"]
    assert both.where("abs(y_base - greatest(expm1(margin), 0)) > 1e-9").count() == 0
    log = r.run_log.collect()
    assert len(log) == 4 and log[0]["metrics"]["base"]["r2_test"] is not None and log[0]["n_val"] > 0
    assert all(x["metrics_val"]["full"]["r2_val"] is not None and x["study"]["target"] == "TOC" for x in log)
    assert {x["setting"]: x["study"]["refinement"] for x in log} == {"Full": "True", "NoRes": "False"}
    import os

    assert not [n for n in os.listdir(f"{out}/work") if n.startswith(("block", "held"))]


def test_missing_and_infinite_logs_do_not_end_a_study(spark, sample_table):
    raw = sample_table.select("sample_id", "ac", "gr", "k", "th", "u", "toc",
                              F.when(F.col("sample_id") % 5 == 0, -1.0).otherwise(F.col("rd")).alias("rd"),
                              F.when(F.col("sample_id") % 7 == 0, float("inf")).otherwise(F.col("rs")).alias("rs"))
    p = h.prepare_multi_basin(raw)
    for external in (True, False):
        cfg = h.multi_basin(p.settings, n_repeats=1, target=p.target, use_external_booster=external, use_refinement=False)
        r = h.run_ablation(p.table, cfg.but(booster=replace(cfg.booster, max_iter=2)))
        assert {x["setting"] for x in r.summary.collect()} == {"Full", "NoRes"}


def test_resume_adds_seeds(spark, logs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("resume"))
    base = h.AblationConfig(settings={"NoRes": logs.settings["NoRes"]}, seeds=[0], target="TOC", booster=TINY)
    h.run_ablation(logs.table, base, out)
    r = h.run_ablation(logs.table, base.but(seeds=[1]), out)
    assert {x["seed"] for x in spark.read.parquet(f"{out}/predictions").select("seed").distinct().collect()} == {0, 1}
    assert {x["seed"] for x in r.predictions.select("seed").distinct().collect()} == {1}
    both = h.run_ablation(logs.table, base.but(seeds=[0, 1, 3]), out, resume=True)
    assert {x["seed"] for x in both.metrics.select("seed").distinct().collect()} == {0, 1, 3}
    best = both.metrics.where("mode = 'full'").orderBy(F.desc("r2"), "seed").first()["seed"]
    assert both.best_runs == {"NoRes": best}
    assert {x["seed"] for x in both.importances.select("seed").distinct().collect()} == {best}
    h.run_ablation(logs.table, base.but(seeds=[2]), out, clean_outputs=True)
    assert {x["seed"] for x in spark.read.parquet(f"{out}/predictions").select("seed").distinct().collect()} == {2}


def test_a_crash_between_writes_leaves_nothing_half_done(spark, logs, tmp_path_factory, monkeypatch):
    out = str(tmp_path_factory.mktemp("crash"))
    cfg = h.AblationConfig(settings={"NoRes": logs.settings["NoRes"]}, seeds=[0, 1], target="TOC", val_size=0.15, booster=TINY, seeds_per_block=1)
    write, calls = study.W.write_predictions, []

    def fails(df, path, **options):
        calls.append(path)
        if len(calls) == 6:  # TEST of the second block is written, VAL is not
            raise RuntimeError("lost")
        write(df, path, **options)

    monkeypatch.setattr(study.W, "write_predictions", fails)
    with pytest.raises(RuntimeError):
        h.run_ablation(logs.table, cfg, out)
    monkeypatch.setattr(study.W, "write_predictions", write)
    assert {x["seed"] for x in spark.read.parquet(f"{out}/predictions").select("seed").distinct().collect()} == {0, 1}
    r = h.run_ablation(logs.table, cfg, out, resume=True)
    assert {x["seed"] for x in r.val_metrics.select("seed").distinct().collect()} == {0, 1}
    assert {x["seed"] for x in r.models.select("seed").distinct().collect()} == {0, 1}
    assert spark.read.parquet(f"{out}/finished").count() == 2


def pyrolysis(sample_table):
    return sample_table.select("sample_id", F.col("toc").alias(" TOC "), F.col("s2").alias("S2_mgHC_gRock"),
                               F.col("s1").cast("string").alias("S1"), F.col("tmax").alias("Tmax"),
                               F.when(F.col("sample_id") % 5 != 0, F.col("gr")).alias("GR"), F.lit(None).cast("double").alias("blank"))


def test_log_pyrolysis_study(spark, sample_table):
    p = h.prepare_log_pyrolysis(pyrolysis(sample_table))
    assert p.settings == {"RockEval": ["S1", "S2_mgHC_gRock", "Tmax"]} and "blank" not in p.table.columns
    cfg = h.log_pyrolysis(p.settings, n_repeats=1, target=p.target, s2_col=p.roles["S2"], booster=replace(TINY, missing="encode"))
    r = h.run_ablation(p.table, cfg)
    cap = r.constraints.first()["toc_max"]
    assert r.predictions.where(f"y_base < 0 or y_base > {cap} or y_full < 0 or y_full > {cap}").count() == 0
    assert r.predictions.where("refined_accepted").count() == 0  # Fusion is not among the settings
    everything = h.prepare_log_pyrolysis(pyrolysis(sample_table), only=None, max_rows=400)
    assert everything.table.count() == 400
    cfg = h.log_pyrolysis(everything.settings, n_repeats=1, target="TOC", s2_col="S2_mgHC_gRock",
                          refinement_setting="fusion", booster=replace(TINY, missing="encode"))
    r = h.run_ablation(everything.table, cfg.but(refine=replace(cfg.refine, epochs=2)))
    assert {x["setting"] for x in r.predictions.where("refined_accepted").select("setting").distinct().collect()} == {"Fusion"}


def test_test_truth_never_reaches_the_fits(spark, sample_table):
    p = h.prepare_log_pyrolysis(pyrolysis(sample_table))
    cfg = h.log_pyrolysis(p.settings, n_repeats=2, target=p.target, s2_col=p.roles["S2"], use_refinement=False)
    whole = h.Study(p.table, cfg)
    spoiled = p.table.withColumn("TOC", F.when(whole.part("RockEval", 0) == "test", F.col("TOC") * 7).otherwise(F.col("TOC")))
    other = h.Study(spoiled, cfg)

    def fit(s, seed):
        return tuple(s.constraints.where(f"seed = {seed}").select("a", "b", "toc_max").first())

    assert fit(whole, 0) == pytest.approx(fit(other, 0))
    assert fit(whole, 1) != pytest.approx(fit(other, 1))


def hi_table(sample_table):
    return sample_table.select("sample_id", F.col("toc").alias("TOC (wt%)"), F.col("s2").alias("S2 (mg HC/g)"), F.col("s1").alias("S1"),
                               F.col("depth").alias("Depth"), F.when(F.col("sample_id") % 7 != 0, 100 * F.col("s2") / F.col("toc")).alias("HI"))


def test_pyrolysis_hi_study(spark, sample_table):
    p = h.standard_names(h.prepare_pyrolysis_hi(hi_table(sample_table)))
    assert p.settings == {"RockEval": ["S1", "S2_mg_HC_g", "Depth"], "GeoFusion": ["S1", "S2_mg_HC_g", "Depth", "HI"]}
    cfg = h.pyrolysis_hi(p.settings, seeds_step=20, seeds_max=40, target=p.target, s2_col=p.roles["S2"], hi_col=p.roles["HI"],
                         booster=replace(TINY, log_target=False))
    r = h.run_ablation(p.table, cfg.but(refine=replace(cfg.refine, epochs=2)))
    n = {x["setting"]: x["n_samples"] for x in r.sizes.collect()}
    assert n["GeoFusion"] < n["RockEval"]
    best = r.best_of_best.collect()
    assert [b["seed"] for b in best] == [0, 20]
    by_setting = {(x["seed"], x["setting"]): x["r2_full"] for x in S.delta_between_modes(r.metrics).collect()}
    assert all(b["r2_full"] == max(v for (seed, _), v in by_setting.items() if seed == b["seed"]) for b in best)
    common = h.Study(p.table, cfg.but(common_rows=True))
    assert {c.n for c in common.cuts.values()} == {n["GeoFusion"]}


def test_no_usable_setting_gives_empty_tables(spark):
    table = spark.range(30).select(F.col("id").alias("sample_id"), F.col("id").cast("double").alias("toc"),
                                   F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("s2"))
    cfg = h.pyrolysis_hi({"x": ["a", "s2"]}, seeds_max=20, target="toc", s2_col="s2", booster=TINY)
    r = h.run_ablation(table, cfg)
    assert {(x["setting"], x["reason"]) for x in r.skipped.collect()} == {("x", "0 of 25 rows")}
    assert r.predictions.count() == 0 and r.best_of_best.count() == 0 and r.summary.count() == 0 and r.deltas.count() == 0


def test_tables_without_id_get_a_stable_one(spark):
    from holdfast.plans.prepare import with_sample_id

    df = with_sample_id(spark.range(50).select((F.col("id") * 2).alias("a.b (%)")))
    assert df.select("sample_id").distinct().count() == 50
    assert df.collect() == df.collect()


def test_config_checks():
    with pytest.raises(ValueError):
        h.AblationConfig(settings={}, seeds=[0], constraint="other")
    with pytest.raises(ValueError):
        h.AblationConfig(settings={}, seeds=[0], constraint="line")
    with pytest.raises(ValueError):
        h.AblationConfig(settings={}, seeds=[0], refine=h.RefineConfig(gate="val"))
    with pytest.raises(ValueError):
        h.log_pyrolysis({}, refinement_setting="none")
