"""Parquet store round trip, ledgers, exports."""
import json
import os
import tempfile

from regiopanel.plans.store import local_store
from regiopanel.sources import sinks
from tests.seed import seed_store


def test_store_recompute_forecast_and_exports(spark):
    root = tempfile.mkdtemp(prefix="rp-store-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    derived = store.recompute()
    assert derived["scores"].count() == 288
    store.run_forecast(1, 12, "seasonal_trend_v2")
    store.run_forecast(2, 3, "bogus-model")          # unknown model -> default
    runs = store.read("model_run").orderBy("model_run_id").collect()
    assert [(r["model_run_id"], r["model_name"], r["horizon_months"]) for r in runs] == [
        (1, "seasonal_trend_v2", 12), (2, "seasonal_trend_v2", 3)]
    assert store.read("forecast").where("model_run_id = 2").count() == 36
    store.recompute()
    loaded = store.load()
    ov = sinks.overview_export(loaded, {k: loaded[k] for k in ("indicators", "classification", "scores")})
    assert ov.columns[1:] == [b for _, b in sinks.OVERVIEW_HEADERS] and ov.count() == 12
    out = os.path.join(root, "exports")
    sinks.write_csv(ov, out + "/overview")
    sinks.write_region_csvs(loaded, loaded["scores"], out + "/regions")
    assert all(d.startswith("region_bucket=") for d in os.listdir(out + "/regions") if d[0] not in "._")
    assert spark.read.option("header", True).csv(out + "/regions").select("governorate_id").distinct().count() == 12
    sinks.write_geojson_seq(loaded["boundaries"], out + "/map")
    feats = [json.loads(x) for x in spark.read.text(out + "/map").collect() for x in [x[0]]]
    assert len(feats) == 12 and feats[0]["geometry"]["type"] == "MultiPolygon"
    assert feats[0]["geometry"]["coordinates"][0][0][0] == [35.8, 31.8]


def test_documented_workflow(spark):
    import datetime as dt

    from regiopanel.operators import overview as OV
    from regiopanel.operators.scenario import scenario_frame
    from regiopanel.plans import jobs
    from regiopanel.sources import ingest, params

    root = tempfile.mkdtemp(prefix="rp-flow-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    csv_dir = tempfile.mkdtemp(prefix="rp-flow-csv-")
    path = os.path.join(csv_dir, "visitors.csv")
    with open(path, "w") as f:
        f.write("governorate_id,month_index,total_visitors\n1,2026-01-01,70000\n99,2026-01-01,5\n")
    loaded = store.load()
    r = ingest.import_csv(spark, path, "visitors_monthly", governorate=loaded["governorate"])
    merged = loaded["visitors"].unionByName(r["loaded"])      # append a month to the history
    store.overwrite(ingest.TARGET["visitors_monthly"], merged.checkpoint())
    store.append("import_job", ingest.job_row(r["summary"], 1, "visitors_monthly", "visitors.csv"))
    store.append("import_error", ingest.error_ledger_rows(r["errors"], 1))
    assert ingest.list_jobs(store.read("import_job")).collect()[0]["error_rows"] == 1
    assert ingest.list_errors(store.read("import_error"), 1).collect()[0]["row_number"] == 3
    store.run_forecast(1, 12, "seasonal_trend_v2")
    store.recompute()
    loaded = store.load()
    derived = {k: loaded[k] for k in ("indicators", "classification", "scores")}
    k = OV.kpis(loaded, derived["scores"]).collect()[0]
    assert k["latest_month"] == "2026-01-01" and float(k["total_visitors"]) == 70000.0
    sc = scenario_frame(spark, [{"governorate_id": 1, "target_month": "2026-03-01", "additional_beds": 100}])
    run = jobs.run_scenarios(loaded, derived, sc)
    store.append("scenario_run", run["scenario_run"])
    store.append("scenario_result", run["scenario_result"])
    loaded = store.load()
    assert jobs.latest_scenario_run(loaded["scenario_run"]).collect()[0]["target_month"] == dt.date(2026, 3, 1)
    assert jobs.scenario_run_detail(loaded, 1).collect()[0]["governorate_name_en"] == "Amman"
    upd = params.upsert_params(loaded["params"], params.updates_frame(
        spark, [{"parameter_key": "high_priority_threshold", "parameter_value": 50}]))
    store.overwrite("params", upd.checkpoint())
    assert params.resolve(store.read("params"))["high_priority_threshold"] == 50.0


def test_store_one_call_import_and_scenarios(spark):
    from regiopanel.operators.scenario import scenario_frame

    root = tempfile.mkdtemp(prefix="rp-store1-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    d = tempfile.mkdtemp(prefix="rp-store1-csv-")
    path = os.path.join(d, "occ.csv")
    with open(path, "w") as f:
        f.write("governorate_id,month_index,average_occupancy_rate\n1,2025-12-01,0.5\n42,2025-12-01,0.4\n")
    r = store.import_csv(path, "hotel_occupancy_monthly", 5)
    assert store.read("occupancy").count() == 1            # full refresh
    job = store.read("import_job").collect()[0]
    assert (job["import_job_id"], job["success_rows"], job["error_rows"], job["filename"]) == (5, 1, 1, "occ.csv")
    assert store.read("import_error").count() == 1 and r["summary"].count() == 1
    store.recompute()
    out = store.run_scenarios(scenario_frame(spark, [{"governorate_id": 2, "target_month": "2025-12-01"}]))
    assert store.read("scenario_result").count() == 1 and out["rejected"].count() == 0


def test_cli_flow(spark, capsys):
    from regiopanel.__main__ import main

    root = tempfile.mkdtemp(prefix="rp-cli-")
    folder = tempfile.mkdtemp(prefix="rp-cli-in-")

    def run(*args):
        assert main(list(args)) == 0
        return [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]

    run("init", root, "/root/testdata/sf0.001")
    run("recompute", root)
    assert run("forecast", root, "1", "--horizon", "6")[0]["horizon_months"] == 6
    run("recompute", root)
    assert [r["model_run_id"] for r in run("runs", root)] == [1] and len(run("run", root, "1", "--limit", "7")) == 7
    with open(f"{folder}/o.csv", "w") as f:
        f.write("governorate_id,month_index,average_occupancy_rate\n1,2001-01-01,0.5\nx,2001-01-01,0.5\n")
    assert run("import", root, f"{folder}/o.csv", "hotel_occupancy_monthly", "4")[0]["error_rows"] == 1
    assert [j["import_job_id"] for j in run("jobs", root)] == [4] and run("errors", root, "4")[0]["row_number"] == 3
    with open(f"{folder}/s.json", "w") as f:
        f.write('{"scenario_run_id": 9, "governorate_id": 3, "target_month": "2001-09-01", "additional_beds": 10}\n')
    for _ in range(2):
        assert run("scenarios", root, f"{folder}/s.json", "--batch", "b1") == [{"results": 1, "rejected": 0}]
    assert [r["scenario_run_id"] for r in run("scenario-runs", root)] == [9] and run("scenario", root, "9")[0]["beds_delta"] == 10
    assert {r["parameter_key"]: r["parameter_value"] for r in run("params", root, "high_priority_threshold=55")}["high_priority_threshold"] == "55"
    out = os.path.join(tempfile.mkdtemp(prefix="rp-cli-out-"), "exp")
    run("export", root, out)
    run("vacuum", root)
    assert len(run("params", root)) == 7
    assert any(d.startswith("region_bucket=") for d in os.listdir(os.path.join(out, "regions")))


def test_feature_collection_document(spark):
    st, root = seed_store(spark), tempfile.mkdtemp(prefix="rp-fc-")

    def document(boundaries, name):
        sinks.write_feature_collection(boundaries.repartition(5), f"{root}/{name}")
        parts = sorted(f for f in os.listdir(f"{root}/{name}") if f.startswith("part-"))
        return json.loads("".join(open(f"{root}/{name}/{f}").read() for f in parts))
    doc = document(st["boundaries"], "all")
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 12
    assert [f["properties"]["governorate_id"] for f in doc["features"]] == list(range(1, 13))
    assert document(st["boundaries"].where("false"), "none") == {"type": "FeatureCollection", "features": []}


def test_rejected_import_leaves_a_readable_store(spark):
    """Every row rejected: the table is refreshed to nothing, and everything still runs."""
    root = tempfile.mkdtemp(prefix="rp-empty-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    path = os.path.join(tempfile.mkdtemp(prefix="rp-empty-csv-"), "o.csv")
    with open(path, "w") as f:
        f.write("governorate_id,month_index,average_occupancy_rate\nx,2026-01-01,0.5\n")
    store.import_csv(path, "hotel_occupancy_monthly", 1)
    loaded = store.load()
    assert loaded["occupancy"].count() == 0 and loaded["occupancy"].dtypes == [
        ("governorate_id", "int"), ("month_index", "date"), ("average_occupancy_rate", "decimal(8,4)")]
    assert store.recompute()["scores"].count() == 288


def test_run_ids_are_used_once(spark):
    import pytest

    from regiopanel.plans.store import RunExists
    root = tempfile.mkdtemp(prefix="rp-runs-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    run = store.run_forecast(1, 3)
    with pytest.raises(RunExists):
        store.run_forecast(1, 3)
    store.append("forecast", run["forecast"])          # a retry of the same write
    assert store.read("forecast").count() == 36
    assert dict(store.read("forecast").dtypes)["model_run_id"] == "bigint"


def test_csv_text_survives(spark):
    import csv
    text = ['say "hi"', " padded ", "a,b", "line\nbreak", ""]
    out = tempfile.mkdtemp(prefix="rp-csv-") + "/t"
    sinks.write_csv(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "n int, t string").coalesce(1), out)
    part = next(f for f in os.listdir(out) if f.startswith("part-"))
    with open(f"{out}/{part}", newline="") as f:
        rows = list(csv.reader(f))
    assert rows == [["n", "t"]] + [[str(i), t] for i, t in enumerate(text)]


def test_overflow_fails_loudly(spark):
    import pytest

    from regiopanel import schemas as S
    from regiopanel.functions.columns import store_as
    df = spark.createDataFrame([(1e30,), (None,)], "x double")
    assert df.where("x is null").select(store_as("x", S.INDEX)).collect()[0][0] is None
    with pytest.raises(Exception, match="numeric field overflow"):
        df.select(store_as("x", S.INDEX)).collect()


def test_stored_reads_prune_and_match(spark):
    from regiopanel.operators import overview as OV
    root = tempfile.mkdtemp(prefix="rp-prune-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    mem = store.recompute()
    loaded = store.load()
    derived = {k: loaded[k] for k in ("indicators", "classification", "scores")}
    for fn in (OV.region_overview, OV.exec_top, lambda s, d: OV.region_detail(s, d, 7)):
        stored = fn(loaded, derived)
        assert sorted(map(str, stored.collect())) == sorted(map(str, fn(loaded, mem).collect()))
        scans = [x for x in stored._jdf.queryExecution().sparkPlan().toString().splitlines()
                 if "FileScan" in x and any(f"/{k}" in x for k in derived)]
        assert scans and all("PartitionFilters: [isnotnull(month_index" in x for x in scans if "max(" not in x), scans


def _snapshot(store):
    return {n: sorted(map(str, df.drop("created_at", "updated_at").collect())) for n, df in store.load().items()}


def test_a_refresh_that_dies_leaves_the_old_tables(spark):
    """Killed between the writes, or by another writer's switch: nothing changes."""
    import pytest

    from regiopanel.plans.store import StoreChanged
    root = tempfile.mkdtemp(prefix="rp-kill-")
    store = local_store(spark, root)
    store.save(seed_store(spark))
    store.recompute()
    before = _snapshot(store)
    write, done = store._write, []

    def dies(name, df, path, mode="errorifexists"):
        if len(done) == 2:
            raise RuntimeError("killed")
        done.append(name)
        write(name, df, path, mode)
    store._write = dies
    with pytest.raises(RuntimeError, match="killed"):
        store.recompute({"priority_weight_growth": 0.9})
    assert len(done) == 2 and _snapshot(store) == before
    store._write = write
    publish = store.files.publish

    def late(path, text):       # another job switches first
        assert publish(path, text)
        return publish(path, text)
    store.files.publish = late
    with pytest.raises(StoreChanged):
        store.recompute()
    store.files.publish = publish
    store.recompute({"priority_weight_growth": 0.9})
    assert _snapshot(store)["scores"] != before["scores"] and _snapshot(store)["visitors"] == before["visitors"]
    store.vacuum(keep=1)
    assert len([d for d in os.listdir(root) if d.startswith("scores-")]) == 1 and _snapshot(store)["scores"]


def test_a_scenario_batch_runs_once(spark):
    import pytest

    from regiopanel.operators.scenario import scenario_frame
    from regiopanel.plans import jobs
    from regiopanel.plans.store import RunExists
    store = local_store(spark, tempfile.mkdtemp(prefix="rp-batch-"))
    store.save(seed_store(spark))
    store.recompute()
    payloads = [{"scenario_run_id": i, "governorate_id": 1 + i % 12, "target_month": "2026-01-01", "additional_beds": i} for i in range(1, 41)]
    batch = scenario_frame(spark, payloads)
    store.run_scenarios(batch, batch_id="a")
    first = _snapshot(store)
    assert len(first["scenario_run"]) == len(first["scenario_result"]) == 40 and len(first["scenario_batch"]) == 1
    store.run_scenarios(batch.orderBy("governorate_id"), batch_id="a")
    assert _snapshot(store) == first
    with pytest.raises(RunExists, match="other scenarios"):
        store.run_scenarios(batch.limit(3), batch_id="a")
    with pytest.raises(RunExists, match="another batch"):
        store.run_scenarios(batch.limit(3), batch_id="b")
    # a run that died before its ledger row, with other scenarios, is replaced whole
    dead = scenario_frame(spark, [{"scenario_run_id": i, "governorate_id": 2, "target_month": "2026-01-01"} for i in range(100, 160)])
    out = jobs.run_scenarios(store.load(), {k: store.read(k) for k in ("indicators", "classification", "scores")}, dead)
    store._write("scenario_result", jobs.scenario_partitions(out["scenario_result"], "c"), store.path("scenario_result"), "overwrite")
    store.run_scenarios(scenario_frame(spark, [{"scenario_run_id": 500, "governorate_id": 2, "target_month": "2026-01-01"}]), batch_id="c")
    assert store.read("scenario_result").where("batch_id = 'c'").count() == 1
    detail = store.scenario_run_detail(7)
    assert [(r.scenario_run_id, r.beds_delta, r.governorate_name_en) for r in detail.collect()] == [(7, 7, detail.first().governorate_name_en)]
    from tests.plan_report import formatted
    assert "PartitionFilters: [isnotnull(bucket" in formatted(detail)


def test_history_is_pruned_at_run_time(spark):
    from regiopanel.operators import scenario as SC
    from tests.plan_report import formatted
    store = local_store(spark, tempfile.mkdtemp(prefix="rp-hist-"))
    store.save(seed_store(spark))
    mem = store.recompute()
    loaded = store.load()
    derived = {k: loaded[k] for k in ("indicators", "classification", "scores")}
    stored = SC.latest_history(loaded, derived)
    assert sorted(map(str, stored.collect())) == sorted(map(str, SC.latest_history(loaded, mem).collect())) and stored.count() == 12
    text = formatted(stored)
    filters = [x for x in text.splitlines() if "PartitionFilters:" in x]
    assert sum("array_contains" in x for x in filters) >= 5, filters     # three facts, two derived tables
    assert "FullOuter" not in text and "SortAggregate" not in text


def test_forecasts_follow_the_dimension(spark):
    from regiopanel.plans import jobs
    st = seed_store(spark)
    some = st | {"governorate": st["governorate"].where("governorate_id < 4")}
    assert {r[0] for r in jobs.run_forecast(some, 1)["forecast"].select("governorate_id").distinct().collect()} == {1, 2, 3}
