"""Batch entry point over a Parquet store (the HTTP endpoints' batch form).

  python -m regiopanel init ROOT TABLES_DIR
  python -m regiopanel import ROOT CSV_PATH DATASET_TYPE JOB_ID
  python -m regiopanel jobs ROOT | errors ROOT JOB_ID
  python -m regiopanel recompute ROOT
  python -m regiopanel forecast ROOT RUN_ID [--horizon 12] [--model seasonal_trend_v2]
  python -m regiopanel runs ROOT | run ROOT RUN_ID
  python -m regiopanel scenarios ROOT SCENARIOS [--batch NAME]     (JSON lines, one scenario each)
  python -m regiopanel scenario-runs ROOT | scenario ROOT SCENARIO_RUN_ID
  python -m regiopanel params ROOT [KEY=VALUE ...]
  python -m regiopanel export ROOT OUT_DIR
  python -m regiopanel vacuum ROOT

Listings print one JSON object per line, at most --limit of them (default 100, newest
first).  Cluster settings (master, spark.checkpoint.dir, partitions) come from
spark-submit / the environment.
"""

from __future__ import annotations

import argparse
import json
import sys

from regiopanel import schemas as S
from regiopanel.operators import overview as OV
from regiopanel.plans import jobs as PL
from regiopanel.plans.store import ParquetStore
from regiopanel.session import get_session
from regiopanel.sources import ingest, params, sinks
from regiopanel.sources.proxy import panel_store


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="regiopanel")
    sub = ap.add_subparsers(dest="cmd", required=True)
    listing = argparse.ArgumentParser(add_help=False)
    listing.add_argument("--limit", type=int, default=100)
    for cmd, args, parents in (
            ("init", ["root", "tables"], []), ("import", ["root", "path", "dataset_type", "job_id"], []), ("recompute", ["root"], []),
            ("forecast", ["root", "run_id"], []), ("scenarios", ["root", "path"], []), ("export", ["root", "out"], []), ("vacuum", ["root"], []),
            ("jobs", ["root"], [listing]), ("errors", ["root", "job_id"], [listing]), ("runs", ["root"], [listing]),
            ("run", ["root", "run_id"], [listing]), ("scenario-runs", ["root"], [listing]), ("scenario", ["root", "run_id"], [listing]),
            ("params", ["root"], [listing])):
        p = sub.add_parser(cmd, parents=parents)
        for a in args:
            p.add_argument(a, type=int if a.endswith("_id") else str)
        if cmd == "forecast":
            p.add_argument("--horizon", type=int, default=12)
            p.add_argument("--model", default=None)
        if cmd == "scenarios":
            p.add_argument("--batch", default=None)
        if cmd == "params":
            p.add_argument("updates", nargs="*")
    return ap


def _listing(store: ParquetStore, args):
    """The frame of a listing command, or None."""
    if args.cmd == "jobs":
        return ingest.list_jobs(store.read("import_job"))
    if args.cmd == "errors":
        return ingest.list_errors(store.read("import_error"), args.job_id)
    if args.cmd == "runs":
        return PL.list_runs(store.read("model_run"))
    if args.cmd == "run":
        return PL.forecast_run_detail(store.load(["forecast", "backtest", "governorate"]), args.run_id)
    if args.cmd == "scenario-runs":
        return PL.list_scenario_runs(store.read("scenario_run"))
    if args.cmd == "scenario":
        return store.scenario_run_detail(args.run_id)
    if args.cmd == "params":
        if args.updates:
            items = [dict(zip(("parameter_key", "parameter_value"), u.split("=", 1))) for u in args.updates]
            store.overwrite("params", params.upsert_params(store.read("params"), params.updates_frame(store.spark, items)))
        return params.list_params(store.read("params"))
    return None


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_session()
    store = ParquetStore(spark, args.root)
    frame = _listing(store, args)
    if frame is not None:
        for row in frame.limit(args.limit).toJSON().collect():
            print(row)
        return 0
    out = {"status": "ok"}
    if args.cmd == "init":
        store.save(panel_store(spark, args.tables))
    elif args.cmd == "import":
        r = store.import_csv(args.path, args.dataset_type, args.job_id)
        out = r["summary"].drop("validation_summary_json").collect()[0].asDict()
    elif args.cmd == "recompute":
        store.recompute()
    elif args.cmd == "vacuum":
        store.vacuum()
    elif args.cmd == "forecast":
        run = store.run_forecast(args.run_id, args.horizon, args.model)
        out = run["model_run"].select("model_run_id", "model_name", "horizon_months", "status").collect()[0].asDict()
    elif args.cmd == "scenarios":
        found = store.run_scenarios(spark.read.schema(S.SCENARIOS).json(args.path), batch_id=args.batch)
        out = {"results": found["scenario_result"].count(), "rejected": found["rejected"].count()}
    else:
        st = store.load()
        derived = {k: st[k] for k in ("indicators", "classification", "scores")}
        sinks.write_csv(sinks.overview_export(st, derived), f"{args.out}/overview")
        sinks.write_region_csvs(st, derived["scores"], f"{args.out}/regions")
        sinks.write_geojson_seq(st["boundaries"], f"{args.out}/map")
        sinks.write_csv(OV.exec_top(st, derived), f"{args.out}/executive_top")
        out["out"] = args.out
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
