"""Parquet-backed store (SRC-10, SRC-20, SRC-21).

Tables live under one root folder (on a cluster: a shared filesystem / object
store path).

*Refreshed tables* (facts, dimension, derived panels, parameters, the small run
ledgers) are written aside: every refresh writes new folders, and one pointer file,
``_versions/<n>.json``, then switches all of its tables together.  A job that dies
before the switch leaves the old tables as they were; a second writer that switched
first makes this one fail (``StoreChanged``).  ``vacuum`` removes folders that no kept
version names.

*Run tables* (forecasts, backtests, import errors, scenario runs and results) are
partitioned by run, or by batch and hash bucket, and a run's own partitions are
replaced, so a repeated write doubles nothing.  The ledger row that says that a run
exists comes last, with the pointer.

Facts and derived panels are partitioned by month, so latest-month reads prune to one
folder (the scalar-subquery "latest month" filter becomes a partition filter).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.plans import jobs as PL
from regiopanel.plans.files import Files
from regiopanel.sources import ingest

PARTITIONING = {
    "visitors": [S.M], "rooms_beds": [S.M], "occupancy": [S.M],
    "indicators": [S.M], "classification": [S.M], "scores": [S.M],
    "forecast": ["model_run_id"], "backtest": ["model_run_id"], "import_error": ["import_job_id"],
    "scenario_run": PL.SCENARIO_PARTITIONS, "scenario_result": PL.SCENARIO_PARTITIONS,
}
# Tables whose runs are replaced partition by partition.
RUN_TABLES = {"forecast", "backtest", "import_error", "scenario_run", "scenario_result"}
# Ledgers of one row per run, which grow by a row with each switch.
LEDGERS = {"model_run", "import_job", "scenario_batch"}
APPEND_ONLY = RUN_TABLES | LEDGERS

# Stored tables are read with these types, so an empty refresh (no part files) and
# run ids in folder names come back as they were written.
SCHEMAS = {
    "governorate": S.GOVERNORATE, "visitors": S.VISITORS, "rooms_beds": S.ROOMS_BEDS, "occupancy": S.OCCUPANCY,
    "sites": S.SITES, "boundaries": S.BOUNDARIES, "params": S.PARAMS, "model_run": S.MODEL_RUN,
    "forecast": S.FORECAST, "backtest": S.BACKTEST,
}


class RunExists(ValueError):
    """A run id that the ledger already has."""


class StoreChanged(RuntimeError):
    """Another writer switched the store's tables since this one read them."""


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    # --- versions -------------------------------------------------------------

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json"))

    def _tables(self, version: int | None) -> dict:
        return json.loads(self.files.read_text(f"{self.root}/_versions/{version}.json")) if version is not None else {}

    def current(self) -> tuple[int | None, dict]:
        """(newest version, its folder of each refreshed table)."""
        versions = self._versions()
        newest = versions[-1] if versions else None
        return newest, self._tables(newest)

    def path(self, name: str, tables: dict | None = None) -> str:
        return f"{self.root}/{(self.current()[1] if tables is None else tables).get(name, name)}"

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions but the last ``keep``, and the folders that only they name.
        Not while another job reads or writes the store."""
        versions = self._versions()
        named = {f for v in versions[-keep:] for f in self._tables(v).values()}
        for v in versions[:-keep]:
            for folder in set(self._tables(v).values()) - named:
                self.files.delete(f"{self.root}/{folder}")
            self.files.delete(f"{self.root}/_versions/{v}.json")

    # --- reading --------------------------------------------------------------

    def read(self, name: str, tables: dict | None = None) -> DataFrame | None:
        """The stored table, or None when it was never written."""
        path = self.path(name, tables)
        try:
            if name in SCHEMAS:
                return self._typed(name, path)
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return None
            raise

    def _typed(self, name: str, path: str) -> DataFrame:
        """Read with the table's types; columns beyond the schema (older layouts,
        wider region keys) are kept as the files have them."""
        schema = SCHEMAS[name]
        try:
            found = self.spark.read.parquet(path)
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)    # refreshed to nothing: no part file
        parts = [p for p in PARTITIONING.get(name, []) if p in found.columns]
        return found.withColumns({p: F.col(p).cast(schema[p].dataType) for p in parts}) if parts else found

    def load(self, names=None) -> dict:
        """Tables of one version, all read at the same pointer."""
        names = names or list(PARTITIONING) + ["governorate", "sites", "boundaries", "params"] + sorted(APPEND_ONLY)
        tables = self.current()[1]
        return {n: df for n in dict.fromkeys(names) if (df := self.read(n, tables)) is not None}

    # --- writing --------------------------------------------------------------

    def _write(self, name: str, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
        parts = [p for p in PARTITIONING.get(name, []) if p in df.columns]
        if parts and (parts == [S.M] or len(parts) > 1):
            # Rows of a partition close together, for few files; a rebalance may split a
            # large partition over tasks, and AQE merges small ones.
            df = df.hint("rebalance", *parts)
        w = df.write.mode(mode)
        if mode == "overwrite":
            w = w.option("partitionOverwriteMode", "dynamic")
        (w.partitionBy(*parts) if parts else w).parquet(path)

    def refresh(self, new: dict, add: dict | None = None) -> int:
        """Replace the tables ``new`` and add rows to the ledgers ``add``, all in one
        switch; returns the version."""
        version, tables = self.current()
        out = dict(tables)
        rows = dict(new)
        for name, df in (add or {}).items():
            old = self.read(name, tables)
            rows[name] = df if old is None else old.unionByName(df, allowMissingColumns=True)
        for name, df in rows.items():
            out[name] = f"{name}-{uuid.uuid4().hex}"
            self._write(name, df, f"{self.root}/{out[name]}")
        following = 0 if version is None else version + 1
        if not self.files.publish(f"{self.root}/_versions/{following}.json", json.dumps(out, sort_keys=True)):
            raise StoreChanged(f"version {following} of {self.root} was written by another job")
        return following

    def overwrite(self, name: str, df: DataFrame) -> None:
        """Full refresh of a table (written even when ``df`` is empty); ``df`` may read
        the table that it replaces."""
        self.refresh({name: df})

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows.  In tables partitioned by run, the run's own partition is
        replaced, so a repeated write after a failure doesn't double it."""
        if name in LEDGERS:
            self.refresh({}, {name: df})
            return
        if PARTITIONING.get(name) == PL.SCENARIO_PARTITIONS:
            df = PL.scenario_partitions(df)
        self._write(name, df, self.path(name), "overwrite" if name in RUN_TABLES else "append")

    def check_new(self, ledger: str, key: str, run_id) -> None:
        known = self.read(ledger)
        if known is not None and not known.where(F.col(key) == run_id).isEmpty():
            raise RunExists(f"{key} {run_id} exists")

    def save(self, tables: dict) -> None:
        for name in RUN_TABLES & set(tables):
            self.append(name, tables[name])
        self.refresh({n: df for n, df in tables.items() if n not in APPEND_ONLY},
                     {n: df for n, df in tables.items() if n in LEDGERS})

    # --- whole operations -----------------------------------------------------

    def recompute(self, overrides: dict | None = None) -> dict:
        """IND-4 + SRC-20: rebuild the three derived panels from one
        checkpointed frame and switch to them together."""
        derived = PL.recompute(self.load(), overrides, persist=True)
        self.refresh({name: derived[name] for name in ("indicators", "classification", "scores")})
        return derived

    def run_forecast(self, run_id: int, horizon: int = 12, model_name: str | None = None) -> dict:
        """FC-5.  The header is written last: a run without one never finished, and its
        id may be used again."""
        self.check_new("model_run", "model_run_id", run_id)
        run = PL.run_forecast(self.load(), run_id, horizon, model_name, persist=True)
        self.save({name: run[name] for name in ("forecast", "backtest", "model_run")})
        return run

    def import_csv(self, path: str, dataset_type: str, import_job_id: int, filename: str | None = None,
                   created_by: str | None = None) -> dict:
        """SRC-1..13 in one call: parse and quarantine, then switch to the loaded rows
        (even when none loaded) together with the job's ledger row.  The error rows, in
        the job's own partition, are there before.  Unknown regions are quarantined."""
        self.check_new("import_job", "import_job_id", import_job_id)
        gov = self.read("governorate")
        r = ingest.import_csv(self.spark, path, dataset_type, governorate=gov)
        self.append("import_error", ingest.error_ledger_rows(r["errors"], import_job_id))
        job = ingest.job_row(r["summary"], import_job_id, dataset_type, filename or os.path.basename(path), created_by)
        self.refresh({ingest.TARGET[dataset_type]: r["loaded"]}, {"import_job": job})
        return r

    def run_scenarios(self, scenarios: DataFrame, overrides: dict | None = None, batch_id: str | None = None) -> dict:
        """SC-1..5 for a batch of scenarios against the stored panels.  Results come
        first, then the run rows, then the batch's ledger row.  A batch that the ledger
        has is not run again, and one that died is replaced whole; a batch id, or a
        scenario id, of another batch is an error.  Without a batch id the scenarios'
        own content names the batch, so a retry is the same batch."""
        loaded = self.load()
        derived = {k: loaded[k] for k in ("indicators", "classification", "scores")}
        content = PL.batch_fingerprint(scenarios)
        batch_id = batch_id or content
        known = loaded.get("scenario_batch")
        done = known.where(F.col("batch_id") == batch_id).select("content").collect() if known is not None else []
        if done and done[0].content != content:
            raise RunExists(f"batch {batch_id} has other scenarios")
        tables = {n: loaded.get(n) for n in ("scenario_run", "scenario_result")}
        if done:
            mine = {n: df.where(F.col("batch_id") == batch_id) for n, df in tables.items() if df is not None}
            return mine | {"rejected": PL.run_scenarios(loaded, derived, scenarios, overrides)["rejected"]}
        if tables["scenario_run"] is not None:
            ids = PL.scenario_partitions(scenarios.select("scenario_run_id"), batch_id).drop("batch_id")
            other = tables["scenario_run"].where(F.col("batch_id") != batch_id).join(ids, ["bucket", "scenario_run_id"], "left_semi")
            if not other.isEmpty():
                raise RunExists(f"scenario {other.first().scenario_run_id} is part of another batch")
        out = PL.run_scenarios(loaded, derived, scenarios, overrides)
        for name in ("scenario_result", "scenario_run"):
            self.files.delete(f"{self.path(name)}/batch_id={batch_id}")    # of a run that never finished
            self._write(name, PL.scenario_partitions(out[name], batch_id), self.path(name), "overwrite")
        counts = self.spark.createDataFrame([(batch_id, content)], "batch_id string, content string") \
            .withColumn("created_at", F.current_timestamp())
        self.refresh({}, {"scenario_batch": counts})
        return out

    def scenario_run_detail(self, scenario_run_id: int) -> DataFrame:
        """SC-4 on the stored results: reads one bucket of each batch."""
        return PL.scenario_run_detail(self.load(["scenario_result", "governorate"]), scenario_run_id)


def local_store(spark: SparkSession, root: str) -> ParquetStore:
    os.makedirs(root, exist_ok=True)
    return ParquetStore(spark, root)
