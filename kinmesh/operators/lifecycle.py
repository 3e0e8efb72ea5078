"""Run records and their states, the snapshots a run keeps, and the execution of a run.

States are appended, never rewritten: each row is the whole record of a run as it was at one time, and the last row of a run
counts. Appends of several drivers don't hinder each other. Snapshots are tables laid out by run_id.

Defined edge cases: an unknown run is a KeyError; a transition that its state doesn't allow is a ValueError; a failed
execution leaves a FAILED run with the error and raises it; null counters count as 0.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators import review
from kinmesh.storage import delete, exists

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"
COUNTERS = ["records_in", "records_normalized", "blocks_created", "candidates_generated", "pairs_scored", "auto_links", "review_items", "rejected"]
SCHEMA = (
    "run_id string, mode string, policy_version int, status string, description string, " + ", ".join(f"{c} bigint" for c in COUNTERS)
    + ", started_at timestamp, ended_at timestamp, error_message string, written_at timestamp"
)
#: Which states may follow a state.
NEXT = {PENDING: (RUNNING, CANCELLED, FAILED), RUNNING: (COMPLETED, FAILED, CANCELLED), COMPLETED: (), FAILED: (), CANCELLED: ()}


def can_retry(status: Column) -> Column:
    return status.isin(FAILED, CANCELLED)


def can_cancel(status: Column) -> Column:
    return status == RUNNING


def upsert(runs: DataFrame, changes: DataFrame, order: str = "written_at") -> DataFrame:
    """Runs with changed ones replaced by their last change and new ones added; null counters are 0."""
    both = runs.withColumn("__turn", F.lit(0)).unionByName(changes.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    last = review.latest(both, "run_id", ["__turn", order] if order in both.columns else ["__turn"]).drop("__turn")
    return last.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTERS if c in last.columns})


@dataclass
class RunStore:
    """Runs under `root`: runs (states), records and clusters (snapshots by run_id), audit (events)."""

    spark: SparkSession
    root: str
    _known: dict[str, dict] = field(default_factory=dict)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def runs(self) -> DataFrame:
        """The last state of every run, newest first."""
        if not exists(self.spark, self._path("runs")):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self._path("runs"))
        last = review.latest(rows, "run_id", ["written_at"]).withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTERS})
        return last.orderBy(F.desc("started_at"), "run_id")

    def get(self, run_id: str) -> dict:
        found = self.runs().where(F.col("run_id") == run_id).collect()  # one row
        if not found:
            raise KeyError(run_id)
        return found[0].asDict()

    def _write(self, run: dict) -> dict:
        run = run | {"written_at": datetime.now(UTC).replace(tzinfo=None)}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        self.spark.createDataFrame([tuple(run.get(n) for n in names)], SCHEMA).coalesce(1).write.mode("append").parquet(self._path("runs"))
        return run

    def create(self, mode: str = "FULL", description: str = "", policy_version: int = 1) -> str:
        run_id = str(uuid.uuid4())
        self._write({"run_id": run_id, "mode": mode, "policy_version": policy_version, "status": PENDING, "description": description, "started_at": datetime.now(UTC).replace(tzinfo=None)} | dict.fromkeys(COUNTERS, 0))
        return run_id

    def to(self, run_id: str, status: str, **more) -> dict:
        """Moves a run to another state."""
        run = self.get(run_id)
        if status not in NEXT[run["status"]]:
            raise ValueError(f"a run that is {run['status']} can't become {status}")
        ended = {} if status == RUNNING else {"ended_at": datetime.now(UTC).replace(tzinfo=None)}
        return self._write(run | {"status": status} | ended | more)

    def cancel(self, run_id: str) -> bool:
        """Cancels a run that is running, its Spark jobs with it; False if there is nothing to cancel."""
        try:
            if self.get(run_id)["status"] != RUNNING:
                return False
        except KeyError:
            return False
        self.to(run_id, CANCELLED)
        self.spark.sparkContext.cancelJobsWithTag(_tag(run_id))
        return True

    def retry(self, run_id: str) -> str:
        """A new run in place of a failed or cancelled one."""
        run = self.get(run_id)
        if run["status"] not in (FAILED, CANCELLED):
            raise ValueError("only failed or cancelled runs can be retried")
        return self.create(run["mode"], f"Retry of {run_id}: {run['description']}", run["policy_version"])

    # ---- snapshots

    def save(self, name: str, run_id: str, df: DataFrame) -> None:
        """Keeps a table of a run (records, clusters); a second save of the same run replaces the first."""
        df.write.mode("overwrite").parquet(f"{self._path(name)}/run_id={run_id}")

    def load(self, name: str, run_id: str, attempts: int = 3) -> DataFrame | None:
        """A kept table of a run, None if there is none; reading is tried again, as a store may show a new table late."""
        for k in range(attempts):
            if exists(self.spark, f"{self._path(name)}/run_id={run_id}"):
                return self.spark.read.parquet(f"{self._path(name)}/run_id={run_id}")
            time.sleep(0.1 * (k + 1 < attempts))
        return None

    def merged(self, name: str = "records", key: str = "customer_key") -> DataFrame | None:
        """The tables of all runs as one; of a key in several runs the latest run's row counts."""
        if not exists(self.spark, self._path(name)):
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(self._path(name))
        order = self.runs().select("run_id", "started_at")
        both = rows.join(order, "run_id", "left")
        return review.latest(both, key, ["started_at", "run_id"]).drop("started_at")

    def export_json(self, path: str) -> None:
        """All runs as JSON lines, for places without a database."""
        self.runs().coalesce(1).write.mode("overwrite").json(path)

    def import_json(self, path: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(path)

    # ---- events

    def log(self, run_id: str, event_type: str, payload: DataFrame | str) -> None:
        row = self.spark.createDataFrame([(run_id, event_type, payload, datetime.now(UTC).replace(tzinfo=None))], "run_id string, event_type string, payload string, created_at timestamp")
        row.coalesce(1).write.mode("append").parquet(self._path("audit"))

    def events(self) -> DataFrame | None:
        return self.spark.read.parquet(self._path("audit")) if exists(self.spark, self._path("audit")) else None

    # ---- execution

    def execute(self, run_id: str, run) -> dict:
        """Executes a plans.pipeline.Run as run `run_id`: counters, snapshots, state and events.

        The jobs carry the run's tag, by which cancel() ends them.
        """
        self.to(run_id, RUNNING)
        self.log(run_id, "RUN_STARTED", f'{{"run_id": "{run_id}"}}')
        context = self.spark.sparkContext
        context.addJobTag(_tag(run_id))
        try:
            counters = counted(run)
            self.save("records", run_id, run.norm)
            self.save("clusters", run_id, run.members)
        except Exception as e:
            if self.get(run_id)["status"] == RUNNING:
                self.to(run_id, FAILED, error_message=str(e)[:1000])
                self.log(run_id, "RUN_FAILED", f'{{"run_id": "{run_id}"}}')
            raise
        finally:
            context.removeJobTag(_tag(run_id))
        if self.get(run_id)["status"] != RUNNING:  # cancelled meanwhile
            return self.get(run_id)
        done = self.to(run_id, COMPLETED, **counters)
        self.log(run_id, "RUN_COMPLETED", f'{{"run_id": "{run_id}"}}')
        return done

    def reset(self, really: bool = False) -> None:
        """Deletes all runs, snapshots and events; only if it is said so."""
        if not really:
            raise ValueError("reset deletes everything under the store; say really=True")
        for name in ("runs", "records", "clusters", "audit"):
            delete(self.spark, self._path(name))
        self.log("", "SYSTEM_GENESIS", "{}")


def _tag(run_id: str) -> str:
    return f"kinmesh-run-{run_id}"


def counted(run) -> dict[str, int]:
    """The counters of a run of plans.pipeline."""
    n = run.raw.count()
    decided = {r["decision"]: r["count"] for r in run.decided.groupBy("decision").count().collect()}  # three rows
    return {
        "records_in": n, "records_normalized": run.norm.count(), "blocks_created": run.keys.select("block_key").distinct().count(), "candidates_generated": run.pairs.count(),
        "pairs_scored": sum(decided.values()), "auto_links": decided.get("AUTO_LINK", 0), "review_items": decided.get("REVIEW", 0), "rejected": decided.get("REJECT", 0),
    }


# Columns of the stored tables.
TABLES = {
    "runs": SCHEMA.rsplit(", ", 1)[0], "clusters": "cluster_id string, customer_key string, active_version int, valid_from timestamp, valid_to timestamp",
    "candidate_pairs": "pair_id string, run_id string, a_key string, b_key string, blocking_reasons array<string>, block_key_sample string, created_at timestamp",
    "match_decisions": "pair_id string, run_id string, decision string, score double, threshold_used double, signals_hit array<string>, decided_at timestamp",
    "audit_events": "audit_id string, run_id string, event_type string, payload string, actor string, prev_hash string, this_hash string, created_at timestamp",
}


def bootstrap(spark: SparkSession, root: str, database: str = "default") -> list[str]:
    """Makes the tables that are missing, over folders of `root`; names of the new ones."""
    made = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet LOCATION '{root.rstrip('/')}/{name}'")
            made.append(name)
    return made
