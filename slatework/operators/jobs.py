"""Job bookkeeping as tables: ids, upserts, transitions folded from events, summaries, what to resume."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.vocab import JOB_STATES, MODES


def job_id(image: Column, method: Column) -> Column:
    """Name of the image without folders and extension, two underscores, method."""
    return F.concat(F.regexp_replace(F.regexp_replace(image, r"^.*/", ""), r"\.[^.]*$", ""), F.lit("__"), method)


def upsert(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs after inserting or refreshing ``wanted``: (job_id, output, status, created_at, updated_at).

    New jobs are pending. Known jobs keep created_at and status and take the new
    output and updated_at. Jobs of the manifest that aren't wanted stay. Both sides have unique job_ids.
    """
    m = manifest.select("job_id", *[F.col(c).alias(f"m_{c}") for c in ("output", "status", "created_at", "updated_at")])
    w = wanted.select("job_id", *[F.col(c).alias(f"w_{c}") for c in ("output", "at")])
    return m.join(w, "job_id", "full_outer").select(
        "job_id", F.coalesce("w_output", "m_output").alias("output"), F.coalesce("m_status", F.lit("pending")).alias("status"),
        F.coalesce("m_created_at", "w_at").alias("created_at"), F.coalesce("w_at", "m_updated_at").alias("updated_at"),
    )


def folded(events: DataFrame, job: str = "job", state: str = "state", at: str = "at", tie: str = "event_id") -> DataFrame:
    """State of every job after its events: last state and time, start of its last run, end of its last finish, number of events.

    Every column is a maximum, so events are folded before the shuffle and a job
    with very many of them is no single task's.
    """
    s, t = F.col(state), F.col(at)
    last = F.max(F.struct(at, tie, state))
    return events.groupBy(job).agg(
        last.alias("_l"), F.max(F.when(s == "running", t)).alias("started_at"), F.max(F.when(s.isin("done", "failed"), t)).alias("finished_at"), F.count(F.lit(1)).alias("events")
    ).select(job, F.col(f"_l.{state}").alias("status"), F.col(f"_l.{at}").alias("updated_at"), "started_at", "finished_at", "events")


def summary(jobs: DataFrame, state: str = "status") -> DataFrame:
    """status, n for all states, zeros kept."""
    n = jobs.agg(*[F.count_if(F.col(state) == x).alias(x) for x in JOB_STATES])
    return n.select(F.inline(F.array(*[F.struct(F.lit(x).alias("status"), F.col(x).alias("n")) for x in JOB_STATES])))


def actions(wanted: DataFrame, jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """wanted (job_id, output) with ``action``: skip if the job is done and its output exists, else run."""
    done = jobs.where("status = 'done'").select("job_id", F.lit(True).alias("_d"))
    there = outputs.select("output").distinct().withColumn("_o", F.lit(True))
    return wanted.join(done, "job_id", "left").join(there, "output", "left").withColumn("action", F.when(F.col("_d") & F.col("_o"), "skip").otherwise("run")).drop("_d", "_o")


def run_grid(spark: SparkSession, modes: list[str], seeds: int, start: int = 0) -> DataFrame:
    """(mode, seed): every mode with ``seeds`` numbers from ``start`` on. Unknown modes raise ValueError."""
    if unknown := [m for m in modes if m not in MODES]:
        raise ValueError(f"unknown modes: {unknown}")
    return spark.range(start, start + seeds).select(F.explode(F.array(*[F.lit(m) for m in modes]) if modes else F.array().cast("array<string>")).alias("mode"), F.col("id").cast("int").alias("seed"))


def run_all(grid: DataFrame, run, results: DataFrame | None = None, dry: bool = False) -> DataFrame:
    """(mode, seed, success, seconds) of the runs of a grid that have no result yet; with ``dry`` only (mode, seed) of what would run.

    ``run(mode, seed) -> bool`` is called in the executors, one call per row; one that raises has failed.
    ``results`` has the (mode, seed) of runs that are there already.
    """
    todo = grid if results is None else grid.join(results.select("mode", "seed").distinct(), ["mode", "seed"], "left_anti")
    todo = todo.select("mode", "seed")
    if dry:
        return todo

    def each(batches):
        for pdf in batches:
            rows = []
            for mode, seed in zip(pdf["mode"], pdf["seed"], strict=True):
                began = time.perf_counter()
                try:
                    good = bool(run(mode, int(seed)))
                except Exception:
                    good = False
                rows.append((mode, int(seed), good, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["mode", "seed", "success", "seconds"])

    return todo.repartition(todo.sparkSession.sparkContext.defaultParallelism, "mode", "seed").mapInPandas(each, "mode string, seed int, success boolean, seconds double")


def time_audit(runs: DataFrame, times: list[str], success: str = "success") -> DataFrame:
    """One row: runs, succeeded, the mean of every time over the runs that succeeded (0 if none did), and task hours of the last one over all runs."""
    good = F.coalesce(F.col(success), F.lit(False))
    means = [F.coalesce(F.avg(F.when(good, F.col(t))), F.lit(0.0)).alias(f"avg_{t}") for t in times]
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(good).alias("succeeded"), *means, (F.coalesce(F.sum(times[-1]), F.lit(0.0)) / 3600).alias("task_hours"))
