"""Bounded, resumable runs: plan, units, audit, repair.

Model and OCR calls are injected callables. A unit is one row; results are
checkpoints keyed by a digest of scope and input, so a run that is started
again does only what is pending. The loop is on the driver, its steps are
DataFrame actions, and its bounds are parameters.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.errors import PipelineError
from codicil.session import durable
from codicil.sources import files


@dataclass(frozen=True)
class Settings:
    """Bounds of a run; secrets are no part of its text form."""

    max_repairs: int = 3
    token_budget: int = 2_000_000
    timeout_s: int = 300
    attempts: int = 2
    api_key: str = field(default="", repr=False)

    @staticmethod
    def from_env(prefix: str = "CODICIL_") -> Settings:
        def number(name: str, default: int) -> int:
            text = os.environ.get(prefix + name, str(default))
            if not text.isdigit() or int(text) < 1:
                raise PipelineError("invalid_configuration", f"{prefix}{name} is a positive integer")
            return int(text)

        return Settings(number("MAX_REPAIRS", 3), number("TOKEN_BUDGET", 2_000_000), number("TIMEOUT_S", 300), number("ATTEMPTS", 2), os.environ.get(prefix + "API_KEY", ""))


def work_key(df: DataFrame, *columns: str) -> DataFrame:
    """``key``: digest of what a unit's result depends on; another input makes another key."""
    return df.withColumn("key", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256))


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a valid checkpoint of the same key."""
    return units.join(done.where("valid").select("key"), "key", "left_anti")


def _within(seconds: float | None, f: Callable, *args):
    """The result of a call, or TimeoutError; a call that hangs is left behind in its thread."""
    if seconds is None:
        return f(*args)
    box: list = []

    def run() -> None:
        try:
            box.append((True, f(*args)))
        except Exception as e:  # noqa: BLE001 - handed to the caller
            box.append((False, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not box:
        raise TimeoutError(f"no result within {seconds} s")
    ok, value = box[0]
    if not ok:
        raise value
    return value


def run_units(units: DataFrame, worker: Callable[[dict], str], attempts: int = 2, timeout_s: float | None = None) -> DataFrame:
    """Results of an injected worker: key, output, error, attempts. A failure is a row, not the end of the run, and so is an attempt longer than ``timeout_s``."""
    columns = units.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit in pdf.to_dict("records"):
                error, output, n = None, None, 0
                for n in range(1, attempts + 1):
                    try:
                        output, error = _within(timeout_s, worker, {c: unit[c] for c in columns}), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((unit["key"], output, error, n))
            yield pd.DataFrame(rows, columns=["key", "output", "error", "attempts"])

    return durable(units.mapInPandas(run, "key string, output string, error string, attempts int"), "units")


def latest_attempts(passes: DataFrame) -> DataFrame:
    """The last attempt of each unit."""
    w = Window.partitionBy("unit_id").orderBy(F.desc("attempt"))
    return passes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def usage(passes: DataFrame) -> DataFrame:
    """Tokens, time and reuse over all passes."""
    return passes.groupBy("run_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("latency_ms").alias("latency_ms"), F.count_if("reused").alias("reused"), F.count(F.lit(1)).alias("passes"))


def over_budget(passes: DataFrame, budget: int) -> DataFrame:
    """The first pass of each run with which its running token sum exceeds the budget."""
    w = Window.partitionBy("run_id").orderBy("position")
    run = passes.withColumn("spent", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("spent") > budget).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repair_loop(state, audit: Callable, repair: Callable, better: Callable, settings: Settings, spent: Callable[[], int] = lambda: 0):
    """Audits, repairs and keeps a repair only where it improves, at most ``max_repairs`` times and within the budget.

    Returns the last state, its issues, and the events of the run.
    """
    issues, events = audit(state), [("audited", 0)]
    for n in range(1, settings.max_repairs + 1):
        if not issues:
            break
        if spent() > settings.token_budget:
            raise PipelineError("token_budget_exhausted", f"more than {settings.token_budget} tokens")
        candidate = repair(state, issues)
        after = audit(candidate)
        if better(issues, after):
            state, issues = candidate, after
            events.append(("repaired", n))
        else:
            events.append(("rejected", n))
    events.append(("passed" if not issues else "failed", len(issues)))
    return state, issues, events


def save_state(root: str, run: str, key: str, state: dict) -> None:
    """The state of a run as one file; ``key`` is the digest of what it was made from."""
    files.write(files.join(root, "states", f"{run}.json"), json.dumps({"key": key, "state": state}, ensure_ascii=False).encode())


def load_state(root: str, run: str, key: str, problems: Callable[[dict], list[str]] = lambda state: []) -> dict | None:
    """The saved state of a run with the same input, checked again by the rules it must keep; None where there is none or its input has changed."""
    try:
        saved = json.loads(files.read(files.join(root, "states", f"{run}.json")))
    except FileNotFoundError:
        return None
    if saved.get("key") != key:
        return None
    found = problems(saved["state"])
    if found:
        raise PipelineError("stale_state", "; ".join(found[:8]))
    return saved["state"]


def promotion_gate(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("act_id",)) -> DataFrame:
    """Counts for a review decision by act (and whatever else ``by`` names): provisions before and after, machine-extracted ones, changed and lost ids."""
    by = list(by)
    b = before.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(*by).agg(F.count(F.lit(1)).alias("n_after"), F.count_if(F.col("text_fidelity") == "machine_extracted").alias("n_machine"))
    x = before.select(*by, "provision_id", F.col("canonical_record").alias("r0")).join(after.select(*by, "provision_id", F.col("canonical_record").alias("r1")), [*by, "provision_id"], "left")
    d = x.groupBy(*by).agg(F.count_if(F.col("r1").isNull()).alias("n_lost"), F.count_if(F.col("r1").isNotNull() & (F.col("r0") != F.col("r1"))).alias("n_changed"))
    out = b.join(a, by, "full").join(d, by, "left").fillna(0)
    return out.withColumn("ready", (F.col("n_machine") == 0) & (F.col("n_lost") == 0) & (F.col("n_after") >= F.col("n_before")))
