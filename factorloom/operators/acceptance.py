"""Runs that put the parts together: acceptance gate, rollouts."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import registry
from ..sources.panels import time_slice
from . import candidates as C

#: A task's rewards vary if their spread is above this; so many tasks must.
LEAST_SPREAD, LEAST_VARYING = 0.05, 3

Job = tuple[C.Task, DataFrame]


def panel_days(panel: DataFrame) -> list:
    """The distinct days of a panel in order (a calendar, not data)."""
    return [r[0] for r in panel.select(F.col("ts").cast("date").alias("day")).distinct().orderBy("day").collect()]


def acceptance_tasks(panel: DataFrame, seed: C.Seed, space: str = "crypto", parts: int = 5, ranked: int = 3, min_history: int = 30) -> list[Job]:
    """``parts`` windows of equal row counts, the first ``ranked`` across assets, the others on the first asset.

    Each task has its own slice of the panel; history is cut with it.
    """
    days = panel_days(panel)
    windows = C.row_windows(days, parts, min_history + 1)
    if len(windows) < parts:
        raise ValueError(f"{len(days)} days are too few for {parts} windows of {min_history + 1}")
    first = panel.agg(F.min("asset")).first()[0]
    jobs = []
    for i, w in enumerate(windows):
        kind = registry.CROSS_SECTION if i < ranked else registry.DIRECTION
        scenario = C.Scenario.of(kind, space, 1, name=f"acceptance_{space}_{kind}")
        inside = time_slice(panel, w.start, f"{w.end} 23:59:59.999999")
        jobs.append((C.Task(seed.expr, seed.score, scenario, w, scenario.objective), inside if i < ranked else inside.where(F.col("asset") == first)))
    return jobs


def _number(x: float | None) -> float:
    return float(x) if x is not None and math.isfinite(x) else -1.0


def sweep(panel: DataFrame, exprs: Sequence[str], space: str = "crypto", price: str = "close", min_history: int = 30, min_assets: int = 8) -> dict:
    """A fixed list of expressions through score and reward; passes if all are valid and their scores differ."""
    scenario = C.Scenario.of(registry.CROSS_SECTION, space, 1)
    task = C.Task(exprs[0], 0.0, scenario, C.Period("", ""), scenario.objective)
    done = C.discover(panel, task, space, price, lambda *_: exprs, len(exprs), min_history, min_assets, C.Archive())
    scores = {round(_number(o.score), 12) for o in done if o.valid}
    return {"results": [{"expr": o.expr, "valid": o.valid, "score": _number(o.score), "reward": _number(o.reward)} for o in done], "passed": all(o.valid for o in done) and len(scores) > 1}


def reward_gate(jobs: Sequence[Job], generator: Callable[[C.Task, int], Sequence[str]], space: str = "crypto", price: str = "close", rollouts: int = 8, min_history: int = 30, min_assets: int = 8) -> dict:
    """Do rewards differ within a task's completions?

    Passes with at least LEAST_VARYING tasks whose spread is above LEAST_SPREAD,
    no task of invalid completions only, and a valid, scored one somewhere.
    """
    archive, tasks = C.Archive(), []
    for number, (task, panel) in enumerate(jobs):
        done = C.reward_completions(panel, list(generator(task, rollouts)), task, space, price, archive, min_history, min_assets)
        rows = [{"completion": o.completion, "expr": o.expr, "valid": o.valid, "score": _number(o.score), "reward": _number(o.reward)} for o in done]
        rewards = [r["reward"] for r in rows]
        mean = sum(rewards) / len(rewards)
        spread = math.sqrt(sum((r - mean) ** 2 for r in rewards) / len(rewards))
        scored = any(o.valid and o.score is not None and math.isfinite(o.score) for o in done)
        tasks.append({"task": number, "benchmark": task.scenario.benchmark, "rollouts": rows, "reward_mean": mean, "reward_std": spread, "scored": scored})
    varying = sum(t["reward_std"] > LEAST_SPREAD for t in tasks)
    invalid = sum(all(r["reward"] == -1.0 for r in t["rollouts"]) for t in tasks)
    passed = varying >= LEAST_VARYING and invalid == 0 and any(t["scored"] for t in tasks)
    return {"tasks": tasks, "varying": varying, "all_invalid": invalid, "passed": passed}


def rollout(panel: DataFrame, request: str, generator: Callable[[C.Task, str, int], Sequence[str]], candidates: Sequence[str] | None = None, windows: int = 1, count: int = 4, top_k: int = 4, min_history: int = 30) -> tuple[C.SeedBank, list[dict]]:
    """Request to scenario, seeds, tasks and generated candidates; one record for each candidate."""
    r = C.refine(request)
    days = panel_days(panel)
    periods = C.time_windows(str(days[0]), str(days[-1]), windows)
    bank = C.seed_bank(panel, r.scenario, r.space, r.price, periods, candidates, min_history, top_k=top_k)
    archive, rows = C.Archive(), []
    for k, task in enumerate(bank.tasks):
        for o in C.discover(panel, task, r.space, r.price, generator, count, min_history, archive=archive):
            rows.append({"task": k, "seed_expr": task.seed_expr, **{n: v for n, v in asdict(o).items() if n not in ("completion", "components")}})
    return bank, rows


def valid_expressions(records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Distinct valid, non-empty expressions of rollout records, in first-seen order."""
    rows = records.where(F.col("valid") & (F.trim("expr") != "")).select(F.trim("expr").alias("expr"), F.col(ordinal).alias("ordinal"))
    return rows.groupBy("expr").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal")


def duplicates_of(candidates: DataFrame, archive: DataFrame, known: bool = True) -> DataFrame:
    """Candidates whose signature the archive has, or (``known=False``) has not."""
    return candidates.join(archive.select("signature").distinct(), "signature", "left_semi" if known else "left_anti")


def first_of_batch(candidates: DataFrame) -> DataFrame:
    """One candidate for each signature of a batch: the first by ordinal; invalid ones all stay."""
    place = F.row_number().over(Window.partitionBy("signature").orderBy("ordinal"))
    first = candidates.where("valid").withColumn("__place", place).where("__place = 1").drop("__place")
    return first.unionByName(candidates.where("not valid"))


def report_rows(result: Mapping[str, dict]) -> list[dict]:
    """Flat rows of ``compare_approaches`` for a table."""
    return [{**{k: v for k, v in r.items() if k not in ("validation", "test", "selected")}, "selected_count": len(r["selected"]), **{f"{s}_{m}": v for s in ("validation", "test") for m, v in r[s].items()}} for r in result.values()]
