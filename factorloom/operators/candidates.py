"""Candidate expressions: text to scenario, extraction, pools, tasks, rewards, archive, prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.guarded import clip, plain
from ..plans import expr as X
from ..plans import registry
from ..sources import store
from ..sources.panels import time_slice
from ..sources.versioned import VersionedTable
from ..workers import cut, ship
from .factors import factor_frame, lengthen
from .profiles import closest_profiles
from .scoring import CROSS_SECTION_METRICS, cross_sections, least_assets, over_time, score_cross_section, score_direction, score_sections

# Scenarios -------------------------------------------------------------------

# The words that decide what a request is about.
INTRADAY_WORDS = ("taq", "intraday", "microstructure", "spread", "imbalance")
COIN_WORDS = ("crypto", "btc", "eth", "coin")
RANKING_WORDS = ("cross-sectional", "cross sectional", "rankic", "rank", "many assets")


@dataclass(frozen=True)
class Scenario:
    name: str
    benchmark: str
    market: str
    horizon: int
    objective: str
    fields: tuple[str, ...]
    constraints: tuple[str, ...] = ()

    @classmethod
    def of(cls, benchmark: str, market: str, horizon: int, name: str | None = None, constraints: Sequence[str] = ()) -> "Scenario":
        s = registry.surface(benchmark)
        return cls(name or s.name, s.name, market, int(horizon), s.target, s.fields, tuple(constraints))


@dataclass(frozen=True)
class Request:
    scenario: Scenario
    space: str
    price: str


#: A number of days ("5d"), or a number of up to three digits.
_HORIZON = re.compile(r"(?<!\S)(?:(\d+)d|(\d{1,3}|0+\d{1,3}))(?!\S)")


def horizon_in(text: str, default: int = 1) -> int:
    """The first "5d" or whole number from 1 to 252 in a text."""
    found = (int(m[1] or m[2]) for m in _HORIZON.finditer(text.replace("-", " ")) if m[1] or 1 <= int(m[2]) <= 252)
    return next(found, default)


def refine(text: str) -> Request:
    """A plain request as a scenario, its namespace and price column."""
    text = str(text).strip().lower()
    if not text:
        raise ValueError("the request is empty")
    ranked = registry.CROSS_SECTION if any(w in text for w in RANKING_WORDS) else registry.DIRECTION
    if any(w in text for w in INTRADAY_WORDS):
        kind, market, space, price, rule = registry.INTRADAY, "wrds_taq", "taq", "close", "bars built from trades and quotes"
    elif any(w in text for w in COIN_WORDS):
        kind, market, space, price, rule = ranked, "crypto", "crypto", "close", "daily coin prices and volumes"
    else:
        kind, market, space, price, rule = ranked, "wrds_crsp", "crsp", "dlyclose", "daily stock records"
    return Request(Scenario.of(kind, market, horizon_in(text), constraints=(f"nothing but {rule}, as known at the time",)), space, price)


# Candidates ------------------------------------------------------------------

_TAGGED = re.compile(r"<expr>\s*(.*?)\s*</expr>", re.I | re.S)
#: The same for Spark.
TAGGED_SQL = r"(?is)<expr>\s*(.*?)\s*</expr>"


def expressions_in(text: str) -> tuple[str, ...]:
    """All tagged expressions of a completion; without tags, its lines."""
    found = [x.strip() for x in _TAGGED.findall(text)]
    return tuple(x for x in (found or [line.strip() for line in text.splitlines()]) if x)


def extract_expressions(df: DataFrame, text: str = "text", ordinal: str = "ordinal") -> DataFrame:
    """``ordinal, place, expr`` for every candidate in a table of completions."""
    blank = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    tagged = F.regexp_extract_all(F.col(text), F.lit(TAGGED_SQL), F.lit(1))
    found = F.when(F.size(tagged) > 0, blank(tagged)).otherwise(blank(F.split(F.col(text), r"\r\n|\n|\r")))
    return df.select(ordinal, F.posexplode(found).alias("place", "expr"))


def single_expression(text: Column) -> Column:
    """The first tagged expression of a completion, else its first call, else the text."""
    tagged = F.regexp_extract(text, TAGGED_SQL, 1)
    call = F.regexp_extract(text, r"(?s)([A-Za-z_]\w*\s*\(.*\))", 1)
    return F.when(tagged != "", tagged).when(call != "", call).otherwise(F.trim(text))


@dataclass(frozen=True)
class Realized:
    expr: str
    valid: bool
    signature: str = ""
    reason: str = ""


def realize(text: str, limits: X.Limits = X.Limits()) -> Realized:
    """Check one candidate; problems are reported, not raised."""
    expr = str(text).strip()
    try:
        return Realized(expr, True, X.signature(X.validate(expr, limits)))
    except (X.ExpressionError, RecursionError) as problem:
        return Realized(expr, False, "", str(problem))


def realize_all(spark: SparkSession, exprs: Iterable[str]) -> DataFrame:
    """``ordinal, expr, valid, signature, reason`` of a list of candidates."""
    rows = [(i, r.expr, r.valid, r.signature, r.reason) for i, r in enumerate(map(realize, exprs))]
    return spark.createDataFrame(rows, "ordinal int, expr string, valid boolean, signature string, reason string")


def realize_table(rows: DataFrame, expr: str = "expr", limits: X.Limits = X.Limits(), cache: int = 50_000) -> DataFrame:
    """Adds ``valid, signature, reason`` to a table of candidates and trims ``expr``; a missing one is not valid.

    Candidates are checked in Arrow batches; a worker keeps what it has last seen, since
    generators repeat themselves.  Nothing of the table comes to the driver.
    """
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c not in (expr, "valid", "signature", "reason")]
    given = rows.select(*names, F.col(expr).cast("string").alias(expr))
    new = [(expr, T.StringType()), ("valid", T.BooleanType()), ("signature", T.StringType()), ("reason", T.StringType())]
    schema = T.StructType([*(given.schema[n] for n in names), *(T.StructField(n, t) for n, t in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, Realized] = {}
        for batch in batches:
            found = []
            for text in batch.column(expr).to_pylist():
                r = seen.get(text)
                if r is None:
                    r = Realized("", False, reason="no expression") if text is None else realize(text, limits)
                    if len(seen) >= cache:
                        seen.clear()
                    seen[text] = r
                found.append(r)
            made = [pa.array([getattr(r, n) for r in found], t) for n, t in (("expr", pa.string()), ("valid", pa.bool_()), ("signature", pa.string()), ("reason", pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=schema.names)

    return given.mapInArrow(run, schema)


DESCRIBED = "kind string, problem string, fields array<string>, spaces array<string>, longest int, depth int"


def describe(text: str | None, limits: X.Limits = X.Limits()) -> tuple:
    """(kind, problem, fields, namespaces, longest window, depth) of an expression.

    ``problem`` is empty, ``limit`` for one that can be read but not used, or ``syntax``; then the rest is missing.
    """
    try:
        node = X.parse("" if text is None else text)
    except (X.ExpressionError, RecursionError):
        return None, "syntax", None, None, None, None
    try:
        X.check(node, limits)
        problem = ""
    except X.ExpressionError:
        problem = "limit"
    found = list(X.windows(node))
    deep = lambda n: 1 + max(map(deep, n.args)) if isinstance(n, X.Apply) else 0
    return node.kind, problem, sorted({w.full_name for w in found}), sorted({w.space for w in found}), max((w.length for w in found), default=None), deep(node)


def describe_table(rows: DataFrame, expr: str = "expr", limits: X.Limits = X.Limits()) -> DataFrame:
    """Adds DESCRIBED to a table of candidates: their types, problems, fields and namespaces, for filters on tables."""
    ship(rows.sparkSession)
    new = T._parse_datatype_string(DESCRIBED)
    kept = [c for c in rows.columns if c not in new.names]
    schema = T.StructType([*(rows.schema[c] for c in kept), *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, tuple] = {}
            texts = batch.column(expr).to_pylist()
            for text in set(texts):
                seen[text] = describe(text, limits)
            made = [pa.array([seen[t][k] for t in texts], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Seed:
    expr: str
    score: float
    signature: str


def pool_frame(scored: DataFrame, top_k: int = 16, threshold: float = float("-inf")) -> DataFrame:
    """The best ``top_k`` of ``ordinal, expr, valid, signature, score``, one for each signature.

    A missing score is not below any threshold and comes last; ties go by ordinal.
    """
    rows = scored.where(F.col("valid") & (F.col("score").isNull() | (F.col("score") >= threshold)))
    order = [F.desc_nulls_last("score"), F.col("ordinal")]
    first = rows.withColumn("__place", F.row_number().over(Window.partitionBy("signature").orderBy(*order))).where("__place = 1").drop("__place")
    return first.orderBy(*order).limit(top_k).select("ordinal", "expr", "score", "signature")


def seed_pool(candidates: Sequence[str], scores: Mapping[str, float] | None = None, score_fn: Callable[[str], float] | None = None, top_k: int = 16, threshold: float = float("-inf")) -> tuple[Seed, ...]:
    """The same for a list on the driver; scores that agree in twelve digits tie."""
    seeds = []
    for r in map(realize, (c for c in candidates if str(c).strip())):
        if r.valid:
            score = float(score_fn(r.expr) if score_fn else (scores or {}).get(r.expr, 0.0))
            if not score < threshold:
                seeds.append(Seed(r.expr, score, r.signature))
    seeds.sort(key=lambda s: round(s.score, 12) if s.score == s.score else float("-inf"), reverse=True)
    best = {s.signature: s for s in reversed(seeds)}
    return tuple(s for s in seeds if best[s.signature] is s)[:top_k]


# Tasks -----------------------------------------------------------------------


@dataclass(frozen=True)
class Period:
    start: str
    end: str


@dataclass(frozen=True)
class Task:
    seed_expr: str
    seed_score: float
    scenario: Scenario
    window: Period
    objective: str


def time_windows(start: str, end: str, periods: int) -> tuple[Period, ...]:
    """A range in equal parts by time; each after the first begins a day after the edge."""
    if int(periods) <= 0:
        raise ValueError("periods must be positive")
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    if b < a:
        raise ValueError("the end is before the start")
    edges = [a + (b - a) * i / int(periods) for i in range(int(periods) + 1)]
    return tuple(Period(str((x + timedelta(days=i > 0)).date()), str(y.date())) for i, (x, y) in enumerate(zip(edges, edges[1:])))


def row_windows(days: Sequence[date], parts: int, least: int = 1) -> tuple[Period, ...]:
    """Sorted days in ``parts`` windows of equal counts; shorter ones than ``least`` are left out."""
    n = len(days)
    edges = [round(i * n / parts) for i in range(parts + 1)]
    return tuple(Period(str(days[a]), str(days[b - 1])) for a, b in zip(edges, edges[1:]) if b - a >= max(1, least))


def split_days(days: Sequence[date], share: float = 0.7) -> tuple[Period, Period]:
    """Validation and test periods: the test starts at the row after the split."""
    k = min(int(len(days) * share), len(days) - 1)
    return Period(str(days[0]), str(days[k])), Period(str(days[min(k + 1, len(days) - 1)]), str(days[-1]))


def task_bank(seeds: Sequence[Seed], scenario: Scenario, windows: Sequence[Period]) -> tuple[Task, ...]:
    return tuple(Task(s.expr, s.score, scenario, w, scenario.objective) for s in seeds for w in windows)


def task_bank_frame(seeds: DataFrame, windows: Sequence[Period]) -> DataFrame:
    """Every row of ``seeds`` with every window (``start, end``), without a join."""
    every = F.array(*(F.struct(F.lit(w.start).alias("start"), F.lit(w.end).alias("end")) for w in windows))
    return seeds.select("*", F.inline(every)) if windows else seeds.select("*", F.lit("").alias("start"), F.lit("").alias("end")).limit(0)


# Scores, rewards, archive ----------------------------------------------------


def score_all(panel: DataFrame, exprs: Sequence[str], scenario: Scenario, space: str, price: str, min_history: int = 1, min_assets: int = 8) -> dict[str, dict[str, float | None]]:
    """Metrics (with ``score``) of many expressions in one job.

    Direction is that of one asset: a panel of several is refused.  An
    expression without scored rows has a missing score.
    """
    if scenario.benchmark == registry.CROSS_SECTION:
        rows = score_cross_section(panel, exprs, space, price, scenario.horizon, min_history, min_assets).collect()
        names = ("score", *CROSS_SECTION_METRICS, "valid_times", "mean_assets")
    else:
        if len(panel.select("asset").distinct().limit(2).collect()) > 1:
            raise ValueError("a direction is scored for one asset; choose one of the panel's")
        rows = score_direction(panel, exprs, space, price, scenario.horizon, min_history).collect()
        names = ("score", "dir_acc", "ic", "rank_ic", "samples")
    missing = dict.fromkeys(names) | ({"samples": 0} if "samples" in names else {})
    return {e: dict(missing) for e in exprs} | {r["expr"]: {n: plain(r[n]) for n in names} for r in rows}


@dataclass(frozen=True)
class SeedBank:
    scenario: Scenario
    space: str
    seeds: tuple[Seed, ...]
    tasks: tuple[Task, ...]
    raw_count: int
    scored_count: int


def seed_bank(panel: DataFrame, scenario: Scenario, space: str, price: str, windows: Sequence[Period], candidates: Sequence[str] | None = None, min_history: int = 1, min_assets: int = 8, top_k: int = 16, threshold: float = float("-inf"), scored: Mapping[str, Mapping[str, float | None]] | None = None) -> SeedBank:
    """Candidates of one namespace, scored in one job (or ``scored`` before), pooled and crossed with windows."""
    raw = tuple(candidates) if candidates is not None else registry.templates(scenario.benchmark)
    own = tuple(e for e in raw if X.only_uses(e, space))
    if scored is not None:
        found = {e: scored[e] for e in own}
    else:
        found = score_all(panel, list(dict.fromkeys(own)), scenario, space, price, min_history, min_assets) if own else {}
    scores = {e: m["score"] if m["score"] is not None else float("nan") for e, m in found.items()}
    seeds = seed_pool(own, scores, top_k=top_k, threshold=threshold)
    return SeedBank(scenario, space, seeds, task_bank(seeds, scenario, windows), len(raw), len(own))


def asset_seed_bank(panel: DataFrame, asset: str, space: str, price: str, windows: Sequence[Period], candidates: Sequence[str] | None = None, start: str | None = None, end: str | None = None, horizon: int = 1, min_history: int = 1, top_k: int = 16, threshold: float = float("-inf")) -> SeedBank:
    """The seed bank of one asset within a range of time, scored by direction."""
    scenario = Scenario.of(registry.DIRECTION, space, horizon, name=f"{space}_single_asset_seed_bank")
    inside = time_slice(panel.where(F.col("asset") == asset), start, end and f"{end} 23:59:59.999999")
    return seed_bank(inside, scenario, space, price, windows, candidates, min_history, top_k=top_k, threshold=threshold)


@dataclass(frozen=True)
class RewardWeights:
    invalid: float = -1.0
    quality: float = 1.0
    diversity: float = 0.05
    complementarity: float = 0.05
    duplicate: float = 0.25


@dataclass(frozen=True)
class Record:
    expr: str
    signature: str
    score: float
    reward: float
    metrics: dict[str, float]
    task: dict = field(default_factory=dict)


def _profile_correlation(a: Mapping[str, float | None], b: Mapping[str, float | None]) -> float:
    """Pearson over shared finite metrics; 0 for fewer than two or no spread."""
    import math

    keys = [k for k in sorted(set(a) & set(b)) if a[k] is not None and b[k] is not None and math.isfinite(a[k]) and math.isfinite(b[k])]
    if len(keys) < 2:
        return 0.0
    x, y = [a[k] for k in keys], [b[k] for k in keys]
    n, mx, my = len(keys), sum(x) / len(x), sum(y) / len(y)
    sx, sy = math.sqrt(sum((v - mx) ** 2 for v in x) / n), math.sqrt(sum((v - my) ** 2 for v in y) / n)
    if sx <= 1e-12 or sy <= 1e-12:
        return 0.0
    return sum((p - mx) * (q - my) for p, q in zip(x, y)) / n / (sx * sy)


class Archive:
    """Accepted factors in order; what is in it changes later rewards, so it is filled one by one."""

    def __init__(self, records: Iterable[Record] = ()):
        self.records: list[Record] = list(records)
        self.signatures = {r.signature for r in self.records}

    def __contains__(self, signature: str) -> bool:
        return bool(signature) and signature in self.signatures

    def closest(self, metrics: Mapping[str, float | None]) -> float:
        return max((abs(_profile_correlation(metrics, r.metrics)) for r in self.records), default=0.0)

    def offer(self, r: Realized, score: float, reward: float, metrics: Mapping, task: dict, min_score: float = 0.0, min_reward: float = 0.0) -> bool:
        """Store a valid, new factor that is not below the thresholds."""
        if not r.valid or r.signature in self or score < min_score or reward < min_reward:
            return False
        self.records.append(Record(r.expr, r.signature, float(score), float(reward), dict(metrics), task))
        self.signatures.add(r.signature)
        return True

    def save(self, spark: SparkSession, path: str) -> None:
        """JSON lines, by a Hadoop path."""
        store.write_text(spark, path, "".join(json.dumps(asdict(r), sort_keys=True) + "\n" for r in self.records))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Archive":
        """What ``save`` has written; without a file, an empty archive."""
        text = store.read_text(spark, path) or ""
        return cls(Record(**json.loads(x)) for x in text.splitlines() if x.strip())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.expr, r.signature, r.score, r.reward, r.metrics) for r in self.records]
        return spark.createDataFrame(rows, "expr string, signature string, score double, reward double, metrics map<string,double>")


def reward_of(score: float, duplicate: bool, closest: float, w: RewardWeights = RewardWeights()) -> float:
    total = w.quality * score + w.diversity * (not duplicate) + w.complementarity * (1.0 - max(0.0, closest)) - w.duplicate * duplicate
    return min(1.0, max(-1.0, total)) if total == total else total


def reward_column(valid: Column, score: Column, duplicate: Column, closest: Column, w: RewardWeights = RewardWeights()) -> Column:
    """The same as a column."""
    penalty = F.when(duplicate, F.lit(-w.duplicate)).otherwise(F.lit(w.diversity))
    total = w.quality * score + penalty + w.complementarity * (1.0 - F.greatest(F.lit(0.0), closest))
    return F.when(valid, clip(total, -1.0, 1.0)).otherwise(F.lit(w.invalid))


def reward_batch(candidates: DataFrame, archive: DataFrame, w: RewardWeights = RewardWeights(), block: int = 1024) -> DataFrame:
    """Rewards of ``ordinal, expr, signature, valid, score, metrics`` against a stored archive.

    Adds ``duplicate``, ``closest`` (largest absolute profile correlation) and
    ``reward``.  The archive is read, not changed: within the batch candidates
    do not see each other.  The closest profile comes from a pruned index
    (``profiles``), not from meeting every record.
    """
    known = archive.select("signature").distinct().withColumn("duplicate", F.lit(True))
    close = closest_profiles(candidates, archive, block=block)
    out = candidates.join(known, "signature", "left").join(close, "ordinal", "left").withColumns({"duplicate": F.coalesce("duplicate", F.lit(False)), "closest": F.coalesce("closest", F.lit(0.0))})
    return out.withColumn("reward", reward_column(F.col("valid"), F.col("score"), F.col("duplicate"), F.col("closest"), w))


@dataclass(frozen=True)
class Outcome:
    """What became of one candidate."""

    expr: str
    valid: bool
    signature: str = ""
    score: float = -1.0
    metrics: dict[str, float | None] = field(default_factory=dict)
    reward: float | None = None
    components: dict[str, float] | None = None
    stored: bool = False
    reason: str = ""
    completion: str = ""


def task_payload(task: Task, space: str) -> dict:
    fields = tuple(f for f in registry.surface(task.scenario.benchmark).fields if f.startswith(f"{space}."))
    return {"seed_expr": task.seed_expr, "seed_score": task.seed_score, "scenario": asdict(task.scenario), "window": asdict(task.window), "objective": task.objective, "namespace": space, "allowed_fields": fields, "allowed_operators": X.FUNCTIONS}


def _settle(r: Realized, metrics: Mapping[str, float | None], archive: Archive | None, payload: dict, w: RewardWeights, store: bool, **limits: float) -> Outcome:
    score = metrics["score"] if metrics["score"] is not None else float("nan")
    base = Outcome(r.expr, True, r.signature, score, dict(metrics))
    if archive is None:
        return base
    duplicate, closest = r.signature in archive, archive.closest(metrics)
    reward = reward_of(score, duplicate, closest, w)
    parts = {"quality": score, "diversity": float(not duplicate), "complementarity": 1.0 - max(0.0, closest), "duplicate": float(duplicate)}
    stored = store and archive.offer(r, score, reward, metrics, payload, **limits)
    return replace(base, reward=reward, components=parts, stored=stored)


def discover(panel: DataFrame, task: Task, space: str, price: str, generator: Callable[[Task, str, int], Sequence[str]], count: int = 4, min_history: int = 1, min_assets: int = 8, archive: Archive | None = None, weights: RewardWeights = RewardWeights(), **limits: float) -> tuple[Outcome, ...]:
    """Candidates of a generator: checked, freed of repeats, scored in one job, then rewarded in order."""
    realized = [realize(e) for e in generator(task, space, count)]
    fresh = list({r.signature: r for r in reversed(realized) if r.valid}.values())
    found = score_all(panel, [r.expr for r in fresh], task.scenario, space, price, min_history, min_assets) if fresh else {}
    payload, seen, out = task_payload(task, space), set(), []
    for r in realized:
        if not r.valid:
            out.append(Outcome(r.expr, False, reason=r.reason))
        elif r.signature not in seen:
            seen.add(r.signature)
            out.append(_settle(r, found[r.expr], archive, payload, weights, True, **limits))
    return tuple(out)


def reward_completions(panel: DataFrame, completions: Sequence[str], task: Task, space: str, price: str, archive: Archive | None = None, min_history: int = 1, min_assets: int = 8, weights: RewardWeights = RewardWeights(), **limits: float) -> tuple[Outcome, ...]:
    """One reward for each completion, from its first expression; what cannot be used gets -1 and a reason."""
    firsts = [expressions_in(c)[:1] for c in completions]
    realized = [realize(f[0]) if f else Realized("", False, reason="no expression found") for f in firsts]
    exprs = list(dict.fromkeys(r.expr for r in realized if r.valid))
    found = score_all(panel, exprs, task.scenario, space, price, min_history, min_assets) if exprs else {}
    payload, out = task_payload(task, space), []
    for text, r in zip(completions, realized):
        if r.valid:
            done = _settle(r, found[r.expr], archive if archive is not None else Archive(), payload, weights, archive is not None, **limits)
        else:
            done = Outcome(r.expr, False, reward=weights.invalid, reason=r.reason)
        out.append(replace(done, completion=text))
    return tuple(out)


def reward_table(panel: DataFrame, completions: DataFrame, archive: DataFrame, scenario: Scenario, space: str, price: str, min_history: int = 1, min_assets: int = 8, weights: RewardWeights = RewardWeights(), batch: int = 64) -> DataFrame:
    """One reward for each row of ``completions`` (``ordinal, text``) against a stored archive.

    Adds ``expr, valid, signature, reason, score, metrics, duplicate, closest, reward``, from a
    completion's first expression.  Completions stay a table: what comes to the driver is one text
    for each different valid expression (by signature), which the plan over the panel is made of,
    ``batch`` of them in a job.  The archive is read, not changed.
    """
    first = extract_expressions(completions).where("place = 0").drop("place")
    done = realize_table(completions.select("ordinal").join(first, "ordinal", "left"))
    done = done.withColumn("reason", F.when((F.col("expr") == "") & ~F.col("valid"), F.lit("no expression found")).otherwise(F.col("reason")))
    texts = {r["signature"]: r["expr"] for r in done.where("valid").groupBy("signature").agg(F.min("expr").alias("expr")).collect()}
    rows, names = [], list(texts)
    for k in range(0, len(names), batch):
        some = names[k : k + batch]
        found = score_all(panel, [texts[s] for s in some], scenario, space, price, min_history, min_assets)
        rows += [(s, found[texts[s]]["score"], {n: None if v is None else float(v) for n, v in found[texts[s]].items()}) for s in some]
    # a reward is that of the expression, so each is rewarded once
    once = panel.sparkSession.createDataFrame([(k, True, *r) for k, r in enumerate(rows)], "ordinal int, valid boolean, signature string, score double, metrics map<string,double>")
    rewarded = reward_batch(once, archive, weights).select("signature", "score", "metrics", "duplicate", "closest", "reward")
    worst = {"score": F.lit(-1.0), "duplicate": F.lit(False), "closest": F.lit(0.0), "reward": F.lit(weights.invalid)}
    return done.join(rewarded, "signature", "left").withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(v) for c, v in worst.items()})


def store_rewards(rewarded: DataFrame, archive: VersionedTable, log: VersionedTable | None = None, source: str = "rewards", number: int = 0, min_score: float = 0.0, min_reward: float = 0.0) -> None:
    """Keep a batch of ``reward_batch`` or ``reward_table`` rows: all in the ``log``, accepted ones in the ``archive``.

    Accepted: valid, not in the archive already, not below the thresholds, the first by ordinal of
    its signature.  A batch that is repeated (same ``source`` and ``number``) changes neither table.
    """
    names = ["ordinal", "expr", "signature", "score", "reward", "metrics"]
    if log is not None:
        log.append(rewarded.select(*names, "valid", "duplicate", "closest"), source, number)
    good = rewarded.where(F.col("valid") & ~F.col("duplicate") & (F.col("score") >= min_score) & (F.col("reward") >= min_reward) & ~F.isnan("score") & ~F.isnan("reward"))
    if archive.manifest() is not None:
        good = good.join(archive.read().select("signature").distinct(), "signature", "left_anti")
    first = good.groupBy("signature").agg(F.min_by(F.struct(*(n for n in names if n != "signature")), "ordinal").alias("c"))
    archive.append(first.select("c.expr", "signature", "c.score", "c.reward", "c.metrics"), source, number)


def reward_spread(outcomes: DataFrame, most_flat: float = 0.05) -> DataFrame:
    """By ``task`` of ``task, reward, valid``: mean, spread, valid count, and whether rewards vary."""
    out = outcomes.groupBy("task").agg(F.count("*").alias("rollouts"), F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"), F.sum(F.col("valid").cast("long")).alias("valid"))
    return out.withColumn("varies", F.col("reward_std") > most_flat)


# Prompt rows (their ids are of this package's own making) and generators --------------------------------------------------

_SYSTEM = (
    "You improve quantitative factor expressions. Change the given seed into valid candidates. "
    "Use only the allowed fields and functions, and answer with expressions only."
)


def messages(task: Task, space: str, count: int = 1) -> list[dict[str, str]]:
    p = task_payload(task, space)
    lines = [
        f"Seed expression: {p['seed_expr']}",
        f"Seed score: {p['seed_score']}",
        f"Benchmark: {task.scenario.benchmark}; market: {task.scenario.market}; horizon: {task.scenario.horizon}",
        f"Objective: {task.objective}",
        f"Window: {task.window.start} to {task.window.end}",
        f"Namespace: {space}",
        f"Allowed fields: {', '.join(p['allowed_fields'])}",
        f"Allowed functions: {', '.join(p['allowed_operators'])}",
        f"Give {int(count)} expressions, each as <expr>expression</expr>.",
    ]
    return [{"role": "system", "content": _SYSTEM}, {"role": "user", "content": "\n".join(lines)}]


PROMPT_ROW = (
    "data_source string, prompt array<struct<role:string,content:string>>, reward_model struct<ground_truth:array<string>,style:string>, "
    "extra_info struct<index:int,task_id:string,seed_id:string,seed_name:string,seed_expr:string,seed_score:double,family:string,time_split:string,start_date:string,end_date:string,"
    "bar_minutes:int,namespace:string,reward_kind:string,horizon:int,horizon_bars:int,window:struct<start:string,end:string>,"
    "scenario:struct<name:string,benchmark:string,market:string,horizon:int,objective:string,fields:array<string>,constraints:array<string>>,objective:string,repeat_index:int>"
)


def prompt_rows(spark: SparkSession, tasks: Sequence[Task], space: str, repeats: int = 1, data_source: str = "factorloom/factor_dsl", bar_minutes: int = 1440) -> DataFrame:
    """Training rows: each task's messages and its description, ``repeats`` times."""
    rows = []
    for i, t in enumerate(tasks):
        family, split, s = f"{space}_{t.scenario.benchmark}", f"{t.window.start}_{t.window.end}", t.scenario
        info = (i, f"{family}/{split}/{i}", f"{i}", f"{space}/{i}", t.seed_expr, float(t.seed_score), family, split, t.window.start, t.window.end, int(bar_minutes), space, s.benchmark, s.horizon, s.horizon, (t.window.start, t.window.end), (s.name, s.benchmark, s.market, s.horizon, s.objective, list(s.fields), list(s.constraints)), t.objective)
        rows += [(data_source, [(m["role"], m["content"]) for m in messages(t, space)], ([], "rule"), (*info, k)) for k in range(max(1, int(repeats)))]
    return spark.createDataFrame(rows, PROMPT_ROW)


def prompt_frame(tasks: DataFrame, scenario: Scenario, space: str, repeats: int = 1, count: int = 1, data_source: str = "factorloom/factor_dsl") -> DataFrame:
    """``data_source, prompt, seed_expr, repeat_index``: the messages of a table of tasks (``expr, score, start, end``), each ``repeats`` times.

    The prompt of a row is that of ``messages`` for the same task.
    """
    task = Task("\x00expr\x00", 0.0, scenario, Period("\x00start\x00", "\x00end\x00"), scenario.objective)
    system, user = messages(task, space, count)
    text = F.lit(user["content"].replace("Seed score: 0.0", "Seed score: \x00score\x00"))
    for name in ("start", "end", "score", "expr"):  # the expression last: nothing in it is taken for a name
        text = F.replace(text, F.lit(f"\x00{name}\x00"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.array(message(system["role"], F.lit(system["content"])), message(user["role"], text))
    again = F.explode(F.sequence(F.lit(0), F.lit(max(1, int(repeats)) - 1))).alias("repeat_index")
    return tasks.select(F.lit(data_source).alias("data_source"), prompt.alias("prompt"), F.col("expr").alias("seed_expr"), again)


# What the offline generators try.
MUTATED_WINDOWS, NEW_WINDOWS = ("7", "20", "30"), (5, 7, 10, 14, 20, 30, 45, 60)
WRAPPERS = ("tanh", "zscore", "neg", "abs")
ATOMS = ("ts_mean(crypto.returns(7))", "ts_std(crypto.returns(30))", "ts_mean(crypto.volume(20))", "ts_mean(crypto.close(14))")


def mutations(templates: Sequence[str], count: int) -> tuple[str, ...]:
    """Templates with other windows."""
    every = (t.replace(f"({old})", f"({new})") for t in templates for old in MUTATED_WINDOWS for new in NEW_WINDOWS)
    return tuple(x for _, x in zip(range(count), every))


def refinements(templates: Sequence[str], count: int) -> tuple[str, ...]:
    """Templates, bare and wrapped."""
    every = (x for t in templates for x in (t, *(f"{w}({t})" for w in WRAPPERS)))
    return tuple(x for _, x in zip(range(count), every))


def expansions(templates: Sequence[str], count: int) -> tuple[str, ...]:
    """Templates, then quotients and differences of fixed parts."""
    pairs = (f"{op}({a}, {b})" for a in ATOMS for b in ATOMS if a != b for op in ("div", "sub"))
    return tuple(x for _, x in zip(range(count), (*templates, *pairs)))


GENERATORS = {"mutation": mutations, "refinement": refinements, "expansion": expansions}


def compare_approaches(panel: DataFrame, approaches: Mapping[str, Callable[[Sequence[str], int], Sequence[str]]] | None = None, space: str = "crypto", price: str = "close", count: int = 12, top_k: int = 5, threshold: float = 0.7, min_history: int = 30) -> dict[str, dict]:
    """Candidate generators under one protocol: scored, pooled, and evaluated as libraries on a 70/30 split of days.

    The factors of all generators are computed once, and so are their cross-sections of each day,
    which the scores of all days and those of the validation days are both made of.
    """
    from .library import Selection, choose_and_fuse, undersized

    days = [r[0] for r in panel.select(F.col("ts").cast("date")).distinct().orderBy("ts").collect()]
    first, second = split_days(days)
    scenario = Scenario.of(registry.CROSS_SECTION, space, 1, name=f"{space}_compared_approaches")
    own = tuple(t for t in registry.templates(scenario.benchmark) if f"{space}." in t)
    config = Selection((first.start, first.end), (second.start, second.end), threshold, top_k, min_history)
    made = {name: tuple(str(e).strip() for e in generate(own, count)) for name, generate in (approaches or GENERATORS).items()}
    exprs = list(dict.fromkeys(e for some in made.values() for e in some if X.only_uses(e, space)))
    enough = panel.select("asset").distinct().limit(least_assets(config.min_assets)).count() >= least_assets(config.min_assets)
    wide = factor_frame(panel, exprs, space, min_history, price, scenario.horizon).cache()
    out = {}
    try:
        sections = cut(cross_sections(lengthen(wide, len(exprs)), config.min_assets))
        scored = {r["expr"]: {"score": plain(r["score"])} for r in score_sections(sections, exprs, F.lit(enough)).collect()}
        validated = {exprs[r["expr_id"]]: plain(r["rank_ic_mean"]) for r in over_time(time_slice(sections, first.start, first.end)).collect()}
        for name, candidates in made.items():
            bank = seed_bank(panel, scenario, space, price, [first], candidates, min_history, top_k=max(top_k, 1), threshold=-1.0, scored=scored)
            seeds = list(dict.fromkeys(s.expr for s in bank.seeds))
            columns = [F.col(f"f{exprs.index(e)}").alias(f"f{k}") for k, e in enumerate(seeds)]
            scores = {k: validated.get(e) for k, e in enumerate(seeds)}
            result = choose_and_fuse(wide.select("asset", "ts", *columns, "fwd"), seeds, scores, config) if enough else undersized(config)
            out[name] = {"approach": name, "candidates": len(candidates), "usable": len(bank.seeds), "selected": result.selected, "validation": asdict(result.validation), "test": asdict(result.test)}
    finally:
        wide.unpersist()
    return out
