"""Experiments: one configuration, a grid of them, or several seeds, as DataFrames over a shared series."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from . import adaptive, drift, leaderboard, models
from .rolling import Layout, windows

log = logging.getLogger(__name__)
STRATEGIES = ("no_retrain", "fixed_retrain", "adaptive_retrain")
#: Window lengths in rows of the four published datasets.
LAYOUTS = {"electricity": Layout(720, 24, 24), "traffic": Layout(720, 24, 24), "brent": Layout(1440, 168, 168), "wti": Layout(1440, 168, 168)}


@dataclass(frozen=True)
class Config:
    dataset: str = "events"
    model: str = "naive"
    strategy: str = "fixed_retrain"
    layout: Layout = Layout()
    every: int = 10
    detector: str = "ks_test"
    detector_params: Mapping[str, float] = field(default_factory=dict)
    policy: Mapping[str, object] = field(default_factory=lambda: {"kind": "drift_triggered", "gap": 3, "consecutive": 2, "threshold": 0.5, "decay": 0.5})
    drift_enabled: bool = True
    seed: int = 42
    params: Mapping[str, float] = field(default_factory=dict)
    on: str = "residual"
    sample_entities: int | None = None
    downsample: str | None = None
    metrics: tuple[str, ...] = ()


def load_config(path: str) -> dict:
    """A YAML configuration as a tree."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


# Fixed names of configuration files, and what they are called here.
PARAMS = {"random_state": "seed", "learning_rate": "rate", "num_leaves": "leaves", "hidden_size": "hidden", "num_layers": "layers", "sequence_length": "steps", "batch_size": "batch", "seasonality": "m", "season_length": "m"}
POLICY = {"min_steps_between_retrain": "gap", "require_consecutive": "consecutive", "drift_threshold": "threshold", "consecutive_decay_rate": "decay", "max_retrains_per_month": "budget", "error_window": "window", "error_threshold": "relative"}
FREQUENCIES = {"h": None, "d": "day", "w": "week", "m": "month"}
#: Parameters of the ridge's namesake, a mixing network, that the ridge has no use for.
UNUSED = {"ridge_features": ("input_len", "hidden", "n_layers", "layers", "dropout", "epochs", "rate", "batch")}


def config_of(tree: Mapping, seed: int | None = None) -> Config:
    """A configuration file's tree; what it leaves out has the defaults, and what nobody knows is an error.

    dataset: name, sample_entities, downsample_freq (h, d, w, m). model: name, params. simulation: history_window_days, forecast_horizon_hours, step_size_hours,
    in rows of an hourly series as published. drift: enabled, detector, detector_params, on. retraining: policy and its parameters: no_retraining and fixed_schedule are
    strategies, any other policy makes an adaptive run. metrics: names of the overall metrics. A given seed goes before the file's.
    """
    part = lambda k: {"name": tree[k]} if isinstance(tree.get(k), str) else dict(tree.get(k) or {})
    data, model, sim, found, rules = map(part, ("dataset", "model", "simulation", "drift", "retraining"))
    name = model.get("name", "naive")
    params = {PARAMS.get(k, k): v for k, v in (model.get("params") or {}).items()}
    params = {k: v for k, v in params.items() if k not in UNUSED.get(models.resolve(name), ())}
    chosen = seed if seed is not None else tree.get("seed", params.pop("seed", 42))
    params.pop("seed", None)
    freq = str(data.get("downsample_freq", "h")).lower()
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}; there are {', '.join(FREQUENCIES)}")
    base = LAYOUTS.get(data.get("name", ""), Layout())
    layout = Layout(int(sim["history_window_days"] * 24) if "history_window_days" in sim else base.history, int(sim.get("forecast_horizon_hours", base.forecast)), int(sim.get("step_size_hours", base.step)))
    kind = drift.ALIASES.get(rules.get("policy", ""), rules.get("policy"))
    strategy = tree.get("strategy") or ("no_retrain" if not rules.get("enabled", True) or kind == "no_retraining" else "fixed_retrain" if kind in (None, "fixed_schedule") else "adaptive_retrain")
    policy = {POLICY[k]: v for k, v in rules.items() if k in POLICY}
    if not rules.get("decay_consecutive", True):
        policy["decay"] = float("inf")  # a quiet step forgets the run of drifts
    metrics = tuple(tree.get("metrics") or ())
    if unknown := set(metrics) - set(M.METRICS):
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    return Config(
        data.get("name", "events"), name, strategy, layout, int(rules.get("retrain_every_n_steps", 10)), found.get("detector", "ks_test"), dict(found.get("detector_params") or {}),
        {"kind": kind if strategy == "adaptive_retrain" and kind else "drift_triggered", **policy}, bool(found.get("enabled", True)), int(chosen), params, found.get("on", "residual"), data.get("sample_entities"), FREQUENCIES[freq], metrics,
    )


def prepare(series: DataFrame, c: Config) -> DataFrame:
    """The configuration's entities at its frequency."""
    from ..sources import series as sources

    return sources.downsample(sources.sample_entities(series, c.sample_entities, c.seed) if c.sample_entities else series, c.downsample)


def grid(datasets: Iterable[str] = LAYOUTS, strategies: Iterable[str] = STRATEGIES, names: Iterable[str] | None = None) -> list[Config]:
    """All combinations of datasets, strategies and available models."""
    names = [n for n in (names or ("naive", "seasonal_naive", "lgbm", "rf", "lstm", "tsmixer")) if models.is_model_available(n)]
    return [Config(d, m, s, LAYOUTS.get(d, Layout())) for d in datasets for s in strategies for m in names]


def run(series: DataFrame, c: Config) -> dict[str, DataFrame]:
    """predictions, window_metrics, drift_log, retraining_log, overall and extended tables of one configuration; nothing runs until one is used."""
    series = prepare(series, c)
    seed = dict(c.params) | ({"seed": c.seed} if models.resolve(c.model) in models.SEEDED else {})
    decided, name = None, models.resolve(c.model)
    if c.strategy == "adaptive_retrain":  # each model follows the loop of its own residuals
        if name in models.LEARNED:
            framed, make = models.prepared(series, name, **seed)
            decided = adaptive.loop(framed, c.layout, detector=c.detector, policy=c.policy, make=make, on=c.on, **c.detector_params)
        else:
            decided = adaptive.loop(series, c.layout, name, c.detector, c.policy, on=c.on, **seed, **c.detector_params)
        seed["decided"] = decided
    p = models.get_model(c.model)(series, c.layout, policy=c.strategy, every=c.every, **seed)
    p = p.drop("step").join(windows(series, c.layout).select("entity_id", "window_id", "step"), ["entity_id", "window_id"])
    from .rolling import window_metrics

    per = window_metrics(p)
    out = {"predictions": p, "window_metrics": per, "overall": p.agg(*[f().alias(n) for n, f in M.METRICS.items() if n in (c.metrics or M.METRICS)], F.count("*").alias("n_predictions")), "extended": M.extended(p)}
    if c.drift_enabled:
        ref = series.where(F.col("pos") < c.layout.history).select("entity_id", "pos", F.col("target").alias("x"))
        found = decided.select("entity_id", "window_id", "drift_detected", "drift_score", "retrain", "reason") if decided is not None else drift.detect_windows(p, ref, c.detector, c.on, **c.detector_params)
        before = Window.partitionBy("entity_id").orderBy("window_id").rowsBetween(-5, -1)
        seen = per.join(found, ["entity_id", "window_id"]).withColumn("error", F.coalesce(F.avg("mae").over(before), F.lit(0.0)))
        if decided is not None:
            total = F.count_if("retrain").over(Window.partitionBy("entity_id").orderBy("window_id"))
            trace = decided.select("entity_id", "window_id", "retrain", "reason", total.alias("total_retrains"))
            seen, trace = seen.drop("retrain", "reason"), trace.join(per.select("entity_id", "window_id", "step"), ["entity_id", "window_id"]).drop("window_id")
        else:
            kind = {"kind": "no_retraining"} if c.strategy == "no_retrain" else {"kind": "fixed_schedule", "interval": c.every if c.strategy == "fixed_retrain" else 1}
            trace = drift.policy_trace(seen, drift.create_policy(**kind))
        out["drift_log"] = seen.join(trace, ["entity_id", "step"]).select("timestamp", "step", "entity_id", "drift_detected", "drift_score", F.lit(c.detector).alias("detector"), F.col("retrain").alias("retrain_triggered"), F.col("reason").alias("retrain_reason"))
        out["retraining_log"] = seen.join(trace.where("retrain"), ["entity_id", "step"]).select("step", "timestamp", "entity_id", "drift_detected", "drift_score", "error", "reason", "total_retrains")
    return out


def run_grid(series: Mapping[str, DataFrame], configs: Iterable[Config]) -> DataFrame:
    """A row for each configuration: its overall metrics, or (metrics null) the error that kept it from being planned; a dataset that is not given is such an error."""
    rows, failed, spark = None, [], next(iter(series.values())).sparkSession
    for c in configs:
        try:
            if c.dataset not in series:
                raise ValueError(f"no series for {c.dataset!r}")
            r = run(series[c.dataset], c)
        except Exception as e:
            log.exception("run failed: %s/%s/%s", c.dataset, c.strategy, c.model)
            failed.append((c.dataset, c.strategy, c.model, f"{type(e).__name__}: {e}"))
            continue
        metrics = [F.col(m) if m in r["overall"].columns else F.lit(None).cast("double").alias(m) for m in ("mae", "rmse", "smape")]
        one = r["overall"].select(F.lit(c.dataset).alias("dataset"), F.lit(c.strategy).alias("strategy"), F.lit(c.model).alias("model"), *metrics, "n_predictions", F.lit(None).cast("string").alias("error"))
        rows = one if rows is None else rows.unionByName(one)
    bad = spark.createDataFrame(failed, "dataset string, strategy string, model string, error string")
    if rows is None or failed:
        bad = bad.select("dataset", "strategy", "model", *[F.lit(None).cast("double").alias(m) for m in ("mae", "rmse", "smape")], F.lit(None).cast("bigint").alias("n_predictions"), "error")
        rows = bad if rows is None else rows.unionByName(bad)
    return rows


def multi_seed(series: DataFrame, c: Config, seeds: Iterable[int] = (42, 43, 44, 45, 46)) -> DataFrame:
    """Statistics of the overall metrics over seeds; models without randomness are evaluated once."""
    from dataclasses import replace

    rows = None
    seeds = list(seeds)
    for s in seeds if models.resolve(c.model) in models.SEEDED else seeds[:1]:
        one = run(series, replace(c, seed=s, drift_enabled=False, metrics=()))["overall"].select(F.lit(s).alias("seed"), "mae", "rmse", "smape", "mape")
        rows = one if rows is None else rows.unionByName(one)
    long = rows.unpivot("seed", ["mae", "rmse", "smape", "mape"], "metric", "value")
    return leaderboard.seed_statistics(long)


def main(argv: list[str] | None = None) -> None:
    """python -m tidewatch.operators.experiment --config c.yaml --output folder --data folder."""
    import argparse

    from ..session import local
    from ..sources import run_store, series

    a = argparse.ArgumentParser()
    a.add_argument("--config", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--data", required=True, help="folder of the driver tables, or a CSV for the published datasets")
    a.add_argument("--seed", type=int, help="goes before the configuration's")
    args = a.parse_args(argv)
    raw = load_config(args.config)
    c = config_of(raw, args.seed)
    name, model = c.dataset, c.model
    tables = run(series.get_dataset(local(), name, args.data), c)
    named = {"dataset": F.lit(name), "strategy": F.lit(c.strategy), "model": F.lit(model)}
    for table, part in (("metrics", "overall"), ("window_metrics", "window_metrics"), ("drift_log", "drift_log"), ("retraining_log", "retraining_log")):
        if part in tables:
            run_store.write_runs(tables[part].withColumns(named), args.output, table)


if __name__ == "__main__":
    main()
