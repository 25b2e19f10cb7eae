"""Forecast models: a registry, baselines by position joins, and learned ones over shared features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import adaptive, features, learned, learners
from .rolling import Layout, predictions, test_rows, version, windows

CALENDAR = ("hour", "day_of_week", "month", "hour_sin", "hour_cos")
TREE_CALENDAR = ("hour", "day_of_week", "day_of_month", "month", "is_weekend")


def feature_frame(series: DataFrame, n_lags: int = 3, rolling: tuple[int, ...] = (3,), strict: bool = True, m: int = 24, calendar: tuple[str, ...] = CALENDAR) -> tuple[DataFrame, list[str]]:
    """The series with calendar, lag, rolling and seasonal features, and their names."""
    times = {k: v for k, v in features.time_columns().items() if k in calendar}

    def columns(by: Sequence[str]) -> dict[str, Column]:
        roll = {k: v for k, v in features.rolling_columns(rolling, by=by, strict=strict).items() if "_mean_" in k or "_std_" in k}
        return features.lag_columns(range(1, n_lags + 1), by=by) | roll | {"seasonal_diff": features.seasonal_columns(m, by=by)["seasonal_diff"]}

    framed = features.in_blocks(series, max(n_lags, m, *rolling), columns)
    return framed.withColumns(times), [*times, *columns(("entity_id",))]


def _served(series: DataFrame, at: Layout, policy: str, every: int, decided: DataFrame | None = None) -> DataFrame:
    """entity_id, window_id and the window v_window whose history serves it; adaptive_retrain takes them from a loop (by default, of naive forecasts)."""
    if policy == "adaptive_retrain":
        return (decided if decided is not None else adaptive.loop(series, at)).select("entity_id", "window_id", "v_window")
    return windows(series, at).select("entity_id", "window_id", version(policy, F.col("window_id"), every).alias("v_window"))


def baseline(series: DataFrame, at: Layout, model: str, policy: str = "each", every: int = 10, decided: DataFrame | None = None, **params) -> DataFrame:
    """Forecasts of a baseline; adaptive_retrain follows the decisions of its own loop, or those given."""
    if policy != "adaptive_retrain":
        return predictions(series, at, model, policy, every, **params)
    m = {"m": params["m"]} if "m" in params else {}
    decided = decided if decided is not None else adaptive.loop(series, at, model, scope=params.get("scope", "entity"), **m)
    return adaptive.predictions(series, at, decided, model, **m)


def prepared(series: DataFrame, name: str, **params) -> tuple[DataFrame, learned.Make]:
    """The series with a learned model's features as an array x, and what makes its learner. Features are those of the whole series, so a test row's lags are observed values.

    ridge_features: n_lags (24), alpha. rf and lgbm: n_lags (3), n_estimators, max_depth, seed. lstm: steps (24), hidden, layers, dropout, rate, epochs, batch, seed.
    Sizes are the published ones unless params give others: 100 trees of depth 10; 100 rounds of depth 5 and 31 leaves; two layers of 32 cells, 30 epochs.
    """
    params = dict(params)
    if name == "ridge_features":
        framed, names = feature_frame(series, params.pop("n_lags", 24), (3, 6, 12, 24))
        make = partial(_ridge, **params)
    elif name in ("rf", "lgbm"):
        framed, names = feature_frame(series, params.pop("n_lags", 3), (3,) if name == "rf" else (3, 7), strict=name != "rf", calendar=TREE_CALENDAR)
        make = partial(_trees, **({"kind": "rf"} if name == "rf" else {"kind": "gbt", "max_depth": 5}) | params)
    elif name == "lstm":
        steps = params.pop("steps", 24)
        lags = range(steps, 0, -1)
        framed, names, make = features.in_blocks(series, steps, lambda by: features.lag_columns(lags, by=by)), [f"lag_{k}" for k in lags], partial(_recurrent, **params)
    else:
        raise ValueError(f"{name} does not learn")
    return framed.select(*series.columns, F.array(*[F.col(n).cast("double") for n in names]).alias("x")), make


def _ridge(x, y, origin, **params):
    return learners.RollingRidge(x, y, **params)


def _trees(x, y, origin, **params):
    return learners.TreeLearner(x, y, origin=origin, **params)


def _recurrent(x, y, origin, **params):
    return learners.RecurrentLearner(x, y, **params)


def learnt(series: DataFrame, at: Layout, name: str, policy: str, every: int = 10, decided: DataFrame | None = None, **params) -> DataFrame:
    """One-step forecasts of a learned model: entity_id, window_id, h, timestamp, y_true, y_pred.

    An entity's window is fitted on its own rows, as it is served by them. adaptive_retrain takes the model's own loop (default rules), or a given one: with
    its forecasts if it is this model's, else with fits where it says.
    """
    framed, make = prepared(series, name, **params)
    if policy == "adaptive_retrain" and decided is None:
        decided = adaptive.loop(framed, at, make=make)
    if policy == "adaptive_retrain" and "y_pred" in decided.columns:
        return adaptive.predictions(series, at, decided).drop("step")
    served = _served(series, at, policy, every, decided)
    return learned.forecasts(framed, at, served, learned.fits(framed, at, served, make))


def trees(series: DataFrame, at: Layout, kind: str = "rf", policy: str = "no_retrain", every: int = 10, decided: DataFrame | None = None, **params: int) -> DataFrame:
    """One-step forecasts of a random forest (rf) or boosted trees (gbt); a training window is a task's work, whatever the policy."""
    return learnt(series, at, "rf" if kind == "rf" else "lgbm", policy, every, decided, **params)


MODELS: dict[str, Callable[..., DataFrame]] = {}
#: Models whose fit takes a seed; forecasts of the others are the same for every seed.
SEEDED = ("rf", "lgbm", "lstm")
LEARNED = ("ridge_features", "rf", "lgbm", "lstm")
ALIASES = {"tsmixer": "ridge_features", "tsmixer_legacy": "ridge_features", "seasonal": "seasonal_naive"}


def register_model(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MODELS[name] = f
        return f

    return add


for _name in ("naive", "seasonal_naive"):
    register_model(_name)(lambda series, at, policy="each", every=10, _name=_name, **kw: baseline(series, at, _name, policy, every, **kw))
for _name in ("ridge_features", "lstm"):
    register_model(_name)(lambda series, at, policy="each" if _name == "ridge_features" else "no_retrain", every=10, _name=_name, **kw: learnt(series, at, _name, policy, every, **kw))
register_model("rf")(lambda series, at, policy="no_retrain", every=10, **kw: trees(series, at, "rf", policy, every, **kw))
register_model("lgbm")(lambda series, at, policy="no_retrain", every=10, **kw: trees(series, at, "gbt", policy, every, **kw))


def resolve(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def is_model_available(name: str) -> bool:
    return resolve(name) in MODELS


def get_model(name: str) -> Callable[..., DataFrame]:
    if not is_model_available(name):
        raise ValueError(f"unknown model {name!r}; there are {', '.join(available_models())}")
    return MODELS[resolve(name)]


def available_models() -> list[str]:
    return sorted(MODELS)


def model_info(name: str) -> dict[str, object]:
    return {"name": resolve(name), "available": is_model_available(name), "learned": resolve(name) in LEARNED, "fallback": None}
