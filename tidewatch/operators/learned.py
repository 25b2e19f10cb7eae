"""Learned models over rolling windows, as two joins of Spark: fits, dealt to tasks by blocks of training windows, and forecasts from them.

A block is BLOCK consecutive positions of one entity's window starts; a task gets the rows that these windows span and fits, in order, only the windows
that serve some test window. A row is sent once a block that needs it (1 + history / BLOCK times on average), not once a window, and a long entity is many tasks. Fitted
models are rows (a pickled object of arrays); each meets its test rows in shares of SHARE windows. The number of jobs does not grow with windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Layout, test_rows

BLOCK, SHARE, SIDE = 2048, 64, 8
SCHEMA = "entity_id string, window_id bigint, h int, timestamp timestamp, y_true double, y_pred double"
#: make(x, y, origin) gives a learner of learners.py; origin is the position of the first row.
Make = Callable[[np.ndarray, np.ndarray, int], Any]


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column; a null component is a NaN."""
    return np.array([[np.nan if v is None else v for v in r] for r in column], float) if len(column) else np.empty((0, 0))


def fits(framed: DataFrame, at: Layout, served: DataFrame, make: Make, block: int = BLOCK) -> DataFrame:
    """entity_id, v_window and model of each training window that `served` (entity_id, window_id, v_window) names.

    framed: entity_id, pos, target and x, an array of features.
    """
    which = F.floor(F.col("v_window") * at.step / block).cast("bigint")
    wanted = served.select("entity_id", "v_window").distinct().withColumn("block", which)
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - (at.history + block) + 1) / block)).cast("bigint")
    rows = framed.select("entity_id", "pos", F.col("target").cast("double").alias("target"), "x").withColumn("block", F.explode(F.sequence(low, F.floor(F.col("pos") / block).cast("bigint"))))
    rows = rows.join(wanted.select("entity_id", "block").distinct(), ["entity_id", "block"], "left_semi")
    history, step = at.history, at.step

    def fold(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows, starts = rows.sort_values("pos"), sorted(wanted.v_window)
        origin = int(rows.pos.iloc[0]) if len(rows) else 0
        learner = make(matrix(rows.x), rows.target.to_numpy(float), origin)
        bounds = [(v * step - origin, v * step - origin + history) for v in starts]
        if hasattr(learner, "fit_all"):
            models = [m for i in range(0, len(bounds), SIDE) for m in learner.fit_all(bounds[i : i + SIDE])]
        else:
            models = [learner.fit(*b) for b in bounds]
        name = wanted.v_entity.iloc[0] if len(wanted) else None
        return pd.DataFrame({"entity_id": name, "v_window": starts, "model": [pickle.dumps(m) for m in models]})

    wanted = wanted.toDF("v_entity", "v_window", "v_block")  # names of their own, so that the sides of the cogroup can be told apart
    return rows.groupBy("entity_id", "block").cogroup(wanted.groupBy("v_entity", "v_block")).applyInPandas(fold, "entity_id string, v_window bigint, model binary")


def forecasts(framed: DataFrame, at: Layout, served: DataFrame, fitted: DataFrame) -> DataFrame:
    """entity_id, window_id, h, timestamp, y_true and y_pred of each test row, from the model of the window that serves it."""
    served = served.select("entity_id", "window_id", "v_window", F.floor(F.col("window_id") / SHARE).alias("share"))
    rows = test_rows(framed, at, "x").join(served, ["entity_id", "window_id"])
    models = fitted.join(served.select("entity_id", "v_window", "share").distinct(), ["entity_id", "v_window"])

    def fold(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = rows[["entity_id", "window_id", "h", "timestamp", "y_true"]].copy()
        out["y_pred"] = pickle.loads(models.model.iloc[0]).predict(matrix(rows.x)) if len(rows) and len(models) else np.nan
        return out

    models = models.select(F.col("entity_id").alias("m_entity"), F.col("v_window").alias("m_window"), F.col("share").alias("m_share"), "model")
    return rows.groupBy("entity_id", "v_window", "share").cogroup(models.groupBy("m_entity", "m_window", "m_share")).applyInPandas(fold, SCHEMA)
