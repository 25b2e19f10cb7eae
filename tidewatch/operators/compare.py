"""Drift-detection metrics and statistical comparison of models, strategies and detectors."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

# ---- drift detection; truth and detections are tables with key columns and step ---------------------------------------------


def detection_delay(truth: DataFrame, found: DataFrame, *by: str, step_hours: float = 1.0) -> DataFrame:
    """For each key: true drifts, those with a detection at or after them, and mean and maximum delay in steps and hours.

    The first detection at or after a drift is found in one ordered pass over both tables together, not by a range join.
    """
    both = truth.select(*by, "step", F.lit(True).alias("t")).unionByName(found.select(*by, "step", F.lit(False).alias("t")))
    # in reverse order, so that the frame only grows
    w = Window.partitionBy(*by).orderBy(F.desc("step")).rangeBetween(Window.unboundedPreceding, 0)
    first = both.withColumn("next", F.min(F.when(~F.col("t"), F.col("step"))).over(w)).where("t")
    delay = F.col("next") - F.col("step")
    out = first.groupBy(*by).agg(F.count("*").alias("n_true"), F.count("next").alias("n_detected"), F.avg(delay).alias("mean_delay_steps"), F.max(delay).cast("double").alias("max_delay_steps"))
    return out.withColumns({"mean_delay_hours": F.col("mean_delay_steps") * step_hours, "max_delay_hours": F.col("max_delay_steps") * step_hours})


def false_positives(truth: DataFrame, found: DataFrame, total: int, *by: str, window: int = 10) -> DataFrame:
    """Detections that no true drift is within `window` steps of: their number and rate, and the rate of detected drifts."""
    span = F.explode(F.array(F.floor(F.col("step") / window) - 1, F.floor(F.col("step") / window), F.floor(F.col("step") / window) + 1)).alias("cell")
    near = truth.select(*[F.col(k).alias(f"t_{k}") for k in by], F.col("step").alias("t_step"), span)
    cells = found.select(*by, "step", F.floor(F.col("step") / window).alias("cell"))
    on = [cells[k] == near[f"t_{k}"] for k in by] + [cells["cell"] == near["cell"], F.abs(cells["step"] - near["t_step"]) <= window]
    false = cells.join(near, on, "left_anti").groupBy(*by).agg(F.count("*").alias("false_positives"))
    n_found, n_true = found.groupBy(*by).agg(F.count("*").alias("detected")), truth.groupBy(*by).agg(F.count("*").alias("n_true"))
    if by:
        joined = n_true.join(n_found, list(by), "left").join(false, list(by), "left")
    else:
        joined = n_true.join(n_found).join(false)  # one row each
    fp, n = F.coalesce("false_positives", F.lit(0)), F.coalesce("detected", F.lit(0))
    return joined.select(*by, fp.alias("false_positives"), (fp / total).alias("false_positive_rate"), F.try_divide(n - fp, F.col("n_true")).alias("detection_rate"))


def recovery_time(errors: DataFrame, drift_step: Column, baseline: Column, *by: str, tolerance: float = 1.1) -> DataFrame:
    """Steps from the first row at or after the drift to the first error within `tolerance` of the baseline."""
    after = errors.where(F.col("step") >= drift_step)
    return after.groupBy(*by).agg((F.min(F.when(F.col("error") <= baseline * tolerance, F.col("step"))) - F.min("step")).alias("recovery_steps"))


def degradation(errors: DataFrame, baseline: Column, *by: str) -> DataFrame:
    """Area (trapezoids of unit width), maximum and mean of the error above the baseline."""
    w = Window.partitionBy(*by).orderBy("step")
    d = errors.withColumn("d", F.greatest(F.lit(0.0), F.col("error") - baseline)).withColumn("n", F.lead("d").over(w))
    return d.groupBy(*by).agg(F.coalesce(F.sum((F.col("d") + F.col("n")) / 2), F.lit(0.0)).alias("area"), F.max("d").alias("max_degradation"), F.avg("d").alias("mean_degradation"))


def correlations(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson and Spearman (average ranks) correlation."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
    return pairs.withColumns({"__x": rank(x), "__y": rank(y)}).groupBy(*by).agg(F.corr(x, y).alias("pearson"), F.corr("__x", "__y").alias("spearman"))


def drift_benchmark(errors: DataFrame, truth: DataFrame, found: DataFrame, total: int, *by: str, window: int = 10) -> DataFrame:
    """Delay, false positives, recovery and degradation of each key; the baseline is the mean error before the first true drift."""
    first = truth.groupBy(*by).agg(F.min("step").alias("__t"))
    marked = errors.join(first, list(by))
    base = marked.where("step < __t").groupBy(*by).agg(F.avg("error").alias("__b"))
    marked = marked.join(base, list(by))
    parts = [
        detection_delay(truth, found, *by), false_positives(truth, found, total, *by, window=window),
        recovery_time(marked, F.col("__t"), F.col("__b"), *by), degradation(marked.where("step >= __t"), F.col("__b"), *by),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by), "left")
    return out


# ---- tests on paired losses --------------------------------------------------------------------------------------------------


def loss(kind: str, y: Column, p: Column) -> Column:
    e = F.abs(y - p)
    return {"MAE": e, "MSE": e * e, "MAPE": F.try_divide(e, F.abs(y))}[kind.upper()]


def diebold_mariano(pairs: DataFrame, *by: str, h: int = 1, kind: str = "MAE") -> DataFrame:
    """Statistic of the loss difference of two forecasts, with columns idx, y_true, p1, p2: null where its variance is not positive."""
    d = loss(kind, F.col("y_true"), F.col("p1")) - loss(kind, F.col("y_true"), F.col("p2"))
    w = Window.partitionBy(*by).orderBy("idx")
    rows = pairs.withColumn("d", d).withColumns({f"l{k}": F.lag("d", k).over(w) for k in range(1, h)})
    agg = [F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("v"), *[F.covar_samp("d", f"l{k}").alias(f"c{k}") for k in range(1, h)]]
    s = rows.groupBy(*by).agg(*agg)
    var = (F.col("v") + 2 * sum((F.coalesce(F.col(f"c{k}"), F.lit(0.0)) for k in range(1, h)), F.lit(0.0))) / F.col("n")
    return s.select(*by, "n", "mean_diff", F.when(var > 0, F.col("mean_diff") / F.sqrt(var)).alias("statistic"))


def with_normal_p(df: DataFrame, statistic: str = "statistic") -> DataFrame:
    """Two-sided p of a standard normal statistic, and whether it is under 5 %."""

    return df.withColumn("p_value", stats.normal_p(F.col(statistic))).withColumn("significant", F.col("p_value") < 0.05)


def _signed_ranks(pairs: DataFrame, *by: str) -> DataFrame:
    """n (differences other than 0), w_plus, w_minus and ties (the sum of t^3 - t over groups of t equal absolute differences) of column d."""
    rows = pairs.where(F.col("d").isNotNull() & (F.col("d") != 0)).withColumn("a", F.abs("d"))
    t = F.count("*").over(Window.partitionBy(*by, "a"))
    r = F.rank().over(Window.partitionBy(*by).orderBy("a")) + (t - 1) / 2.0
    return rows.withColumn("r", r).withColumn("t", t).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).alias("ties")
    )


def wilcoxon(pairs: DataFrame, *by: str) -> DataFrame:
    """n (differences other than 0), w_plus, w_minus and statistic of the signed-rank test on column d; no statistic under 10 differences."""
    return _signed_ranks(pairs, *by).drop("ties").withColumn("statistic", F.when(F.col("n") >= 10, F.least("w_plus", "w_minus")))


def wilcoxon_test(pairs: DataFrame, *by: str, exact_upto: int = 50) -> DataFrame:
    """n, statistic and two-sided p_value of each key, whether the p is `exact`, and whether it is under 5 %.

    Exact by counting subsets of ranks up to `exact_upto` untied differences; else the normal approximation, its variance less the ties'. Under 10
    differences there is neither statistic nor p.
    """
    s = _signed_ranks(pairs, *by).withColumn("statistic", F.when(F.col("n") >= 10, F.least("w_plus", "w_minus")))
    n, exact = F.col("n"), (F.col("ties") == 0) & (F.col("n") <= exact_upto)
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(sd > 0, (F.col("statistic") - n * (n + 1) / 4) / sd)
    # the exact fold is asked for small n only: elsewhere it runs over no ranks
    p = F.when(exact, stats.signed_rank_p(F.when(exact, F.col("statistic")), F.when(exact, n))).otherwise(stats.normal_p(z))
    s = s.withColumn("exact", exact & F.col("statistic").isNotNull()).withColumn("p_value", F.when(F.col("statistic").isNotNull(), p))
    return s.select(*by, "n", "statistic", "exact", "p_value", (F.col("p_value") < 0.05).alias("significant"))


#: Distinct differences in a block, and blocks in a group of blocks.
BLOCK, GROUP = 2048, 512


def bootstrap(pairs: DataFrame, n: int = 1000, seed: int = 42, centred: bool = True, *by: str, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """mean_diff of column d, percentile interval and two-sided p from n seeded resamples, each of exactly as many differences as the key has.

    Equal differences are one row with their number. How often a resample takes each of them is multinomial, and drawn from the top down: first how many of its draws fall
    into each group of blocks, then into each block of a group, then onto each difference of a block, by generators seeded by the key, the group and the
    block. So a key is many tasks, a task holds a block's differences and n counts, and what is shuffled between the steps is n numbers a block.
    Null and NaN differences take no part; a key without any has no row.
    """
    keys = list(by)
    by_key = [F.col(k) for k in keys] or [F.lit("all").alias("all")]
    rows = pairs.where(F.col("d").isNotNull() & ~F.isnan("d")).select(*by_key, F.col("d").cast("double").alias("d"))
    names = keys or ["all"]
    values = rows.groupBy(*names, "d").agg(F.count("*").alias("c"))
    totals = values.groupBy(*names).agg(F.count("*").alias("__distinct"), F.sum(F.col("c") * F.col("d")).alias("__sum"), F.sum("c").alias("__n"))
    cells = F.ceil(F.col("__distinct") / block).cast("bigint")
    values = values.join(totals.select(*names, cells.alias("__cells")), names)
    place = F.pmod(F.xxhash64("d"), F.col("__cells"))
    values = values.select(*names, "d", "c", place.alias("block"), F.floor(place / group).cast("bigint").alias("group"))
    kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in names)

    def rng(*which: object) -> np.random.Generator:
        return np.random.default_rng([seed, *[zlib.crc32(repr(w).encode()) for w in which]])

    def split(parts: str):
        """Deals the draws of a parent (column draws; at the top, as many as there are differences) to its parts by their sizes."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(parts)
            size = pdf["size"].to_numpy(float)
            draws = np.full(n, int(size.sum())) if parts == "group" else np.array(pdf.draws.iloc[0], np.int64)
            key = [pdf[k].iloc[0] for k in names] + ([] if parts == "group" else [pdf.group.iloc[0]])
            dealt = rng(parts, *key).multinomial(draws, size / size.sum())
            return pdf[[*names, "group", *([] if parts == "group" else ["block"])]].assign(draws=list(dealt.T))

        return one

    def sums(values: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("d")
        c, d = values.c.to_numpy(float), values.d.to_numpy(float)
        counts = rng("value", *[values[k].iloc[0] for k in names], values.block.iloc[0]).multinomial(np.array(dealt.draws.iloc[0], np.int64), c / c.sum())
        out = pd.DataFrame({"r": np.arange(n), "total": counts @ d})
        return out.assign(**{k: values[k].iloc[0] for k in names})[[*names, "r", "total"]]

    sizes = values.groupBy(*names, "group", "block").agg(F.sum("c").alias("size"))
    tops = sizes.groupBy(*names, "group").agg(F.sum("size").alias("size")).groupBy(*names).applyInPandas(split("group"), f"{kinds}, group bigint, draws array<bigint>")
    dealt = sizes.join(tops, [*names, "group"]).groupBy(*names, "group").applyInPandas(split("block"), f"{kinds}, group bigint, block bigint, draws array<bigint>")
    dealt = dealt.toDF(*[f"__{c}" for c in dealt.columns])
    drawn = values.groupBy(*names, "block").cogroup(dealt.groupBy(*[f"__{k}" for k in names], "__block")).applyInPandas(lambda v, w: sums(v, w.rename(columns={"__draws": "draws"})), f"{kinds}, r int, total double")
    means = drawn.groupBy(*names, "r").agg(F.sum("total").alias("total")).join(totals, names)
    mean = F.col("__sum") / F.col("__n")
    away = F.col("total") / F.col("__n") - (mean if centred else F.lit(0.0))
    quantiles = F.percentile(F.col("total") / F.col("__n"), F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*names).agg(F.first(mean).alias("mean_diff"), quantiles.alias("q"), F.avg((F.abs(away) >= F.abs(mean)).cast("double")).alias("p_value"))
    return out.select(*keys, "mean_diff", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "p_value")


def pairwise(losses: DataFrame) -> DataFrame:
    """Of rows (model, idx, loss): each pair of models with the difference of mean losses, its DM statistic and the winner."""
    a, b = losses.alias("a"), losses.alias("b")
    d = a.join(b, (F.col("a.idx") == F.col("b.idx")) & (F.col("a.model") < F.col("b.model"))).select(
        F.col("a.model").alias("model1"), F.col("b.model").alias("model2"), F.col("a.idx").alias("idx"), (F.col("a.loss") - F.col("b.loss")).alias("d")
    )
    s = d.groupBy("model1", "model2").agg(F.avg("d").alias("mean_diff"), F.var_samp("d").alias("v"), F.count("d").alias("n"))
    stat = F.when(F.col("v") > 0, F.col("mean_diff") / F.sqrt(F.col("v") / F.col("n")))
    winner = F.when(F.col("mean_diff") < 0, F.col("model1")).when(F.col("mean_diff") > 0, F.col("model2")).otherwise("tie")
    return s.select("model1", "model2", "mean_diff", stat.alias("statistic"), winner.alias("winner"))


def wins(pairs: DataFrame) -> DataFrame:
    return pairs.where("winner <> 'tie'").groupBy("winner").agg(F.count("*").alias("wins"))


def rank_strategies(runs: DataFrame) -> DataFrame:
    """Competition ranks of strategies by MAE in each dataset and model, and whether they are best."""
    r = F.rank().over(Window.partitionBy("dataset", "model").orderBy("mae"))
    return runs.select("dataset", "model", "strategy", "mae", r.alias("rank")).withColumn("best", F.col("rank") == 1)


def rank_detectors(scores: DataFrame) -> DataFrame:
    """Of rows (detector, detection_rate, false_positive_rate, mean_delay): ranks by each, and their mean. Scores are one row a detector."""
    place = lambda *c: F.row_number().over(Window.orderBy(*c))
    out = scores.select("detector", place(F.desc("detection_rate"), "detector").alias("rate_rank"), place("false_positive_rate", "detector").alias("fpr_rank"), place("mean_delay", "detector").alias("delay_rank"))
    mean = (F.col("rate_rank") + F.col("fpr_rank") + F.col("delay_rank")) / 3.0
    return out.withColumn("mean_rank", mean)


