"""Distances of many windows to one reference an entity: the reference is sorted once, and what is shuffled grows with the series, not with windows times history.

Reference rows are (entity_id, x), current rows (entity_id, window_id, x). A current value's rank in its entity's reference (how many values are below it, or
not above it, and their sum) comes from one ordered pass over both, dealt by cells between quantiles of the reference, so an entity is many tasks; values outside
the reference's range need no pass. Between two neighbouring values of a window its share is constant, so distances follow from ranks alone.
Null and NaN values take no part. Windows without values, or of an entity without reference, have distance 0 and their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 16


def _clean(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x"))


def _facts(reference: DataFrame) -> DataFrame:
    """One row an entity: size, sum, range, deviation, and the quantiles that part its cells."""
    steps = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    return _clean(reference).groupBy("entity_id").agg(
        F.count("*").alias("nr"), F.sum("x").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("sd"), F.percentile("x", steps).alias("cuts")
    )


def _celled(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their entity's facts and the cell between its quantiles."""
    return rows.join(facts, "entity_id").withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("x"))))


def _offsets(celled: DataFrame) -> DataFrame:
    """For each cell of a reference, size and sum of the cells before it (CELLS rows an entity)."""
    before = Window.partitionBy("entity_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy("entity_id", "cell").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    cells = cells.groupBy("entity_id").agg(F.collect_list(F.struct("cell", "n", "s")).alias("have")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    # cells without reference values are there as well, since current values may fall into them
    had = F.filter("have", lambda h: h["cell"] == F.col("cell"))
    cells = cells.select("entity_id", "cell", F.coalesce(F.get(had, F.lit(0))["n"], F.lit(0)).alias("n"), F.coalesce(F.get(had, F.lit(0))["s"], F.lit(0.0)).alias("s"))
    return cells.select("entity_id", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"))


def ranked(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Current rows with nr, total and sd of their reference, le and lt (its values not above, and below x) and ps (the sum of those not above)."""
    facts = _facts(reference)
    ref = _celled(_clean(reference).select("entity_id", "x"), facts).select("entity_id", "cell", "x")
    cur = _celled(_clean(current).select("entity_id", "window_id", "x"), facts)
    out = F.when(F.col("x") < F.col("lo"), F.struct(F.lit(0).cast("bigint").alias("le"), F.lit(0).cast("bigint").alias("lt"), F.lit(0.0).alias("ps")))
    out = out.when(F.col("x") > F.col("hi"), F.struct(F.col("nr").alias("le"), F.col("nr").alias("lt"), F.col("total").alias("ps")))
    cur = cur.withColumn("out", out)
    facts_of = ("entity_id", "window_id", "x", "nr", "total", "sd")
    outside = cur.where("out is not null").select(*facts_of, "out.*")
    none = F.lit(None)
    both = cur.where("out is null").select(*facts_of, "cell", F.lit(0).alias("r")).unionByName(
        ref.select("entity_id", none.cast("bigint").alias("window_id"), "x", none.cast("bigint").alias("nr"), none.cast("double").alias("total"), none.cast("double").alias("sd"), "cell", F.lit(1).alias("r"))
    )
    upto = Window.partitionBy("entity_id", "cell").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("entity_id", "cell", "x")
    both = both.withColumns({"le": F.sum("r").over(upto), "ps": F.sum(F.col("r") * F.col("x")).over(upto), "eq": F.sum("r").over(alike)}).where("r = 0")
    inside = both.join(_offsets(ref), ["entity_id", "cell"]).select(*facts_of, (F.col("le") + F.col("n0")).alias("le"), (F.col("le") + F.col("n0") - F.col("eq")).alias("lt"), (F.col("ps") + F.col("s0")).alias("ps"))
    return inside.unionByName(outside)


def _whole(found: DataFrame, reference: DataFrame, current: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """A row for each window, with sizes and defaults where nothing was found."""
    windows = current.groupBy("entity_id", "window_id").agg(F.count(F.nanvl("x", F.lit(None))).alias("cur_size"))
    sizes = _clean(reference).groupBy("entity_id").agg(F.count("*").alias("ref_size"))
    out = windows.join(found, ["entity_id", "window_id"], "left").join(sizes, "entity_id", "left").withColumn("ref_size", F.coalesce("ref_size", F.lit(0)))
    return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})


def ks(reference: DataFrame, current: DataFrame) -> DataFrame:
    """ks_d, ref_size and cur_size of each window."""
    own = Window.partitionBy("entity_id", "window_id")
    rows = ranked(reference, current).withColumns({
        "cle": F.count("*").over(own.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)), "clt": F.rank().over(own.orderBy("x")) - 1, "nc": F.count("*").over(own),
    })
    gap = lambda r, c: F.abs(F.col(r) / F.col("nr") - F.col(c) / F.col("nc"))
    found = rows.groupBy("entity_id", "window_id").agg(F.max(F.greatest(gap("le", "cle"), gap("lt", "clt"))).alias("ks_d"))
    return _whole(found, reference, current, {"ks_d": F.lit(0.0)}).select("entity_id", "window_id", "ks_d", "ref_size", "cur_size")


def wasserstein(reference: DataFrame, current: DataFrame) -> DataFrame:
    """w1 of each window, and w1 over the reference's deviation (its floor is 1e-10).

    With G(x) the integral of the reference's share up to x, an interval on which the window's share is c contributes |G(b) - G(a) - c (b - a)|, in two parts where the reference's share
    crosses c within it: at its k-th value, k = ceil(c n), which is joined by its rank.
    """
    own = Window.partitionBy("entity_id", "window_id")
    inner = own.orderBy("x", "le")
    rows = ranked(reference, current).withColumns({"cle": F.count("*").over(own.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)), "nc": F.count("*").over(own), "i": F.row_number().over(inner)})
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(inner) for c in ("x", "le", "ps")})
    rows = rows.withColumn("k", F.expr("(cle * nr + nc - 1) div nc"))
    ref = _celled(_clean(reference).select("entity_id", "x"), _facts(reference)).select("entity_id", "cell", "x")
    order = Window.partitionBy("entity_id", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = ref.withColumns({"k": F.row_number().over(Window.partitionBy("entity_id", "cell").orderBy("x")), "s": F.sum("x").over(order)}).join(_offsets(ref), ["entity_id", "cell"])
    places = places.select("entity_id", (F.col("k") + F.col("n0")).alias("k"), F.col("x").alias("t"), (F.col("s") + F.col("s0")).alias("t_ps"))
    rows = rows.join(places, ["entity_id", "k"])
    area = lambda n, x, s: (n * x - s) / F.col("nr")
    a, b, t, c = F.col("x"), F.col("next_x"), F.col("t"), F.col("cle") / F.col("nc")
    ga, gb, gt = area(F.col("le"), a, F.col("ps")), area(F.col("next_le"), b, F.col("next_ps")), area(F.col("k"), t, F.col("t_ps"))
    rising = gb - ga - c * (b - a)
    between = F.when(b.isNull(), F.lit(0.0)).when(t <= a, rising).when(t >= b, -rising).otherwise(c * (t - a) - (gt - ga) + (gb - gt) - c * (b - t))
    first = F.when(F.col("i") == 1, ga).otherwise(0.0)
    last = F.when(b.isNull(), (F.col("total") - F.col("ps") - (F.col("nr") - F.col("le")) * a) / F.col("nr")).otherwise(0.0)
    found = rows.groupBy("entity_id", "window_id").agg(F.sum(first + between + last).alias("w1"))
    sd = _clean(reference).groupBy("entity_id").agg(F.stddev_pop("x").alias("sd"))
    out = _whole(found, reference, current, {"w1": F.lit(0.0)}).join(sd, "entity_id", "left")
    return out.select("entity_id", "window_id", "w1", (F.col("w1") / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-10))).alias("w1_normalised"))


def psi(reference: DataFrame, current: DataFrame, buckets: int = 10) -> DataFrame:
    """Population stability index of each window over quantile bins of the reference, and its category; as drift.psi, whose bins are counted here once an entity."""
    steps = F.array(*[F.lit(k / buckets) for k in range(buckets + 1)])
    edges = _clean(reference).groupBy("entity_id").agg(F.percentile("x", steps).alias("q"))
    edges = edges.withColumn("q", F.concat(F.slice("q", 1, buckets), F.array(F.element_at("q", buckets + 1) + 1)))
    inside = lambda k: (F.col("x") >= F.col("q")[k]) & ((F.col("x") < F.col("q")[k + 1]) if k + 1 < buckets else (F.col("x") <= F.col("q")[k + 1]))

    def counts(rows: DataFrame, side: str, *by: str) -> DataFrame:
        return _clean(rows).join(edges, "entity_id").groupBy(*by).agg(F.count("*").alias(f"n_{side}"), *[F.count_if(inside(k)).alias(f"{side}{k}") for k in range(buckets)])

    both = counts(current, "cur", "entity_id", "window_id").join(counts(reference, "ref", "entity_id"), "entity_id")
    share = lambda s, k: F.when(F.col(f"{s}{k}") == 0, 1e-4).otherwise(F.try_divide(F.col(f"{s}{k}"), F.col(f"n_{s}")))
    total = sum((share("cur", k) - share("ref", k)) * F.log(share("cur", k) / share("ref", k)) for k in range(buckets))
    found = both.select("entity_id", "window_id", F.when((F.col("n_ref") < 2) | (F.col("n_cur") < 2), 0.0).otherwise(total).alias("psi"))
    category = F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.2, "moderate").otherwise("significant")
    return _whole(found, reference, current, {"psi": F.lit(0.0)}).select("entity_id", "window_id", "psi", category.alias("category"))
