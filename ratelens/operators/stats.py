"""Exact grouped statistics that survive a group of any size.

``median()`` keeps every distinct value of a group in one task's memory. Here one
hotel may hold a third of all rows, so the exact median is selected in two steps
that never bring a group together:

1. count equal values per (group, value): a map-side combined shuffle on the value
   as well as the group, so a hot group spreads over all tasks;
2. add the counts up per (group, bucket of the value), at most some thirty thousand
   rows per group, and find the bucket that holds the middle rank;
3. only the values inside that bucket are ordered, and the middle one or two read.

Count, mean, min and max come out of the same pass. Inputs of all sizes go this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Buckets per unit of log1p(|v|): about 0.05% wide, some 30,000 up to two million.
RESOLUTION = 2048


def _bucket(v: Column) -> Column:
    # Monotone in v; log1p is semi-monotone, so equal values share a bucket and
    # order between buckets is the order of values.
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(float(RESOLUTION)))


def count_cube(df: DataFrame, keys: list[str], values: dict[str, str | Column]) -> DataFrame:
    """How often each value occurs in each group: (keys, measure number, value, count),
    with rows for ``values`` in their order. Counts add up, so the statistics of any
    coarser grouping follow from the cube alone (``cube_stats``). Nulls and NaN are
    ignored."""
    cols = [F.col(v) if isinstance(v, str) else v for v in values.values()]
    if len(cols) == 1:
        flat = df.select(*keys, F.lit(0).alias("_m"), cols[0].cast("double").alias("_v"))
    else:
        pairs = [F.struct(F.lit(i).alias("m"), c.cast("double").alias("v")) for i, c in enumerate(cols)]
        flat = df.select(*keys, F.explode(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())).alias("_p")).select(
            *keys, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v")
        )
    flat = flat.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return flat.groupBy(*keys, "_m", "_v").agg(F.count("*").alias("_c"))


def by_grains(cube: DataFrame, grains: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """The cube once for each grain, marked by a column ``grain``; of ``keys``, those that
    a grain does not list are null in it. One pass over the cube serves all grains, and
    counts that become alike are added up."""
    shapes = [
        F.struct(F.lit(g).alias("grain"), *[(F.col(k) if k in own else F.lit(None).cast(cube.schema[k].dataType)).alias(k) for k in keys])
        for g, own in grains.items()
    ]
    rest = [c for c in cube.columns if c not in keys]
    flat = cube.select(*rest, F.explode(F.array(*shapes)).alias("_g")).select("_g.*", *rest)
    return flat.groupBy(*[c for c in flat.columns if c != "_c"]).agg(F.sum("_c").alias("_c"))


def grouped_stats(df: DataFrame, keys: list[str], values: dict[str, str | Column], extra: bool = True) -> DataFrame:
    """Per group and named value: ``<name>_n``, ``<name>_mean``, ``<name>_median``,
    ``<name>_min``, ``<name>_max`` (only the median and count unless ``extra``).

    Null values are ignored. Groups in which every value is null do not appear."""
    return cube_stats(count_cube(df, keys, values), keys, list(values), extra)


def cube_stats(cube: DataFrame, keys: list[str], names: list[str], extra: bool = True) -> DataFrame:
    """``grouped_stats`` from a cube, grouped by some of its keys. ``names`` are its
    measures in order. With ``extra`` there is also ``<name>_distinct``, the number of
    different values. Where ``keys`` are fewer than the cube's, counts are added up first."""
    gm = [*keys, "_m"]
    if set(cube.columns) != {*gm, "_v", "_c"}:
        cube = cube.groupBy(*gm, "_v").agg(F.sum("_c").alias("_c"))
    counts = cube.withColumn("_b", _bucket(F.col("_v")))

    coarse = counts.groupBy(*gm, "_b").agg(
        F.sum("_c").alias("_bn"),
        F.count("*").alias("_bd"),
        F.sum(F.col("_v") * F.col("_c")).alias("_bs"),
        F.min("_v").alias("_bmin"),
        F.max("_v").alias("_bmax"),
    )
    whole = Window.partitionBy(*gm)
    ranked = coarse.withColumns(
        {
            "_upto": F.sum("_bn").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.sum("_bn").over(whole),
            "_d": F.sum("_bd").over(whole),
            "_s": F.sum("_bs").over(whole),
            "_min": F.min("_bmin").over(whole),
            "_max": F.max("_bmax").over(whole),
        }
    )
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = (F.col("_upto") >= lo) & (F.col("_upto") - F.col("_bn") < hi)
    targets = ranked.where(holds).select(
        *[F.col(k).alias(f"_t{i}") for i, k in enumerate(gm)],
        F.col("_b").alias("_tb"),
        (F.col("_upto") - F.col("_bn")).alias("_before"),
        "_n", "_d", "_s", "_min", "_max",
    )
    # Null-safe throughout, so that no filter is inferred and both readers of the
    # counts share one shuffle.
    match = F.col("_b").eqNullSafe(F.col("_tb"))
    for i, k in enumerate(gm):
        match = match & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    inside = counts.join(targets, match).select(*gm, "_b", "_v", "_c", "_before", "_n", "_d", "_s", "_min", "_max")
    # What is left is a sliver of each group; one shuffle on the keys serves both the
    # ordering below and the final aggregate.
    inside = inside.repartition(*keys)
    run = F.col("_before") + F.sum("_c").over(
        Window.partitionBy(*gm, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    picked = inside.withColumn("_run", run).withColumns(
        {
            "_lo": F.when((F.col("_run") >= lo) & (F.col("_run") - F.col("_c") < lo), F.col("_v")),
            "_hi": F.when((F.col("_run") >= hi) & (F.col("_run") - F.col("_c") < hi), F.col("_v")),
        }
    )
    aggs = []
    for i, name in enumerate(names):
        mine = F.col("_m") == i

        def only(c):
            return F.max(F.when(mine, F.col(c)))

        aggs.append(only("_n").alias(f"{name}_n"))
        aggs.append(((only("_lo") + only("_hi")) / 2).alias(f"{name}_median"))
        if extra:
            aggs += [
                (only("_s") / only("_n")).alias(f"{name}_mean"),
                only("_min").alias(f"{name}_min"),
                only("_max").alias(f"{name}_max"),
                only("_d").alias(f"{name}_distinct"),
            ]
    return picked.groupBy(*keys).agg(*aggs)


def grouped_medians(df: DataFrame, keys: list[str], values: dict[str, str | Column]) -> DataFrame:
    """The exact median of each named value per group, named as given."""
    out = grouped_stats(df, keys, values, extra=False)
    return out.select(*keys, *[F.col(f"{n}_median").alias(n) for n in values])


def beside(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row results side by side. Each other row is a scalar subquery, so a
    result that is not one row fails instead of multiplying rows."""
    for i, other in enumerate(others):
        row = other.select(F.struct("*").alias("row")).scalar()
        base = base.withColumn(f"_row{i}", row)
        base = base.select(*[c for c in base.columns if c != f"_row{i}"], f"_row{i}.*")
    return base
