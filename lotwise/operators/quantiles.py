"""Exact quantiles and quantile bins that never hold one group in one task.

``percentile`` keeps every distinct value of a group in one buffer, which fails
on a column with billions of values. Here a bounded sketch first brackets each
wanted rank; a second pass counts what lies below the bracket and keeps only the
values inside it, and the exact order statistics are read from those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Groups up to this size skip the bracket, so all of their values are kept.
SMALL_GROUP = 20_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
    accuracy: int = 20_000, bounded_keys: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles per group: ``keys, n, quantiles array``.

    About ``8 / accuracy`` of a group is kept per probability, already combined
    to distinct values before the shuffle. ``bounded_keys`` says that the keys
    are column names, so the bracket table is bounded by the schema and may be
    broadcast; otherwise the join is left to the optimizer, which also splits a
    hot key. A bracket that misses its rank fails the query instead of giving a
    wrong value.
    """
    if not keys:
        whole = exact_quantiles(
            df.select(F.lit(0).alias("__all"), value), ["__all"], value, probabilities, accuracy, True
        )
        return whole.drop("__all")
    keys = list(keys)
    slack = 4.0 / accuracy
    data = df.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    last = len(probabilities) - 1
    marks = [max(p - slack, 0.0) for p in probabilities] + [min(p + slack, 1.0) for p in probabilities]
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", marks, accuracy).alias("__marks"),
    )
    # One bracket per probability; an open end takes in everything on its side.
    def end(i: int, p: float, offset: int, open_at: float, infinity: str) -> Column:
        is_open = (F.col("__n") <= SMALL_GROUP) | F.lit(p == open_at)
        return F.when(is_open, F.lit(infinity).cast("double")).otherwise(
            F.col("__marks")[i + offset].cast("double")
        )

    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            end(i, p, 0, 0.0, "-Infinity").alias("lo"),
            end(i, p, last + 1, 1.0, "Infinity").alias("hi"),
        )
        for i, p in enumerate(probabilities)
    ])
    brackets_of = sketch.select(*keys, "__n", brackets.alias("__brackets"))
    rows = data.join(F.broadcast(brackets_of) if bounded_keys else brackets_of, keys)

    # Values below the bracket all fold into one NULL value before the shuffle.
    kept = (
        rows.select(*keys, "__n", "__v", F.inline("__brackets"))
        .filter(F.col("__v") <= F.col("hi"))
        .groupBy(*keys, "__n", "i", F.when(F.col("__v") >= F.col("lo"), F.col("__v")).alias("__v"))
        .agg(F.count("*").alias("__c"))
    )
    running = Window.partitionBy(*keys, "i").orderBy(F.col("__v").asc_nulls_first())
    rank = F.element_at(F.array(*map(F.lit, probabilities)), F.col("i") + 1) * (F.col("__n") - 1)
    ranked = kept.select(
        *keys, "__n", "i", "__v", rank.alias("__rank"), F.sum("__c").over(running).alias("__upto"),
    )

    def order_statistic(position: Column) -> Column:
        return F.min_by("__v", F.when(F.col("__upto") > position, F.col("__upto")))

    one = (
        ranked.groupBy(*keys, "__n", "i")
        .agg(
            F.first("__rank").alias("__rank"),
            order_statistic(F.floor("__rank")).alias("__low"),
            order_statistic(F.ceil("__rank")).alias("__high"),
        )
    )
    part = F.col("__rank") - F.floor("__rank")
    exact = F.col("__low") + (F.col("__high") - F.col("__low")) * part
    checked = F.when(exact.isNotNull(), exact).otherwise(
        F.raise_error(F.lit("quantile bracket missed its rank; raise the accuracy")).cast("double")
    )
    return one.groupBy(*keys, F.col("__n").alias("n")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", checked.alias("q")))), lambda s: s["q"]
        ).alias("quantiles")
    )


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
) -> DataFrame:
    """Exact quantiles of several columns: ``variable, n, quantiles``."""
    from lotwise.operators.reshape import to_long

    return exact_quantiles(
        to_long(df, columns), ["variable"], "value", probabilities, bounded_keys=True
    )


def quantile_bin(value: Column, edges: Column, bins: int) -> Column:
    """Right-closed bin number, the lowest edge included; edges are distinct.

    Equal edges must have been dropped before, so bins may be fewer than asked.
    """
    above = [
        F.when(value > F.get(edges, F.lit(i)), 1).otherwise(0) for i in range(1, bins)
    ]
    count = above[0]
    for a in above[1:]:
        count = count + a
    # the top edge never counts, however few edges are left
    return F.least(count, F.greatest(F.size(edges) - 2, F.lit(0)))
