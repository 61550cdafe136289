"""Counts, shares, exact distributed quantiles and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcheck.constants import PREFERRED_SHARE
from fieldcheck.functions.numbers import fmt_pct, is_finite, order_bin, r_round
from fieldcheck.functions.text import blank_to_null
from fieldcheck.operators.joins import small_side
from fieldcheck.operators.schema import quoted

FIVE_NUMBERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def preferred_n(n: str = "n", prop: str = "prop", threshold: float = PREFERRED_SHARE) -> Column:
    """Aggregate: rows in the buckets whose share reaches the threshold."""
    return F.sum(F.when(F.col(prop) >= threshold, F.col(n)).otherwise(0))


def max_prop(prop: str = "prop") -> Column:
    """Aggregate: largest share in percent."""
    return F.max(prop) * F.lit(100.0)


def preferred_list(
    buckets: DataFrame, keys: Sequence[str], bucket: str, label: Column,
    threshold: float = PREFERRED_SHARE,
) -> DataFrame:
    """Per group the preferred buckets in ascending order and their percents, ``-`` if none.

    A group has at most 21 buckets, so the collected lists are short.
    """
    chosen = F.when(F.col("prop") >= threshold, F.struct(
        F.col(bucket).alias("b"), label.alias("label"), fmt_pct("prop").alias("pct")
    ))
    lists = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(chosen)).alias("_list"))

    def joined(field: str) -> Column:
        text = F.array_join(F.transform("_list", lambda s: s[field]), ", ")
        return F.when(F.size("_list") == 0, F.lit("-")).otherwise(text)

    return lists.select(
        *keys, joined("label").alias("Preferred"), joined("pct").alias("Preferred_Prop")
    )


def distinct_nonmissing(
    df: DataFrame, variables: Sequence[str], variable: str = "Variable"
) -> DataFrame:
    """Exact number of different non-blank texts per variable.

    Long form: one shuffle on (variable, text) instead of one expansion per column.
    """
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias(variable), blank_to_null(quoted(v)).alias("text"))
        for v in variables
    ])))
    return (
        pairs.groupBy(variable, "text").agg(F.lit(1).alias("_one"))
        .groupBy(variable).agg(F.count("text").alias("distinct_n"))
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Finite values per group with their number of rows: the input of ``quantiles``.

    Counted before the shuffle, so a value that fills a third of all rows travels as one
    row per task.
    """
    return (
        df.filter(is_finite(F.col(value)))
        .groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )


#: Parts into which an order bin is cut, evenly between its lowest and its highest value.
CUTS = 4096


def cut_of(value: Column, low: Column, high: Column) -> Column:
    """Part of an order bin that the value lies in; it never decreases with the value."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.least(F.floor(share * CUTS), F.lit(CUTS - 1)), F.lit(0)).cast("bigint")


def bin_ranges(bins: DataFrame, keys: Sequence[str], order: Sequence[str] = ("_bin",)) -> DataFrame:
    """Ranks ``_from`` (included) to ``_to`` (not included) of every order bin of a group.

    ``bins`` has ``_bin`` and its number of rows ``_bin_n``. There are far fewer bins than
    rows, and their number is bounded whatever the data.
    """
    in_order = Window.partitionBy(*keys).orderBy(*order)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bins.withColumn("_to", F.sum("_bin_n").over(upto))
        .withColumn("_total", F.sum("_bin_n").over(Window.partitionBy(*keys)))
        .withColumn("_from", F.col("_to") - F.col("_bin_n"))
    )


def join_bins(
    rows: DataFrame, bins: DataFrame, keys: Sequence[str], max_rows: int | None = None,
    by: Sequence[str] = ("_bin",), take: Sequence[str] = ("_from", "_total"),
) -> DataFrame:
    """Rows with the columns ``take`` of their bin; NULL keys match NULL keys."""
    side = bins.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(b).alias(f"_k{b}") for b in by], *take)
    same = F.lit(True)
    for b in by:
        same = same & (F.col(b) == F.col(f"_k{b}"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    drop = [f"_k_{k}" for k in keys] + [f"_k{b}" for b in by]
    return rows.join(small_side(side, max_rows), same).drop(*drop)


#: A sketch cuts the values of a group into so many runs and one; a power of two less one.
PIVOTS = 255
#: Rank error of the sketch: below 1/ACCURACY of a group's different values.
ACCURACY = 10_000
#: Groups of fewer different values are one run.
FEW = 4 * PIVOTS


def run_of(value: str, pivots: str) -> Column:
    """How many of the ascending pivots the value reaches, by bisection; it never decreases with the value."""
    steps = ", ".join(str((PIVOTS + 1) >> i) for i in range(1, (PIVOTS + 1).bit_length()))
    return F.expr(f"aggregate(array({steps}), 0, (done, step) -> if(get({pivots}, done + step - 1) <= {value}, done + step, done))")


def sketched(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group ascending ``_pivots`` that cut its different values into even runs; none for few values."""
    # As a text: so many literals one by one would take longer than the sketch.
    shares = ", ".join(f"{i / (PIVOTS + 1)}D" for i in range(1, PIVOTS + 1))
    # Every value has rows; asking for them keeps the columns of `counts` as they are elsewhere.
    cuts = F.expr(f"percentile_approx(if(n > 0, value, NULL), array({shares}), {ACCURACY})")
    return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), cuts.alias("_pivots")).select(
        *keys, F.expr(f"if(_m > {FEW}, _pivots, CAST(array() AS array<double>))").alias("_pivots"))


def quantiles(
    counts: DataFrame, keys: Sequence[str], probs: Sequence[float] = FIVE_NUMBERS,
    names: Sequence[str] = ("q_min", "q1", "median", "q3", "q_max"),
    max_groups: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, linear interpolation between ranks.

    ``counts`` comes from ``value_counts``. No group is ever sorted as a whole: a mergeable sketch of a
    group's different values, one aggregate, gives pivots that cut them into even runs (a 256th each),
    wherever the values lie. The rows counted per run tell in which runs the wanted ranks are,
    and only the values of these are ranked. The sketch steers the work, the result is exact whatever its
    error. ``max_groups`` is the known bound of groups, if there is one.

    All uses of ``counts`` have the same columns and no filter of their own (the joins are
    null-safe for that reason), so Spark shuffles it once and reads the shuffle again. Besides it, only
    sketches, counts of runs and the values of the wanted runs are exchanged.
    """
    keys = list(keys)
    if not keys:
        return quantiles(counts.withColumn("_all", F.lit(0)), ["_all"], probs, names, 1).drop("_all")
    counts = counts.select(*keys, "value", "n")
    # Pivots weigh as much as so many rows of a small table.
    weight = None if max_groups is None else max_groups * PIVOTS
    cut = join_bins(counts, sketched(counts, keys), keys, weight, by=(), take=("_pivots",))
    binned = cut.select(*keys, "value", "n", run_of("value", "_pivots").alias("_bin"))
    bins = bin_ranges(binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_bin_n")), keys)

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    def low(p: float) -> Column:
        return F.floor(position(p))

    def high(p: float) -> Column:
        return F.least(low(p) + 1, F.col("_total") - 1)

    def holds(rank: Column, start: Column, end: Column) -> Column:
        return (rank >= start) & (rank < end)

    wanted = [r for p in probs for r in (low(p), high(p))]
    hit = F.lit(False)
    for rank in wanted:
        hit = hit | holds(rank, F.col("_from"), F.col("_to"))
    bound = None if max_groups is None else max_groups * len(wanted)
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        join_bins(binned, bins.filter(hit), keys, bound)
        .withColumn("_end", F.col("_from") + F.sum("n").over(in_bin))
        .withColumn("_start", F.col("_end") - F.col("n"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("_start"), F.col("_end")), F.col("value")))

    aggs = [F.max("_total").alias("_total")]
    for i, p in enumerate(probs):
        aggs += [at(low(p)).alias(f"_lo{i}"), at(high(p)).alias(f"_hi{i}")]
    found = ranked.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        share = position(p) - low(p).cast("double")
        out.append((lo + (hi - lo) * share).alias(name))
    return found.select(*out)


def quantiles_approx(
    df: DataFrame, keys: Sequence[str], value: str = "value",
    probs: Sequence[float] = FIVE_NUMBERS,
    names: Sequence[str] = ("q_min", "q1", "median", "q3", "q_max"), accuracy: int = 10_000,
) -> DataFrame:
    """One-pass quantiles by sketch, rank error below 1/accuracy, nearest value."""
    sketch = F.percentile_approx(F.col(value), list(map(float, probs)), F.lit(accuracy))
    found = (
        df.filter(is_finite(F.col(value)))
        .groupBy(*keys).agg(sketch.alias("_q"))
    )
    return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def basic_stats(
    counts: DataFrame, keys: Sequence[str], max_groups: int | None = None
) -> DataFrame:
    """Rows, mean, median, lowest, highest and range per group, from ``value_counts``."""
    keys = list(keys)
    sums = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
    )
    middle = quantiles(counts, keys, (0.5,), ("median",), max_groups)
    return sums.join(small_side(middle, max_groups), keys)


def null_counts(df: DataFrame, variables: Sequence[str], variable: str = "Variabel") -> DataFrame:
    """Rows, filled, empty, percent empty, lowest and highest value of numeric columns.

    One aggregate over the wide table, then turned into a row per variable.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, v in enumerate(variables):
        aggs += [F.count(quoted(v)).alias(f"c{i}"), F.min(quoted(v)).alias(f"lo{i}"),
                 F.max(quoted(v)).alias(f"hi{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(v).alias(variable), F.col("n"), F.col(f"c{i}").alias("n_nonNA"),
            (F.col("n") - F.col(f"c{i}")).alias("n_NA"),
            r_round((F.col("n") - F.col(f"c{i}")) / F.nullif(F.col("n"), F.lit(0)) * 100.0, 2)
            .alias("prop_NA"),
            F.col(f"lo{i}").cast("double").alias("min"), F.col(f"hi{i}").cast("double").alias("max"),
        )
        for i, v in enumerate(variables)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def ratio_total(
    labels: DataFrame, day: str = "Tanggal", num: str = "num", den: str = "den",
    skip_zero: bool = False,
) -> DataFrame:
    """Ratio of sums per day; ``skip_zero`` leaves out rows with nothing preferred."""
    if skip_zero:
        labels = labels.filter((F.col(num) > 0) & (F.col(den) > 0))
    sums = labels.groupBy(day).agg(F.sum(num).alias(num), F.sum(den).alias(den))
    return sums.withColumn(
        "pct", F.when(F.col(den) > 0, r_round(F.lit(100.0) * F.col(num) / F.col(den), 2))
    )


def mean_pct(daily: DataFrame, day: str = "Tanggal", pct: str = "Total_Preferred_Prop") -> DataFrame:
    """Mean of the percentages of a day."""
    return daily.groupBy(day).agg(F.avg(pct).alias("Average_Prop"))


def any_flag(flags: Sequence[str]) -> Column:
    """True if one of the flag columns is true; NULL counts as false."""
    return F.greatest(*[F.coalesce(quoted(f), F.lit(False)) for f in flags]) \
        if len(flags) > 1 else F.coalesce(quoted(flags[0]), F.lit(False))


def max_day(df: DataFrame, day: str = "day", known: DataFrame | None = None) -> DataFrame:
    """Last day in the cache: the high-water mark; from the ``known`` days (``day``) of ``df`` no row is read."""
    days = df.select(F.col(day).cast("date").alias("day")) if known is None else known
    return days.agg(F.max("day").alias("max_day"))


def max_file_time(
    df: DataFrame, keys: Sequence[str] = ("day", "file_name"), time: str = "file_ts_fallback"
) -> DataFrame:
    """Last time per key; NULL when the key has no time at all."""
    return df.groupBy(*keys).agg(F.max(time).alias(time))
