"""Histograms with aligned bins, automatic bin width, top bins and window comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fieldcheck.constants import BIN_PADDING
from fieldcheck.functions.numbers import number_of, parse_first_number, r_round, round2
from fieldcheck.operators.aggregates import quantiles, value_counts
from fieldcheck.operators.joins import small_side, with_rules
from fieldcheck.operators.ranking import shared_max, top_bins
from fieldcheck.operators.schema import Parser, at_stage, dtypes_of, quoted

# A value this close below a break belongs to the bin above it, as a share of the width.
_FUZZ = 1e-7
# Bins of a stretch.
_BLOCK = 65_536

HISTOGRAM_SCHEMA = T.StructType([
    T.StructField("Variable", T.StringType()), T.StructField("bin", T.LongType()),
    T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType()),
    T.StructField("count", T.LongType()), T.StructField("percent", T.DoubleType()),
    T.StructField("N", T.LongType()), T.StructField("median", T.DoubleType()),
    T.StructField("mean", T.DoubleType()), T.StructField("binwidth", T.DoubleType()),
])


def numbers_long(
    df: DataFrame, variables: Sequence[str], parser: Parser = parse_first_number,
    period: str | None = None,
) -> DataFrame:
    """``Variable, value`` (and the period column) of the variables."""
    types = dtypes_of(df)
    cells = F.array(*[
        F.struct(F.lit(v).alias("Variable"), number_of(quoted(v), types[v], parser).alias("value"))
        for v in variables
    ])
    # No alias where the name is right: it would set this use of the source apart from copies of it.
    keep = [] if not period else [F.col("period") if period == "period" else quoted(period).alias("period")]
    return df.select(*keep, F.inline(cells))


def _iqr_width(n: Column, q1: Column, q3: Column, low: Column, high: Column) -> Column:
    width = F.lit(2.0) * (q3 - q1) / F.pow(n.cast("double"), F.lit(1.0 / 3.0))
    spread = (high - low) / F.lit(30.0)
    return (
        F.when((n >= 2) & (width > 0), width)
        .when((n >= 2) & (spread > 0), spread).otherwise(F.lit(1.0))
    )


def auto_binwidth(counts: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Bin width per variable: 2·IQR/n^(1/3), else a thirtieth of the range, else 1."""
    sums = counts.groupBy("Variable").agg(F.sum("n").alias("n"))
    stats = quantiles(counts, ["Variable"], max_groups=max_groups)
    stats = stats.join(small_side(sums, max_groups), "Variable")
    width = _iqr_width(F.col("n"), F.col("q1"), F.col("q3"), F.col("q_min"), F.col("q_max"))
    return stats.select("Variable", width.alias("binwidth"))


def limits(
    counts: DataFrame, variables: Sequence[str], clamp: str = "data",
    probs: tuple[float, float] = (0.01, 0.99), rules: DataFrame | None = None,
) -> DataFrame:
    """Padded display window per variable: the data's extremes, two quantiles or the rule."""
    # Every value has rows; asking for them keeps the columns of `counts` as they are in
    # its other uses, which then all read one shuffle.
    counted = F.when(F.col("n") > 0, F.col("value"))
    ends = counts.groupBy("Variable").agg(F.min(counted).alias("lo"), F.max(counted).alias("hi"))
    if clamp == "quantile":
        lo, hi = sorted(min(max(p, 0.0), 1.0) for p in probs)
        ends = quantiles(counts, ["Variable"], (lo, hi), ("lo", "hi"), len(variables))
    elif clamp == "rules" and rules is not None:
        ruled = F.col("min_ok").isNotNull() & F.col("max_ok").isNotNull()
        ends = with_rules(ends, rules, "Variable", variables).select(
            "Variable",
            F.when(ruled, F.col("min_ok")).otherwise(F.col("lo")).alias("lo"),
            F.when(ruled, F.col("max_ok")).otherwise(F.col("hi")).alias("hi"),
        )
    elif clamp not in ("data", "rules"):
        raise ValueError(f"unknown clamp {clamp}")
    pad = (F.col("hi") - F.col("lo")) * BIN_PADDING
    return ends.select(
        "Variable", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def _grid(
    ends: DataFrame, counts: DataFrame, binwidth: float | None, groups: int
) -> DataFrame:
    """Per variable: window, width, first break and number of bins."""
    if binwidth is not None and binwidth > 0:
        grid = ends.withColumn("binwidth", F.lit(float(binwidth)))
    else:
        grid = ends.join(auto_binwidth(counts, groups), "Variable")
    w = F.col("binwidth")
    first, last = F.floor(F.col("lo") / w), F.ceil(F.col("hi") / w)
    return grid.withColumns({"first": first, "bins": last - first + 1})


def _runs(
    counts: DataFrame, keys: Sequence[str], variables: Sequence[str], binwidth: float | None,
    clamp: str, probs: tuple[float, float], rules: DataFrame | None,
) -> DataFrame:
    """Filled bins, and runs of empty ones between and around them, of every group.

    One far value can extend a histogram over billions of bins: they are one run. There are at most
    twice as many runs as filled bins and one more. Gaps are found within stretches of bins, which
    are spread over tasks, and between the ends of the stretches.
    """
    keys = list(keys)
    ends = limits(counts, variables, clamp, probs, rules)
    # One row per variable.
    grid = small_side(_grid(ends, counts, binwidth, len(variables)), len(variables))
    w, x = F.col("binwidth"), F.col("value")
    start = F.col("first") * w
    shown = counts.join(grid, "Variable").filter(x.between(F.col("lo"), F.col("hi")))
    index = F.floor((x - start) / w + F.lit(_FUZZ))
    index = F.least(F.greatest(index, F.lit(0)), F.col("bins") - 1)
    filled = shown.groupBy(*keys, index.alias("bin")).agg(
        F.sum("n").alias("count"), F.sum(x * F.col("n")).alias("_sum"), F.max("bins").alias("bins"))
    # Both uses of the filled bins ask for all columns, so that one shuffle serves them.
    count = F.when((F.col("bins") > 0) & F.col("_sum").isNotNull(), F.col("count"))
    sums = filled.groupBy(*keys).agg(
        F.sum(count).alias("N"), (F.sum("_sum") / F.sum(count)).alias("mean"))
    # Groups are the variables, times two when windows are compared.
    bound = len(variables) * (2 if len(keys) > 1 else 1)
    middle = quantiles(shown.select(*keys, "value", "n"), keys, (0.5,), ("median",), bound)
    groups = small_side(sums.join(small_side(middle, bound), keys).join(grid, "Variable"), bound)

    def run(first: Column, last: Column, count: Column | int) -> Column:
        return F.struct(first.alias("bin"), last.alias("last_bin"), F.lit(count).cast("bigint").alias("count"))

    def present(*runs: Column) -> Column:
        return F.inline(F.filter(F.array(*runs), lambda r: r["bin"] <= r["last_bin"]))

    at = F.col("bin")
    stretch = filled.select(*keys, "bin", count.alias("count"), "bins", F.floor(at / _BLOCK).alias("_stretch"))
    following = F.lead("bin").over(Window.partitionBy(*keys, "_stretch").orderBy("bin"))
    inside = stretch.withColumn("_next", following).select(
        *keys, present(run(at, at, F.col("count")), run(at + 1, F.coalesce("_next", at) - 1, 0)))
    held = F.when(F.col("count") > 0, at)
    edges = stretch.groupBy(*keys, "_stretch").agg(
        F.min(held).alias("_low"), F.max(held).alias("_high"), F.max("bins").alias("bins"))
    in_order = Window.partitionBy(*keys).orderBy("_stretch")
    edges = edges.withColumns({"_next": F.lead("_low").over(in_order), "_first": F.row_number().over(in_order) == 1})
    between = edges.select(*keys, present(
        run(F.when(F.col("_first"), F.lit(0).cast("bigint")).otherwise(F.col("_low")), F.col("_low") - 1, 0),
        run(F.col("_high") + 1, F.coalesce("_next", "bins") - 1, 0)))
    return inside.unionByName(between).join(groups, keys).select(
        *keys, "bin", "last_bin", "count", "N", "median", "mean", "binwidth", "first")


def _shown_bins(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges, percents and rounded statistics of runs or bins."""
    w = F.col("binwidth")
    return runs.select(
        *keys, "bin", "last_bin", ((F.col("first") + F.col("bin")) * w).alias("left"),
        ((F.col("first") + F.col("last_bin") + 1) * w).alias("right"), "count",
        (F.lit(100.0) * F.col("count") / F.col("N")).alias("percent"),
        "N", round2("median").alias("median"), round2("mean").alias("mean"), "binwidth",
    )


def _binned(counts: DataFrame, keys: Sequence[str], *how) -> DataFrame:
    """All bins of every group, empty ones too: ``_runs`` with long runs cut, dealt out and expanded."""
    runs = _runs(counts, keys, *how)
    pieces = _upto(runs, F.ceil((F.col("last_bin") - F.col("bin") + 1) / _BLOCK), "_piece", 0)
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_from", F.col("bin") + F.col("_piece") * _BLOCK).repartition(tasks, *keys, "_from")
    bins = _upto(pieces, F.col("last_bin") + 1, "_bin", F.col("_from"), _BLOCK)
    one = bins.withColumns({"bin": F.col("_bin"), "last_bin": F.col("_bin")})
    return _shown_bins(one, keys).drop("last_bin").withColumn("right", F.col("left") + F.col("binwidth"))


def _upto(df: DataFrame, end: Column, name: str, start: Column | int, most: int | None = None) -> DataFrame:
    """A row for each number from ``start`` below ``end``, ``most`` of them at the highest."""
    start = F.lit(start).cast("bigint")
    last = end.cast("bigint") - 1
    if most is not None:
        last = F.least(last, start + (most - 1))
    return df.withColumn(name, F.explode(F.sequence(start, last)))


def histogram(
    df: DataFrame, variables: Sequence[str], binwidth: float | None = None,
    clamp: str = "data", probs: tuple[float, float] = (0.01, 0.99),
    rules: DataFrame | None = None, parser: Parser = parse_first_number, stage: str = "raw",
) -> DataFrame:
    """Bins of each variable, left-closed, breaks at multiples of the bin width.

    Without a positive ``binwidth`` it is chosen per variable. Values are counted once per
    different value; window, bins, median and mean all come from those counts. With
    ``stage="clipped"`` values outside ``rules`` are left out. Absent variables give no rows.
    """
    variables = [v for v in variables if v in df.columns]
    if not variables:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
    df = at_stage(df, stage, rules)
    counts = value_counts(numbers_long(df, variables, parser), ["Variable"])
    return _binned(counts, ["Variable"], variables, binwidth, clamp, probs, rules)


def histogram_runs(
    df: DataFrame, variables: Sequence[str], binwidth: float | None = None,
    clamp: str = "data", probs: tuple[float, float] = (0.01, 0.99),
    rules: DataFrame | None = None, parser: Parser = parse_first_number, stage: str = "raw",
) -> DataFrame:
    """``histogram`` with each run of empty bins as one row, from ``bin`` to ``last_bin``.

    Its rows are bounded by the different values, however far these lie apart. ``top_bins`` takes it
    as it is.
    """
    variables = [v for v in variables if v in df.columns]
    if not variables:
        fields = HISTOGRAM_SCHEMA.fields
        at = [f.name for f in fields].index("bin") + 1
        return df.sparkSession.createDataFrame([], T.StructType([*fields[:at], T.StructField("last_bin", T.LongType()), *fields[at:]]))
    df = at_stage(df, stage, rules)
    counts = value_counts(numbers_long(df, variables, parser), ["Variable"])
    return _shown_bins(_runs(counts, ["Variable"], variables, binwidth, clamp, probs, rules), ["Variable"])


def histogram_compare(
    current: DataFrame, previous: DataFrame, variable: str, binwidth: float = 1.0,
    clamp: str = "data", probs: tuple[float, float] = (0.01, 0.99),
    rules: DataFrame | None = None, parser: Parser = parse_first_number, stage: str = "raw",
) -> DataFrame:
    """Histograms of two windows on the same bins, with the fullest bin of both."""
    if variable not in current.columns or variable not in previous.columns:
        return _no_periods(current)
    keep = [quoted(variable)]
    both = current.select(*keep, F.lit("Current").alias("period")).unionByName(
        previous.select(*keep, F.lit("Previous").alias("period")))
    return histogram_periods(both, variable, binwidth, clamp, probs, rules, parser, stage)


def histogram_periods(
    df: DataFrame, variable: str, binwidth: float = 1.0, clamp: str = "data",
    probs: tuple[float, float] = (0.01, 0.99), rules: DataFrame | None = None,
    parser: Parser = parse_first_number, stage: str = "raw", period: str = "period",
) -> DataFrame:
    """``histogram_compare`` of one table with a period column, such as a ``range_pair`` scope: one scan."""
    if variable not in df.columns:
        return _no_periods(df)
    df = at_stage(df, stage, rules)
    counts = value_counts(numbers_long(df, [variable], parser, period), ["period", "Variable"])
    width = binwidth if binwidth and binwidth > 0 else 1.0
    bins = _binned(counts, ["period", "Variable"], [variable], width, clamp, probs, rules)
    return shared_max(bins)


def _no_periods(df: DataFrame) -> DataFrame:
    fields = [T.StructField("period", T.StringType()), *HISTOGRAM_SCHEMA.fields]
    return shared_max(df.sparkSession.createDataFrame([], T.StructType(fields)))


def top_bins_report(
    hist: DataFrame, n: int, digits: int = 1, keys: Sequence[str] = ("Variable",)
) -> DataFrame:
    """The fullest bins with a text such as ``2: 3 (50.0%)``, or ``2–4`` for wider bins."""
    top = top_bins(hist, n, keys)
    lo, hi = (F.format_string("%.0f", r_round(c, 0)) for c in ("left", "right"))
    name = F.when(F.abs(F.col("binwidth") - 1) < 1e-9, lo).otherwise(F.concat(lo, F.lit("–"), hi))
    percent = F.format_string(f"%.{digits}f", r_round("percent", digits))
    text = F.concat(name, F.lit(": "), F.col("count"), F.lit(" ("), percent, F.lit("%)"))
    return top.select(*keys, "rank", "left", "right", "count", "percent", text.alias("text"))


def period_label(day: str = "day") -> Column:
    """Aggregate: first and last day as text, one day when they are the same, NULL without."""
    d = F.col(day).cast("date")
    first, last = F.date_format(F.min(d), "yyyy-MM-dd"), F.date_format(F.max(d), "yyyy-MM-dd")
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(" – "), last))


def facility_label(column: str = "puskesmas_name") -> Column:
    """Aggregate: the only facility, or ``Multiple``; NULL without any.

    The lowest and the highest name tell; nothing distinct is collected.
    """
    lowest, highest = F.min(quoted(column)), F.max(quoted(column))
    return F.when(lowest == highest, lowest).when(lowest.isNotNull(), F.lit("Multiple"))
