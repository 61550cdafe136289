"""Tables that a refresh keeps next to the visits, so that reports need not scan them.

All three are partial aggregates of the rows that a run added: maxima, counts and sketches, which merge by
maximum, sum and union. A refresh adds the parts of its new rows and never reads the old ones, also for
days that were reloaded. Their rows are bounded by days, facilities, files and variables.

| table | row | content |
|---|---|---|
| ``files`` | facility, day, file | last time of the file, visits |
| ``heaping`` | facility, day, file, variable, slot | values in the slot (21 slots at most) |
| ``distinct`` | facility, day, variable | sketch of the different non-blank texts |
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from fieldcheck.constants import CLINICAL_VARS
from fieldcheck.functions.text import blank_to_null
from fieldcheck.functions.times import usable_file_time
from fieldcheck.operators.ranking import latest_file_per_day
from fieldcheck.operators.schema import apply_schema, quoted
from fieldcheck.plans.heaping import BY_DAY, heaping_long, heaping_of, slot_counts
from fieldcheck.sources.versions import Version, VersionedTables

FILES, HEAPING, DISTINCT = "files", "heaping", "distinct"
FILE_KEYS = ("PKM_norm", "day", "file_name")
#: Columns whose different texts are sketched.
SKETCHED = ("diagnosa_1", "umur_tahun", "nik_hash", "phone_hash", "dokter_pseudo", "staff_pseudo", "file_name")
#: Size of a sketch (2^k registers): the standard error is about 1.04 / sqrt(2^k), 1.6 % for 12.
SKETCH_K = 12


def file_index(visits: DataFrame) -> DataFrame:
    """Last time and number of visits of every file of a facility and day."""
    timed = visits.withColumn("file_ts_fallback", usable_file_time("file_ts", "tanggal_ts"))
    return timed.groupBy(*FILE_KEYS).agg(
        F.max("file_ts_fallback").alias("file_ts_fallback"), F.count(F.lit(1)).alias("visits"))


def heaping_parts(visits: DataFrame, variables: Sequence[str] = CLINICAL_VARS) -> DataFrame:
    """Values per slot of every file of a facility and day."""
    named = apply_schema(visits).withColumn("Tanggal", F.col("day"))
    long = heaping_long(named, variables, ids=FILE_KEYS)
    return slot_counts(long, [*FILE_KEYS, "Variabel"])


def distinct_parts(visits: DataFrame, columns: Sequence[str] = SKETCHED) -> DataFrame:
    """Sketches of the different texts of every facility, day and column."""
    pairs = visits.select("PKM_norm", "day", F.inline(F.array(*[
        F.struct(F.lit(c).alias("Variable"), blank_to_null(quoted(c)).alias("text")) for c in columns if c in visits.columns])))
    return pairs.filter("text IS NOT NULL").groupBy("PKM_norm", "day", "Variable").agg(
        F.hll_sketch_agg("text", SKETCH_K).alias("sketch"))


#: What a refresh keeps: table and how its part comes from the visits that were added.
SUMMARIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    FILES: file_index, HEAPING: heaping_parts, DISTINCT: distinct_parts,
}


class Summaries:
    """The summary tables of one version of a refreshed cache."""

    def __init__(self, store: VersionedTables, version: Version | None = None):
        self.store, self.version = store, version or store.version()

    def _read(self, table: str, days: Iterable[dt.date] | None, facility: str | None) -> DataFrame:
        found = self.store.read(table, days, self.version)
        if found is None:
            raise ValueError(f"the cache keeps no table {table}")
        return found if facility is None else found.filter(F.col("PKM_norm") == facility)

    def files(self, days: Iterable[dt.date] | None = None, facility: str | None = None) -> DataFrame:
        """The file index: the operators that choose files and days take it in place of visits.

        ``facility`` is a normalized name (``PKM_norm``).
        """
        return self._read(FILES, days, facility).groupBy(*FILE_KEYS).agg(
            F.max("file_ts_fallback").alias("file_ts_fallback"), F.sum("visits").alias("visits"))

    def latest_files(self, start: dt.date, end: dt.date, group: Sequence[str] = ()) -> DataFrame:
        """``latest_file_per_day`` from the index."""
        days = [d for d in self.version.days(FILES) if start <= d <= end]
        return latest_file_per_day(self.files(days), start, end, group)

    def slots(self, days: Iterable[dt.date] | None = None, facility: str | None = None, files: DataFrame | None = None) -> DataFrame:
        """Slot counts per day and variable, of some files (``day, file_name``) only if given."""
        found = self._read(HEAPING, days, facility)
        if files is not None:
            found = found.join(files.select("day", "file_name"), ["day", "file_name"], "left_semi")
        return found.groupBy(F.col("day").alias("Tanggal"), "Variabel", "slot").agg(F.sum("n").alias("n"))

    def heaping_daily(self, **chosen) -> DataFrame:
        """``heaping.heaping_daily`` from the counts."""
        return heaping_of(self.slots(**chosen), BY_DAY).drop("Int_pref_n")

    def heaping_window(self, **chosen) -> DataFrame:
        """``heaping.heaping_window`` from the counts."""
        slots = self.slots(**chosen).groupBy("Variabel", "slot").agg(F.sum("n").alias("n"))
        return heaping_of(slots, ("Variabel",)).drop("Int_pref_n")

    def distinct(self, days: Iterable[dt.date] | None = None, facility: str | None = None) -> DataFrame:
        """``Variable, distinct_n``: estimated different texts over the days, a union of their sketches."""
        return self._read(DISTINCT, days, facility).groupBy("Variable").agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_n"))
