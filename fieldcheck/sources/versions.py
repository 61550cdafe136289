"""Tables by day that change as a whole: data is staged first and becomes visible by one small manifest.

    <path>/_versions/<number>.json                  one manifest for each version, the highest one counts
    <path>/<table>/run=<id>/day=<date>/part-*       Parquet files, never changed once written

A manifest names the (table, run, day) folders that make up a version, the ledger of fetched days, the
schema of each table and the last micro-batch of each stream. A writer stages its rows in a run folder of
its own, which no reader sees, and then creates the next manifest. Creating fails if that number exists
already, so of two writers that started from one version one wins and the other gets ``Conflict`` and can
look again. A writer that dies at any point leaves the last version as it was. Manifests hold a line for
each day and run, never anything that grows with the rows.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

VISITS = "visits"
#: How Spark names the folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
#: Tasks, and so files, of one day where Spark does not adapt their number.
DAY_TASKS = 8


class Conflict(Exception):
    """Another writer published a version in between."""


@dataclass(frozen=True)
class Part:
    """Rows of one day (None: rows without a day) that one run wrote."""

    table: str
    run: str
    day: dt.date | None
    rows: int

    @property
    def folder(self) -> str:
        return f"{self.table}/run={self.run}/day={self.day.isoformat() if self.day else NO_DAY}"


@dataclass(frozen=True)
class Fetched:
    """When a day was last fetched, how many rows it holds, and from which version of the source."""

    at: dt.datetime
    rows: int
    source: str


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    fetched: Mapping[dt.date, Fetched] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    batches: Mapping[str, int] = field(default_factory=dict)

    def of(self, table: str, days: Iterable[dt.date] | None = None) -> list[Part]:
        wanted = None if days is None else set(days)
        return [p for p in self.parts if p.table == table and (wanted is None or p.day in wanted)]

    def days(self, table: str = VISITS) -> list[dt.date]:
        """Days with rows, ascending: known from the manifest, no folder is listed."""
        return sorted({p.day for p in self.of(table) if p.day})

    def text(self) -> str:
        head = {"version": self.number, "schemas": dict(self.schemas), "batches": dict(self.batches)}
        lines = [head, *({"table": p.table, "run": p.run, "day": p.day and p.day.isoformat(), "rows": p.rows} for p in self.parts)]
        lines += [{"fetched": d.isoformat(), "at": f.at.isoformat(), "rows": f.rows, "source": f.source}
                  for d, f in sorted(self.fetched.items())]
        return "".join(json.dumps(line) + "\n" for line in lines)

    @classmethod
    def parse(cls, text: str) -> Version:
        head, *lines = map(json.loads, text.splitlines())
        parts = tuple(Part(x["table"], x["run"], x["day"] and dt.date.fromisoformat(x["day"]), x["rows"]) for x in lines if "table" in x)
        fetched = {dt.date.fromisoformat(x["fetched"]): Fetched(dt.datetime.fromisoformat(x["at"]), x["rows"], x["source"])
                   for x in lines if "fetched" in x}
        return cls(head["version"], parts, fetched, head["schemas"], head["batches"])


def by_day(df: DataFrame, day: str = "day") -> DataFrame:
    """Rows of a day together for writing, big days split and small ones merged.

    Rebalancing is adaptive: a day that holds a third of all rows becomes many tasks. Without adaptive
    execution, as in a stream with state, the hint counts for nothing and every task would write a file for
    every day; there each day goes to ``DAY_TASKS`` tasks.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled").lower() == "true":
        return df.hint("rebalance", day)
    return df.repartition(day, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(DAY_TASKS)))


class VersionedTables:
    """The tables below a path, read and published by version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file("").getFileSystem(self._conf)

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._file(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # --- manifests ------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, by default the last one; an empty one before the first."""
        if number is None:
            number = (self.numbers() or [0])[-1]
        if not number:
            return Version()
        stream = self._fs.open(self._file(f"_versions/{number:020d}.json"))
        try:
            return Version.parse(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _create(self, new: Version) -> None:
        """The manifest of ``new``, written aside and moved to a name that must be free."""
        own = self._file(f"_versions/.{uuid.uuid4().hex}.tmp")
        free = self._file(f"_versions/{new.number:020d}.json")
        stream = self._fs.create(own, True)
        try:
            stream.write(bytearray(new.text().encode()))
        finally:
            stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(own.toUri().getPath(), free.toUri().getPath())  # fails if the name is taken, as one step
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(own, free, none)
        except FileExistsError as e:
            raise Conflict(str(free)) from e
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(str(free)) from e
            raise
        finally:
            self._fs.delete(own, False)

    # --- reading --------------------------------------------------------------------------

    def read(self, table: str = VISITS, days: Iterable[dt.date] | None = None, version: Version | None = None) -> DataFrame | None:
        """The rows of a version, of ``days`` only if given; None if the table was never published.

        Folders come from the manifest, so other days are not even listed, and no footer is read for
        the schema.
        """
        version = version or self.version()
        if table not in version.schemas:
            return None
        schema = T.StructType.fromJson(json.loads(version.schemas[table]))
        return self.rows_of(version.of(table, days), table, schema)

    def rows_of(self, parts: Sequence[Part], table: str, schema: T.StructType) -> DataFrame:
        """The rows of some parts of a table, published or just staged."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        paths = [f"{self.path}/{p.folder}" for p in parts]
        found = self.spark.read.schema(full).option("basePath", f"{self.path}/{table}").parquet(*paths)
        return found.select(*(F.col(f"`{n}`") for n in schema.names))

    def day_rows(self, table: str = VISITS, version: Version | None = None) -> DataFrame:
        """``day, rows``: the days of a version and their rows, ascending; rows without a day have no line.

        All of it is in the manifest: no folder is listed and no data file is opened. The operators that
        ask for days only (``max_day``, ``available_days``, ``resolve_day``, ``latest_date_only``,
        ``scope_frame``) take it as ``known``. A line for each day, never more. Empty where the table was
        never published.
        """
        rows: dict[dt.date, int] = {}
        for p in (version or self.version()).of(table):
            if p.day and p.rows:
                rows[p.day] = rows.get(p.day, 0) + p.rows
        return self.spark.createDataFrame(sorted(rows.items()), "day date, rows bigint")

    # --- writing --------------------------------------------------------------------------

    def stage(self, df: DataFrame, run: str, table: str = VISITS) -> list[Part]:
        """Writes rows to a folder of their own; they stay unseen until ``publish`` names them."""
        folder = f"{self.path}/{table}/run={run}"
        by_day(df).write.partitionBy("day").mode("errorifexists").parquet(folder)
        names = [n[4:] for n in self._names(f"{table}/run={run}") if n.startswith("day=")]
        parts = [Part(table, run, None if n == NO_DAY else dt.date.fromisoformat(n), 0) for n in names]
        # The number of rows is in the files' footers.
        counts = self.rows_of(parts, table, df.schema).groupBy("day").count().collect()
        return [Part(table, run, r["day"], r["count"]) for r in counts]

    def publish(
        self, base: Version, added: Sequence[Part], schemas: Mapping[str, T.StructType],
        fetched: Mapping[dt.date, Fetched] | None = None, batches: Mapping[str, int] | None = None,
        dropped: Iterable[Part] = (),
    ) -> Version:
        """The next version: ``base`` without ``dropped`` and with ``added``. All of it becomes visible, or nothing."""
        gone = set(dropped)
        kept = tuple(p for p in base.parts if p not in gone)
        new = Version(
            base.number + 1, kept + tuple(added), {**base.fetched, **(fetched or {})},
            {**base.schemas, **{t: s.json() for t, s in schemas.items()}}, {**base.batches, **(batches or {})})
        self._create(new)
        return new

    def discard(self, run: str) -> None:
        """Deletes what a run has staged and not published."""
        for table in self._names(""):
            if not table.startswith(("_", ".")):
                self._fs.delete(self._file(f"{table}/run={run}"), True)

    def vacuum(self, keep: int = 2, older_than: dt.timedelta = dt.timedelta(days=1)) -> list[str]:
        """Deletes old manifests but the last ``keep``, and run folders that none of these names.

        Folders younger than ``older_than`` stay, since a writer may be about to publish them.
        """
        numbers = self.numbers()
        last = [self.version(n) for n in numbers[-keep:]]
        named = {(p.table, p.run) for v in last for p in v.parts}
        before = (dt.datetime.now(dt.timezone.utc) - older_than).timestamp() * 1000
        gone = []
        for table in self._names(""):
            if table.startswith(("_", ".")):
                continue
            for status in self._fs.listStatus(self._file(table)):
                name = status.getPath().getName()
                if name.startswith("run=") and (table, name[4:]) not in named and status.getModificationTime() < before:
                    self._fs.delete(status.getPath(), True)
                    gone.append(f"{table}/{name}")
        for n in numbers[:-keep]:
            self._fs.delete(self._file(f"_versions/{n:020d}.json"), False)
        return gone


def new_run() -> str:
    return f"r{uuid.uuid4().hex[:16]}"


def replace_days(df: DataFrame, path: str, table: str = VISITS, attempts: int = 10) -> Version:
    """Publishes distinct rows; the days in ``df`` take the place of the same days, other days stay."""
    store, run = VersionedTables(df.sparkSession, path), new_run()
    added = store.stage(df.dropDuplicates(), run, table)
    days = {p.day for p in added}
    for _ in range(attempts):
        base = store.version()
        try:
            # Whatever another writer published since, these days are replaced as a whole.
            return store.publish(base, added, {table: df.schema}, dropped=base.of(table, days))
        except Conflict:
            continue
    raise Conflict(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``day, fetched_at, rows, source``: one row for each day that was ever asked for, empty days too."""
    rows = [(d, f.at, f.rows, f.source) for d, f in VersionedTables(spark, path).version().fetched.items()]
    return spark.createDataFrame(rows, "day date, fetched_at timestamp, rows bigint, source string")
