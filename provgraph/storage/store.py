"""A table in bucketed, sorted files with committed generations.

Layout of a store's folder:

* `rows/part=<attempt>/`: Parquet files, one a bucket, sorted by the key. An attempt writes a folder of its own and never
  touches another's.
* `generations/<number>.json`: the manifest of a generation: for each bucket the attempt whose file holds it, and what the writer
  says of it. Manifests are created whole and never overwritten: that is the compare-and-set, so of two writers from one base the
  second is refused, and its files belong to nothing.

A generation is read through a table definition over `rows` that has the buckets, so Spark knows how rows are dealt: a join
or a grouping by the key needs no exchange of the stored side. A commit replaces the buckets that it touches; the others keep
their files. Readers pin a manifest, and see its rows whatever is committed later, until `vacuum` drops the generation.

Rows of a replaced bucket are skipped by a filter on (part, bucket); their files are read until `vacuum` removes the attempts that no
kept generation names, so a store that is written often should be vacuumed, or compacted (`commit` of all buckets).
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


class StaleGeneration(Exception):
    """Another writer has committed from the same base."""


@dataclass(frozen=True)
class Generation:
    number: int
    parts: list[str | None]
    info: dict = field(default_factory=dict)


_defining = threading.Lock()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A session setting for a moment; one thread at a time."""
    with _defining:
        old = spark.conf.get(key, None)
        spark.conf.set(key, value)
        try:
            yield
        finally:
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)


class Store:
    """root: a shared folder; schema: column definitions; key: the column that rows are dealt by."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    # manifests

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.root}/generations") if n.endswith(".json")]

    def _manifest(self, number: int) -> str:
        return f"{self.root}/generations/{number:012d}.json"

    def generation(self, number: int | None = None) -> Generation:
        """A generation, by default the newest; number 0, without rows, where nothing is committed."""
        if number is None:
            number = max(self._numbers(), default=0)
        if number == 0:
            return Generation(0, [None] * self.buckets)
        m = files.read_json(self.spark, self._manifest(number))
        return Generation(number, m["parts"], m["info"])

    # rows

    @contextmanager
    def _table(self, location: str, partitioned: bool):
        """A table definition over files that are there, for as long as a plan is made of it."""
        name = f"store_{uuid.uuid4().hex}"
        columns, by = (f"{self.schema}, part string", "PARTITIONED BY (part)") if partitioned else (self.schema, "")
        with _setting(self.spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet {by} CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{location}'"
            )
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the definition; the files stay

    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a key, as Spark deals them."""
        return F.pmod(F.hash(F.col(self.key) if key is None else key), F.lit(self.buckets))

    def read(self, generation: Generation) -> DataFrame:
        """The rows of a generation; the plan knows that they are dealt by the key."""
        live = sorted({p for p in generation.parts if p})
        if not live:
            return self.spark.createDataFrame([], self.schema)
        with self._table(f"{self.root}/rows", True) as name:
            t = self.spark.table(name)
        newest = F.element_at(F.array(*[F.lit(p) for p in generation.parts]), self.bucket() + 1)
        return t.filter(F.col("part").isin(live) & (F.col("part") == newest)).drop("part")

    def commit(self, base: Generation, stay: DataFrame | None, come: DataFrame | None, touched: list[int] | None = None, info: dict | None = None) -> Generation:
        """The generation after base: stay and come hold all rows of the touched buckets (by default all buckets).

        stay: rows read from the store, or joined with it by the key; they lie in their buckets and are written as they lie. come: rows from elsewhere,
        dealt to their buckets first. Raises StaleGeneration, and leaves nothing, if another writer has made that generation.
        """
        touched = list(range(self.buckets)) if touched is None else touched
        part = uuid.uuid4().hex
        rows = [r for r in (stay, come.repartition(self.buckets, self.key) if come is not None else None) if r is not None]
        if touched and rows:
            with self._table(f"{self.root}/rows/part={part}", False) as name:
                order = self.spark.table(name).columns
                every = reduce(DataFrame.unionAll, [r.select(*order) for r in rows])
                (every.filter(self.bucket().isin(touched)) if len(touched) < self.buckets else every).write.insertInto(name)
        parts = list(base.parts)
        for b in touched:
            parts[b] = part
        made = Generation(base.number + 1, parts, info or {})
        try:
            files.create_json(self.spark, self._manifest(made.number), {"parts": parts, "info": made.info})
        except files.Exists:
            files.delete(self.spark, f"{self.root}/rows/part={part}")
            raise StaleGeneration(f"generation {made.number} of {self.root} is taken") from None
        return made

    def vacuum(self, keep: int) -> list[str]:
        """Drops the generations before number keep, and the attempts that only they name. Readers pinned to them must be done."""
        old = [n for n in self._numbers() if n < keep]
        needed = {p for n in self._numbers() if n >= keep for p in self.generation(n).parts}
        gone = sorted({p for n in old for p in self.generation(n).parts if p} - needed)
        for p in gone:
            files.delete(self.spark, f"{self.root}/rows/part={p}")
        for n in old:
            files.delete(self.spark, self._manifest(n))
        return gone
