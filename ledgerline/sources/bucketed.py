"""Large keyed tables that merges do not shuffle: catalog tables in buckets of their keys.

A table is a row of versions <name>_v<number>, each bucketed and sorted by the
keys, and a view <name> of the last.  A merge joins the version that is there,
as it lies, with the incoming rows, which alone are dealt to its buckets; every
task merges one bucket and writes it.  The view changes when the next version
is whole, so readers see one version or the other.  A table has one writer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.growth import wider
from ..operators.names import all_names, fresh, named, spelled
from ..operators.rows import latest_per_key
from ..operators.upsert import ORIGINS


@dataclass(frozen=True)
class BucketedTable:
    """The table ``name`` (schema.table) with rows told apart by ``keys``.

    ``buckets`` is fixed when the table is first written: its size over a few
    hundred megabytes, so that a bucket is a task's work.  Versions lie in the
    catalog's warehouse, or under ``folder``.
    """

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    buckets: int
    folder: str | None = None
    fmt: str = "parquet"

    def versions(self) -> list[str]:
        schema, _, table = self.name.rpartition(".")
        found = self.spark.sql(f"SHOW TABLES IN {schema or 'default'} LIKE '{table}_v*'").collect()
        prefix = f"{schema}." if schema else ""
        return sorted(prefix + r["tableName"] for r in found if r["tableName"][len(table) + 2 :].isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _path(self, version: str) -> str:
        return f"{self.folder.rstrip('/')}/{version.rpartition('.')[2]}"

    def _drop(self, version: str) -> None:
        self.spark.sql(f"DROP TABLE {version}")
        if self.folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(version))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def merged(self, df: DataFrame, order: Sequence[Column] = (), origin: str = "_origin") -> DataFrame:
        """The rows after a merge with a column ``origin``, as in ``operators.upsert.marked``; no key may be null.

        The join is on plain equality of the keys in the types of the table, so
        that Spark sees that its buckets lie as the join needs them.
        """
        old = self.spark.table(self.versions()[-1])
        rows = latest_per_key(df, self.keys, order)
        names = all_names(old.columns, rows.columns)
        keys, new_keys = spelled(old, self.keys), spelled(rows, self.keys)
        sides = {"old": old.select(*[named(k).alias(f"old{i}") for i, k in enumerate(keys)], F.struct(*map(named, old.columns)).alias("old"))}
        cast = [named(n).cast(old.schema[k].dataType).alias(f"new{i}") for i, (k, n) in enumerate(zip(keys, new_keys))]
        sides["new"] = rows.select(*cast, F.struct(*map(named, rows.columns)).alias("new"))
        same = reduce(lambda a, b: a & b, [F.col(f"old{i}") == F.col(f"new{i}") for i in range(len(keys))])
        is_new, is_old = F.col("new").isNotNull(), F.col("old").isNotNull()
        fields = {side: {f.name.lower(): f for f in frame.schema} for side, frame in (("old", old), ("new", rows))}

        def value(name: str) -> Column:
            a, b = (fields[side].get(name.lower()) for side in ("old", "new"))
            kind = a.dataType if name.lower() in (k.lower() for k in keys) else wider(a.dataType, b.dataType) if a and b else (a or b).dataType
            if kind is None:
                raise ValueError(f"column {name} is {a.dataType.simpleString()} and gets {b.dataType.simpleString()}")
            of = lambda side, f: F.col(side).getField(f.name).cast(kind) if f else F.lit(None).cast(kind)
            return F.when(is_new, of("new", b)).otherwise(of("old", a)).alias(name)

        where = F.when(is_new & is_old, "updated").when(is_new, "inserted").otherwise("kept")
        return sides["old"].join(sides["new"], same, "full_outer").select(*map(value, names), where.alias(origin))

    def upsert(self, df: DataFrame, order: Sequence[Column] = (), keep: int = 2) -> dict[str, int]:
        """Merge ``df`` and return how many rows were inserted, updated and kept; a null key is an error."""
        no_key = reduce(lambda a, b: a | b, [named(k).isNull() for k in spelled(df, self.keys)])
        checked = df.where(F.when(no_key, F.raise_error(F.lit(f"{self.name}: a key is null"))).otherwise(F.lit(True)).cast("boolean"))
        versions, counts = self.versions(), Observation()
        origin = fresh("origin", df.columns, self.read().columns if versions else [])
        if versions:
            rows = self.merged(checked, order, origin)
        else:
            first = latest_per_key(checked, self.keys, order)
            rows = first.repartition(self.buckets, *map(named, spelled(first, self.keys))).withColumn(origin, F.lit("inserted"))
        rows = rows.observe(counts, *[F.count_if(F.col(origin) == o).alias(o) for o in ORIGINS]).drop(origin)
        number = int(versions[-1].rpartition("_v")[2]) + 1 if versions else 1
        made, by = f"{self.name}_v{number:06d}", spelled(rows, self.keys)
        writer = rows.write.format(self.fmt).bucketBy(self.buckets, *by).sortBy(*by)
        (writer.option("path", self._path(made)) if self.folder else writer).saveAsTable(made)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT * FROM {made}")
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            self._drop(old)
        return {o: counts.get[o] for o in ORIGINS}
