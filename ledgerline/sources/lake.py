"""Tables in folders <root>/<layer>/<name>, in a columnar format.

A full or merged table is a row of version folders; readers take the last one.
A new version is written aside and renamed, so a crash leaves the old one, and
a table can be read while its next version is made, on file systems that rename
a folder at once (HDFS, local disks; object stores copy).  A table has one
writer at a time.

A table kept by partition (snapshots) has a folder for each partition value, of
which a write replaces those that it touches.  Its columns stand in a numbered
file beside them: they may grow with each load, in number and in type.  Files
keep the type they were written with: a column that has grown has one stored
column for each of its types, and reading takes the one that is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.growth import wider
from ..operators.names import all_names, fresh, named, spelled
from ..operators.quality import CAST_FAILED, quarantined
from ..operators.upsert import ORIGINS, marked, without
from .layout import interleaved, with_interleaved_key

#: Files with the columns of a table kept by partition; readers of the data skip names that begin like this.
_COLUMNS = "_columns-"
_MISSING = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
#: Partition values that a merge names to Spark when it reads; a load of more is joined by partition instead.
NAMED_PARTITIONS = 1_000


@dataclass(frozen=True)
class Stored:
    """A column of a table kept by partition: its name, and the stored columns of its types, narrowest first."""

    name: str
    parts: tuple[tuple[str, T.DataType], ...]

    @property
    def kind(self) -> T.DataType:
        return self.parts[-1][1]

    def read(self) -> Column:
        if len(self.parts) == 1:
            return named(self.name)
        return F.coalesce(*[named(n).cast(self.kind) for n, _ in self.parts]).alias(self.name)


@dataclass(frozen=True)
class Layout:
    """Columns and partition columns of a table kept by partition."""

    columns: tuple[Stored, ...]
    by: tuple[str, ...]

    def schema(self) -> T.StructType:
        """Of the files."""
        return T.StructType([T.StructField(n, kind) for c in self.columns for n, kind in c.parts])

    def grown(self, schema: T.StructType) -> Layout:
        """With the columns of ``schema``, and types that take its values; a type that has nothing in common with the table's is an error."""
        columns = {c.name.lower(): c for c in self.columns}
        for f in schema:
            c = columns.get(f.name.lower())
            if c is None:
                columns[f.name.lower()] = Stored(f.name, ((fresh(f.name, self.schema().names), f.dataType),))
                continue
            kind = wider(c.kind, f.dataType)
            if kind is None:
                raise ValueError(f"column {c.name} is {c.kind.simpleString()} and gets {f.dataType.simpleString()}")
            if kind != c.kind:
                is_path = c.name.lower() in (b.lower() for b in self.by)  # folder names have no type
                more = (c.name, kind) if is_path else (fresh(f"{c.name}@{len(c.parts)}", self.schema().names, schema.names), kind)
                columns[f.name.lower()] = Stored(c.name, (more,) if is_path else (*c.parts, more))
        return Layout(tuple(columns.values()), self.by)

    def to_json(self) -> str:
        return json.dumps({"by": self.by, "columns": [{"name": c.name, "parts": [[n, kind.jsonValue()] for n, kind in c.parts]} for c in self.columns]})

    @staticmethod
    def from_json(text: str) -> Layout:
        kind = lambda value: T.StructField.fromJson({"name": "x", "type": value, "nullable": True, "metadata": {}}).dataType
        made = json.loads(text)
        return Layout(tuple(Stored(c["name"], tuple((n, kind(v)) for n, v in c["parts"])) for c in made["columns"]), tuple(made["by"]))


@dataclass(frozen=True)
class Lake:
    """All tables under ``root``."""

    spark: SparkSession
    root: str
    fmt: str = "parquet"

    def path(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, path: str, prefix: str) -> list[str]:
        """Names in a folder that begin like this, in order."""
        fs, at = self._fs(path)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix))

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def current(self, layer: str, name: str) -> str:
        """Folder that holds the rows now."""
        path = self.path(layer, name)
        versions = self._listed(path, "v-")
        return f"{path}/{versions[-1]}" if versions else path

    def read(self, layer: str, name: str, snapshot: tuple[str, str] | None = None) -> DataFrame:
        """A table; ``snapshot`` (column, date) keeps one capture, and prunes if the table is partitioned by it."""
        reader, layout = self.spark.read.format(self.fmt), self._layout(layer, name)
        if layout is None:
            df = reader.load(self.current(layer, name))
        else:
            df = reader.schema(layout.schema()).load(self.path(layer, name)).select(*[c.read() for c in layout.columns])
        if snapshot is not None and snapshot[0] in df.columns:
            df = df.where(named(snapshot[0]) == F.to_date(F.lit(snapshot[1])))
        return df

    def _layout(self, layer: str, name: str) -> Layout | None:
        """Of a table kept by partition; None for others."""
        path = self.path(layer, name)
        files = self._listed(path, _COLUMNS)
        if not files:
            return None
        fs, at = self._fs(f"{path}/{files[-1]}")
        stream = fs.open(at)
        try:
            return Layout.from_json(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _keep_layout(self, layout: Layout, layer: str, name: str) -> None:
        """Write the columns under the next number, by rename, so that no reader meets half a file; the one before stays."""
        path = self.path(layer, name)
        files = self._listed(path, _COLUMNS)
        last = int(files[-1][len(_COLUMNS) : -len(".json")]) if files else 0
        staged = f"{path}/.columns-{uuid.uuid4().hex}"
        fs, at = self._fs(staged)
        out = fs.create(at, True)
        out.write(bytearray(layout.to_json().encode()))
        out.close()
        self._rename(staged, f"{path}/{_COLUMNS}{last + 1:09d}.json")
        for old in files[:-1]:
            self._delete(f"{path}/{old}")

    def exists(self, layer: str, name: str) -> bool:
        """Whether the table can be read; any error but a missing one is raised."""
        fs, at = self._fs(self.path(layer, name))
        if not fs.exists(at):
            return False
        try:
            self.read(layer, name)
        except AnalysisException as error:
            if (error.getCondition() or "").split(".")[0] in _MISSING:
                return False
            raise
        return True

    def append(self, df: DataFrame, layer: str, name: str) -> None:
        df.write.format(self.fmt).mode("append").save(self.path(layer, name))

    def replace(self, df: DataFrame, layer: str, name: str, keep: int = 2) -> int:
        """Make ``df`` the table's next version; returns its rows, counted while they are written."""
        path = self.path(layer, name)
        if self._layout(layer, name) is not None:
            raise ValueError(f"{layer}/{name} is kept by partition and has no versions")
        rows = Observation()
        staged = f"{path}/.staged-{uuid.uuid4().hex}"
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.format(self.fmt).save(staged)
        versions = self._listed(path, "v-")
        last = int(versions[-1][2:]) if versions else 0
        self._rename(staged, f"{path}/v-{last + 1:09d}")
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            self._delete(f"{path}/{old}")
        return rows.get["n"]

    def _rename(self, source: str, target: str) -> None:
        fs, at = self._fs(source)
        if not fs.rename(at, self._fs(target)[1]):
            raise OSError(f"could not rename {source}")

    def replace_partitions(self, df: DataFrame, layer: str, name: str, by: Sequence[str]) -> None:
        """Replace the partitions that ``df`` has rows for; others stay, and have null in new columns.

        ``df`` may read the table itself: new files go aside, and take the
        places of the old ones when all are written.
        """
        by = spelled(df, by)
        layout = self._layout(layer, name)
        if layout is None:
            if self._listed(self.path(layer, name), "v-"):
                raise ValueError(f"{layer}/{name} has versions and is not kept by partition")
            layout = Layout((), tuple(by))
        if [b.lower() for b in by] != [b.lower() for b in layout.by]:
            raise ValueError(f"{layer}/{name} is kept by {', '.join(layout.by)}")
        grown = layout.grown(df.schema)
        if grown != layout:
            self._keep_layout(grown, layer, name)
        own = {c.lower(): c for c in df.columns}
        rows = df.select(*[named(own[c.name.lower()]).cast(c.kind).alias(c.parts[-1][0]) for c in grown.columns if c.name.lower() in own])
        rows.write.format(self.fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout.by).save(self.path(layer, name))

    def fit(self, df: DataFrame, layer: str, name: str) -> tuple[DataFrame, DataFrame | None]:
        """(rows whose values the table's types or wider ones can take, the rest as they came, None if all types fit).

        Only columns of a type that has nothing in common with the table's are
        cast; a value that does not survive is drift.
        """
        held = {f.name.lower(): f.dataType for f in self.read(layer, name).schema} if self.exists(layer, name) else {}
        odd = {f.name: held[f.name.lower()] for f in df.schema if f.name.lower() in held and wider(held[f.name.lower()], f.dataType) is None}
        if not odd:
            return df, None
        drifted = F.lit(False)
        for c, kind in odd.items():
            drifted = drifted | (named(c).isNotNull() & named(c).try_cast(kind).isNull())
        good = df.where(~drifted).select(*[named(c).try_cast(odd[c]).alias(c) if c in odd else named(c) for c in df.columns])
        return good, df.where(drifted)

    def _touched(self, existing: DataFrame, df: DataFrame, partition: str) -> DataFrame:
        """Rows of ``existing`` in the partitions of ``df``, a null one among them."""
        (old,), (new,), touched = spelled(existing, [partition]), spelled(df, [partition]), fresh("touched", existing.columns)
        kind = wider(existing.schema[old].dataType, df.schema[new].dataType)
        if kind is None:
            raise ValueError(f"partition {old} is {existing.schema[old].dataType.simpleString()} and gets {df.schema[new].dataType.simpleString()}")
        own = named(old) if kind == existing.schema[old].dataType else named(old).cast(kind)
        values = df.select(named(new).cast(kind).alias(touched)).distinct()
        # One row for each capture in the load, as a rule.
        few = [r[0] for r in values.limit(NAMED_PARTITIONS + 1).collect()]
        if len(few) > NAMED_PARTITIONS:
            return existing.join(values, own.eqNullSafe(F.col(touched)), "left_semi")
        known = own.isin([v for v in few if v is not None])
        return existing.where(known | own.isNull() if None in few else known)

    def upsert(self, df: DataFrame, layer: str, name: str, keys: Sequence[str], order: Sequence[Column] = (), partition: str | None = None, batch_id: str | None = None) -> dict[str, int]:
        """Merge ``df`` by ``keys`` and return how many rows were inserted, updated and kept.

        Counts come from the write itself.  With ``partition``, which must be
        one of the keys, only the partitions of ``df`` are read and rewritten.
        Types may grow; with a ``batch_id`` rows that drift from the table's
        types go to quarantine, without one they are an error.
        """
        if partition is not None and partition.lower() not in (k.lower() for k in keys):
            raise ValueError("the partition column must be one of the keys")
        found = self.exists(layer, name)
        if found and batch_id is not None:
            df, drifted = self.fit(df, layer, name)
            if drifted is not None:
                self.quarantine(quarantined(drifted, CAST_FAILED, batch_id), f"{layer}_{name}")
        existing = self.read(layer, name) if found else self.spark.createDataFrame([], df.schema)
        if partition is not None and found:
            existing = self._touched(existing, df, partition)
        counts, origin = Observation(), fresh("origin", existing.columns, df.columns)
        rows = marked(existing, df, keys, order, origin)
        rows = rows.observe(counts, *[F.count_if(F.col(origin) == o).alias(o) for o in ORIGINS]).drop(origin)
        if partition is None:
            self.replace(rows, layer, name)
        else:
            self.replace_partitions(rows, layer, name, [partition])
        return {o: counts.get[o] for o in ORIGINS}

    def delete_where(self, layer: str, name: str, predicate: Column) -> int:
        """Drop rows for which ``predicate`` holds; returns how many stay.

        Of a table kept by partition only the partitions with such rows are
        rewritten; one that has no other rows goes as a folder.
        """
        layout, rows = self._layout(layer, name), self.read(layer, name)
        if layout is None:
            return self.replace(without(rows, predicate), layer, name)
        gone, by = F.coalesce(predicate, F.lit(False)), [named(b) for b in layout.by]
        keys = [fresh(f"part{i}", rows.columns) for i in range(len(by))]
        # One row for each partition: where the predicate is on partition columns alone, no data is read.
        counted = rows.groupBy(*[c.alias(k) for c, k in zip(by, keys)]).agg(F.count("*").alias("n"), F.count_if(gone).alias("gone"), F.max("_metadata.file_path").alias("file")).collect()
        part = [r for r in counted if 0 < r["gone"] < r["n"]]
        if part:
            values = self.spark.createDataFrame([tuple(r[k] for k in keys) for r in part], T.StructType([T.StructField(k, rows.schema[b].dataType) for k, b in zip(keys, layout.by)]))
            same = F.lit(True)
            for k, c in zip(keys, by):
                same = same & c.eqNullSafe(F.col(k))
            # As many rows as partitions, whose folders the driver lists anyway.
            self.replace_partitions(without(rows.join(F.broadcast(values), same, "left_semi"), predicate).select(*map(named, rows.columns)), layer, name, layout.by)
        for r in counted:
            if r["gone"] == r["n"]:
                self._delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.spark.sparkContext._jvm.java.net.URI(r["file"])).getParent().toString())
        return sum(r["n"] - r["gone"] for r in counted)

    def quarantine(self, df: DataFrame, name: str, keys: Sequence[str] = ("batch_id", "quarantine_reason")) -> int:
        """Set rejected rows aside; rows of the same table, batch and reason replace those of an earlier attempt."""
        if df.isEmpty():
            return 0
        counts = Observation()
        every = df.observe(counts, F.count(F.lit(1)).alias("n"))
        if self.exists("quarantine", name):
            again = df.select(*keys).distinct()
            every = self.read("quarantine", name).join(again, list(keys), "left_anti").unionByName(every, allowMissingColumns=True)
        self.replace(every, "quarantine", name)
        return counts.get["n"]

    def cluster(self, layer: str, name: str, by: Sequence[str], files: int, interleave: bool = False) -> None:
        """Rewrite a table ordered by ``by`` over ``files`` files (for each partition, as far as it has the rows), so that readers skip by the files' least and greatest values.

        With ``interleave`` all columns count alike; without, the first one
        counts before the others.  A table kept by partition is always in order
        of its partitions first.
        """
        layout, rows = self._layout(layer, name), self.read(layer, name)
        if layout is None:
            self.replace((interleaved if interleave else clustered)(rows, by, files), layer, name)
        elif interleave:
            key = fresh("turn", rows.columns)
            placed = clustered(with_interleaved_key(rows, by, key), [*layout.by, key], files)
            self.replace_partitions(placed.drop(key), layer, name, layout.by)
        else:
            self.replace_partitions(clustered(rows, all_names(layout.by, by), files), layer, name, layout.by)

    def staged(self, df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
        """``df`` written once to a folder of its own and read back, and a function that removes it."""
        path = self.path("staging", f"{name}-{uuid.uuid4().hex}")
        df.write.format(self.fmt).save(path)
        return self.spark.read.format(self.fmt).schema(df.schema).load(path), lambda: self._delete(path)

    def tables(self, layer: str) -> list[str]:
        """Names of the tables of a layer."""
        fs, at = self._fs(f"{self.root.rstrip('/')}/{layer}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    def publish(self, tables: Sequence[tuple[str, str]], schema: str, prefix: str = "", more: Mapping[str, DataFrame] = {}) -> list[str]:
        """Write (layer, name) tables as catalog tables of ``schema``, in the given order, and then the frames of ``more``; returns their names."""
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        made = []
        for name, df in [*((name, self.read(layer, name)) for layer, name in tables), *more.items()]:
            df.write.format(self.fmt).mode("overwrite").saveAsTable(f"{schema}.{prefix}{name}")
            made.append(f"{schema}.{prefix}{name}")
        return made


def clustered(df: DataFrame, by: Sequence[str], files: int) -> DataFrame:
    """The same rows in ranges of ``by``."""
    columns = [named(c) for c in by]
    return df.repartitionByRange(files, *columns).sortWithinPartitions(*columns)
