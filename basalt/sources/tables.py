"""Mutable tables over immutable Parquet versions, with MERGE, snapshots and transactions.

A table is a folder of versions and a pointer to the current one, held by the driver (one writer).  A statement
computes the new version as one DataFrame, writes it beside the old one and moves the pointer; readers of the old
version are not disturbed, a failed statement leaves nothing behind, rollback moves pointers back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


@dataclass
class Version:
    """Folders of Parquet files, none of which changes any more; an insert adds one."""

    paths: list[str]
    schema: StructType


@dataclass
class MergeClause:
    """One WHEN clause: ``kind`` is 'matched', 'not_matched' or 'not_matched_by_source'.

    ``action`` is 'update', 'delete' or 'insert'; ``values`` map target columns to expressions over ``t`` and ``s``.
    """

    kind: str
    action: str
    values: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


class TableStore:
    """Named tables under a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables: dict[str, Version] = {}
        self.required: dict[str, set[str]] = {}
        self.defaults: dict[str, dict[str, Column]] = {}
        self.saved: list[dict[str, Version]] = []

    # Reading and creating

    def read(self, name: str) -> DataFrame:
        v = self._version(name)
        return self.spark.read.schema(v.schema).parquet(*v.paths)

    def _version(self, name: str) -> Version:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise KeyError(f"table {name} does not exist") from None

    def create(self, name: str, schema: StructType | str, replace: bool = False, if_not_exists: bool = False, required: set[str] = frozenset(), defaults: dict[str, Column] | None = None) -> None:
        if name.lower() in self.tables and not replace:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self.required[name.lower()] = {c.lower() for c in required}
        self.defaults[name.lower()] = {c.lower(): v for c, v in (defaults or {}).items()}
        self._write(name, self.spark.createDataFrame([], schema))

    def create_as(self, name: str, df: DataFrame, replace: bool = False) -> None:
        if name.lower() in self.tables and not replace:
            raise ValueError(f"table {name} exists")
        self._write(name, df)

    def _store(self, name: str, df: DataFrame, schema: StructType) -> str:
        for c in self.required.get(name.lower(), ()):
            df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in required column {c}"))).otherwise(F.col(c)))
        path = f"{self.folder}/{name.lower()}/{uuid.uuid4().hex}"
        df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]).write.parquet(path)
        return path

    def _write(self, name: str, df: DataFrame) -> None:
        schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema])
        self._point(name, Version([self._store(name, df, schema)], schema))

    def _point(self, name: str, version: Version) -> None:
        self.tables[name.lower()] = version
        self.read(name).createOrReplaceTempView(name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.tables.pop(name.lower(), None) is None and not if_exists:
            raise KeyError(f"table {name} does not exist")
        self.spark.catalog.dropTempView(name)

    # Changing rows

    def insert(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> int:
        """Append; columns that are not named get their default or null.  Returns the number of rows."""
        schema = self._version(name).schema
        given = dict(zip([c.lower() for c in columns or schema.names], rows.columns))
        if len(rows.columns) != len(given):
            raise ValueError(f"{len(rows.columns)} values for {len(given)} columns")
        unknown = given.keys() - {c.lower() for c in schema.names}
        if unknown:
            raise ValueError(f"no such column: {sorted(unknown)[0]}")
        defaults = self.defaults.get(name.lower(), {})
        new = rows.select(*[(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else defaults.get(f.name.lower(), F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])
        old = self._version(name)
        path = self._store(name, new, schema)  # the rows are computed once; what was there is not touched
        self._point(name, Version([*old.paths, path], schema))
        return self.spark.read.schema(schema).parquet(path).count()

    def update(self, name: str, values: dict[str, Column], where: Column | None = None) -> int:
        """Set columns, or fields of structs by dotted names, where the condition is TRUE.  Returns the number of rows."""
        old, hit = self.read(name), F.coalesce(where if where is not None else F.lit(True), F.lit(False))
        known = {f.name.lower(): f for f in old.schema}
        whole: dict[str, Column] = {}
        for target, value in values.items():
            first, _, path = target.lower().partition(".")
            if first not in known:
                raise ValueError(f"no such column: {target}")
            field = known[first]
            if not path:
                whole[first] = value.cast(field.dataType)
            else:
                kind = _field_type(field.dataType, path, target)
                whole[first] = whole.get(first, F.col(f"`{field.name}`")).withField(path, value.cast(kind))
        n = old.where(hit).count()
        self._write(name, old.select(*[(F.when(hit, whole[f.name.lower()]).otherwise(F.col(f"`{f.name}`")) if f.name.lower() in whole else F.col(f"`{f.name}`")).alias(f.name) for f in old.schema]))
        return n

    def delete(self, name: str, where: Column) -> int:
        old, hit = self.read(name), F.coalesce(where, F.lit(False))
        n = old.where(hit).count()
        self._write(name, old.where(~hit))
        return n

    def truncate(self, name: str) -> None:
        self._write(name, self.read(name).limit(0))

    def merge(self, name: str, source: DataFrame, on: Column, clauses: list[MergeClause]) -> None:
        """MERGE as one full outer join; the first clause that fits a row decides.  Two matches of a target row fail.

        ``on`` and the clauses' expressions name the sides ``t`` and ``s``.
        """
        schema = self._version(name).schema
        t = self.read(name).withColumn("_t", F.monotonically_increasing_id()).alias("t")
        s = source.withColumn("_s", F.lit(True)).alias("s")
        both = t.join(s, on, "full_outer")
        has_t, has_s = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()
        sides = {"matched": has_t & has_s, "not_matched": ~has_t & has_s, "not_matched_by_source": has_t & ~has_s}
        chosen = F.lit(-1)
        for i, c in reversed(list(enumerate(clauses))):
            fits = sides[c.kind] & F.coalesce(c.condition if c.condition is not None else F.lit(True), F.lit(False))
            chosen = F.when(fits, F.lit(i)).otherwise(chosen)
        # The join is computed once: the test for double matches and the new version read the same rows.
        names = {**{("t", c): f"t{i}" for i, c in enumerate([*schema.names, "_t"])}, **{("s", c): f"s{i}" for i, c in enumerate([*source.columns, "_s"])}}
        path = f"{self.folder}/{name.lower()}/merge-{uuid.uuid4().hex}"
        both.withColumn("_c", chosen).select(*[F.col(f"{side}.`{c}`").alias(n) for (side, c), n in names.items()], "_c").write.parquet(path)
        flat = self.spark.read.parquet(path)
        fields = lambda side: F.struct(*[F.col(n).alias(c) for (x, c), n in names.items() if x == side]).alias(side)
        both = flat.select(fields("t"), fields("s"), "_c")
        changed = both.where("_c >= 0").where(has_t & has_s)
        if not changed.groupBy(F.col("t._t")).count().where("count > 1").isEmpty():
            raise ValueError("MERGE: a target row matches more than one source row")
        acts = {a: [i for i, c in enumerate(clauses) if c.action == a] for a in ("update", "delete", "insert")}
        keep = (has_t & ~F.col("_c").isin(acts["delete"] or [-2])) | F.col("_c").isin(acts["insert"] or [-2])

        def column(f: StructField) -> Column:
            out = F.col(f"t.{f.name}")
            for i, c in enumerate(clauses):
                if c.action != "delete":
                    low = {k.lower(): v for k, v in c.values.items()}
                    new = low.get(f.name.lower(), F.lit(None) if c.action == "insert" else None)
                    if new is not None:
                        out = F.when(F.col("_c") == i, new.cast(f.dataType)).otherwise(out)
            return out.alias(f.name)

        # An unmatched side can repeat a kept target row only when it matched several source rows that change nothing.
        rows = both.where(keep).withColumn("_n", F.when(has_t, F.row_number().over(_per_row())).otherwise(1)).where("_n = 1")
        self._write(name, rows.select(*[column(f) for f in schema]))
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    # Changing tables

    def add_column(self, name: str, column: str, kind: str, default: Column | None = None, if_not_exists: bool = False) -> None:
        if column.lower() in {c.lower() for c in self._version(name).schema.names}:
            if if_not_exists:
                return
            raise ValueError(f"column {column} exists")
        self._write(name, self.read(name).withColumn(column, (default if default is not None else F.lit(None)).cast(kind)))

    def drop_column(self, name: str, column: str) -> None:
        self._write(name, self.read(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        self._write(name, self.read(name).withColumnRenamed(old, new))

    def alter_type(self, name: str, column: str, kind: str) -> None:
        self._write(name, self.read(name).withColumn(column, F.col(column).cast(kind)))

    def require(self, name: str, column: str, required: bool) -> None:
        """SET or DROP NOT NULL; rows that are there must comply."""
        self._column(name, column)
        own = self.required.setdefault(name.lower(), set())
        if required:
            if not self.read(name).where(F.col(f"`{column}`").isNull()).isEmpty():
                raise ValueError(f"column {column} holds nulls")
            own.add(column.lower())
        else:
            own.discard(column.lower())

    def set_default(self, name: str, column: str, default: Column | None) -> None:
        self._column(name, column)
        own = self.defaults.setdefault(name.lower(), {})
        own.pop(column.lower(), None)
        if default is not None:
            own[column.lower()] = default

    def _column(self, name: str, column: str) -> None:
        if column.lower() not in {c.lower() for c in self._version(name).schema.names}:
            raise ValueError(f"no such column: {column}")

    def rename(self, name: str, new: str) -> None:
        for kept in (self.required, self.defaults):
            if name.lower() in kept:
                kept[new.lower()] = kept.pop(name.lower())
        self.tables[new.lower()] = self.tables.pop(name.lower())
        self.spark.catalog.dropTempView(name)
        self.read(new).createOrReplaceTempView(new)

    def snapshot(self, name: str, of: str, if_not_exists: bool = False) -> None:
        """A table that shows another as it is now; versions are immutable, so nothing is copied."""
        if name.lower() in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self.tables[name.lower()] = self._version(of)
        self.read(name).createOrReplaceTempView(name)

    def begin(self) -> None:
        self.saved.append(dict(self.tables))

    def commit(self) -> None:
        self.saved.pop()

    def rollback(self) -> None:
        now, self.tables = self.tables, self.saved.pop()
        for name in now.keys() - self.tables.keys():
            self.spark.catalog.dropTempView(name)
        for name in self.tables:
            self.read(name).createOrReplaceTempView(name)


def _field_type(kind, path: str, target: str):
    for part in path.split("."):
        inner = {f.name.lower(): f.dataType for f in kind} if isinstance(kind, StructType) else {}
        if part not in inner:
            raise ValueError(f"no such field: {target}")
        kind = inner[part]
    return kind


def _per_row():
    from pyspark.sql import Window

    return Window.partitionBy("t._t").orderBy(F.lit(1))
