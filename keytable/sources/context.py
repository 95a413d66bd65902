"""A context: named tables of one folder or catalog, and the entities that live in them."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytable.functions import geojson
from keytable.model import PARTITION_KEY, ROW_KEY, Entity
from keytable.operators import index as index_ops
from keytable.operators import relation, revision, spatial_index, write
from keytable.plans.query import Query


class Context:
    """Entities over Parquet tables ``<folder>/<name>.parquet``; registered views and
    DataFrames take precedence. Rows are read lazily; ``save`` writes."""

    def __init__(self, spark: SparkSession, folder: str | None = None, entities: Sequence[Entity] = ()):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.entities: dict[str, Entity] = {e.name: e for e in entities}
        self.frames: dict[str, DataFrame] = {}
        self.pending: dict[str, list[DataFrame]] = {}
        self._sequence = 0

    # --- sources -------------------------------------------------------------

    def add_entity(self, entity: Entity) -> Context:
        self.entities[entity.name] = entity
        return self

    def register(self, name: str, df: DataFrame) -> Context:
        self.frames[name] = df
        return self

    def stored(self, name: str) -> str:
        """The table of an entity; other names as they are."""
        return self.entities[name].stored_name if name in self.entities else name

    def path(self, name: str) -> str:
        if self.folder is None:
            raise ValueError(f"no folder for table {name}")
        return f"{self.folder}/{self.stored(name)}.parquet"

    def table(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.folder is None or self.spark.catalog.tableExists(self.stored(name)):
            return self.spark.table(self.stored(name))
        self._recover(name)
        return self.spark.read.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        if name in self.frames or self.spark.catalog.tableExists(self.stored(name)):
            return True
        if self.folder is None:
            return False
        self._recover(name)
        fs, at = self._files(self.path(name))
        return fs.exists(at)

    def _files(self, path: str):
        """The Hadoop file system and path of a folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _recover(self, name: str) -> None:
        """Bring back a table that a swap had put aside when it was cut off."""
        fs, old = self._files(f"{self.path(name)}.old")
        _, at = self._files(self.path(name))
        if not fs.exists(at) and fs.exists(old):
            fs.rename(old, at)

    def query(self, entity: str | Entity) -> Query:
        """The query root of an entity."""
        return Query(self.entities[entity] if isinstance(entity, str) else entity, self.table)

    # --- table creation ------------------------------------------------------

    def _schemas(self, entity: Entity) -> dict[str, T.StructType]:
        keys = [T.StructField(n, T.StringType()) for n in (PARTITION_KEY, ROW_KEY)]
        refs = [T.StructField(n, T.StringType()) for n in (index_ops.REF_PARTITION, index_ops.REF_ROW)]
        out = {entity.stored_name: entity.schema}
        for index in entity.indexes:
            out[index_ops.index_table(entity, index)] = T.StructType([*keys, *refs, *(entity.schema.fields if index.covering else [])])
        return {n: s for n, s in out.items() if n not in entity.ignored_tables}

    def create_tables(self) -> list[str]:
        """Empty typed tables for entities and indexes that have none yet."""
        made = []
        for entity in self.entities.values():
            for name, schema in self._schemas(entity).items():
                if not self.exists(name):
                    self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))
                    made.append(name)
        return made

    def recreate_tables(self) -> list[str]:
        """Empty tables in place of any that are there."""
        made = []
        for entity in self.entities.values():
            for name, schema in self._schemas(entity).items():
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path(name))
                made.append(name)
        return made

    # --- unit of work --------------------------------------------------------

    def _queue(self, entity: str, df: DataFrame, op: str) -> Context:
        self._sequence += 1
        self.pending.setdefault(entity, []).append(write.changes(df, op, F.lit(self._sequence)))
        return self

    def add(self, entity: str, df: DataFrame, mode: str = write.ADD) -> Context:
        """Queue rows; ``mode`` says what happens where a key exists (add, merge, replace)."""
        return self._queue(entity, df, mode)

    def add_with_keys(self, entity: str, df: DataFrame, partition: str, row: str = "", mode: str = write.ADD) -> Context:
        """Queue rows under explicit keys."""
        return self._queue(entity, self.entities[entity].from_keys(df, partition, row), mode)

    def delete_by_key(self, entity: str, partition: str, row: str = "") -> Context:
        """Queue the deletion of the row of one key."""
        model = self.entities[entity]
        one = model.from_keys(self.spark.range(1).select(), partition, row)
        return self._queue(entity, one, write.DELETE)

    def update(self, entity: str, df: DataFrame, children: Mapping[str, DataFrame] | None = None) -> Context:
        """Queue changes to existing rows, and with them rows of collections by name."""
        for name, rows in (children or {}).items():
            declared = next(c for c in self.entities[entity].collections if c.name == name)
            self._queue(declared.child, rows, write.MERGE)
        return self._queue(entity, df, write.UPDATE)

    def delete(self, entity: str, df: DataFrame) -> Context:
        return self._queue(entity, df, write.DELETE)

    def key_members(self, entity: Entity) -> list[str]:
        return [p.member for _, parts in entity.keys() for p in parts]

    def apply_pending(self, entity: str) -> DataFrame:
        """The table as it will be after the queued changes."""
        base = self.table(entity)
        if not self.pending.get(entity):
            return base
        model = self.entities[entity]
        return write.apply_last(base, self._last_changes(model), self.key_members(model))

    def _last_changes(self, model: Entity) -> DataFrame:
        """The queued changes, one per key."""
        queued = self.pending[model.name]
        every = queued[0]
        for more in queued[1:]:
            every = every.unionByName(more, allowMissingColumns=True)
        return write.last_changes(model.drop_defaults(model.assert_partition(every)), self.key_members(model))

    def save(self) -> dict[str, list[str]]:
        """Write all queued changes, the revisions of tracked entities, and the indexes. An
        entity's queue is emptied even if its write fails; those of entities that come
        after a failure stay. Returns the tables written per entity."""
        done: dict[str, list[str]] = {}
        for entity in list(self.pending):
            try:
                done[entity] = self._save(self.entities[entity])
            finally:
                self.pending.pop(entity, None)
        return done

    def _save(self, model: Entity) -> list[str]:
        keys = self.key_members(model)
        # the changes may have been read from the table that is about to be replaced
        aside = f"{self.path(model.name)}.changes"
        self._last_changes(model).write.mode("overwrite").parquet(aside)
        last = self.spark.read.parquet(aside)
        base = self.table(model.name)
        written = [model.name]
        if model.tracked:
            self._revisions(model, base, last).write.mode("append").parquet(self.path(self.revision_table(model)))
            written.append(self.revision_table(model))
        self._swap(model.name, write.apply_last(base, last, keys).sortWithinPartitions(*keys))
        written += self.write_indexes(model, last)
        written += [self.write_spatial_index(model.name, g) for g in model.spatial]
        fs, at = self._files(aside)
        fs.delete(at, True)
        return written

    def revision_table(self, model: Entity) -> str:
        return f"{model.stored_name}Revisions"

    def _revisions(self, model: Entity, base: DataFrame, last: DataFrame) -> DataFrame:
        """What the changes change: of each key the columns that differ, ``changed`` names
        them, ``deleted`` marks rows that go, ``saved`` orders the saves."""
        keys = self.key_members(model)
        now = write.apply_last(write.matching(base, last, keys, "left_semi"), last, keys)
        veto = F.expr(model.track_filter) if model.track_filter else None
        changed = revision.diff_changes(base, now, keys, veto=veto).withColumn("deleted", F.lit(False))
        gone = write.matching(base, last.where(F.col(write.OP) == write.DELETE), keys, "left_semi")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in changed.schema if f.name not in (*keys, "changed", "deleted")]
        rows = changed.unionByName(gone.select(*keys, *nothing, F.lit("").alias("changed"), F.lit(True).alias("deleted")))
        return rows.withColumn("saved", F.lit(time.time_ns() // 1000))

    def write_indexes(self, entity: Entity, changes: DataFrame | None = None) -> list[str]:
        """Derive the indexes of an entity. Rows of ``changes`` were written last, in their
        order; of the others those that an index refers to came after the rest."""
        base, keys = self.table(entity.name), self.key_members(entity)
        order = []
        if changes is not None and entity.indexes:
            named = changes.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col(write.SEQ).alias("__written"))
            base = base.join(named, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], "left").drop(*[f"__key_{k}" for k in keys])
            order = [F.coalesce("__written", F.lit(0).cast("long"))]
        tables: dict[str, list[DataFrame]] = {}
        for index in entity.indexes:
            name = index_ops.index_table(entity, index)
            current = self.table(name) if self.exists(name) else None
            tables.setdefault(name, []).append(index_ops.derive(entity, index, base, order=order, current=current))
        for name, frames in tables.items():
            rows = frames[0]
            for more in frames[1:]:
                rows = rows.unionByName(more, allowMissingColumns=True)
            self._swap(name, self._laid_out(rows, [PARTITION_KEY, ROW_KEY]))
        return list(tables)

    def _laid_out(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Ranges of keys per file, sorted, so that file and row-group statistics leave a
        lookup little to read."""
        return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def write_spatial_index(self, entity: str, geometry: str) -> str:
        """The covering quad-tree index of a GeoJSON column, as table <table>SpatialIndex."""
        name = f"{self.stored(entity)}SpatialIndex"
        rows = spatial_index.derive(self.table(entity), geojson.extent_column(F.col(geometry)))
        self._swap(name, self._laid_out(rows, [spatial_index.TILE_COLUMN]))
        return name

    def spatial_search(self, entity: str, query: str, geometry: str) -> DataFrame:
        """Rows whose geometry intersects the query geometry, by the stored index."""
        return spatial_index.search(self.table(f"{self.stored(entity)}SpatialIndex"), self.key_members(self.entities[entity]), query, geometry)

    def _swap(self, name: str, df: DataFrame) -> None:
        """Write beside the old table, put that aside, and the new one in its place. A run that
        is cut off between leaves the old one aside, from where ``_recover`` takes it."""
        fresh = f"{self.path(name)}.next"
        df.write.mode("overwrite").parquet(fresh)
        fs, at = self._files(self.path(name))
        _, new = self._files(fresh)
        _, aside = self._files(f"{self.path(name)}.old")
        if fs.exists(at):
            fs.delete(aside, True)
            if not fs.rename(at, aside):
                raise OSError(f"table {name} can't be put aside")
        if not fs.rename(new, at):
            fs.rename(aside, at)
            raise OSError(f"table {name} can't be replaced")
        fs.delete(aside, True)
        self.frames.pop(name, None)
        self.spark.catalog.refreshByPath(self.path(name))

    # --- lookups -------------------------------------------------------------

    def find_by_index(self, entity: str, **values: object) -> DataFrame:
        """Rows by the declared indexes on exactly these members; the first index that
        finds the row wins."""
        model = self.entities[entity]
        base = self.table(entity)
        found = []
        for index in model.indexes:
            members = [*index.first, *index.second]
            if set(members) == set(values):
                name = index_ops.index_table(model, index)
                rows = self.table(name) if self.exists(name) else index_ops.derive(model, index, base)
                found.append(index_ops.lookup(model, index, rows, base, [values[m] for m in members]))
        if not found:
            raise KeyError(f"{entity} has no index on {sorted(values)}")
        return found[0] if len(found) == 1 else index_ops.first_hit(found, self.key_members(model))

    def collection(self, entity: str, name: str, parent: Mapping[str, object] | None = None) -> DataFrame:
        """The children of one parent, or all parents joined to their children."""
        declared = next(c for c in self.entities[entity].collections if c.name == name)
        child = self.table(declared.child)
        if parent is not None:
            return relation.children_of(child, declared, parent)
        return relation.join_children(self.table(entity), child, declared)
