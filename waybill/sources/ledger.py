"""Collections that change by small writes: logs of changes merged on read, and one commit over several collections.

A collection is a base, cut into buckets of the key's hash, and deltas: the rows of each upsert and the keys of each
delete. A write of k rows writes k rows. Reading takes the base less the keys that deltas name, and the last change of
each key: with few changes the base isn't shuffled, as its side of the anti-join meets a small one. ``compact`` folds
deltas into the buckets that they touch and leaves the files of the others.

A manifest names what all collections consist of. A transaction writes its files first and then one manifest; what a
crash leaves behind before that is never read, and readers of an older manifest go on undisturbed. Two transactions that
change the same collection can't both commit: the later one is told. The manifest is created only if its number is free,
which the file system decides.

Defined results: of several rows with one key in one upsert the last by ``order`` counts (without it the greatest by all
columns); null keys are keys, equal to each other; a missing collection is empty; deleting what isn't there is no error; patching it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from waybill.operators import changes
from waybill.sources.files import _path, remove

BUCKETS = 64
_BUCKET, _GONE, _AT = "_bucket", "_gone", "_at"


class Conflict(RuntimeError):
    """Another transaction has changed the same collection."""


@dataclass
class State:
    """What a collection consists of: the folder of each bucket of its base, and its deltas, the oldest first."""

    base: dict[str, str] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)
    changed: int = 0  # number of the manifest that changed it last


class Store:
    """``tables``: name to (schema, key columns). ``root``: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str | StructType, Sequence[str]]], buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = {n: s if isinstance(s, StructType) else spark.createDataFrame([], s).schema for n, (s, _) in tables.items()}
        self.key = {n: list(k) for n, (_, k) in tables.items()}

    # manifests

    def _manifests(self) -> list[tuple[int, Any]]:
        p, fs = _path(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted((int(s.getPath().getName().split(".")[0]), s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _load(self, path: Any) -> dict[str, State] | None:
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            return {n: State(**s) for n, s in json.loads(text).items()}
        except ValueError:  # its writer died on the way
            return None
        finally:
            stream.close()

    def version(self) -> tuple[int, dict[str, State]]:
        """Number and content of the last whole manifest; 0 and nothing before the first."""
        for number, path in reversed(self._manifests()):
            if (found := self._load(path)) is not None:
                return number, found
        return 0, {}

    def _publish(self, number: int, states: dict[str, State]) -> bool:
        p, fs = _path(self.spark, f"{self.root}/manifest/{number:012}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise OSError(f"manifest {number} could not be written") from e
        out.write(bytearray(json.dumps({n: asdict(s) for n, s in states.items()}).encode()))
        out.close()
        return True

    # reading

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.key[name]), F.lit(self.buckets)).cast("int")

    def _delta_schema(self, name: str) -> StructType:
        return StructType([*self.schema[name].fields, StructField(_BUCKET, IntegerType()), StructField(_GONE, BooleanType())])

    def _changes(self, name: str, deltas: Sequence[str]) -> DataFrame:
        """The last change of each key; pre-aggregated before it is dealt out."""
        schema = self._delta_schema(name)
        parts = [self.spark.read.schema(schema).parquet(path).withColumn(_AT, F.lit(i)) for i, path in enumerate(deltas)]
        every = reduce(DataFrame.unionByName, parts)
        # a key is in a delta once, so its last change is a maximum
        return every.groupBy(*self.key[name]).agg(F.max_by(F.struct(*[c for c in every.columns if c not in (*self.key[name], _AT)]), _AT).alias("_r")).select(*self.key[name], "_r.*")

    def _merged(self, name: str, base: DataFrame, deltas: Sequence[str]) -> DataFrame:
        if not deltas:
            return base
        last = self._changes(name, deltas)
        on = reduce(Column.__and__, [base[k].eqNullSafe(F.col(f"_d.{k}")) for k in self.key[name]])
        return base.join(last.select(*self.key[name]).alias("_d"), on, "left_anti").unionByName(last.where(~F.col(_GONE)).select(*base.columns))

    def _base(self, name: str, folders: Sequence[str]) -> DataFrame:
        schema = self.schema[name]
        return self.spark.read.schema(schema).parquet(*dict.fromkeys(folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, states: dict[str, State] | None = None) -> DataFrame:
        """The collection as of the last manifest, or of ``states``."""
        state = (self.version()[1] if states is None else states).get(name, State())
        return self._merged(name, self._base(name, list(state.base.values())), state.deltas)

    def get(self, name: str, *key: Any) -> DataFrame:
        """The record of a key, one row or none: reads one bucket of the base, and of the deltas what falls into it."""
        state = self.version()[1].get(name, State())
        asked = self.spark.createDataFrame([tuple(key)], StructType([self.schema[name][k] for k in self.key[name]]))
        b = asked.select(self.bucket(name)).first()[0]
        fit = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.key[name], key, strict=True)])
        base = self._base(name, [state.base[str(b)]] if str(b) in state.base else []).where(fit)
        if not state.deltas:
            return base
        last = self._changes(name, state.deltas).where((F.col(_BUCKET) == b) & fit)
        none = last.limit(1).select(F.lit(True).alias("_changed"))
        return base.join(none, how="left_anti", on=F.lit(True)).unionByName(last.where(~F.col(_GONE)).select(*base.columns))

    def begin(self) -> Transaction:
        return Transaction(self)

    # upkeep

    def compact(self, name: str) -> int:
        """Folds the deltas into the buckets that they touch; returns how many those are."""
        tx = self.begin()
        state = tx.states.get(name, State())
        if not state.deltas:
            return 0
        last = self._changes(name, state.deltas)
        touched = {str(r[0]) for r in last.select(_BUCKET).distinct().collect()}  # the number of buckets at most
        old = [path for b, path in state.base.items() if b in touched]
        rows = self._merged(name, self._base(name, old), state.deltas)
        base = {b: path for b, path in state.base.items() if b not in touched} | tx._bucketed(name, rows)
        tx.states[name] = State(base, [])
        tx.touched.add(name)
        tx.commit()
        return len(touched)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes files that the last ``keep`` manifests don't name, and older manifests. Not while a transaction is open."""
        whole = [(n, p, s) for n, p in self._manifests() if (s := self._load(p)) is not None]
        named = {path for *_, states in whole[-keep:] for s in states.values() for path in (*s.base.values(), *s.deltas)}
        gone = []
        for name in self.key:
            p, fs = _path(self.spark, f"{self.root}/{name}")
            for folder in fs.listStatus(p) if fs.exists(p) else ():
                path = folder.getPath().toString().removeprefix("file:")
                held = [x for x in named if x.removeprefix("file:") == path or x.removeprefix("file:").startswith(path + "/")]
                if not held:
                    remove(self.spark, path)
                    gone.append(path)
        for _, p, _ in whole[:-keep]:
            remove(self.spark, p.toString())
        return gone


class Transaction:
    """Changes of one or more collections that count together from ``commit`` on, or never."""

    def __init__(self, store: Store):
        self.store = store
        self.number, states = store.version()
        self.states = {n: State(dict(s.base), list(s.deltas), s.changed) for n, s in states.items()}
        self.touched: set[str] = set()

    def _place(self, name: str) -> str:
        return f"{self.store.root}/{name}/{uuid.uuid4().hex}"

    def _typed_columns(self, name: str) -> list[Column]:
        return [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.store.schema[name]]

    def _log(self, name: str, rows: DataFrame) -> None:
        place = self._place(name)
        rows.withColumn(_BUCKET, self.store.bucket(name)).sortWithinPartitions(_BUCKET).write.parquet(place)
        self.states.setdefault(name, State()).deltas.append(place)
        self.touched.add(name)

    def _bucketed(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes a base; the folder of each bucket."""
        place = self._place(name)
        rows.withColumn(_BUCKET, self.store.bucket(name)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(place)
        p, fs = _path(self.store.spark, place)
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return {x.split("=")[1]: f"{place}/{x}" for x in found if x.startswith(f"{_BUCKET}=")}

    def upsert(self, name: str, rows: DataFrame, order: Column | None = None) -> Transaction:
        """Rows in place of those with their key; new keys are added."""
        typed = rows.select(*self._typed_columns(name), (F.lit(0) if order is None else order).alias("_order"))
        by = [F.desc("_order"), *[F.desc(c) for c in typed.columns if c != "_order"]]
        one = typed.withColumn("_n", F.row_number().over(Window.partitionBy(*self.store.key[name]).orderBy(*by))).where("_n = 1").drop("_n", "_order")
        self._log(name, one.withColumn(_GONE, F.lit(False)))
        return self

    def delete(self, name: str, keys: DataFrame) -> Transaction:
        key = self.store.key[name]
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.store.schema[name] if f.name not in key]
        only = keys.select(*[F.col(k).cast(self.store.schema[name][k].dataType).alias(k) for k in key]).distinct()
        self._log(name, only.select(*key, *none).select(*[f.name for f in self.store.schema[name]]).withColumn(_GONE, F.lit(True)))
        return self

    def patch(self, name: str, rows: DataFrame) -> Transaction:
        """Columns of ``rows`` into the records with their key (unique in ``rows``); a record that isn't there is an error."""
        key, columns = self.store.key[name], [f.name for f in self.store.schema[name]]
        new = [c for c in rows.columns if c in columns and c not in key]
        side = rows.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_asked"))
        met = side.join(self.store.read(name, self.states).withColumn("_there", F.lit(True)), key, "left")
        said = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
        there = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"{name} "), said, F.lit(" not found")))).otherwise(F.lit(False))
        self._log(name, met.select(*[F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in columns], there.alias(_GONE)))
        return self

    def replace(self, name: str, rows: DataFrame) -> Transaction:
        """The whole collection; keys are unique in ``rows``."""
        self.states[name] = State(self._bucketed(name, rows.select(*self._typed_columns(name))), [])
        self.touched.add(name)
        return self

    def commit(self) -> int:
        """Makes all changes count at once; returns the manifest's number. What others changed meanwhile is taken over,
        unless it is the same collection."""
        while True:
            number, now = self.store.version()
            if number != self.number:
                mine = {n: self.states[n] for n in self.touched}
                for n in self.touched:
                    if now.get(n, State()).changed > self.number:
                        raise Conflict(f"{n} was changed by manifest {now[n].changed}")
                self.states = now | mine
            last = max((n for n, _ in self.store._manifests()), default=0) + 1
            for n in self.touched:
                self.states[n].changed = last
            if self.store._publish(last, self.states):
                return last


def restore(store: Store, backup: DataFrame, names: dict[str, str]) -> str | None:
    """Writes the collections of a backup (one row, column json) in one commit; returns what is wrong with it, or None.

    ``names``: name in the backup to collection. Of repeated keys the last record counts.
    """
    error = backup.select(changes.backup_error(F.col("json")).alias("e")).first().e
    if error:
        return error
    tx = store.begin()
    for said, name in names.items():
        schema = store.schema[name].simpleString()
        rows = backup.select(F.posexplode(F.coalesce(F.from_json("json", f"{said} array<{schema}>")[said], F.array()))).select("pos", "col.*")
        last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*store.key[name]).orderBy(F.desc("pos")))).where("_n = 1")
        tx.replace(name, last.drop("_n", "pos"))
    tx.commit()
    return None


def archive(store: Store, records: DataFrame, images: DataFrame) -> int:
    """Records and what is known of their images, together or not at all."""
    return store.begin().upsert("receipts", records).upsert("images", images).commit()


def delete_archived(store: Store, ids: DataFrame) -> int:
    """Records by id and their images in one commit; ids without a record are no error."""
    images = store.read("images").join(ids.select("id").distinct(), "id", "left_semi")
    return store.begin().delete("images", images).delete("receipts", ids).commit()
