"""A Parquet table with versions: a manifest for each names the folders that it is made of.

A batch writes folders of its own and then one manifest, by a rename; readers
see the version before or the version after.  Only the partitions that a batch
touches are written again, the others are taken over by name.  A batch that is
broken off leaves folders that no manifest names; a batch that is repeated is
known by its source and number and changes nothing.  Old versions stay readable
until they are expired.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

_NONE = "all"


class ConflictProblem(RuntimeError):
    """Another writer has made the next version."""


class VersionedTable:
    """``keys``: a row for each (upserts); ``by``: the column (date or text) that partitions the table, if any."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), by: str | None = None):
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), tuple(keys), by

    # versions
    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in store.names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        every = self.versions()
        if version is None:
            version = every[-1] if every else None
        if version is None:
            return None
        text = store.read_text(self.spark, f"{self.path}/versions/{version:012d}.json")
        if text is None:
            raise ValueError(f"{self.path} has no version {version}")
        return json.loads(text)

    def _commit(self, before: dict | None, folders: dict[str, list[str]], schema: StructType, source: str | None, number: int | None) -> int:
        version = before["version"] + 1 if before else 0
        applied = dict(before["applied"]) if before else {}
        if source is not None:
            applied[source] = number
        made = {"version": version, "folders": folders, "schema": schema.json(), "applied": applied}
        if not store.put_new(self.spark, f"{self.path}/versions/{version:012d}.json", json.dumps(made)):
            raise ConflictProblem(f"version {version} of {self.path} was made by another writer")
        return version

    @staticmethod
    def _applied(before: dict | None, source: str | None, number: int | None) -> bool:
        return before is not None and source is not None and before["applied"].get(source, -1) >= number

    # reading
    def _folders(self, manifest: dict, parts: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/{f}" for p, fs in sorted(manifest["folders"].items()) if parts is None or p in parts for f in fs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The newest or a given version; ``parts``: only these values of ``by``, whose folders alone are read."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"there is no table at {self.path}")
        return self._folders(found, parts)

    # writing
    def _part(self):
        return F.coalesce(F.col(self.by).cast("string"), F.lit("none")) if self.by else F.lit(_NONE)

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders ``data/<id>/part=<value>``, by value."""
        name = f"data/{uuid.uuid4().hex}"
        (rows.withColumn("__part", self._part()).repartition("__part") if self.by else rows.withColumn("__part", self._part())).write.partitionBy("__part").parquet(f"{self.path}/{name}")
        found = [n for n in store.names_in(self.spark, f"{self.path}/{name}") if n.startswith("__part=")]
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n.removeprefix("__part=")): [f"{name}/{n}"] for n in found}

    def append(self, rows: DataFrame, source: str | None = None, number: int | None = None) -> int:
        """Rows after those that are there; the version they are in."""
        before = self.manifest()
        if self._applied(before, source, number):
            return before["version"]
        folders = {p: list(f) for p, f in before["folders"].items()} if before else {}
        for p, new in self._write(rows).items():
            folders.setdefault(p, []).extend(new)
        return self._commit(before, folders, rows.schema, source, number)

    def upsert(self, rows: DataFrame, source: str | None = None, number: int | None = None, order: Sequence[str] = ()) -> int:
        """Rows in place of those with equal keys; of equal keys in ``rows`` the last by ``order`` (else by all columns).

        Equal keys must be in one partition: ``by`` follows from the keys.
        """
        if not self.keys:
            raise ValueError("an upsert needs keys")
        before = self.manifest()
        if self._applied(before, source, number):
            return before["version"]
        rest = [c for c in rows.columns if c not in self.keys]
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(F.desc(c) for c in (order or rest or self.keys))))
        fresh = rows.withColumn("__place", place).where("__place = 1").drop("__place")
        folders = {p: list(f) for p, f in before["folders"].items()} if before else {}
        merged = fresh
        if before:
            touched = [r[0] for r in rows.select(self._part()).distinct().collect()]  # partitions, not rows
            kept = self._folders(before, touched)
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            kept = kept.alias("o").join(fresh.select(*self.keys).alias("n"), same, "left_anti")
            merged = kept.unionByName(fresh, allowMissingColumns=True)
        folders.update(self._write(merged))
        return self._commit(before, folders, merged.schema, source, number)

    def expire(self, keep: int = 2) -> list[int]:
        """Remove all but the newest ``keep`` versions, and every folder that these do not name (broken-off batches too).

        Not while a batch is being written.
        """
        every = self.versions()
        old, kept = every[: -max(1, keep)], every[-max(1, keep) :]
        named = {f for v in kept for fs in self.manifest(v)["folders"].values() for f in fs}
        for v in old:
            store.remove(self.spark, f"{self.path}/versions/{v:012d}.json")
        for name in store.names_in(self.spark, f"{self.path}/data"):
            inside = [f"data/{name}/{p}" for p in store.names_in(self.spark, f"{self.path}/data/{name}") if p.startswith("__part=")]
            if not any(f in named for f in inside):
                store.remove(self.spark, f"{self.path}/data/{name}")
            else:
                for f in inside:
                    if f not in named:
                        store.remove(self.spark, f"{self.path}/{f}")
        return old
