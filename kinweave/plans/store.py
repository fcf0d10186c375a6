"""A graph store of layered Parquet tables with a commit log.

A table is a list of layers. A commit adds layers, never rewrites the table: rows with new keys, or a
patch that replaces or removes rows by key; what a commit costs follows its batch, not the table. Tables
without patches are read as a union of files. After ``MOST_LAYERS`` a table is written anew as one.

The log entry names every table's layers. It is made by a rename that fails if the version is taken, so
a reader sees a whole version or none, and of two writers one wins. A batch id makes a replay a no-op.
"""

from __future__ import annotations

import json
import uuid

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.schemas import TABLES, evolve_articles

MOST_LAYERS = 24
KEYS = {"people": "person_id", "aliases": "alias_id", "articles": "article_id", "relationships": "rel_id", "provenance": "prov_id"}


class Conflict(RuntimeError):
    """Another writer has made the version."""


@dataclass
class Change:
    """A batch's part in a table: rows with new keys, rows that replace those of their key, rows whose key goes."""

    added: DataFrame | None = None
    replaced: DataFrame | None = None
    removed: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/log"))

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def version(self) -> int:
        names = [int(x.getPath().getName().removesuffix(".json")) for x in self._fs.listStatus(self._path(f"{self.root}/log")) if x.getPath().getName().endswith(".json") and not x.getPath().getName().startswith("_")]
        return max(names, default=0)

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "batches": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/log/{version:010d}.json").collect()))  # one small file

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, self.entry(version)["tables"].get(name, []))

    def _layer(self, name: str, at: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.root}/{at}")
        gone = [F.col("__gone")] if "__gone" in found.columns else []
        return (evolve_articles(found) if name == "articles" and not gone else found.select(*TABLES[name].fieldNames(), *gone))

    def _read(self, name: str, layers: list[dict]) -> DataFrame:
        key, columns = KEYS[name], TABLES[name].fieldNames()
        rows, patches = None, None
        for layer in layers:
            df = self._layer(name, layer["at"]).withColumn("__n", F.lit(layer["n"]))
            if layer["kind"] == "patch":
                patches = df if patches is None else patches.unionByName(df)
            else:
                rows = df if rows is None else rows.unionByName(df)
        if rows is None:
            rows = self.spark.createDataFrame([], TABLES[name]).withColumn("__n", F.lit(0))
        if patches is None:
            return rows.select(*columns)
        last = patches.groupBy(key).agg(F.max_by(F.struct(*(c for c in patches.columns if c != key)), "__n").alias("p"))
        old = rows.join(last.select(key, F.col("p.__n").alias("__p")), key, "left").where("__p is null or __n >= __p").select(*columns)
        readded = rows.join(last.select(key, F.col("p.__n").alias("__p")), key).where("__n >= __p").select(key)
        new = last.where("not p.__gone").join(readded, key, "left_anti").select(*(c if c == key else F.col(f"p.{c}").alias(c) for c in columns))
        return old.unionByName(new)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name, version) for name in TABLES}

    def has_batch(self, stream: str, batch: int) -> bool:
        return self.entry()["batches"].get(stream, -1) >= batch

    def commit(self, changed: dict[str, DataFrame | Change], *, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """Writes changes, or whole tables, as the next version. ``base`` is the version that they were made from, else the last."""
        base = self.version() if base is None else base
        entry = self.entry(base)
        if batch and entry["batches"].get(batch[0], -1) >= batch[1]:
            return base
        n = base + 1
        for name, change in changed.items():
            held = entry["tables"].setdefault(name, [])
            write = lambda df, kind: {"at": self._write(name, n, df), "n": n, "kind": kind}  # noqa: B023,E731
            if isinstance(change, DataFrame):
                entry["tables"][name] = [write(change, "rows")]
                continue
            patch = None
            for df, gone in ((change.replaced, False), (change.removed, True)):
                if df is not None:
                    part = df.select(*TABLES[name].fieldNames(), F.lit(gone).alias("__gone"))
                    patch = part if patch is None else patch.unionByName(part)
            layers = [write(patch, "patch")] if patch is not None else []
            if change.added is not None:
                layers.append(write(change.added, "rows"))
            entry["tables"][name] = held + [x for x in layers if self._has_rows(x["at"])]
            if len(entry["tables"][name]) > MOST_LAYERS:
                entry["tables"][name] = [write(self._read(name, entry["tables"][name]), "rows")]
        if batch:
            entry["batches"][batch[0]] = batch[1]
        said = self._path(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = self._fs.create(said)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        target = self._path(f"{self.root}/log/{base + 1:010d}.json")
        try:
            done = not self._fs.exists(target) and self._fs.rename(said, target)
        except Py4JJavaError:
            done = False
        if not done:
            self._fs.delete(said, False)
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def _write(self, name: str, version: int, df: DataFrame) -> str:
        at = f"{name}/{version:010d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{at}")
        return at

    def _has_rows(self, at: str) -> bool:
        """Whether a layer has rows, from its files' footers."""
        return not self.spark.read.parquet(f"{self.root}/{at}").isEmpty()
