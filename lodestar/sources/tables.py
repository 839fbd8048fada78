"""Updates and resumable appends of a stored table: only the files of the touched buckets are written again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StoredTable:
    """A table in a folder, cut into buckets by a hash of its key. Each commit writes one small list of the folders that make up the table.

    A change writes new folders for the buckets that it touches and then the next list. A list is created whole and only if its number is free, so of two
    writers one fails; what was written without a list is never read. Each change has a name, and a name that the list has is not applied again: a job that was
    killed at any time is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self) -> tuple[int, dict]:
        """The number and content of the last list."""
        found = [-1]
        if self._files.exists(self._hadoop.Path(f"{self.path}/lists")):
            names = [s.getPath().getName() for s in self._files.listStatus(self._hadoop.Path(f"{self.path}/lists"))]
            found += [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        last = max(found)
        if last < 0:
            return -1, {"folders": {}, "applied": [], "schema": None}
        text = self.spark.read.text(f"{self.path}/lists/{last:08d}.json", wholetext=True).first()[0]
        return last, json.loads(text)

    def _commit(self, number: int, content: dict) -> None:
        """Writes the list beside its place and gives it its name; a rename does not overwrite."""
        lists = f"{self.path}/lists"
        draft, name = self._hadoop.Path(f"{lists}/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{lists}/{number:08d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._files.exists(name) or not self._files.rename(draft, name):
            self._files.delete(draft, False)
            raise RuntimeError(f"another writer has committed {name}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as of the last list."""
        _, now = self._list()
        if now["schema"] is None:
            raise FileNotFoundError(self.path)
        folders = [f for b, fs in now["folders"].items() if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(now["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], now["schema"])

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """Writes rows in new folders, by bucket."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn("bucket of row", self.bucket()).write.partitionBy("bucket of row").parquet(folder)
        there = [s.getPath().getName() for s in self._files.listStatus(self._hadoop.Path(folder)) if s.isDirectory()]
        return {n.rpartition("=")[2]: [f"{folder}/{n}"] for n in there}

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of the rows' keys: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in df.select(self.bucket().alias("b")).distinct().collect())

    def append(self, df: DataFrame, name: str) -> bool:
        """Adds the rows whose key the table does not have; False if the change was made before. Of rows that share a key one is added. Only the buckets of
        the new keys are read, and no file is written again."""
        number, now = self._list()
        if name in now["applied"]:
            return False
        new = df.where(F.col(f"`{self.key}`").isNotNull()).dropDuplicates([self.key])
        if now["schema"] is not None:
            held = self.read(self.touched(new)).select(F.col(f"`{self.key}`"))
            new = new.join(held, self.key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
        folders = dict(now["folders"])
        for b, fs in self._write(new).items():
            folders[b] = folders.get(b, []) + fs
        self._commit(number + 1, {"folders": folders, "applied": [*now["applied"], name], "schema": now["schema"] or _ddl(df)})
        return True

    def update(self, changes: DataFrame, columns: list[str], name: str) -> bool:
        """Sets columns to the values that `changes` (a row for each key) has and that are not null; False if the change was made before. Keys
        that the table does not have are ignored. Only the buckets of the changed keys are read and written."""
        number, now = self._list()
        if name in now["applied"]:
            return False
        at = self.touched(changes.where(F.col(f"`{self.key}`").isNotNull()))
        base = self.read(at)
        given = changes.select(F.col(f"`{self.key}`"), *[F.col(f"`{c}`").alias(f"new {c}") for c in columns])
        both = base.join(given, self.key, "left")
        done = both.select(*[F.coalesce(F.col(f"`new {c}`"), F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in base.columns])
        folders = {b: fs for b, fs in now["folders"].items() if int(b) not in set(at)} | self._write(done)
        self._commit(number + 1, {"folders": folders, "applied": [*now["applied"], name], "schema": now["schema"]})
        return True

    def clean(self) -> int:
        """Deletes the folders and lists that the last list does not name, left by killed attempts and earlier states; how many. No writer or
        reader of an earlier list may be running."""
        number, now = self._list()
        used = {f.rpartition("/")[0] for fs in now["folders"].values() for f in fs}
        gone = 0
        for sub, keep in (("data", lambda p: f"{self.path}/data/{p}" in used), ("lists", lambda p: p == f"{number:08d}.json")):
            for s in self._files.listStatus(self._hadoop.Path(f"{self.path}/{sub}")):
                if not keep(s.getPath().getName()):
                    gone += self._files.delete(s.getPath(), True)
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
