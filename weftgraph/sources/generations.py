"""Generations: immutable Parquet snapshots of tables, published by the next numbered pointer."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The active generation isn't the one that the candidate was built on."""


class GenerationStore:
    """Tables under ``root``; a candidate is written beside the active generation and becomes active as a whole.

    All file access is Hadoop's, so the root may be on any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, folder = self._fs(self.root)
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n.removeprefix("ACTIVE-")) for n in names if n.removeprefix("ACTIVE-").isdigit() and n.startswith("ACTIVE-"))

    def _latest(self) -> tuple[int, str | None]:
        """The number of the last pointer and the generation that it names."""
        numbers = self._pointers()
        if not numbers:
            return 0, None
        text = self.spark.read.text(f"{self.root}/ACTIVE-{numbers[-1]:012d}", wholetext=True).first().value
        return numbers[-1], json.loads(text)["generation"]

    def active(self) -> str | None:
        return self._latest()[1]

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation or self.active()}/{table}")

    def candidate(self) -> str:
        return uuid.uuid4().hex

    def write(self, generation: str, table: str, rows: DataFrame) -> None:
        """Replaces a table of a candidate."""
        if generation == self.active():
            raise Conflict("a published generation doesn't change")
        rows.write.mode("overwrite").parquet(f"{self.root}/{generation}/{table}")

    def copy_forward(self, generation: str, table: str, changed: DataFrame, fresh: DataFrame, owner: str = "file") -> None:
        """Rows of owners that didn't change, from the active generation, and the fresh rows. ``changed`` holds changed and removed owners."""
        before = self.read(table)
        kept = before.join(changed.select(owner).union(fresh.select(owner)).distinct(), owner, "left_anti")
        self.write(generation, table, kept.unionByName(fresh))

    def publish(self, generation: str, parent: str | None) -> None:
        """Makes a candidate active if its parent still is.

        Pointers are numbered and never change: the writer of the next number wins, and readers take the highest, so there is an
        active generation at any time. A pointer is written aside and put in place by an operation that fails where the number is taken: a
        hard link on local file systems, else a rename, which stores like HDFS refuse for existing targets. On stores
        whose rename overwrites, writers need a lock of their own.
        """
        number, now = self._latest()
        if now != parent:
            raise Conflict(f"the active generation is {now}, not {parent}")
        fs, aside = self._fs(f"{self.root}/.{generation}.pointer")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"generation": generation, "parent": parent}).encode()))
        out.close()
        _, target = self._fs(f"{self.root}/ACTIVE-{number + 1:012d}")
        try:
            if not self._put(fs, aside, target):
                raise Conflict("another generation was published meanwhile")
        finally:
            fs.delete(aside, False)

    def _put(self, fs, aside, target) -> bool:
        if fs.getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(target) and fs.rename(aside, target)


def with_generation(rows: DataFrame, repo: str, generation: str) -> DataFrame:
    return rows.withColumn("repo", F.lit(repo)).withColumn("generation", F.lit(generation))
