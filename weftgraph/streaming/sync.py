"""Incremental index runs over a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.generations import Conflict, GenerationStore

FILE_VERSIONS = "path string, content string, deleted boolean, version long"


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    return versions.groupBy("path").agg(F.max_by(F.struct("content", "deleted", "version"), "version").alias("v")).select("path", "v.*")


def sync_batch(store: GenerationStore, versions: DataFrame) -> str:
    """Applies one batch of file versions to the files table and publishes the result.

    Versions that aren't newer than the stored ones are left out. Deleted paths keep their version in a table of tombstones, so
    a late older version doesn't bring them back.
    """
    parent = store.active()
    new = latest(versions)
    generation = store.candidate()
    fresh = new.filter("not deleted").select("path", "content", "version", F.sha2("content", 256).alias("content_hash"))
    gone = new.filter("deleted").select("path", "version")
    if parent is None:
        store.write(generation, "files", fresh)
        store.write(generation, "tombstones", gone)
    else:
        stored = store.read("files", parent).select("path", F.col("version").alias("stored")).union(store.read("tombstones", parent).select("path", F.col("version").alias("stored")))
        late = stored.join(new, "path").filter("version <= stored").select("path")
        new = new.join(late, "path", "left_anti")
        store.copy_forward(generation, "files", new.select("path"), fresh.join(late, "path", "left_anti"), "path")
        store.copy_forward(generation, "tombstones", new.select("path"), gone.join(late, "path", "left_anti"), "path")
    store.publish(generation, parent)
    return generation


def sync_stream(versions: DataFrame, store: GenerationStore, checkpoint: str, retries: int = 3):
    """A streaming query that syncs each micro-batch; a batch that loses the race for the pointer is built again on the new parent."""

    def apply(batch: DataFrame, _: int) -> None:
        for attempt in range(retries):
            try:
                sync_batch(store, batch)
                return
            except Conflict:
                if attempt + 1 == retries:
                    raise

    return versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
