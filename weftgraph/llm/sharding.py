"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each node every child draws -ln(u) / weight with u
hashed from key and child, and the smallest draw wins, so children win in proportion to
their weights. A subtree's leaves of one epoch share one straw per level: a leaf added in a
new epoch adds one straw at the root, and the keys that this straw wins descend among leaves
of that epoch only. So an added shard takes rows only into itself, whichever rack holds it,
and a changed weight moves keys only into or out of the subtrees on its path.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the bucket that numbers slots: 4096 buckets a shard.
BUCKET_DIGITS = 3
_DRAW_DIGITS = 12


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0
    epoch: int = 0


#: Two regions of two racks of two shards.
EIGHT = tuple(Leaf(i, f"r{i // 4}", f"k{i // 2}") for i in range(8))


def grown(leaves: tuple[Leaf, ...]) -> tuple[Leaf, ...]:
    """With one more shard of mean weight, in the lightest rack and a new epoch."""
    load: dict[tuple[str, str], float] = {}
    for leaf in leaves:
        load[leaf.region, leaf.rack] = load.get((leaf.region, leaf.rack), 0.0) + leaf.weight
    region, rack = min(load, key=lambda k: (load[k], k))
    return (*leaves, Leaf(max(x.shard for x in leaves) + 1, region, rack, sum(x.weight for x in leaves) / len(leaves), max(x.epoch for x in leaves) + 1))


def levels(leaves: tuple[Leaf, ...]) -> list[list[list[tuple[str, float, int]]]]:
    """For each level the children of each node of the level above: (straw name, weight, number on its own level)."""
    paths = [((f"{x.region}@{x.epoch}",), (f"{x.region}/{x.rack}@{x.epoch}",), (f"{x.region}/{x.rack}/{x.shard}@{x.epoch}",)) for x in leaves]
    out, above = [], [""] * len(leaves)
    numbers: dict[str, int] = {"": 0}
    for depth in range(3):
        children: list[list[tuple[str, float, int]]] = [[] for _ in numbers]
        own: dict[str, int] = {}
        for i, leaf in enumerate(leaves):
            name = paths[i][depth][0]
            if name not in own:
                own[name] = leaf.shard if depth == 2 else len(own)
                weight = sum(y.weight for j, y in enumerate(leaves) if paths[j][depth][0] == name)
                children[numbers[above[i]]].append((name, weight, own[name]))
            above[i] = name
        out.append(children)
        numbers = own
    return out


def shard_of(key: Column, leaves: tuple[Leaf, ...]) -> Column:
    """The shard that a string key descends to."""
    node = F.lit(0)
    for children in levels(leaves):
        literal = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("number")) for n, w, k in c]) for c in children])

        def draw(c: Column) -> Column:
            u = (F.conv(F.substring(F.md5(F.concat(c["name"], F.lit("|"), key)), 1, _DRAW_DIGITS), 16, 10).cast("double") + 1) / float(16**_DRAW_DIGITS)
            return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["number"].alias("number"))

        node = F.array_min(F.transform(F.element_at(literal, node + 1), draw))["number"]
    return node


def keyed(docs: DataFrame, leaves: tuple[Leaf, ...] = EIGHT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, size, text_crc32, law, shard, grown_shard, bucket of each row.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that of the bytes (null: 0). Rows
    without doc_id share the empty key. Repeated doc_ids go to one shard, as the law `key` says.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The draws go by the key alone, which the first projection holds, so that it isn't cast for each of them.
    rows = docs.select("doc_id", *carry, key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.select(
        "doc_id", *carry, "size", "text_crc32", F.lit("key").alias("law"), shard_of(F.col("key"), leaves).alias("shard"), shard_of(F.col("key"), grown(leaves)).alias("grown_shard"),
        F.substring(F.md5(F.concat_ws("|", "key", "text_crc32", "size")), 1, BUCKET_DIGITS).alias("bucket"),
    )


def shard_table(docs: DataFrame, leaves: tuple[Leaf, ...] = EIGHT) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: slots count each shard's rows from 0 without gaps.

    Rows are numbered in buckets of a shard, whose offsets are summed over at most shards * 4096
    counts. Equal rows are counted before the shuffle and numbered together, so no bucket is hot.
    Null and empty texts have size 1; rows without doc_id share one key. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    same = ["doc_id", "size", "text_crc32", "law", "shard", "grown_shard", "bucket"]
    rows = keyed(docs, leaves).groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    # Both branches read the same shuffled counts, so texts are scanned and hashed once.
    rows = rows.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(_offsets(rows, F.sum("copies")), ["shard", "bucket"])
    first = F.col("offset") + F.col("before")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard")


def _offsets(rows: DataFrame, number: Column) -> DataFrame:
    counts = rows.groupBy("shard", "bucket").agg(number.alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * 4096 rows of some 40 bytes, whatever the input.
    return F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))


def sharded_documents(docs: DataFrame, leaves: tuple[Leaf, ...] = EIGHT) -> DataFrame:
    """The documents themselves with shard and slot: doc_id, text, lang, source, n_chars, size, text_crc32, law, shard, slot, grown_shard.

    One shuffle takes each row to its bucket of a shard. Rows are numbered as in ``shard_table``; equal rows of one key share
    a bucket. Other columns are dropped. An empty table gives no rows.
    """
    rows = keyed(docs, leaves, ("text", "lang", "source", "n_chars"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("nth", F.row_number().over(within) - 1).join(_offsets(keyed(docs, leaves), F.count(F.lit(1))), ["shard", "bucket"])
    return rows.select("doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("nth")).alias("slot"), "grown_shard")
