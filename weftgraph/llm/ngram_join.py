"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles. Each shingle flips one bit of a bit
sketch, so the Hamming distance of two sketches is at most the symmetric difference of
the sets. Two sets of similarity 0.8 or more differ in at most (|A| + |B|) / 9 shingles.

Per size band a wide sketch (2^32 bits a part, held as one XOR of bit hashes for each part)
is cut into a fixed number of parts, and the pigeonhole principle makes linked sets agree in
whole parts; sets that share a part are candidates. Candidates are compared by a dense sketch of as many
bits as the set has shingles (1024 at least), whose Hamming distance must not exceed the bound, and what is
left is verified on the whole sets.

Number of parts for a largest distance D: D + 1 + slack, which makes agreement in a part
that isn't empty certain (a set with more empty parts than slack emits those too). For
large D fewer parts do: the differing shingles are spread by hash, and parts are chosen so
that AGREE of them stay untouched on average at the threshold itself; then the chance of
missing a pair is about exp(-AGREE) at most, and falls fast above the threshold.

Equal sets form one class. Inside a shared part, classes are linked to the smallest class
(a star), never in all pairs. In parts whose classes are then still in different components, the dense
sketches of all classes are compared with each other, block by block in tasks, and the pairs between components that
pass are verified. Where these are more than a few for each class, the task's classes go on instead of its pairs,
and their whole sets are compared in a task, which a spanning forest of true links leaves.

Stars and these pairs give the components, not every link. A link never leaves its component, so
links are counted afterwards: the whole sets of a component are compared with each other, block
by block in tasks, and one count for each class of a block leaves the task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tokens import U, chunks, mix, shingle_sets
from weftgraph.session import Scratch

THRESHOLD = (80, 100)
AGREE = 14.0
#: Longs of the dense sketch at least; it has a bit for each shingle of a larger set.
DENSE = 16
#: Classes of a part that one task compares with as many others.
BLOCK = 1024
#: Shingles of a part's classes that one task compares with as many others, and pairs for each class of a cell that may leave it.
BLOCK_SHINGLES = 1_000_000
CELL_PAIRS = 4
#: Classes of a component, and their shingles, that one task compares with as many others to count links.
COUNT_BLOCK = 512
COUNT_SHINGLES = 1_000_000
#: Shingles whose occurrences are multiplied at a time.
SLAB = 4096
#: Links that a task contracts at a time.
CONTRACT = 1_000_000
#: Rows of a part that a map task combines before it passes them on.
COMBINE = 400_000
#: Texts that one verifying group compares with its hub.
SALT_ROWS = 256
#: Ids that may be broadcast to pick texts (16 MB); beyond that the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def band_starts(limit: int) -> list[int]:
    """Smallest set size of each band: a band ends where 1.25 times its start ends."""
    starts = [1]
    while starts[-1] <= limit:
        starts.append(starts[-1] * 5 // 4 + 1)
    return starts


_STARTS = band_starts(1 << 40)
_EDGES = np.array(_STARTS)


def parts(distance: int) -> tuple[int, int | None]:
    """Number of parts for a largest distance; slack, or None where agreement is by spread."""
    slack = 4 + distance // 10
    exact = distance + 1 + slack
    k = max(1, int(distance / 8))
    while k * math.exp(-distance / k) < AGREE:
        k += 1 + k // 64
    return (exact, slack) if exact <= k else (k, None)


_PARTS: dict[int, tuple[int, int | None]] = {}


def part_keys(shingles: np.ndarray) -> np.ndarray:
    """The 64-bit keys under which a set meets its candidates.

    Band j holds pairs whose smaller set is in size band j - 1, so a set emits the sketches
    of its own band and of the next one. Sets of fewer than four shingles link to equal sets only.
    """
    n = len(shingles)
    if n < 4:
        return shingles[:0]
    own = int(np.searchsorted(_EDGES, n, side="right")) - 1
    out = []
    for band in (own, own + 1):
        distance = (_STARTS[band] - 1) // 4
        if distance < 1:
            continue
        if band not in _PARTS:
            _PARTS[band] = parts(distance)
        k, slack = _PARTS[band]
        salted = mix(shingles + U(band * 0x9E37 + 1))
        sketch = np.zeros(k, U)
        # The part's odd bits, as the XOR of their hashes: a bit that is flipped twice cancels.
        np.bitwise_xor.at(sketch, ((salted >> U(32)) % U(k)).astype(np.int64), mix(salted & U(0xFFFFFFFF)))
        keys = mix(mix(sketch + U(0x51ED27)) + np.arange(k, dtype=U) * U(0x2545F4914F6CDD1D) + U(band * 0x9E3779B97F4A7C15 % (1 << 64)))
        full = sketch != 0
        out.append(keys if slack is not None and k - int(full.sum()) > slack else keys[full])
    return np.concatenate(out) if out else shingles[:0]


def dense_sketch(shingles: np.ndarray) -> np.ndarray:
    """Longs whose bit i is the parity of the shingles that hash to i: a power of two of them, and a bit for each shingle at least.

    The hash's low bits say where, so a sketch's halves XORed are the sketch of half as many bits.
    """
    bits = max(64 * DENSE, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles + U(0xD1B54A32)) >> U(20) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((odd & 1).astype(np.uint8), bitorder="little").view(np.int64)


def folded(sketches: np.ndarray, longs: int) -> np.ndarray:
    """Rows of sketches brought down to so many longs."""
    while sketches.shape[1] > longs:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short(cls: bytes) -> int:
    """A class's 64-bit name among candidates; verification goes by whole digests."""
    return int.from_bytes(cls[:8], "little", signed=True)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("name", pa.int64()), ("dense", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, texts in chunks(batch.column(1)):
            ns, classes, names, dense, keys = [], [], [], [], []
            for s in shingle_sets(texts):
                ns.append(len(s))
                classes.append(digest(s) if len(s) else None)
                names.append(short(classes[-1]) if len(s) else None)
                dense.append(dense_sketch(s) if len(s) else None)
                keys.append(part_keys(s).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(ns, pa.int64()), pa.array(classes, pa.binary()), pa.array(names, pa.int64()), pa.array(dense, pa.list_(pa.int64())), listed], schema=_SETS)


def shingle_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n (set size), cls (digest of the set, null if empty), name, dense, keys."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sets, "doc_id long, n long, cls binary, name long, dense array<long>, keys array<long>")


_ROWS = pa.schema([("part", pa.int64()), ("hub", pa.int64()), ("name", pa.int64())])
_SALTED = pa.schema([*_ROWS, ("salt", pa.int32())])


def _starred(part: np.ndarray, name: np.ndarray) -> list[np.ndarray]:
    """Distinct (part, name) with the first name of each part as its hub; salt 0 for the hubs themselves."""
    order = np.lexsort((name, part))
    part, name = part[order], name[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (name[1:] != name[:-1])
    part, name = part[new], name[new]
    first = np.ones(len(part), bool)
    first[1:] = part[1:] != part[:-1]
    hub = name[first][np.cumsum(first) - 1]
    return [part, hub, name, np.where(first, 0, 1 + (name & 63)).astype(np.int32)]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a map task: a part's first class stands for its others, which are tied to it here and needn't meet again."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = _starred(np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SALTED)

    for batch in batches:
        names, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = keys.value_lengths().to_numpy(zero_copy_only=False)
        held.append((keys.flatten().to_numpy(zero_copy_only=False), np.repeat(names, lengths)))
        size += len(held[-1][0])
        if size >= COMBINE:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties the tasks' hubs of a part to the first of them; other rows pass. A part may go on in the next batch."""
    last, head = None, None
    for batch in batches:
        part, hub, name, salt = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(4))
        if not len(part):
            continue
        top = salt == 0
        p, h = part[top], hub[top]
        if len(p):
            at = np.maximum.accumulate(np.where(np.concatenate(([True], p[1:] != p[:-1])), np.arange(len(p)), 0))
            heads = h[at]
            if p[0] == last:
                heads[at == 0] = head
            last, head = p[-1], heads[-1]
            hub[top] = heads
        keep = hub != name
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(part[keep]), pa.array(hub[keep]), pa.array(name[keep])], schema=_ROWS)


def candidates(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, hub, name): classes that share a part, each tied to a smaller one. One shuffle of narrow rows.

    The rows of a part that meet in one task are one for each map task at most, however large the part is.
    """
    rows = sets.filter("n >= 4").select("name", "keys").mapInArrow(_combine, "part long, hub long, name long, salt int")
    met = rows.repartition("part", "salt").sortWithinPartitions("part", "salt", "name").mapInArrow(_merge, "part long, hub long, name long")
    return scratch.save(met)


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * |x & y| >= 80 * |x | y|, for sorted distinct arrays."""
    share, of = THRESHOLD
    if of * min(len(x), len(y)) < share * max(len(x), len(y)) or not len(x):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return of * both >= share * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, top, name, text) in order: the texts of a hub, then those to compare with it.

    The hub's name is 64 bits, so several classes may bear it; each is compared.
    """
    at: tuple[int, int] | None = None
    hubs: dict[bytes, np.ndarray] = {}
    for batch in batches:
        a, b = [], []
        hub, salt, top, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for first, texts in chunks(batch.column(4)):
            for i, s in enumerate(shingle_sets(texts), first):
                cls = digest(s)
                if at != (hub[i], salt[i]):
                    at, hubs = (hub[i], salt[i]), {}
                if short(cls) != name[i]:
                    continue  # another text of a doc_id that occurs more than once
                if top[i]:
                    hubs[cls] = s
                else:
                    found = [h for h, t in hubs.items() if h != cls and linked(s, t)]
                    a += found
                    b += [cls] * len(found)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINKS)


def near(pairs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the distinct (hub, name) pairs whose sizes and dense sketches allow similarity 0.8."""
    share, of = THRESHOLD
    side = classes.select("name", "n", "dense")
    both = pairs.join(side.select(F.col("name").alias("hub"), F.col("n").alias("hub_n"), F.col("dense").alias("hub_dense")), "hub").join(side, "name")
    # Of sizes that fit one sketch has twice the longs of the other at most.
    half = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(half("dense", "hub_dense"), half("hub_dense", "dense"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    fits = (F.least("n", "hub_n") * of >= F.greatest("n", "hub_n") * share) & (differ * (of + share) <= (of - share) * (F.col("n") + F.col("hub_n")))
    return scratch.save(both.filter(fits).select("hub", "name"))


def texts_of(names: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, text) of the distinct names, written; a doc_id that occurs more than once gives each of its texts."""
    wanted = scratch.save(names.join(reps.select("name", "doc_id"), "name"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = wanted.select("doc_id", "name")
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return scratch.save(texts.join(ids, "doc_id").select("name", "text"))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Those of the distinct (hub, name) pairs whose sets are similar, as (a, b) digests, and the texts (name, text) that were compared.

    A hub's text goes once to each group of about SALT_ROWS texts that are compared with it.
    """
    pairs = near(pairs, reps, scratch)
    texts = texts_of(pairs.select("name").union(pairs.select("hub")).distinct(), reps, docs, scratch)
    n_hub = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n_hub"))
    salts = n_hub.select("hub", F.ceil(F.col("n_hub") / SALT_ROWS).alias("salts"))
    below = pairs.join(salts, "hub").select("hub", "name", (F.xxhash64("name") % F.col("salts")).alias("salt")).join(texts, "name")
    above = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("name", "hub"), "hub")
    below = below.select("hub", F.abs("salt").cast("long").alias("salt"), F.lit(0).alias("top"), "name", "text")
    above = above.select("hub", F.col("salt").cast("long"), F.lit(1).alias("top"), F.col("hub").alias("name"), "text")
    both = above.unionByName(below).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("top"))
    return scratch.save(both.mapInArrow(_verify, "a binary, b binary").distinct()), texts


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as stars: each name with the smallest that the links of this task reach from it."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def flush() -> pa.RecordBatch:
        rows = [(x, top(x)) for x in above]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
        if len(above) > CONTRACT:
            yield flush()
            above.clear()
    if above:
        yield flush()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, root): for every class in a link, the smallest class that its links reach.

    Links are contracted inside tasks, then large-star and small-star steps alternate, so the number of rounds
    grows with the logarithm of a component at most; each round is a shuffle of the links.
    """
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
    stars = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).repartition("v").mapInArrow(_contract, "u binary, v binary")
    edges = scratch.save(stars.distinct())
    now = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.save(small.select("e.u", "e.v").filter("u <> v").distinct())
        scratch.drop(edges)
        edges, before = after, now
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))


def links_within(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whether each of the sets at ``rows`` is similar to each at ``columns``, exactly: shared shingles are counted by products of occurrence matrices."""
    share, of = THRESHOLD
    n = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    kinds, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set is shared with none.
    number = np.cumsum(times > 1) - 1
    kept = times[at] > 1
    owner, at = owner[kept], number[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(rows), len(columns)))
    edges = np.searchsorted(at, np.arange(0, int(number[-1]) + 1 + SLAB, SLAB)) if len(kinds) else np.zeros(1, np.int64)
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a < b:
            occurs = np.zeros((len(sets), SLAB), np.float32)
            occurs[owner[a:b], at[a:b] - k * SLAB] = 1
            both += occurs[rows] @ occurs[columns].T
    return of * both >= share * (n[rows][:, None] + n[columns][None, :] - both)


_COUNTS = pa.schema([("cls", pa.binary()), ("n_links", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, block, cls, text) in order of (root, i, j): for each class of a cell its links in the cell. A cell may go on in the next batch."""

    def cell(held: dict[bytes, tuple[int, np.ndarray]], at: tuple) -> Iterator[tuple[bytes, int]]:
        names, sets = list(held), [x for _, x in held.values()]
        block = np.array([x for x, _ in held.values()])
        rows = np.flatnonzero(block == at[1])
        columns = np.flatnonzero(block == at[2])
        if len(names) <= 4:
            fits = np.array([[linked(sets[x], sets[y]) for y in columns] for x in rows], bool).reshape(len(rows), len(columns))
        else:
            fits = links_within(sets, rows, columns)
        if at[1] == at[2]:
            np.fill_diagonal(fits, False)
        else:
            yield from ((names[c], k) for c, k in zip(columns.tolist(), fits.sum(axis=0).tolist(), strict=True) if k)
        yield from ((names[r], k) for r, k in zip(rows.tolist(), fits.sum(axis=1).tolist(), strict=True) if k)

    held: dict[bytes, tuple[int, np.ndarray]] = {}
    at: tuple | None = None
    for batch in batches:
        found: list[tuple[bytes, int]] = []
        root, i, j, block, names = (batch.column(c).to_pylist() for c in range(5))
        for first, texts in chunks(batch.column(5)):
            for x, s in enumerate(shingle_sets(texts), first):
                here = (root[x], i[x], j[x])
                if here != at:
                    found += cell(held, at) if held else ()
                    at, held = here, {}
                if digest(s) == names[x]:  # else another text of a doc_id that occurs more than once
                    held[names[x]] = (block[x], s.copy())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.binary()), pa.array([k for _, k in found], pa.int64())], schema=_COUNTS)
    if held and (found := list(cell(held, at))):
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.binary()), pa.array([k for _, k in found], pa.int64())], schema=_COUNTS)


def link_counts(members: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, n_links): with how many other classes of its component (cls, root) each class is similar.

    A component of more than COUNT_BLOCK classes or COUNT_SHINGLES shingles is cut into blocks, and each text goes to one
    cell for each block. No pair leaves its task. ``texts`` (name, text) holds those of all members, some more than once.
    """
    rows = scratch.save(members.join(classes.select("cls", "name", "n"), "cls"))
    size = rows.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK), F.ceil(F.sum("n") / COUNT_SHINGLES)).cast("int").alias("blocks"))
    placed = rows.join(size, "root").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cells = placed.select("root", "cls", "name", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.join(texts, "name")
    cells = cells.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cls", "text")
    counts = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_count, "cls binary, n_links long")
    return scratch.save(counts.groupBy("cls").agg(F.sum("n_links").alias("n_links")))


def similarity_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """For each document its set size, its class and the smallest doc_id it is linked with.

    Returns doc_id, n_shingles, class_id (hex; null for an empty set), class_rows, n_links (other classes that
    its class is similar to; null unless ``count_links``), component_id. Rows in any order, one for each row of ``docs``.

    Null text and texts without words: an empty set, linked with nothing, component_id = doc_id.
    Rows of equal sets, also of one doc_id, are one class. A row without doc_id never links
    and has a null component_id. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    sets = scratch.save(shingle_classes(docs))
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("cls", "name", "n").agg(F.min("doc_id").alias("doc_id"), F.first("dense").alias("dense"), F.count(F.lit(1)).alias("class_rows"))
    classes = scratch.save(classes)
    met = candidates(sets.filter("doc_id is not null"), scratch)
    pairs = scratch.save(met.select("hub", "name").distinct())
    links, texts = verified(pairs, classes, docs, scratch)
    roots = components(links, scratch)
    # What is still apart after the stars is compared whole.
    compared = scratch.save(between_components(met, classes, roots, scratch))
    across = scratch.save(compared.filter("hub is not null").select("hub", "name").distinct().join(pairs, ["hub", "name"], "left_anti"))
    new = []
    if not across.isEmpty():
        new.append(verified(across, classes, docs, scratch))
    crowded = compared.filter("hub is null")
    if not crowded.isEmpty():
        new.append(linked_within_cells(crowded, classes, docs, scratch))
    # Links inside the components found so far say nothing new about them.
    known = roots.select(F.col("cls").alias("a"), F.col("root").alias("b"))
    more = False
    for found, read in new:
        texts = texts.union(read)
        if not found.isEmpty():
            known, more = known.union(found), True
    if more:
        roots = components(known, scratch)
    scratch.drop(met)
    members = scratch.save(roots.union(roots.select(F.col("root").alias("cls"), "root").distinct()))
    found = classes.select("cls", "doc_id", "class_rows").join(members, "cls", "left")
    if count_links:
        found = found.join(link_counts(members, classes, texts, scratch), "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    else:
        found = found.withColumn("n_links", F.lit(None).cast("long"))
    found = scratch.save(found)
    lowest = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    found = found.join(lowest, "root", "left").select("cls", "class_rows", "n_links", F.coalesce("lowest", "doc_id").alias("component_id"))
    none = F.lit(0 if count_links else None).cast("long")
    return (
        sets.select("doc_id", "n", "cls").join(found, "cls", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.lower(F.hex("cls")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.coalesce("n_links", none).alias("n_links"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )


def _linking(rows: np.ndarray, columns: np.ndarray, fits: np.ndarray, label: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the pairs that fit, those that join two sets of components not joined yet; ``label`` is kept up to date."""
    for x, r in enumerate(rows.tolist()):
        near = columns[fits[x]]
        there = label[of[near]]
        other = there != label[of[r]]
        if other.any():
            joined, first = np.unique(there[other], return_index=True)
            yield from ((r, c) for c in near[other][first].tolist())
            label[np.isin(label, joined)] = label[of[r]]


_CELL = pa.schema([("part", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("hub", pa.int64()), ("name", pa.int64()), ("root", pa.int64())])
_CELL_DDL = "part long, i int, j int, block int, hub long, name long, root long"


def _comparer():
    """Rows (part, i, j, block, name, root, n, dense) in order of (part, i, j): the pairs (hub, name) of a cell between components whose sketches allow similarity 0.8.

    A cell is a block against itself or two blocks against each other; a cell may go on in the next batch. Where its pairs
    are more than CELL_PAIRS for each class, it gives the classes that they are of instead, without a hub.
    """
    share, of = THRESHOLD

    def cell(held: list[tuple], at: tuple) -> pa.RecordBatch | None:
        block, name, root, n = (np.concatenate([h[i] for h in held]) for i in range(4))
        longs = min(x.shape[1] for h in held for _, x in h[4])
        dense = np.empty((len(name), longs), U)
        done = 0
        for h in held:
            for where, x in h[4]:
                dense[done + where] = folded(x, longs)
            done += len(h[0])
        rows = np.flatnonzero(block == at[1])
        columns = rows if at[1] == at[2] else np.flatnonzero(block == at[2])
        found: list[np.ndarray] = []
        near = np.zeros(len(name), bool)
        total = 0
        for first in range(0, len(rows), 64):
            r = rows[first : first + 64]
            differ = np.zeros((len(r), len(columns)), np.int64)
            for k in range(longs):
                differ += np.bitwise_count(dense[r, k][:, None] ^ dense[columns, k][None, :])
            small, large = np.minimum.outer(n[r], n[columns]), np.maximum.outer(n[r], n[columns])
            x, y = np.nonzero((differ * (of + share) <= (of - share) * (small + large)) & (small * of >= large * share) & (root[r][:, None] != root[columns][None, :]))
            total += len(x)
            near[r[x]] = near[columns[y]] = True
            if total <= CELL_PAIRS * len(name):
                found.append(np.column_stack([name[r[x]], name[columns[y]]]))
        if total > CELL_PAIRS * len(name):
            which = np.flatnonzero(near)
            size = len(which)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, at[0]), pa.int64()), *[pa.array(np.full(size, x), pa.int32()) for x in at[1:]], pa.array(block[which], pa.int32()), pa.nulls(size, pa.int64()), pa.array(name[which]), pa.array(root[which])], schema=_CELL)
        pairs = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        none = lambda t: pa.nulls(len(pairs), t)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(pa.int64())], schema=_CELL) if len(pairs) else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at: tuple | None = None
        for batch in batches:
            part, i, j, block, name, root, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            lengths = batch.column(7).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(7).flatten().to_numpy(zero_copy_only=False).view(U)
            begins = np.cumsum(lengths) - lengths
            cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))).tolist() if len(part) else []
            for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
                here = (part[a], i[a], j[a])
                if held and here != at:
                    if (out := cell(held, at)) is not None:
                        yield out
                    held = []
                at = here
                dense = []
                for size in np.unique(lengths[a:b]).tolist():
                    where = np.flatnonzero(lengths[a:b] == size)
                    dense.append((where, flat[begins[a + where][:, None] + np.arange(size)]))
                held.append((block[a:b], name[a:b], root[a:b], n[a:b], dense))
        if held and (out := cell(held, at)) is not None:
            yield out

    return compare


def between_components(met: DataFrame, classes: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """What `_comparer` gives of classes that share a part and are in different components.

    Parts within one component are done. A part of more than BLOCK classes is cut into blocks, and each
    class goes to one cell for each block, where it meets BLOCK others. Rows are a class's sketch, not its text.
    """
    part_of = met.select("part", F.col("hub").alias("name")).union(met.select("part", "name")).distinct()
    root_of = scratch.save(classes.join(roots, "cls", "left").groupBy("name").agg(F.min(F.xxhash64(F.coalesce("root", "cls"))).alias("root"), F.max("n").alias("n")))
    members = part_of.join(root_of, "name")
    mixed = members.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).filter("lo <> hi and members > 2")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = members.drop("n").join(mixed.select("part", blocks.alias("blocks")), "part").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    cells = members.select("part", "name", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("part", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "name", "root")
    rows = cells.join(classes.select("name", "n", "dense"), "name").select("part", "i", "j", "block", "name", "root", "n", "dense")
    return rows.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(_comparer(), _CELL_DDL)


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, i, j, block, name, root, text) in order of (part, i, j): a spanning forest of the links of each cell between components."""

    def forest(held: dict[bytes, tuple[int, int, np.ndarray]], at: tuple) -> list[tuple[bytes, bytes]]:
        names, block, root = list(held), np.array([x[0] for x in held.values()]), np.array([x[1] for x in held.values()])
        rows, columns = np.flatnonzero(block == at[1]), np.flatnonzero(block == at[2])
        if not len(rows) or not len(columns):
            return []
        fits = links_within([x[2] for x in held.values()], rows, columns) & (root[rows][:, None] != root[columns][None, :])
        kinds, kind_of = np.unique(root, return_inverse=True)
        return [(names[x], names[y]) for x, y in _linking(rows, columns, fits, np.arange(len(kinds)), kind_of)]

    held: dict[bytes, tuple[int, int, np.ndarray]] = {}
    at: tuple | None = None
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        part, i, j, block, name, root = (batch.column(c).to_pylist() for c in range(6))
        for first, texts in chunks(batch.column(6)):
            for x, s in enumerate(shingle_sets(texts), first):
                here = (part[x], i[x], j[x])
                if here != at:
                    found += forest(held, at) if held else ()
                    at, held = here, {}
                cls = digest(s)
                if short(cls) == name[x]:  # else another text of a doc_id that occurs more than once
                    held[cls] = (block[x], root[x], s.copy())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], schema=_LINKS)
    if held and (found := forest(held, at)):
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], schema=_LINKS)


def linked_within_cells(crowded: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between components in the cells of ``crowded``, a spanning forest of each, from the whole sets; and the texts compared."""
    texts = texts_of(crowded.select("name").distinct(), classes, docs, scratch)
    rows = crowded.select("part", "i", "j", "block", "name", "root").join(texts, "name").select("part", "i", "j", "block", "name", "root", "text")
    return scratch.save(rows.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(_link_cells, "a binary, b binary").distinct()), texts


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that link to a smaller doc_id, directly or over others; columns as they came.

    A doc_id whose rows stay more than once keeps one row for each of its texts. Rows without doc_id stay.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.save(similarity_components(docs, count_links=False).select("doc_id", "component_id"))
    stay = scratch.save(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    once = stay.filter("rows = 1").select(F.col("doc_id").alias("stay_id"))
    if stay.count() <= BROADCAST_IDS:
        once = F.broadcast(once)
    key = F.col("doc_id").cast("long")
    kept = docs.join(once, key == F.col("stay_id"), "left_semi").union(docs.filter(key.isNull()))
    repeated = stay.filter("rows > 1").select(F.col("doc_id").alias("stay_id"))
    if repeated.isEmpty():
        return kept
    return kept.union(docs.join(repeated, key == F.col("stay_id"), "left_semi").dropDuplicates(["doc_id", "text"]))
