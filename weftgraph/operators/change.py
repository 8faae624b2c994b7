"""Change intelligence: changed symbols, impact of changes, affected tests, structural deltas, status, invalidation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators.resolve import is_test_file
from weftgraph.operators.traverse import IMPACT_TYPES, clamp, importer_closure
from weftgraph.session import Scratch, few


def symbol_key() -> Column:
    return F.concat_ws("\0", "file", "type", F.coalesce("qualified_name", "name"))


#: Lines of a bucket are a power of two; in a bucket, spans have at most 256 different first lines.
BUCKET_BITS = 8


def _spans(symbols: DataFrame) -> DataFrame:
    """symbols with their lines (lo, hi)."""
    end = F.coalesce("end_line", "start_line", F.lit(0))
    return symbols.withColumn("hi", end).withColumn("lo", F.coalesce("start_line", end))


def touching(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows (file, lo, hi and others) that share a line with a span (file, lo, hi) of their file, each once however many spans do.

    A row is touched if the last line of the spans that begin up to its end isn't before its beginning. That line is the largest of the buckets
    before the end's, carried over them, and of the spans in the end's bucket, so no row meets each span of a file and no file is one task's.
    """
    bucket = lambda line: F.shiftright(F.col(line), BUCKET_BITS).alias("bucket")
    asked = rows.select("file", bucket("hi")).distinct()
    last = spans.groupBy("file", bucket("lo")).agg(F.max("hi").alias("last"))
    upto = Window.partitionBy("file").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(asked, allowMissingColumns=True).groupBy("file", "bucket").agg(F.max("last").alias("last")).withColumn("carried", F.max("last").over(upto)).drop("last")
    inside = spans.select("file", "lo", "hi", bucket("lo")).join(asked, ["file", "bucket"], "left_semi").groupBy("file", "bucket", "lo").agg(F.max("hi").alias("hi")).groupBy("file", "bucket").agg(F.collect_list(F.struct("lo", "hi")).alias("inside"))
    known = carried.join(inside, ["file", "bucket"], "left").filter("carried is not null or inside is not null")
    near = F.exists("inside", lambda x: (x["lo"] <= F.col("hi")) & (x["hi"] >= F.col("lo")))
    return rows.withColumn("bucket", bucket("hi")).join(known, ["file", "bucket"]).filter((F.col("carried") >= F.col("lo")) | near).select(*rows.columns)


HUNK = ("path", "old_start", "old_lines", "new_start", "new_lines")


def _lines(hunks: DataFrame, file: str, side: str) -> DataFrame:
    """Hunks with the lines of one side as (file, lo, hi). A hunk of no lines touches nothing."""
    start, lines = F.col(f"{side}_start"), F.col(f"{side}_lines")
    return hunks.filter(lines > 0).withColumn("file", F.col(file)).withColumn("lo", start).withColumn("hi", start + lines - 1)


@dataclass(frozen=True)
class Side:
    """The symbols of one side of a change, where they needn't be read as one table.

    upto: those that begin up to a line (null: none), and those without a first line. tagged: some symbols (a written table) with more columns, so that
    kept says which of them are of this side; None: all are. Both sides may share upto and tagged, which are then asked once.
    """

    symbols: DataFrame
    upto: Callable[[int | None], DataFrame]
    tagged: Callable[[DataFrame], DataFrame] | None = None
    kept: str = "true"


def side_of(symbols: DataFrame | Side) -> Side:
    # Symbols without a first line may have a last one.
    return symbols if isinstance(symbols, Side) else Side(symbols, lambda last: symbols.filter(F.col("start_line").isNull() | (F.col("start_line") <= F.lit(last).cast("int"))))


def near_symbols(scratch: Scratch, before: Side, after: Side, lines: list[DataFrame]) -> list[DataFrame]:
    """Symbols before and after without those that begin after the last line asked for (lines: file, lo, hi), which can't touch any."""
    last = reduce(DataFrame.union, [x.select("hi") for x in lines]).agg(F.max("hi")).first()[0]
    columns = ("id", "type", "name", "qualified_name", "file", "start_line", "end_line")
    near: dict = {}
    for side in (before, after):
        if (side.upto, side.tagged) not in near:
            rows = scratch.save(side.upto(last).select(*columns))
            near[side.upto, side.tagged] = scratch.save(side.tagged(rows)) if side.tagged else rows
    return [near[side.upto, side.tagged].filter(side.kept) for side in (before, after)]


def changed_symbols(before: DataFrame | Side, after: DataFrame | Side, files: DataFrame, hunks: DataFrame) -> DataFrame:
    """id, file, change_kind (modified, added, deleted) of the symbols that hunks touch.

    files: path, old_path, status. hunks: path, old_start, old_lines, new_start, new_lines. A new symbol is modified
    if the old side of its file has its key; an old one is deleted if it is touched and no touched new one has its key.
    """
    before, after = side_of(before), side_of(after)
    scratch = Scratch(before.symbols.sparkSession, "changed")
    f = scratch.save(files.select("path", F.coalesce("old_path", "path").alias("old_file"), "status"))
    h = scratch.save(hunks.select(*HUNK).distinct().join(f, "path"))
    new_lines, old_lines = _lines(h, "path", "new"), _lines(h.filter("status <> 'added'"), "old_file", "old")
    lined = lambda symbols: _spans(symbols).select("id", "file", "lo", "hi", symbol_key().alias("key"))
    spans = lambda rows: rows.select("file", "lo", "hi")
    was, now = near_symbols(scratch, before, after, [new_lines, old_lines])
    new = scratch.save(touching(lined(now), spans(new_lines)).select("id", "file", "key").distinct())
    old_files = scratch.save(f.filter("status <> 'added'").select(F.col("old_file").alias("file")).distinct())
    known = before.symbols.join(few(old_files), "file", "left_semi").select("id", symbol_key().alias("key")).join(few(scratch.save(new.select("key").distinct())), "key", "left_semi")
    known = (before.tagged(scratch.save(known)) if before.tagged else known).filter(before.kept).select("key").distinct().withColumn("was", F.lit(True))
    touched = touching(lined(was), spans(old_lines)).select("id", "file", "key").distinct()
    fresh = new.join(known, "key", "left").select("id", "file", F.when(F.col("was"), "modified").otherwise("added").alias("change_kind"))
    return fresh.union(touched.join(new.select("key"), "key", "left_anti").select("id", "file", F.lit("deleted").alias("change_kind")))


#: Copies of a hunk that are made at a time.
COPIES = 10_000


def unmapped_hunks(before: DataFrame | Side, after: DataFrame | Side, files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Hunks (path, new_start) that touch no symbol on either side. Equal hunks are looked up once and returned as many times as they are."""
    before, after = side_of(before), side_of(after)
    spark = before.symbols.sparkSession
    scratch = Scratch(spark, "unmapped")
    f = files.select("path", F.coalesce("old_path", "path").alias("old_file")).groupBy("path", "old_file").agg(F.count("*").alias("times"))
    h = scratch.save(hunks.groupBy(*HUNK).agg(F.count("*").alias("copies")).join(f, "path"))
    lines = [_lines(h, "old_file", "old"), _lines(h, "path", "new")]
    near = near_symbols(scratch, before, after, lines)
    found = reduce(DataFrame.union, [touching(rows, _spans(symbols).select("file", "lo", "hi")).select(*HUNK) for rows, symbols in zip(lines, near, strict=True)])
    key = F.struct(*HUNK).alias("hunk_id")
    left = h.groupBy(key).agg(F.sum(F.col("copies") * F.col("times")).alias("n")).join(found.select(key).distinct(), "hunk_id", "left_anti")
    # Copies are dealt out in portions, so a hunk of many is not one task's.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    portions = left.select("hunk_id", "n", first.alias("first")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    copies = portions.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(COPIES), F.col("n") - F.col("first")).cast("int"))))
    return copies.select("hunk_id.path", "hunk_id.new_start")


def distances(graph: CodeGraph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """id, origin, depth of the nodes that depend on a group of seeds (id, origin: the group), least depth, the seeds at 0.

    Of a node and a group only the depth is kept, so rows are at most as many as nodes times groups. The edges of one type are joined after those
    of another, and what each join shuffles is gone before the next: the disk holds one type's edges at a time.
    """
    scratch = Scratch(graph.edges.sparkSession, "distances")
    frontier = scratch.save(seeds.select("id", "origin").distinct())
    known = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, clamp(max_depth, 3, 10) + 1):
        front = frontier.select(F.col("id").alias("to_id"), "origin")
        front = few(front)
        near = [scratch.save(graph.edges.filter(F.col("type") == kind).join(front, "to_id").select(F.col("from_id").alias("id"), "origin").distinct()) for kind in IMPACT_TYPES]
        frontier = scratch.save(reduce(DataFrame.union, near).distinct().join(known, ["id", "origin"], "left_anti"))
        scratch.drop(*near)
        if frontier.isEmpty():
            break
        known = known.union(frontier.withColumn("depth", F.lit(depth)))
    return known


def multi_impact(graph: CodeGraph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """id, depth, origins of all that depends on many seeds (column id): least depth, sorted origins at that depth.

    One traversal carries every seed; a node keeps its first level and the origins that reach it there.
    """
    scratch = Scratch(graph.edges.sparkSession, "multi-impact")
    edges = scratch.save(graph.edges.filter(F.col("type").isin(*IMPACT_TYPES)).select("from_id", "to_id").distinct())
    frontier = scratch.save(seeds.select("id", F.col("id").alias("origin")).distinct())
    known = frontier.select("id").distinct().select("id", F.lit(0).alias("depth"), F.array("id").alias("origins"))
    for depth in range(1, clamp(max_depth, 3, 10) + 1):
        new = edges.join(frontier.withColumnRenamed("id", "to_id"), "to_id").select(F.col("from_id").alias("id"), "origin").distinct().join(known.select("id"), "id", "left_anti")
        frontier = scratch.save(new)
        if frontier.isEmpty():
            break
        known = scratch.save(known.union(frontier.groupBy("id").agg(F.lit(depth).alias("depth"), F.sort_array(F.collect_set("origin")).alias("origins"))))
    return known.filter("depth > 0").select("id", F.col("depth").cast("long").alias("depth"), "origins")


def inspect_change(before: CodeGraph, after: CodeGraph, files: DataFrame, hunks: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Changed symbols, and what depends on them: modified ones in the new graph, deleted ones in the old. Added ones have no dependents yet."""
    changed = Scratch(after.edges.sparkSession, "change").save(changed_symbols(before.symbols, after.symbols, files, hunks))
    hit = multi_impact(after, changed.filter("change_kind = 'modified'").select("id"), max_depth).union(multi_impact(before, changed.filter("change_kind = 'deleted'").select("id"), max_depth))
    return changed, hit.groupBy("id").agg(F.min("depth").alias("depth"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"))


def change_summary(changed: DataFrame) -> DataFrame:
    kinds = ("modified", "added", "deleted")
    return changed.agg(F.count_distinct("file").alias("files"), *[F.count_if(F.col("change_kind") == k).alias(k) for k in kinds])


def affected_tests(graph: CodeGraph, targets: DataFrame, max_depth: int = 3, max_tests: int = 100) -> DataFrame:
    """file, distance, confidence, kinds, test_symbols, truncated of the test files that depend on production targets (column id).

    What depends on a target or on anything in its file is evidence: a test file that imports is an import_dependency, a direct call
    a direct_reference, both of high confidence; anything else is a call_path, medium up to two steps, else low. The nearest and the
    strongest evidence of a file count. Targets that are files or in test files are left out.
    """
    s = graph.symbols.select("id", "file", "type")
    scratch = Scratch(graph.edges.sparkSession, "tests")
    production = scratch.save(targets.join(s, "id").filter(~is_test_file(F.col("file")) & (F.col("type") != "file")))
    same = scratch.save(s.join(production.select("file").distinct(), "file", "left_semi").select("id").distinct())
    seeds = production.select("id", F.lit("target").alias("origin")).union(same.select("id", F.lit("file").alias("origin")))
    reached = distances(graph, seeds, max_depth).filter("depth > 0").groupBy("id").agg(F.min("depth").alias("depth"))
    found = scratch.save(reached.join(s.filter(is_test_file(F.col("file"))), "id"))
    # What is called in one step has been found at depth 1.
    calls = graph.edges.filter("type = 'calls'").join(same.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    calls = found.filter("depth = 1").select("id").join(calls, "id", "left_semi").withColumn("direct", F.lit(True))
    found = found.join(calls, "id", "left")
    kind = F.when(F.col("type") == "file", "import_dependency").when(F.coalesce("direct", F.lit(False)) & (F.col("depth") == 1), "direct_reference").otherwise("call_path")
    place = F.when(kind != "call_path", 0).when(F.col("depth") <= 2, 1).otherwise(2)
    rows = found.withColumn("kind", kind).withColumn("place", place).groupBy("file").agg(
        F.min("depth").cast("long").alias("distance"), F.min("place").alias("place"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.collect_set(F.when(F.col("type") != "file", F.col("id")))).alias("test_symbols"))
    most = clamp(max_tests, 100, 1000, 1)
    top = rows.orderBy("place", "distance", "file").limit(most + 1)
    # At most max_tests + 1 rows are numbered.
    top = top.withColumn("nth", F.row_number().over(Window.orderBy("place", "distance", "file"))).withColumn("truncated", F.max("nth").over(Window.partitionBy()) > most)
    return top.filter(F.col("nth") <= most).select("file", "distance", F.element_at(F.array(*[F.lit(c) for c in ("high", "medium", "low")]), F.col("place") + 1).alias("confidence"), "kinds", "test_symbols", "truncated")


def changed_tests(files: DataFrame) -> DataFrame:
    """path of the changed files that are tests themselves."""
    return files.filter(is_test_file(F.col("path"))).select("path").distinct()


def structural_edges(graph: CodeGraph, renames: DataFrame | None = None) -> DataFrame:
    """Distinct calls and imports under identities that don't depend on ids: kind, from_key, to_key, from_file, to_file.

    renames: (old_path, path), applied to the files of the side that is read through them (the one before).
    """
    s = graph.symbols.select("id", "file", "type", F.coalesce("qualified_name", "name").alias("label"))
    if renames is not None:
        s = s.join(renames.select(F.col("old_path").alias("file"), F.col("path").alias("new_file")), "file", "left").withColumn("file", F.coalesce("new_file", "file"))
    key = F.when(F.col("type") == "file", F.concat(F.lit("file:"), "file")).otherwise(F.concat_ws(":", F.lit("symbol"), "file", "type", "label"))
    s = s.select("id", key.alias("key"), "file")
    end = lambda side: s.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"), F.col("file").alias(f"{side}_file"))
    edges = graph.edges.filter(F.col("type").isin("calls", "imports"))
    return edges.join(end("from"), "from_id").join(end("to"), "to_id").select(F.col("type").alias("kind"), "from_key", "to_key", "from_file", "to_file").distinct()


def graph_delta(before: CodeGraph, after: CodeGraph, renames: DataFrame | None = None, max_edges: int = 1000) -> DataFrame:
    """change (added, removed), kind, from_key, to_key of up to ``max_edges`` changed edges in order of edge, then change.

    Keys before are read through the renames, keys after are not, so a file that only moved changes nothing.
    """
    if not 1 <= max_edges <= 10_000:
        raise ValueError("max_edges must be from 1 to 10000")
    key = ["kind", "from_key", "to_key"]
    old, new = structural_edges(before, renames).select(*key).distinct(), structural_edges(after).select(*key).distinct()
    both = new.join(old, key, "left_anti").withColumn("change", F.lit("added")).union(old.join(new, key, "left_anti").withColumn("change", F.lit("removed")))
    return both.orderBy(*key, "change").limit(max_edges).select("change", *key)


def delta_summary(before: CodeGraph, after: CodeGraph, renames: DataFrame | None = None) -> DataFrame:
    """added, removed, unchanged of the whole delta, in one full outer join."""
    key = ["kind", "from_key", "to_key"]
    old, new = structural_edges(before, renames).select(*key).distinct().withColumn("was", F.lit(1)), structural_edges(after).select(*key).distinct().withColumn("is", F.lit(1))
    rows = old.join(new, key, "full_outer")
    return rows.agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"), F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("unchanged"))


def repository_status(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, state (current, changed, new, removed) from (path, content_hash) of the files there are and of the index."""
    both = current.select("path", F.col("content_hash").alias("now")).join(indexed.select("path", F.col("content_hash").alias("then")), "path", "full_outer")
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("then"), "current").otherwise("changed")
    return both.select("path", state.alias("state"))


def overall_status(status: DataFrame, indexed_rows: bool = True) -> DataFrame:
    """One row: not_indexed, stale or current."""
    stale = F.count_if(F.col("state") != "current") > 0
    return status.agg(F.when(F.count_if(F.col("state").isin("current", "changed", "removed")) == 0, "not_indexed").when(stale, "stale").otherwise("current").alias("status"), F.count_if(F.col("state") != "current").alias("different"))


def plan_invalidation(current: DataFrame, indexed: DataFrame, graph: CodeGraph) -> DataFrame:
    """path, action (parse, reuse, renamed, resolve, removed) for the next index run.

    A new path whose content a removed path had is a rename: its facts are reused. What imports a changed or removed
    file, directly or over others, is resolved again though its own text is the same.
    """
    status = repository_status(current, indexed)
    moved = status.filter("state = 'new'").join(current.select("path", "content_hash"), "path").join(
        status.filter("state = 'removed'").join(indexed.select("path", "content_hash"), "path").select("content_hash").distinct(), "content_hash", "left_semi").select("path", F.lit(True).alias("moved"))
    dirty = status.filter("state in ('changed', 'removed')").select(F.col("path").alias("file"))
    again = importer_closure(graph, dirty).select(F.col("file").alias("path"), F.lit(True).alias("reached"))
    rows = status.join(moved, "path", "left").join(again, "path", "left")
    action = F.when(F.col("state") == "removed", "removed").when(F.col("moved"), "renamed").when(F.col("state").isin("changed", "new"), "parse").when(F.col("reached"), "resolve").otherwise("reuse")
    return rows.select("path", action.alias("action"))
