"""Message links, entry catalogues and cross-repository links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_KEYS = ("protocol_kind", "destination_kind", "destination", "consumer_kind")
ENTRY_KINDS = ("route", "graphql_operation", "graphql_field", "scheduled_job", "message_consumer")
RECORDS = 1000


def consumer_kind_of(protocol: Column, producer_kind: Column) -> Column:
    """The kind of consumer that a producer reaches: events for Kafka and event producers, else requests that are answered."""
    return F.when((protocol == "kafka") | (producer_kind == "event"), "event").otherwise("request_response")


def message_links(producers: DataFrame, consumers: DataFrame, limit: int = RECORDS) -> DataFrame:
    """place, record (producer, link, unlinked), repo, producer, consumer, cardinality: the first ``limit`` records, and truncated.

    producers: id, repo, protocol_kind, destination_kind, destination, producer_kind. consumers: id, repo, MESSAGE_KEYS. A producer comes with its
    record and then with its links, or one as unlinked; one budget covers them all, in order of repo and producer. Since every
    producer takes a record, only the first ``limit`` of them are joined. truncated is set where records were left out.
    """
    p = producers.select("repo", F.col("id").alias("producer"), *MESSAGE_KEYS[:3], consumer_kind_of(F.col("protocol_kind"), F.col("producer_kind")).alias("consumer_kind"))
    p = p.orderBy("repo", "producer").limit(limit + 1)
    c = consumers.select(F.col("id").alias("consumer"), "repo", *MESSAGE_KEYS)
    links = p.join(c, ["repo", *MESSAGE_KEYS], "left").select("repo", "producer", "consumer")
    matched = links.groupBy("repo", "producer").agg(F.count("consumer").alias("n"))
    cardinality = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many")
    records = matched.select("repo", "producer", F.lit(0).alias("step"), F.lit("producer").alias("record"), F.lit(None).cast("string").alias("consumer"), cardinality.alias("cardinality")).union(
        links.select("repo", "producer", F.lit(1).alias("step"), F.when(F.col("consumer").isNull(), "unlinked").otherwise("link").alias("record"), "consumer", F.lit(None).cast("string").alias("cardinality")))
    order = ["repo", "producer", "step", "consumer"]
    # At most limit + 1 rows are numbered.
    placed = records.orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("truncated", F.max("place").over(Window.partitionBy()) > limit)
    return placed.filter(F.col("place") <= limit).select("place", "record", "repo", "producer", "consumer", "cardinality", "truncated")


def cross_message_links(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """repo, producer, matches, cardinality (none, one, many, unknown) over the consumers of other repositories.

    A producer without a proven destination is unknown. Consumers are counted by key and repository before the join, so a
    popular destination meets its producers as one row for each repository.
    """
    keys = [*MESSAGE_KEYS, "framework"]
    p = producers.select("repo", F.col("id").alias("producer"), *MESSAGE_KEYS[:3], consumer_kind_of(F.col("protocol_kind"), F.col("producer_kind")).alias("consumer_kind"), "framework", "proven")
    c = consumers.groupBy(F.col("repo").alias("there"), *keys).agg(F.count(F.lit(1)).alias("n"))
    joined = p.join(c, keys, "left").groupBy("repo", "producer", "proven").agg(F.coalesce(F.sum(F.when(F.col("there") != F.col("repo"), F.col("n"))), F.lit(0)).alias("matches"))
    cardinality = F.when(~F.col("proven"), "unknown").when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("many")
    return joined.select("repo", "producer", "matches", cardinality.alias("cardinality"))


def supported_spec(spec: Column) -> Column:
    """A registry range or a workspace spec, not a link, file, git or URL."""
    return spec.isNotNull() & (F.trim(spec) != "") & ~spec.rlike(r"(?i)^(link:|file:|git[+:@]|https?:|github:|[\w-]+/[\w.-]+$)")


def package_name(name: Column) -> Column:
    return name.rlike(r"^(@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$") & (F.length(name) <= 214)


def package_links(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """repo, declared_name, kind, target_repo, state (linked, ambiguous, unmatched, unsupported): exact names in other repositories."""
    d = dependencies.withColumn("ok", supported_spec(F.col("raw_spec")) & package_name(F.col("declared_name")))
    p = packages.filter(package_name(F.col("name"))).select(F.col("repo").alias("target_repo"), F.col("name").alias("declared_name"))
    rows = d.join(p, ["declared_name"], "left").withColumn("target_repo", F.when(F.col("ok") & (F.col("target_repo") != F.col("repo")), F.col("target_repo")))
    per = rows.groupBy("repo", "declared_name", "kind", "ok").agg(F.sort_array(F.collect_set("target_repo")).alias("targets"))
    state = F.when(~F.col("ok"), "unsupported").when(F.size("targets") == 0, "unmatched").when(F.size("targets") > 1, "ambiguous").otherwise("linked")
    return per.select("repo", "declared_name", "kind", F.when(F.size("targets") == 1, F.col("targets")[0]).alias("target_repo"), state.alias("state"))


def list_entries(entities: DataFrame, relations: DataFrame, **filters: str) -> DataFrame:
    """framework, kind, logical_key, handlers, state (bound, ambiguous, unbound) of entry entities; filters are exact and all must hold."""
    e = entities.filter(F.col("kind").isin(*ENTRY_KINDS))
    for column, value in filters.items():
        e = e.filter(F.col(column) == value)
    bound = relations.filter(F.col("relation_kind").isin("controller_route", "route_binding", "graphql_resolver", "scheduled_handler", "message_handler"))
    n = bound.groupBy("framework", "kind", "logical_key").agg(F.count_distinct("node_id").alias("handlers"))
    rows = e.select("framework", "kind", "logical_key").join(n, ["framework", "kind", "logical_key"], "left").withColumn("handlers", F.coalesce("handlers", F.lit(0)))
    return rows.select("*", F.when(F.col("handlers") == 0, "unbound").when(F.col("handlers") == 1, "bound").otherwise("ambiguous").alias("state")).orderBy("framework", "kind", "logical_key")


def accepted_evidence(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, value, state of framework evidence (key, value, node_id): one value with an indexed end is accepted, several conflict, none is unresolved."""
    known = evidence.join(nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("known")), "node_id", "left")
    per = known.groupBy("key").agg(F.count_distinct(F.when(F.col("known"), F.col("value"))).alias("n"), F.min(F.when(F.col("known"), F.col("value"))).alias("value"))
    return per.select("key", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.when(F.col("n") == 1, "accepted").when(F.col("n") > 1, "conflict").otherwise("unresolved").alias("state"))


ROUTE = "framework string, method string, path string"


def route_identity(key: Column) -> Column:
    """The parts of a route's JSON key; null where it isn't one."""
    return F.from_json(key, ROUTE)


def route_key(framework: Column, method: Column, path: Column) -> Column:
    return F.to_json(F.struct(framework.alias("framework"), F.upper(method).alias("method"), F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/").alias("path")))


def workspace_map(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, files, symbols, edges of each repository (column repo)."""
    s = symbols.groupBy("repo").agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") != "file").alias("symbols"))
    return s.join(edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")), "repo", "left").select("repo", "files", "symbols", F.coalesce("edges", F.lit(0)).alias("edges"))
