"""Shaping results for callers: projection modes, byte pages and signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections by mode, excerpt sizes, page limits, life of a cursor in seconds.
SECTIONS = {"compact": ("relationships",), "focused": ("source", "relationships", "provenance"), "full": ("source", "relationships", "provenance", "stages")}
EXCERPT = {"compact": 160, "focused": 600}
PAGE, PAGE_BYTES, LIFE = 100, 64_000, 900
SOURCE = ("content", "snippet", "rendered")
RELATIONSHIP = ("edge", "path", "relation", "relations", "hops")
PROVENANCE = ("provenance", "evidence")
STAGES = ("vector_rank", "lexical_rank", "fused_rank", "reranked")


class CursorError(ValueError):
    """code: invalid_cursor, expired_cursor or stale_cursor."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def project(rows: DataFrame, mode: str = "compact", sections: tuple[str, ...] | None = None, relation_kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of the wanted sections; source text cut to the mode's excerpt; rows of other relation kinds left out."""
    keep = set(SECTIONS[mode] if sections is None else sections)
    out: list[Column] = []
    for c in rows.columns:
        if c in SOURCE:
            if "source" not in keep or (mode != "full" and (c == "rendered" or (c == "snippet" and "content" in rows.columns))):
                continue
            size = EXCERPT.get(mode)
            out.append(F.col(c) if size is None else F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(F.col(c)).alias(c))
        elif not ((c in STAGES and "stages" not in keep) or (c in PROVENANCE and "provenance" not in keep) or (c in RELATIONSHIP and "relationships" not in keep)):
            out.append(F.col(c))
    if relation_kinds is not None and "relation" in rows.columns:
        rows = rows.filter(F.col("relation").isNull() | F.col("relation").isin(*relation_kinds))
    return rows.select(*out)


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, size: int = PAGE, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """The next rows in a total order, at most ``size`` and at most ``most_bytes`` of JSON, with nth (from 1) and bytes up to here.

    Only offset + size rows are sorted out before they are numbered.
    """
    top = rows.orderBy(*order).limit(offset + size)
    numbered = top.withColumn("nth", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("nth") > offset)
    cost = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    upto = F.sum(cost).over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("bytes", upto).filter(F.col("bytes") <= most_bytes)


def snapshot_digest(rows: DataFrame) -> str:
    """A digest of a result whatever the order of its rows: the sum and the count of row hashes."""
    r = rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{r.s}:{r.n}".encode()).hexdigest()


def encode_cursor(request: str, generation: str, snapshot: str, offset: int, now: float, key: bytes) -> str:
    body = {"v": 1, "request": request, "generation": generation, "snapshot": snapshot, "offset": offset, "expires": int(now + LIFE)}
    payload = base64.urlsafe_b64encode(json.dumps(body, sort_keys=True).encode()).rstrip(b"=")
    return (payload + b"." + base64.urlsafe_b64encode(hmac.digest(key, payload, "sha256")).rstrip(b"=")).decode()


def decode_cursor(cursor: str, request: str, generation: str, snapshot: str, now: float, key: bytes) -> int:
    """The offset to go on from; a cursor that is forged, old, or of another request or state of the data is an error."""
    payload, _, signature = cursor.encode().partition(b".")
    if not hmac.compare_digest(base64.urlsafe_b64encode(hmac.digest(key, payload, "sha256")).rstrip(b"="), signature):
        raise CursorError("invalid_cursor")
    body = json.loads(base64.urlsafe_b64decode(payload + b"=" * (-len(payload) % 4)))
    if body["expires"] <= now:
        raise CursorError("expired_cursor")
    if body["request"] != request:
        raise CursorError("invalid_cursor")
    if (body["generation"], body["snapshot"]) != (generation, snapshot):
        raise CursorError("stale_cursor")
    return body["offset"]


def limited(rows: DataFrame, limit: int, *order: Column | str) -> tuple[DataFrame, DataFrame]:
    """The first rows and a one-row table of whether there are more, read from one row beyond the limit."""
    more = rows.orderBy(*order).limit(limit + 1)
    return more.orderBy(*order).limit(limit), more.agg((F.count(F.lit(1)) > limit).alias("truncated"))
