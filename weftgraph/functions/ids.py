"""Deterministic identities."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def identity(*parts: Column) -> Column:
    """SHA-256 of parts separated by NUL; null parts are empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def node_identity(repo: Column, file: Column, kind: Column, qualified: Column) -> Column:
    return identity(F.lit("graph"), repo, file, kind, qualified)


@F.pandas_udf(StringType())
def uuid5(name: pd.Series) -> pd.Series:
    """UUIDv5 in the URL namespace, for stores that want that format."""
    return name.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))


def canonical_json(struct: Column) -> Column:
    """JSON of a struct whose fields the caller has in sorted order."""
    return F.to_json(struct)
