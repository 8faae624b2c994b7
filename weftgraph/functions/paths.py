"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Forward slashes, without empty, `.` and `..` parts; `..` above the root stays."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    # element_at of an empty list is only read where the list isn't empty.
    guarded = lambda done, p: F.when(F.size(done) == 0, F.array(p)).otherwise(step(done, p))
    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), guarded), "/")


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension with its dot; empty for none and for names that begin with their only dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)
