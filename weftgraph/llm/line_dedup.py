"""Line deduplication by site-relative frequency.

A line that many of a host's own pages hold is boilerplate of that host, however rare it is
elsewhere. Only DataFrame functions are used. Lines are cut out of the pages once, into a table
that is counted and then filtered; pages don't move while the lists of common lines are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Scratch

#: A line goes when more than this share of its host's pages hold it, and at least LEAST pages.
RATIO = 0.2
LEAST = 3
#: Common lines (8 bytes each) that may be broadcast; beyond that pages are joined to their host's list by a shuffle.
BROADCAST_LINES = 1_000_000
# Elements that end a line of text.
BREAKS = "p|br|div|li|ul|ol|h[1-6]|nav|article|section|footer|header|main|aside|table|tr|td|th|title|head|body|html|blockquote|pre"
# The entities that are decoded, by name and by number, the ampersand last.
ENTITIES = (
    ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&rsquo;", "\u2019"), ("&lsquo;", "\u2018"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"),
    ("&nbsp;", " "), ("&#160;", " "), ("&copy;", "©"), ("&#169;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"), ("&#38;", "&"),
)


def host_of(url: Column) -> Column:
    """Lower-cased host without port or user; empty when there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """The visible, trimmed, non-empty lines of a page, in order; of a null page none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.trim(F.regexp_replace(text, r"[\x00-\x09\x0B-\x20]+", " "))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def deduplicated(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay, joined by line feeds).

    Each row counts as a page, repeated rows too; a page counts a line once. Pages without a host belong
    to no site and keep all their lines. Null or empty pages have no lines. Other columns are ignored.

    A host's dropped lines are fewer than its mean lines a page divided by the ratio, so its list is
    small; counts are summed before they are shuffled, by host and 64-bit hash of the line.
    """
    scratch = Scratch(pages.sparkSession, "line-dedup")
    rows = scratch.save(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")))
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = rows.filter("host <> ''").select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("holding"))
    common = seen.filter(F.col("holding") >= least).join(total, "host").filter(F.col("holding") > F.lit(float(ratio)) * F.col("pages"))
    listed = scratch.save(common.groupBy("host").agg(F.collect_set("line").alias("common")))
    if (listed.agg(F.sum(F.size("common") + 4)).first()[0] or 0) <= BROADCAST_LINES:
        listed = F.broadcast(listed)
    joined = rows.join(listed, "host", "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("common"), F.xxhash64(x))))
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
