"""Line dedup by the share of a site's pages that hold a line. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatpool.session import stored

#: A line on more than this share of the pages of its host is boilerplate,
RATIO = 0.1
#: if more than one holds it: a site of one page repeats nothing. No other count matters.
MIN_PAGES = 2

# What ends a line in a page, and what is no text; one pattern each for Spark and DuckDB.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|head|template|noscript)\b[^>]*>.*?(?:</(?:script|style|head|template|noscript)\s*>|\z)"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*(?:>|\z)"
TAGS = r"</?[A-Za-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def page_lines(html: Column) -> Column:
    """Lines of a page as an array: text between block elements, white space as one space, trimmed."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"[\x20\x09-\x0D]+", " "), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), "  +", " ")
    return F.filter(F.split(F.trim(text), "\n"), lambda line: line != "")


def site_lines(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """One row per page: page_id, host, host_pages, n_lines, n_dropped, text (the lines that
    stay, joined by line feeds).

    A line is boilerplate if more than ``ratio`` of its host's pages, and at least
    ``min_pages``, hold it; all its occurrences on the host go. A page counts once for a line
    however often it holds it. Pages without url or host form one host, named ''. Null and
    empty pages have no lines and count in the host's total. Repeated rows are pages of their
    own. Other columns are not read.

    Pages per line are combined per task before the shuffle, in which SHA-256 digests stand
    for lines; only lines that go, at most 1 / ``ratio`` times the lines of a mean page per
    host, meet the occurrences again.
    """
    rows = stored(
        pages.select(
            F.col(id_col).alias("page_id"),
            F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"),
            page_lines(F.col(html_col)).alias("lines"),
        ),
        "page-lines",
    )
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    key = F.unhex(F.sha2("line", 256)).alias("key")
    held = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", key)
    counted = held.groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    boilerplate = stored(
        counted.join(hosts, "host").filter(F.col("pages") > F.col("host_pages") * ratio).select("host", "key"), "boilerplate"
    )
    digest = F.xxhash64("lines")
    spots = rows.select(
        "page_id", "host", digest.alias("digest"), F.posexplode("lines").alias("spot", "line")
    ).select("page_id", "host", "digest", "spot", key).join(boilerplate, ["host", "key"])
    gone = spots.groupBy("page_id", "host", "digest").agg(F.collect_set("spot").alias("gone"))
    keyed = rows.withColumn("digest", digest)
    same = (
        keyed["page_id"].eqNullSafe(gone["page_id"]) & (keyed["host"] == gone["host"]) & (keyed["digest"] == gone["digest"])
    )
    joined = keyed.join(gone, same, "left").join(hosts.withColumnRenamed("host", "site"), F.col("site") == keyed["host"])
    lost = F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.filter("lines", lambda line, spot: ~F.array_contains(lost, spot))
    return joined.select(
        keyed["page_id"], keyed["host"], "host_pages", F.size("lines").cast("long").alias("n_lines"),
        F.size(lost).cast("long").alias("n_dropped"), F.array_join(stay, "\n").alias("text"),
    )
