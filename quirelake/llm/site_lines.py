"""Line dedup by site-relative frequency, in DataFrame operations only.

A line that a large share of a host's pages hold is boilerplate of that host, whatever its count elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: A line goes if more than this share of its host's pages hold it, and at least LEAST_PAGES of them.
MOST_SHARE, LEAST_PAGES = 0.02, 5
#: Boilerplate lines up to which their table is broadcast (16 bytes each); beyond it hosts are joined in salted parts.
MOST_BROADCAST, SALTS = 100_000, 64


def _digest(line: Column) -> Column:
    return F.md5(line)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_text(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r\x0b\x0c"))) > 0


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str, most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES, distinct_pages: bool = False
) -> DataFrame:
    """(host, line digest, n_pages, host_pages) of each line over the ratio. Pages are rows, or with ``distinct_pages`` the host's distinct texts; a line counts once in each."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    page = [F.coalesce(F.unhex(F.md5(F.col(text_col))), F.lit(b"")).alias("page")] if distinct_pages else []  # a null text is one page
    n = F.count_distinct("page") if distinct_pages else F.count("*")
    pages = docs.select(host.alias("host"), F.col(text_col).alias("text"), *page)
    totals = pages.groupBy("host").agg(n.alias("host_pages"))
    held = pages.select(
        "host", *["page"][: len(page)], F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_text), _digest))).alias("line")
    )
    counts = held.groupBy("host", "line").agg(n.alias("n_pages")).where(F.col("n_pages") >= least_pages)
    return counts.join(totals, "host").where(F.col("n_pages") > most_share * F.col("host_pages"))


def drop_site_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES,
    most_broadcast: int = MOST_BROADCAST, distinct_pages: bool = False, counts: bool = True
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and with ``counts`` two more columns: n_lines and n_dropped.

    Lines are what newlines part; blank lines neither count nor go. A null text stays null, with no lines; an empty one has one blank line
    and stays empty; a null host counts as the empty one; every row is a page, also where ids repeat; an empty table gives an empty result.
    With ``distinct_pages`` rows of one host with the same text are one page, so that copies of a document don't make boilerplate of it.
    Very long texts are taken whole. Columns named host, line or the like don't clash; where ``docs`` has an n_lines or n_dropped, it stays,
    and the new column's name gets site_ before it.
    """
    found = cut(boilerplate(docs, host_col, text_col, most_share, least_pages, distinct_pages), "site-lines")
    sets = found.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__drop"))  # at most average lines per page / most_share a host
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    if found.count() <= most_broadcast:
        joined = docs.join(F.broadcast(sets), host == F.col("__host"), "left")
    else:
        salted = sets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__part", F.pmod(F.xxhash64(text_col), F.lit(SALTS))).join(
            salted, (host == F.col("__host")) & (F.col("__part") == F.col("__salt")), "left"
        ).drop("__salt", "__part")
    text = F.col(text_col)
    drop = F.coalesce(F.col("__drop"), F.array().cast("array<string>"))
    own = F.array_intersect(F.transform(_lines(text), _digest), drop)  # by hashing: a host's list isn't searched for each line

    def kept(gone: Column) -> Column:
        return F.filter(_lines(text), lambda x: ~_has_text(x) | ~F.array_contains(gone, _digest(x)))

    lines = F.when(F.size(drop) > 0, F.element_at(F.transform(F.array(own), kept), 1)).otherwise(_lines(text))
    out = joined.withColumn("__kept", lines)

    def free(name: str) -> str:
        return name if name not in docs.columns else free(f"site_{name}")

    more = [
        F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long").alias(free("n_lines")),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text)) - F.size("__kept")).cast("long").alias(free("n_dropped")),
    ]
    return out.select(*[F.array_join("__kept", "\n").alias(text_col) if c == text_col else F.col(c) for c in docs.columns], *(more if counts else []))
