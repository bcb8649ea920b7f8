"""A catalogue of media as a table: search with open ranges, paging, sizes to choose from, and a cache of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages hold at least and at most so many; a cached response is good for a day.
PER_PAGE = (3, 200)
TTL = 86_400
#: Schema of a hit.
HIT = "id long, type string, tags string, pageURL string, views long, downloads long, likes long, user string, sizes map<string,struct<url string, width int, height int, size long, thumbnail string>>"


def conditions(text: str | None = None, equal: dict | None = None, ranges: dict | None = None, text_col: str = "tags") -> Column:
    """All of: words of the text, equal columns (a list: one of it), ranges (least, greatest) with None for an open end. What is None asks nothing."""
    out = F.lit(True)
    for word in (text or "")[:100].lower().split():
        out = out & F.lower(text_col).contains(word)
    for column, value in (equal or {}).items():
        if value is not None:
            out = out & (F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    for column, (least, most) in (ranges or {}).items():
        if least is not None:
            out = out & (F.col(column) >= least)
        if most is not None:
            out = out & (F.col(column) <= most)
    return out


def search(df: DataFrame, order: list, page: int = 1, per_page: int = 20, **asked) -> DataFrame:
    """One page of the rows that meet the conditions, in a total order; Catalyst pushes the conditions to the scan."""
    size = min(max(per_page, PER_PAGE[0]), PER_PAGE[1])
    return df.filter(conditions(**asked)).orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def get(df: DataFrame, key: int, key_col: str = "id") -> DataFrame:
    """The one row of a key; none fails when it is read."""
    found = df.filter(F.col(key_col) == key).limit(1)
    return found if found.limit(1).count() else found.sparkSession.range(1).select(F.raise_error(F.lit(f"no {key_col} {key}")).alias(key_col))


def trimmed(hits: DataFrame) -> DataFrame:
    """Hits without the sizes that have neither an address nor bytes."""
    return hits.withColumn("sizes", F.map_filter("sizes", lambda k, v: (F.coalesce(v["url"], F.lit("")) != "") | (v["size"] > 0)))


def choose(sizes: Column, wanted: list[str]) -> Column:
    """The first wanted size that there is."""
    return F.coalesce(*[F.try_element_at(sizes, F.lit(w)) for w in wanted])


def fresh(cache: DataFrame, now: Column, url: str = "url", at: str = "cached_at") -> DataFrame:
    """Cached responses that are still good, by the digest of their address; of several the newest."""
    held = cache.filter(F.col(at) >= now - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {TTL})"))
    return held.groupBy(F.sha1(F.col(url).cast("binary")).alias("key")).agg(F.max_by("payload", at).alias("payload"))
