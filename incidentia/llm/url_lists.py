"""URL filters by dated lists: a temporal join of captures with the entries active when fetched.

Each list entry says that a pattern (a host, a domain with all below it, or a path prefix of a host)
is added or removed on some date. Entries of a pattern become validity intervals, the intervals are
dealt to the days that they touch, and a capture meets those of its own day only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket, in seconds. Narrower ones split a busy pattern further.
BUCKET = 86_400


def host_of(url: Column) -> Column:
    """The lower-case host without user, port or a final dot; empty if the URL has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.regexp_replace(F.lower(authority), r"^.*@|:\d*$|\.(:\d*)?$", "")


def path_of(url: Column) -> Column:
    """The path without query and fragment, without a final slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*(/[^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def patterns_of(url: Column, labels: int | None = None, steps: int | None = None) -> Column:
    """All patterns that can name a URL: ``host``, ``.domain`` for it and each domain above,
    ``host/path`` for each leading part of the path. ``labels`` and ``steps`` leave out domains of
    more labels and prefixes of more parts, which a caller knows that no list has."""
    host, path = host_of(url), path_of(url)
    names = F.split(host, r"\.")
    size = F.size(names)
    domains = F.transform(
        _up_to(size, labels),
        lambda n: F.concat(F.lit("."), F.array_join(F.slice(names, size - n + 1, n), ".")),
    )
    parts = F.array_remove(F.split(path, "/"), "")
    prefixes = F.transform(
        _up_to(F.size(parts), steps),
        lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")),
    )
    every = F.array_distinct(F.concat(F.array(host), domains, prefixes))
    return F.when(host != "", every).otherwise(F.slice(every, 1, 0))


def _up_to(size: Column, most: int | None) -> Column:
    """The numbers from 1 to ``size``, or to ``most`` if that is less; none for 0."""
    last = size if most is None else F.least(size, F.lit(most))
    return F.filter(F.sequence(F.lit(0), last), lambda n: n > 0)


def depths(entries: DataFrame) -> tuple[int, int]:
    """Labels of the deepest listed ``.domain``, and parts of the deepest listed path prefix."""
    pattern = F.col("pattern")
    dots = F.length(pattern) - F.length(F.replace(pattern, F.lit("."), F.lit("")))
    slashes = F.length(pattern) - F.length(F.replace(pattern, F.lit("/"), F.lit("")))
    labels = F.max(F.when(pattern.startswith("."), dots))
    found = entries.agg(F.coalesce(labels, F.lit(0)), F.coalesce(F.max(slashes), F.lit(0))).first()
    return found[0], found[1]


def validity(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Intervals in which a list names a pattern: list, pattern, valid_from, valid_to, bucket.

    ``entries`` holds list, pattern, at (timestamp), action (``add`` or ``remove``). An entry holds
    from its date until the next one of its list and pattern; at one date a removal wins over
    additions. Intervals have a row for each bucket that they touch up to the last date of all
    entries, and one open row behind it. Entries with a null in any column, or another action, count
    for nothing; repeated entries count once.
    """
    at = F.unix_micros("at")
    width = bucket * 1_000_000
    known = entries.filter(
        "list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')"
    )
    dated = known.groupBy("list", "pattern", at.alias("at")).agg(
        (~F.bool_or(F.col("action") == "remove")).alias("on")
    )
    dated = dated.withColumn("bucket", F.floor(F.col("at") / width))
    # The next date inside the bucket, else the first date of the pattern's next bucket: no task
    # sorts more than one bucket of a pattern, or its one row per bucket.
    firsts = dated.groupBy("list", "pattern", "bucket").agg(F.min("at").alias("first"))
    nexts = firsts.withColumn(
        "next", F.lead("first").over(Window.partitionBy("list", "pattern").orderBy("bucket"))
    ).drop("first")
    inside = Window.partitionBy("list", "pattern", "bucket").orderBy("at")
    spans = dated.withColumn("until", F.lead("at").over(inside)).join(
        nexts, ["list", "pattern", "bucket"]
    )
    until = F.coalesce("until", "next")
    end = F.lit(last_date(entries)).cast("long")
    spans = spans.filter("on").select(
        "list", "pattern", F.col("at").alias("valid_from"), until.alias("valid_to")
    )
    last = F.coalesce(F.col("valid_to") - 1, F.greatest(end, F.col("valid_from")))
    touched = F.sequence(F.floor(F.col("valid_from") / width), F.floor(last / width))
    return spans.select(
        "list", "pattern", "valid_from", "valid_to", F.explode(touched).alias("bucket")
    )


def last_date(entries: DataFrame) -> int | None:
    """The latest date of all entries, in microseconds."""
    return entries.agg(F.max(F.unix_micros("at"))).first()[0]


def match_lists(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    at_col: str = "fetched_at",
    bucket: int = BUCKET,
) -> DataFrame:
    """A row per capture: row, id, matches. ``matches`` are (list, pattern, since) of the entries
    active at fetch time, sorted; empty if there are none.

    A null URL, one without a host and a null fetch time match nothing. Repeated captures stay rows
    of their own. Columns other than the named ones are ignored. Captures are looked up by as many
    labels and path parts as the deepest entry has, so no entry is out of reach.
    """
    width = bucket * 1_000_000
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.unix_micros(at_col).alias("t"),
    )
    # Behind the last date of all entries a capture meets what holds in that date's bucket.
    end = F.lit(last_date(entries)).cast("long")
    labels, steps = depths(entries)
    asked = rows.select(
        "row",
        "t",
        F.floor(F.least(F.col("t"), end) / width).alias("bucket"),
        F.explode(patterns_of(F.col("url"), labels, steps)).alias("pattern"),
    )
    spans = validity(entries, bucket)
    active = (F.col("t") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))
    )
    hits = (
        asked.join(spans, ["pattern", "bucket"])
        .filter(active)
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("list", "pattern", F.timestamp_micros("valid_from").alias("since"))
                )
            ).alias("matches")
        )
    )
    nothing = F.slice(F.array(F.struct(
        F.lit("").alias("list"), F.lit("").alias("pattern"), F.timestamp_micros(F.lit(0)).alias("since")
    )), 1, 0)
    return rows.select("row", "id").join(hits, "row", "left").withColumn(
        "matches", F.coalesce("matches", nothing)
    )
