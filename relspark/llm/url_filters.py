"""URL filters by a temporal list join.

Dated list entries (a pattern is listed or delisted on a day) become validity intervals, and every capture is held
against the entries that were active when it was fetched. Patterns are hosts or parent domains.

Scale: entries are reduced to one for each pattern and day, so a pattern has as many intervals as days at most.
Captures are reduced to distinct hosts and days before they meet the list, so a host with a third of all captures
costs no more than its days; what was found goes back to the captures by a join on both, which AQE splits where hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-case host without port and user; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def parents_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) in days, until exclusive and null while open, of entries (pattern, category, day, listed).

    Entries with a null pattern, day or listed are left out; of several for a pattern and category on a day, listing
    wins. A repeated listing opens no new interval.
    """
    one = entries.select(F.lower("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), F.col("day").cast("int").alias("day"), "listed")
    one = one.filter("pattern is not null and day is not null and listed is not null").groupBy("pattern", "category", "day").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("pattern", "category").orderBy("day")
    turns = one.withColumn("was", F.lag("listed", 1, False).over(order)).filter("was != listed")
    return turns.withColumn("until", F.lead("day").over(order)).filter("listed").select("pattern", "category", F.col("day").alias("since"), "until")


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per row of captures (capture_id, url, day): capture_id, host, day, n_active, matches (sorted pattern:category:since), blocked.

    A url without a host or a null day meets nothing and isn't blocked. Repeated captures stay; other columns are
    ignored; an empty list blocks nothing.
    """
    rows = captures.select("capture_id", host_of(F.col("url")).alias("host"), F.col("day").cast("int").alias("day"))
    seen = rows.filter("host is not null and day is not null").select("host", "day").distinct()
    asked = seen.select("host", "day", F.explode(parents_of(F.col("host"))).alias("pattern"))
    valid = intervals(entries)
    active = asked.join(valid, "pattern").filter("since <= day and (until is null or day < until)")
    found = active.groupBy("host", "day").agg(F.sort_array(F.collect_list(F.concat_ws(":", "pattern", "category", F.col("since").cast("string")))).alias("matches"))
    out = rows.join(found, ["host", "day"], "left")
    n = F.when(F.col("matches").isNull(), 0).otherwise(F.size("matches"))
    return out.select("capture_id", "host", "day", n.cast("long").alias("n_active"), F.coalesce(F.array_join("matches", ","), F.lit("")).alias("matches"), (n > 0).alias("blocked"))
