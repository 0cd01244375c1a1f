"""URL filters by dated lists: a temporal join, with DataFrame functions only.

A list is rows (key, category, action, since): from that date the key is on the list ("add") or off it ("remove"), for that
category.  A key is a host suffix ("ads.example") or a host and the first segments of a path ("example.com/en").  The rows of a
key and category become disjoint validity intervals [since, next change); a capture is blocked if any of its keys is on the
list when it is fetched.  The longest such key names the reason (of equally long ones the first in order), and of its
categories the first in order.

A capture has one candidate key for each suffix of its host and each prefix of its path that is as deep as some key of the
list, so the join is an equi-join on the key with a range check.  The verdict belongs to (url, fetched), whatever page_ids say: matches
are aggregated and joined back by these two.  The list is broadcast if it is counted to hold up to BROADCAST rows; a larger one
is joined by shuffle, each (url, fetched) once: keys that very many captures have, as "com", are dropped before it if the list has
none of them, and else cut into parts.

Defined results: a null or unparsable URL has a null host and is not blocked; a null fetch date is not blocked; hosts are
lower-cased, a port, user (up to the last @) and trailing dots are left out; an IPv6 host keeps its brackets, and an IP address has
no suffixes but itself; changes of one key and category on one date count in the order remove, add; rows of a list without key,
category, action or date count for nothing; repeated rows, and repeated page_ids, get the result of their own URL and date; an empty
list blocks nothing; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_in, spread

BROADCAST = 100_000
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
#: Host of a URL: after the scheme and an optional user, up to a port, path, query or fragment; in brackets as a whole.
HOST = _SCHEME + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
PATH = _SCHEME + r"[^/?#]*([^?#]*)"
ADDRESS = r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$"


def intervals(entries: DataFrame) -> DataFrame:
    """key, category, since, until (null: still) of a dated list."""
    by = Window.partitionBy("key", "category").orderBy("since", F.col("action").desc())
    rows = entries.select(F.lower("key").alias("key"), "category", "action", F.col("since").cast("date").alias("since")).dropna()
    spans = rows.withColumn("until", F.lead("since").over(by))
    return spans.where("action = 'add' and (until is null or until > since)").select("key", "category", "since", "until")


def filtered(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, blocked, category, matched of pages(page_id, url, fetched)."""
    spans = intervals(entries)
    depth = spans.agg(F.coalesce(F.max(F.size(F.split("key", "/"))), F.lit(1)).alias("d"), F.count("*").alias("n")).first()
    host = F.nullif(F.regexp_replace(F.lower(F.regexp_extract("url", HOST, 1)), r"\.+$", ""), F.lit(""))
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched")).withColumn("host", host)
    judged = captures.where("host is not null and fetched is not null")
    rest = captures.where("host is null or fetched is null")  # apart, so that nulls meet in no task
    labels, steps = F.split("host", r"\."), F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda s: s != "")
    suffixes = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")))
    paths = F.expr(f"transform(slice(steps, 1, {depth.d - 1}), (s, k) -> concat(host, '/', lower(array_join(slice(steps, 1, k + 1), '/'))))")
    few = depth.n <= BROADCAST
    keyed = (judged if few else judged.dropDuplicates(["url", "fetched"])).withColumn("labels", labels).withColumn("steps", steps).select("url", "fetched", F.explode(F.concat(suffixes, paths)).alias("key"))
    if few:
        met = keyed.join(F.broadcast(spans), "key")
    else:
        hot = hot_in(keyed, ["key"])
        if hot is not None:  # at most HOT_KEYS rows
            hot = cut(hot.join(spans.select("key", F.lit(True).alias("listed")).distinct(), "key", "left"))
            keyed = keyed.join(F.broadcast(hot.where("listed is null").select("key")), "key", "left_anti")
            hot = hot.where("listed").select("key", "parts")
        met = spread(keyed, spans, ["key"], hot)
    hits = met.where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = hits.groupBy("url", "fetched").agg(F.min(F.struct((-F.length("key")).alias("short"), "key", "category")).alias("b"))
    best = best.select("url", "fetched", F.col("b.category").alias("category"), F.col("b.key").alias("matched"))
    none = F.lit(None).cast("string")
    out = judged.join(best, ["url", "fetched"], "left").unionByName(rest.withColumn("category", none).withColumn("matched", none))
    return out.select("page_id", "host", "fetched", F.col("matched").isNotNull().alias("blocked"), "category", "matched")
