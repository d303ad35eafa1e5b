"""Publish/subscribe as joins of messages with subscription rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import glob_prefix_column, glob_regex, glob_regex_column


#: Literal characters of a pattern by which it finds channel names.
PREFIX = 8


def routes(channels: DataFrame, subs: DataFrame) -> DataFrame:
    """(channel, conn, kind, pattern) for distinct channels: exact ones by hash join; patterns meet the channel names that
    begin with their literal characters (PREFIX of them at most), also by equality, and never the messages."""
    names = channels.select("channel").distinct()
    exact = names.join(subs.where("kind = 'channel'"), F.col("channel") == F.col("pattern"))
    globs = subs.where("kind = 'pattern'").withColumn("_prefix", F.substring(glob_prefix_column(F.col("pattern")), 1, PREFIX))
    begun = names.select("channel", F.explode(F.sequence(F.lit(0), F.least(F.length("channel"), F.lit(PREFIX)))).alias("_n"))
    begun = begun.select("channel", F.expr("substring(channel, 1, _n)").alias("_prefix"))
    glob = begun.join(globs, "_prefix").where(F.rlike("channel", glob_regex_column(F.col("pattern"))))
    out = ["channel", "conn", "kind", "pattern"]
    return exact.select(out).unionByName(glob.select(out))


def publish(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Receivers of each message, channel and pattern deliveries counted apart."""
    r = routes(messages, subs).groupBy("channel").agg(F.count(F.when(F.col("kind") == "channel", 1)).alias("channel_receivers"), F.count(F.when(F.col("kind") == "pattern", 1)).alias("pattern_receivers"))
    return messages.join(r, "channel", "left").fillna(0, ["channel_receivers", "pattern_receivers"])


def deliveries(messages: DataFrame, subs: DataFrame) -> DataFrame:
    return messages.join(routes(messages, subs), "channel")


def subscribe(subs: DataFrame, new: DataFrame) -> DataFrame:
    return subs.unionByName(new).distinct()


def unsubscribe(subs: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: (conn, kind, pattern); a NULL pattern drops all of that kind."""
    every = gone.where("pattern IS NULL").select("conn", "kind")
    return subs.join(gone, ["conn", "kind", "pattern"], "left_anti").join(every, ["conn", "kind"], "left_anti")


def channels(subs: DataFrame, pattern: str = "*") -> DataFrame:
    return subs.where("kind = 'channel'").where(F.col("pattern").rlike(glob_regex(pattern))).select(F.col("pattern").alias("channel")).distinct()


def numsub(subs: DataFrame) -> DataFrame:
    return subs.where("kind = 'channel'").groupBy(F.col("pattern").alias("channel")).agg(F.countDistinct("conn").alias("n"))


def numpat(subs: DataFrame) -> DataFrame:
    return subs.where("kind = 'pattern'").agg(F.countDistinct("pattern").alias("n"))
