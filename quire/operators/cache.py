"""Shared calls: equal requests are sent once and the answer is joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.skew import join_groups

#: Fixed value: the unit separator between the parts of a key.
SEPARATOR = "\u001f"


def request_key(columns: list[str]) -> Column:
    """Digest of the parts of a request; null and empty parts are the same."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256)


def shared_requests(requests: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, first_id, requests, calls): the request whose call each row uses, how many use it, and whether it is its own.

    Only keys and digests are shuffled; a digest that a large part of all
    requests share is joined by broadcast. An empty table gives an empty one.
    """
    slim = requests.select(F.col(key).alias("_id"), request_key(columns).alias("_key"))
    groups = slim.groupBy("_key").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("requests"))
    joined = join_groups(slim, groups, "_key", "requests", slim.count())
    return joined.select(F.col("_id").alias(key), "first_id", "requests", (F.col("_id") == F.col("first_id")).alias("calls"))


def call_once(requests: DataFrame, columns: list[str], translate: Callable[[DataFrame], DataFrame], out: str = "translation") -> DataFrame:
    """Adds `out` to every request, calling `translate` with one row per distinct key.

    `translate` gets a frame with the key columns and must return them with
    `out`; blank texts should be filtered before, as they need no call.
    """
    digest = request_key(columns).alias("_key")
    keyed = requests.withColumn("_key", digest)
    distinct = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    answered = translate(distinct.select("_key", "_n", *columns)).select("_key", "_n", out)
    return join_groups(keyed, answered, "_key", "_n", requests.count()).drop("_key", "_n")
