"""State of jobs: checkpoints, history, status and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status texts, states a recovery picks up, rows of the history.
PENDING, RUNNING, PAUSED, COMPLETED, FAILED, STOPPED = "Pending", "Running", "Paused", "Completed", "Failed", "Stopped"
RECOVERABLE = (RUNNING, PAUSED, PENDING)
HISTORY_ROWS = 200


def upsert_checkpoints(stored: DataFrame, changes: DataFrame, path: str, updated: str) -> DataFrame:
    """One row per path, letter case aside: the latest of stored rows and changes; of equal times the change."""
    columns = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.select(*columns).withColumn("_new", F.lit(1)))
    latest = both.groupBy(F.lower(path).alias("_path")).agg(F.max(F.struct(F.col(updated).alias("_at"), "_new", *columns)).alias("_row"))
    return latest.select(*[F.col("_row")[c].alias(c) for c in columns])


def recoverable(checkpoints: DataFrame, status: str, updated: str) -> DataFrame:
    """Checkpoints a new run picks up, the latest first."""
    return checkpoints.filter(F.col(status).isin(*RECOVERABLE)).orderBy(F.desc(updated))


def newest(history: DataFrame, at: str, tie: str, limit: int = HISTORY_ROWS) -> DataFrame:
    """The newest rows of a history: a top-k report of fixed size."""
    return history.orderBy(F.desc(at), F.desc(tie)).limit(limit)


def percent(done: Column, total: Column) -> Column:
    """Whole percent, half to even; 0 without a total."""
    return F.when(total > 0, F.bround(done * 100.0 / total).cast("int")).otherwise(0)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with two decimals, half to even."""
    return F.bround((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def retry_delay(attempt: Column) -> Column:
    """Seconds before a further attempt: two for each, eight at most."""
    return F.least(F.lit(8), attempt * 2)


def clamp(c: Column, low: float, high: float) -> Column:
    """A setting within its bounds; null becomes the lower one."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(low))))


def retries(new: Column, legacy: Column, default: int = 2) -> Column:
    """The new retry setting, unless it is at its default while the legacy one is not; 0 at least."""
    return F.greatest(F.lit(0), F.when((new == default) & (legacy != default), legacy).otherwise(new))


def failure_kind(error: Column) -> Column:
    """auth, endpoint, timeout or server, by the text of an error; null without one."""
    e = F.lower(error)
    return (
        F.when(e.rlike(r"(^|[^0-9])(401|403)([^0-9]|$)|unauthorized|forbidden"), "auth")
        .when(e.rlike(r"(^|[^0-9])(404|405)([^0-9]|$)|<html|not found"), "endpoint")
        .when(e.rlike(r"timed? ?out|timeout|cancell?ed"), "timeout")
        .when(error.isNotNull(), "server")
    )


def utc_stamp(at: Column) -> Column:
    """A time as text, in the session's time zone, which is UTC by convention."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'")
