"""The translation pipeline with an injected translator.

Blank texts are passed through; spans are protected; equal requests are sent once; what comes back is
restored, judged, asked for once more where it fails, and a failure gives the original.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.quality import needs_retry
from quire.functions.text import is_blank
from quire.operators import protect as P
from quire.operators.cache import call_once
from quire.session import materialize, spread

#: A translator: texts of one batch to texts, in order. It may raise; its errors are retried as the settings say.
Translator = Callable[[pd.Series], pd.Series]
#: What tells that an address or a key is refused.
_REFUSED = re.compile(r"(?i)(?<!\d)(?:401|403|404|405)(?!\d)|unauthorized|forbidden|not found|<html")
#: Attempts after a time-out and after another error.
TIMEOUT_RETRIES, SERVER_RETRIES = 1, 2


def _attempt(translate: Translator, texts: pd.Series, wait: Callable[[int], None]) -> tuple[list[str | None], list[str | None]]:
    """(translations, errors): a batch, with its attempts; a batch that keeps failing is tried text by text."""
    timeouts, servers, tries = TIMEOUT_RETRIES, SERVER_RETRIES, 0
    while True:
        try:
            return list(translate(texts)), [None] * len(texts)
        except TimeoutError as e:
            timeouts -= 1
            if timeouts < 0:
                error = e
                break
        except Exception as e:  # noqa: BLE001 - whatever a translator raises is its failure
            servers -= 1
            if servers < 0:
                error = e
                break
        tries += 1
        wait(min(8, 2 * tries))
    if len(texts) == 1:
        return [None], [f"{type(error).__name__}: {error}"]
    out, bad = [], []
    for i in range(len(texts)):
        a, b = _attempt(translate, texts.iloc[i : i + 1], wait)
        out += a
        bad += b
    return out, bad


def with_failover(*translators: Translator) -> Translator:
    """A translator that tries others in order where one is refused (by its address or its key); other failures are not passed on."""

    def run(texts: pd.Series) -> pd.Series:
        for k, translate in enumerate(translators):
            try:
                return translate(texts)
            except Exception as e:  # noqa: BLE001 - told apart by their text
                if k + 1 == len(translators) or not _REFUSED.search(str(e)):
                    raise
        raise ValueError("no translator")

    return run


def throttled(frame: DataFrame, requests: int) -> DataFrame:
    """Rows in as many tasks as requests may run at once, one at least; each task sends its batches one after another."""
    return frame.repartition(max(1, requests))


def apply_translator(frame: DataFrame, text: str, translate: Translator, wait: Callable[[int], None] = lambda s: None) -> DataFrame:
    """Adds translated and error: a translator called over batches of a text column."""
    schema = T.StructType([*frame.schema.fields, T.StructField("translated", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good, bad = _attempt(translate, pdf[text], wait) if len(pdf) else ([], [])
            yield pdf.assign(translated=good, error=bad)

    return frame.mapInPandas(run, schema)


def translate(units: DataFrame, text: str, key: list[str], translator: Translator, kind: str = "plain", requests: int | None = None) -> DataFrame:
    """Adds translation and error to units (with `text` and the further columns of the request key).

    Every row is kept; blank texts stay as they are; a text whose translation
    fails, or lost protected spans twice, keeps what came back or, without any, its original. No more than
    `requests` batches are sent at once, if that is given.
    """
    blank = units.filter(is_blank(F.col(text))).withColumn("translation", F.coalesce(text, F.lit(""))).withColumn("error", F.lit(None).cast("string"))
    rest = units.filter(~is_blank(F.col(text)))

    def call(distinct: DataFrame) -> DataFrame:
        cut = distinct.withColumn("_p", P.protect(F.col(text))).withColumn("_send", F.col("_p.text"))
        first = apply_translator(spread(cut) if requests is None else throttled(cut, requests), "_send", translator)
        raw = F.coalesce("translated", F.lit(""))
        restored = P.restore(raw, F.col("_p.tokens"))
        judged = first.withColumn("_out", restored).withColumn("_bad", (F.col("error").isNull()) & needs_retry(F.col(text), restored, F.lit(kind), P.missing(raw, F.col("_p.tokens")) > 0, ~P.all_restored(restored, F.col("_p.tokens"))))
        # Cut here, or the second attempt would call the translator for the first one again.
        judged = materialize(judged.withColumnRenamed("error", "_error").drop("translated"))
        again = apply_translator(judged.filter("_bad"), "_send", translator)
        better = again.withColumn("_out", F.when(F.col("error").isNull() & F.col("translated").isNotNull(), P.restore(F.col("translated"), F.col("_p.tokens"))).otherwise(F.col("_out"))).drop("translated", "error")
        both = judged.filter(~F.col("_bad")).unionByName(better)
        return both.withColumn("translation", F.struct(F.when(F.col("_error").isNotNull(), F.col(text)).otherwise(F.col("_out")).alias("t"), F.col("_error").alias("e")))

    done = call_once(rest, [text, *[k for k in key if k != text]], call)
    done = done.withColumn("error", F.col("translation.e")).withColumn("translation", F.col("translation.t"))
    return done.unionByName(blank)
