"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.redact import findings, public, redact
from ..policy import Policy

VAULT = "profile string, replacement string, value string, uses long, last_used long"


def masked(stream: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """Stateless: the masked form of each row, originals left out."""
    return public(redact(stream, policy, text), text)


def counted(stream: DataFrame, at: str, policy: Policy = Policy(), text: str = "text", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Findings by event-time window and category; rows later than ``late`` are dropped by the watermark."""
    found = redact(stream.withWatermark(at, late), policy, text).select(at, F.explode("findings.category").alias("category"))
    return found.groupBy(F.window(at, window).alias("window"), "category").agg(F.count("*").alias("n"))


def remembered(stream: DataFrame, profile: str, policy: Policy = Policy(), text: str = "text", ttl_ms: int = 60 * 60 * 1000) -> DataFrame:
    """A vault kept as state a (profile, replacement, value), forgotten ``ttl_ms`` after its last use.

    One key holds two numbers, so a hot profile is many small states.
    """
    found = findings(redact(stream, policy, text).select(F.col(profile).alias("profile"), "input", "findings"), "profile").where("original <> '' AND original <> replacement")
    keyed = found.select("profile", "replacement", F.col("original").alias("value"), F.unix_timestamp().alias("now"))

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        uses, last = state.get if state.exists else (0, 0)
        for part in rows:
            uses, last = uses + len(part), max(last, int(part["now"].max()))
        state.update((uses, last))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(*key, uses, last)], columns=["profile", "replacement", "value", "uses", "last_used"])

    return keyed.groupBy("profile", "replacement", "value").applyInPandasWithState(update, VAULT, "uses long, last_used long", "update", GroupStateTimeout.ProcessingTimeTimeout)
