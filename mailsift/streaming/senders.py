"""What is known of each sender while the stream runs: totals and the last scans, kept as state.

A sender may hold a third of all mails, so scans are reduced before they are shuffled: every Arrow batch sends one
row a sender, its counts and its own last scans. The state of a sender is as small: counts and ``n`` scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: No time: such scans are older than all others.
NEVER = -(1 << 62)
_LAST = "times array<bigint>, ids array<bigint>, scores array<double>, flags array<boolean>"
PARTIAL = f"sender string, at timestamp, total bigint, threats bigint, {_LAST}"
STATE = f"opened bigint, total bigint, threats bigint, {_LAST}"
TOTALS = f"sender string, opened bigint, closed boolean, total bigint, threats bigint, {_LAST}"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _latest(scans: list[tuple], n: int) -> list[tuple]:
    """The last ``n`` of (micros, id, score, flag); the larger id is the later of equal times."""
    return sorted(scans, key=lambda s: s[:2], reverse=True)[:n]


def _columns(scans: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*scans)] if scans else [[], [], [], []]


def _reduce(n: int):
    """Many senders have one mail, so a batch is sorted once and cut at its senders: no table is made for each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rows = pdf.sort_values(["sender", "micros", "id"], ascending=[True, False, False], kind="stable")
            names = rows["sender"].to_numpy()
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            ends = np.append(first[1:], len(rows))
            lists = [rows[c].tolist() for c in ("micros", "id", "probability", "is_phishing")]
            cuts = [(i, min(i + n, e)) for i, e in zip(first.tolist(), ends.tolist())]
            threats = np.add.reduceat(rows["is_phishing"].to_numpy().astype("int64"), first)
            at = rows["at"].groupby(np.repeat(np.arange(len(first)), ends - first)).max()
            yield pd.DataFrame(dict(zip(_names(PARTIAL), [
                names[first], at.to_numpy() if at.dt.tz is None else at.array, ends - first, threats,
                *[[values[i:e] for i, e in cuts] for values in lists]])))

    return run


def _keep(n: int, idle_ms: int | None):
    names = _names(TOTALS)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, total, threats, *last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], opened, True, total, threats, *map(list, last))], columns=names)
            return
        opened, total, threats, *last = state.get if state.exists else (None, 0, 0, [], [], [], [])
        scans = list(zip(*last))
        newest = None
        for pdf in parts:
            # Plain lists: most senders have a row or two, for which a column's own tools take longer than the work.
            total += sum(pdf["total"].tolist())
            threats += sum(pdf["threats"].tolist())
            for row in zip(*(pdf[c].tolist() for c in ("times", "ids", "scores", "flags"))):
                scans += zip(*(c.tolist() if hasattr(c, "tolist") else list(c) for c in row))
            scans = _latest(scans, n)
            if idle_ms is not None:
                at = pdf["at"].max()
                newest = at if newest is None or at > newest else newest
        if opened is None:
            opened = int(scans[0][0])
        last = _columns(scans)
        state.update((opened, total, threats, *last))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({c: [v] for c, v in zip(names, (key[0], opened, False, total, threats, *last))})

    return run


def sender_totals(scans: DataFrame, n: int = 3, idle: timedelta | None = None, late: str = "1 hour",
                  key: str = "email_id", timestamp: str = "timestamp") -> DataFrame:
    """A stream in update mode: per changed sender its totals and last ``n`` scans, newest first.

    Without ``idle`` state is kept for good, and the last row of a sender is what the batch table has. With it, a
    sender without mail for that long behind the watermark is closed: a row with ``closed`` says so, the state goes, and its
    next mail opens a new one (``opened`` is the newest time of the batch that opened it). ``late`` only
    moves the watermark. A null sender is a sender; a null time is older than all others.
    """
    micros = F.coalesce(F.unix_micros(F.col(timestamp).cast("timestamp")), F.lit(NEVER))
    rows = scans.withColumn(timestamp, F.col(timestamp).cast("timestamp"))
    idle_ms = None if idle is None else int(idle.total_seconds() * 1000)
    narrow = rows.select(
        F.coalesce("sender", F.lit("")).alias("sender"), F.col(timestamp).alias("at"),
        micros.alias("micros"), F.col(key).cast("bigint").alias("id"), F.col("probability").cast("double").alias("probability"),
        F.coalesce("is_phishing", F.lit(False)).alias("is_phishing"))
    partial = narrow.mapInPandas(_reduce(n), PARTIAL)
    if idle is not None:
        partial = partial.withWatermark("at", late)
    return partial.groupBy("sender").applyInPandasWithState(
        _keep(n, idle_ms), TOTALS, STATE, "update",
        GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout)


def last_by_sender(totals: DataFrame) -> DataFrame:
    """(sender, total, threats, rank, email_id, timestamp, is_phishing) of a table of totals, one row a kept scan."""
    scans = F.posexplode(F.arrays_zip("times", "ids", "flags")).alias("p", "s")
    time = F.when(F.col("s.times") > NEVER, F.timestamp_micros(F.col("s.times")))
    return totals.select("sender", "total", "threats", scans).select(
        "sender", "total", "threats", (F.col("p") + 1).alias("rank"), F.col("s.ids").alias("email_id"),
        time.alias("timestamp"), F.col("s.flags").alias("is_phishing"))
