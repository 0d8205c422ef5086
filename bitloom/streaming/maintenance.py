"""A translation memory kept up to date by a stream: the newest unit of each source, and whether its targets agree.

The state of a source is its newest unit, its smallest and largest target and a count, however many units it has
had. Units are brought down to one row a source in the tasks that read them, so that a very common source is few
rows in the shuffle to its state. What a batch changes is appended, each source with its count, which only grows:
the row of the largest count is the source's present one. A query that is started again goes on from its checkpoint.

With ``keep``, a source that no unit has come for in so long is let go with a last row, and its state with it;
units that are older than that against the newest of all come too late and are left out, as are undated ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitloom.functions import text as X

PART = "src string, modified_at string, ord long, tgt_text string, low string, high string, units long, at timestamp"
STATE = "modified_at string, ord long, tgt_text string, low string, high string, units long, at_ms long"
ROW = "src string, tgt_text string, modified_at string, ord long, units long, conflict boolean, gone boolean"


def _joined(d: pd.DataFrame) -> pd.DataFrame:
    """One row a source."""
    d = d.sort_values(["modified_at", "ord"], kind="stable")
    return d.groupby("src", sort=False, as_index=False).agg(
        modified_at=("modified_at", "last"), ord=("ord", "last"), tgt_text=("tgt_text", "last"), low=("low", "min"), high=("high", "max"), units=("units", "sum"), at=("at", "max")
    )


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        yield _joined(d)


def _keeper(keep_ms: int | None) -> Callable:
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda s, gone: pd.DataFrame([(key[0], s[2], s[0], s[1], s[5], s[3] != s[4], gone)], columns=[c.split()[0] for c in ROW.split(", ")])
        if state.hasTimedOut:
            old = state.get
            state.remove()
            yield row(old, True)
            return
        d = pd.concat(list(parts), ignore_index=True)
        d = _joined(d.drop(columns=[c for c in d.columns if c not in PART])).iloc[0]
        at = 0 if pd.isna(d["at"]) else int(d["at"].timestamp() * 1000)
        now = (d["modified_at"], int(d["ord"]), d["tgt_text"], d["low"], d["high"], int(d["units"]), at)
        if state.exists:
            old = state.get
            newest = now if now[:2] > tuple(old[:2]) else old
            now = (*newest[:3], min(old[3], now[3]), max(old[4], now[4]), old[5] + now[5], max(old[6], now[6]))
        state.update(now)
        if keep_ms is not None:
            state.setTimeoutTimestamp(max(now[6], state.getCurrentWatermarkMs()) + 1)
        yield row(now, False)

    return update


def newest(stream: DataFrame, keep: str | None = None) -> DataFrame:
    """units (ord, src_text, tgt_text, modified_at) as a stream -> (src, tgt_text, modified_at, ord, units,
    conflict, gone) of each source that a batch changes. keep: such as '90 days'."""
    strip = lambda c: X.py_strip(F.coalesce(F.col(c), F.lit("")))
    at = F.try_to_timestamp(F.col("modified_at"), F.lit("yyyyMMdd'T'HHmmssX"))
    d = stream.select(strip("src_text").alias("src"), F.coalesce("modified_at", F.lit("")).alias("modified_at"), F.col("ord").cast("long").alias("ord"), F.coalesce("tgt_text", F.lit("")).alias("tgt_text"), strip("tgt_text").alias("low"), strip("tgt_text").alias("high"), F.lit(1).cast("long").alias("units"), at.alias("at"))
    parts = d.mapInPandas(_parts, PART)
    if keep is None:
        return parts.groupBy("src").applyInPandasWithState(_keeper(None), ROW, STATE, "append", GroupStateTimeout.NoTimeout)
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return parts.filter("at is not null").withWatermark("at", keep).groupBy("src").applyInPandasWithState(_keeper(ms), ROW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current(rows: DataFrame) -> DataFrame:
    """The present row of each source, of those that were appended and aren't gone."""
    last = rows.groupBy("src").agg(F.max_by(F.struct("tgt_text", "modified_at", "ord", "units", "conflict", "gone"), F.struct("units", "gone")).alias("r"))
    return last.select("src", "r.*").filter("not gone").drop("gone")
