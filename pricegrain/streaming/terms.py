"""Memberships as a stream with timers: joining, renewing and leaving are rows, reminders and the end of a term come by themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricegrain.operators.storage import written

DAY = 86_400_000
OUTPUT = "member_id long, at long, action string, step int"
STATE = "active boolean, expires long, until long"
ROW = ["at", "event_id", "kind", "days", "expires"]
BEGUN = "begun before the stream"


def due(expires: int, after: int, until: int, steps: Sequence[int]) -> list[tuple[int, str, int | None]]:
    """What falls due of a term between two moments (ms), the later one included: a reminder so many days before its end for
    each step, then the end."""
    found = [(expires - s * DAY, "remind", s) for s in sorted(steps, reverse=True)] + [(expires, "expire", None)]
    return [x for x in found if after < x[0] <= until]


def changed(active: bool, expires: int, at: int, kind: str, days: int) -> tuple[bool, int, str | None]:
    """(active, expires, action) after a row. Joining does not restart a term that runs; renewing goes on from its end, or from
    now if there is none; leaving says nothing of one who is not there."""
    if kind == "joined":
        return (True, expires, None) if active else (True, at + days * DAY, "join")
    if kind == "renewed":
        return True, (expires if active and expires > at else at) + days * DAY, "renew"
    if kind == "left" and active:
        return False, expires, "leave"
    return active, expires, None


def _told(out: list[tuple], member: int, term: tuple[bool, int, int], now: int, steps: Sequence[int]) -> tuple[bool, int, int]:
    active, expires, until = term
    for at, action, step in due(expires, until, now, steps) if active else []:
        out.append((member, at, action, step))
        active = action != "expire"
    return active, expires, max(until, now)


def _order(row: tuple) -> tuple:
    """The terms that run at the beginning, then the rows in time's order; those without number are the last of a moment."""
    at, event_id, kind = row[:3]
    return kind != BEGUN, at, bool(pd.isna(event_id)), event_id


def _terms(steps: Sequence[int]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """X15, R15, X19. The state of a member is whether the term runs, its end, and up to when what fell due has been told; its timer
    stands at what falls due next. A row first brings the member up to its own time. State and timer come and go with the rows, many
    members at once; a call to the state store for each of them costs more than all the rest."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        term, out = state.get if state.exists else None, []
        if not state.hasTimedOut:
            rows = [r for pdf in batches for r in zip(*(pdf[c].tolist() for c in ROW))]
            for at, _, kind, days, end in sorted(rows, key=_order):
                if kind == BEGUN:
                    term = term or (True, end, at)
                    continue
                at = int(at)
                active, expires, until = _told(out, key[0], term or (False, 0, at), at, steps)
                active, expires, action = changed(active, expires, at, kind, int(days))
                term = active, expires, until
                if action:
                    out.append((key[0], at, action, None))
        now = state.getCurrentWatermarkMs()
        active, expires, until = _told(out, key[0], term, now, steps)  # no row of a moment before it can come any more
        state.update((active, expires, until))
        coming = due(expires, until, expires, steps) if active else []
        if coming:  # a timer goes off when the watermark is past it: one before, so that it does when what falls due is reached
            state.setTimeoutTimestamp(max(coming[0][0] - 1, now, 1))
        yield pd.DataFrame(out, columns=["member_id", "at", "action", "step"], dtype=object)

    return advance


def with_timers(spark: SparkSession) -> SparkSession:
    """The state of very many members is kept on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def member_terms(changes: DataFrame, members: DataFrame, steps: Sequence[int] = (7, 3, 1), late: str = "1 hour") -> DataFrame:
    """(member_id, at, action, step) of a stream of changes (member_id, event_id, ts, kind, days): join, renew, leave, remind,
    expire. members: the terms that run when the stream begins (member_id, expires_at, since). Times are in milliseconds.
    The members are the stream's first rows; one who has a state already keeps it.
    What falls due when no row comes is told as soon as the watermark has passed it."""
    spark = with_timers(changes.sparkSession)
    rows = changes.withWatermark("ts", late).select("member_id", "event_id", "ts", F.unix_millis("ts").alias("at"), "kind", "days", F.lit(0).cast("long").alias("expires"))
    kinds = {f.name: f.dataType for f in rows.schema}
    first = {"ts": F.col("since"), "at": F.unix_millis("since"), "expires": F.unix_millis("expires_at"), "kind": F.lit(BEGUN), "event_id": F.lit(0), "days": F.lit(0), "member_id": F.col("member_id")}
    begun = written(members.select(*[first.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns]), "members")
    both = rows.union(spark.readStream.schema(begun.schema).parquet(begun._scratch))
    return both.groupBy("member_id").applyInPandasWithState(_terms(list(steps)), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
