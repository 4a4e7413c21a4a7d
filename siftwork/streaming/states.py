"""What each source has come to, event by event: stages of validation, retries, dead letters, pauses. As a batch and as a stream with state."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The stages, in the order that they are passed in; the last makes a candidate active. Fixed values.
STAGES = ("unverified", "V0", "V1", "V2", "V3", "V4", "V5", "V6")
#: Codes that pause a source at once, beside those that begin with BLOCKED; of these, the ones that pause it when they come again. Fixed values.
PAUSING, BLOCKED, SECOND_STRIKE = ("selector_drift", "config_error"), "blocked_", ("blocked_mime",)
#: Retries of a failure, seconds before the first, which double; seconds between polls. Fixed values.
RETRIES, RETRY_SECONDS, INTERVAL = 3, 60, 3600
#: How late events may come, and how long after it was due a silent source is reported.
LATENESS, GRACE = "1 day", dt.timedelta(days=2)

EVENT = "source long, at timestamp, seq long, kind string, stage string, passed boolean, code string, retryable boolean"
STATE = "source long, at timestamp, seq long, outcome string, stage string, status string, reason string, failures int, letters int, next_due timestamp"


def fresh() -> dict[str, Any]:
    return {"stage": 0, "status": "candidate", "reason": None, "failures": 0, "letters": {}, "next_due": None}


def step(s: dict[str, Any], e: Any) -> str:
    """Applies an event to a source's state and tells what came of it; `refused` events change nothing."""
    kind = e.kind
    if kind == "check":
        due = s["stage"] + 1
        if s["status"] == "retired" or due >= len(STAGES) or e.stage != STAGES[due]:
            return "refused"
        if not e.passed:
            return "failed check"
        s["stage"] = due
        if due == len(STAGES) - 1 and s["status"] == "candidate":
            s["status"] = "active"
        return "passed"
    if kind == "reset":
        s |= {"stage": 0, "reason": None, "status": "retired" if s["status"] == "retired" else "candidate"}
        return "reset"
    if kind == "retire":
        s |= {"status": "retired", "reason": e.code}
        return "retired"
    if kind == "pause":
        if s["status"] == "retired":
            return "refused"
        s |= {"status": "paused", "reason": e.code}
        return "paused"
    if kind == "resume":
        if s["status"] != "paused":
            return "refused"
        s |= {"status": "active" if s["stage"] == len(STAGES) - 1 else "candidate", "reason": None}
        return "resumed"
    at = e.at.to_pydatetime() if hasattr(e.at, "to_pydatetime") else e.at
    if kind == "success":
        s |= {"failures": 0, "letters": {}, "next_due": at + dt.timedelta(seconds=INTERVAL)}
        return "success"
    if kind == "failure":
        attempt, code = s["failures"] + 1, e.code or ""
        pauses = code in PAUSING or (code.startswith(BLOCKED) and code not in SECOND_STRIKE)
        if e.retryable and not pauses and attempt <= RETRIES:
            s |= {"failures": attempt, "next_due": at + dt.timedelta(seconds=RETRY_SECONDS << (attempt - 1))}
            return "retry"
        again = code in s["letters"]
        s["letters"] = s["letters"] | {code: s["letters"].get(code, 0) + attempt}
        s |= {"failures": 0, "next_due": at + dt.timedelta(seconds=INTERVAL)}
        if (pauses or again) and s["status"] != "retired":
            s |= {"status": "paused", "reason": ("repeated " if again else "") + code}
        return "dead letter"
    return "refused"


def _row(source: int, at: Any, seq: int, outcome: str, s: dict[str, Any]) -> tuple:
    return (source, at, seq, outcome, STAGES[s["stage"]], s["status"], s["reason"], s["failures"], len(s["letters"]), s["next_due"])


_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({"source": "int64", "seq": "int64", "failures": "int32", "letters": "int32", "at": "datetime64[ns]", "next_due": "datetime64[ns]"})


def histories(events: DataFrame) -> DataFrame:
    """The state of each event's source after it, in the order of (at, seq); events of kinds unknown, out of turn or null are refused.

    Spark sorts the events of a source in their partition; they are read as a stream of which one state is held, so a source with most events needs
    no more memory than others. Rows without a source or a time take no part.
    """
    own = events.where("source IS NOT NULL AND at IS NOT NULL").select([c.split()[0] for c in EVENT.split(", ")])
    own = own.withColumn("seq", F.coalesce("seq", F.lit(0).cast("long"))).withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn("retryable", F.coalesce("retryable", F.lit(False)))
    ordered = own.repartition("source").sortWithinPartitions("source", "at", "seq", "kind", "code")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state = None, fresh()
        for batch in batches:
            rows = []
            for e in batch.itertuples(index=False):
                if e.source != source:
                    source, state = e.source, fresh()
                rows.append(_row(e.source, e.at, e.seq, step(state, e), state))
            yield _frame(rows)

    return ordered.mapInPandas(scan, STATE)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each source."""
    last = states.groupBy("source").agg(F.max_by(F.struct(*[c for c in states.columns if c != "source"]), F.struct("at", "seq")).alias("x"))
    return last.select("source", "x.*")


def _load(text: str) -> dict[str, Any]:
    s = json.loads(text)
    return s | {"next_due": dt.datetime.fromisoformat(s["next_due"]) if s["next_due"] else None}


def _dump(s: dict[str, Any]) -> str:
    return json.dumps(s | {"next_due": s["next_due"].isoformat() if s["next_due"] else None})


def streamed(events: DataFrame) -> DataFrame:
    """The same over a stream: a state for each source, kept by Spark from batch to batch and over restarts, and a timer.

    Events of a batch are applied in the order of (at, seq), batches as they come. A source of which nothing came for GRACE after it was due is reported once as `overdue`
    when the watermark, LATENESS behind the newest event, has passed that time.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = _load(held.get[0]) if held.exists else fresh()
        if held.hasTimedOut:
            yield _frame([_row(key[0], state["next_due"] + GRACE, -1, "overdue", state)])
            held.update((_dump(state),))
            return
        found = pd.concat(list(batches), ignore_index=True).sort_values(["at", "seq", "kind", "code"], kind="stable")
        rows = [_row(key[0], e.at, e.seq, step(state, e), state) for e in found.itertuples(index=False)]
        held.update((_dump(state),))
        if state["next_due"] is not None:
            held.setTimeoutTimestamp(max(int((state["next_due"] + GRACE).replace(tzinfo=dt.timezone.utc).timestamp() * 1000), held.getCurrentWatermarkMs() + 1))
        yield _frame(rows)

    own = events.where("source IS NOT NULL AND at IS NOT NULL").withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
    own = own.withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn("retryable", F.coalesce("retryable", F.lit(False)))
    return own.withWatermark("at", LATENESS).groupBy("source").applyInPandasWithState(fold, STATE, "state string", "append", GroupStateTimeout.EventTimeTimeout)
