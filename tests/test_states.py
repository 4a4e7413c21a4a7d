"""States of sources: the rules one by one, the batch against a loop, and a stream that is stopped and goes on from its checkpoint."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from siftwork.streaming import states

T0 = dt.datetime(2024, 1, 1)


def event(kind, stage=None, passed=False, code=None, retryable=False, at=T0):
    return SimpleNamespace(kind=kind, stage=stage, passed=passed, code=code, retryable=retryable, at=at)


def test_ladder():
    s = states.fresh()
    assert states.step(s, event("check", "V1", True)) == "refused" and states.step(s, event("check", "V0")) == "failed check" and s["stage"] == 0
    for stage in states.STAGES[1:]:
        assert states.step(s, event("check", stage, True)) == "passed"
    assert s["status"] == "active" and states.step(s, event("check", "V6", True)) == "refused"
    assert states.step(s, event("resume")) == "refused"
    assert states.step(s, event("pause", code="by hand")) == "paused" and s["reason"] == "by hand"
    assert states.step(s, event("resume")) == "resumed" and s["status"] == "active"
    assert states.step(s, event("reset")) == "reset" and (s["stage"], s["status"]) == (0, "candidate")
    assert states.step(s, event("retire", code="closed")) == "retired" and states.step(s, event("pause")) == "refused" and states.step(s, event("check", "V0", True)) == "refused"
    assert states.step(s, event("other")) == "refused"


def test_retries_letters_and_pauses():
    s = states.fresh()
    waits = []
    for _ in range(3):
        assert states.step(s, event("failure", code="timeout", retryable=True)) == "retry"
        waits.append((s["next_due"] - T0).total_seconds())
    assert waits == [60, 120, 240]
    assert states.step(s, event("failure", code="timeout", retryable=True)) == "dead letter" and s["letters"] == {"timeout": 4} and s["status"] == "candidate" and s["failures"] == 0
    assert states.step(s, event("failure", code="timeout")) == "dead letter" and s["letters"] == {"timeout": 5} and (s["status"], s["reason"]) == ("paused", "repeated timeout")
    assert states.step(s, event("success")) == "success" and s["letters"] == {}
    s = states.fresh()
    states.step(s, event("failure", code="blocked_captcha", retryable=True))
    assert (s["status"], s["reason"]) == ("paused", "blocked_captcha")
    s = states.fresh()
    states.step(s, event("failure", code="blocked_mime"))
    assert s["status"] == "candidate"
    states.step(s, event("failure", code="blocked_mime"))
    assert s["reason"] == "repeated blocked_mime"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    out = []
    for i in range(400):
        kind = rng.choice(["check", "check", "failure", "failure", "success", "pause", "resume", "reset", "retire"] if i % 23 == 0 else ["check", "check", "failure", "success"])
        out.append((rng.choice([1, 1, 1, 2, 3, 4]), T0 + dt.timedelta(minutes=20 * i), i, kind, rng.choice(states.STAGES[1:4]), rng.random() < 0.8, rng.choice(["timeout", "selector_drift", "parse", None]), rng.random() < 0.5))
    return out


def loop(events):
    held, out = {}, {}
    for source, at, seq, kind, stage, passed, code, retryable in events:
        s = held.setdefault(source, states.fresh())
        outcome = states.step(s, event(kind, stage, passed, code, retryable, at))
        out[seq] = (source, outcome, states.STAGES[s["stage"]], s["status"], s["reason"], s["failures"], len(s["letters"]), s["next_due"])
    return out


def as_dict(rows):
    return {r.seq: (r.source, r.outcome, r.stage, r.status, r.reason, r.failures, r.letters, r.next_due) for r in rows if r.outcome != "overdue"}


def test_histories_are_those_of_the_loop(spark, events):
    df = spark.createDataFrame([*events, (None, T0, 999, "check", "V0", True, None, False), (7, None, 998, "check", "V0", True, None, False)], states.EVENT)
    found = states.histories(df)
    want = loop(events)
    assert as_dict(found.collect()) == want
    assert {r.source: r.seq for r in states.latest(found).collect()} == {s: max(k for k, v in want.items() if v[0] == s) for s in (1, 2, 3, 4)}
    assert states.histories(df.where("false")).count() == 0


def test_a_stream_goes_on_from_its_checkpoint(spark, events, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    silent = [(99, T0, 5000, "success", None, None, None, None)]
    batches = [silent + events[:150], events[150:230], events[230:]]

    def run():
        stream = spark.readStream.schema(states.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        query = states.streamed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for rows in batches:  # each time a new query takes up the states
        spark.createDataFrame(rows, states.EVENT).coalesce(1).write.mode("append").parquet(source)
        run()
    rows = spark.read.parquet(out).collect()
    found = as_dict(rows)
    assert found.pop(5000)[:2] == (99, "success") and found == loop(events)
    assert [(r.source, r.at) for r in rows if r.outcome == "overdue" and r.source == 99] == [(99, T0 + dt.timedelta(hours=1) + states.GRACE)]
