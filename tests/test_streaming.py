import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from clausemill.streaming import events as S

ROW = "study string, arrival long, server_ms long, event_type string, data string, participant_id string, session_id string"


def put(tmp_path, name, rows):
    os.makedirs(tmp_path / "in", exist_ok=True)
    with open(tmp_path / "in" / name, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def row(arrival, kind, session=None, data="{}"):
    return {"study": "s", "arrival": arrival, "server_ms": 1000 + 10 * arrival, "event_type": kind, "data": data, "participant_id": "7" if session else None, "session_id": session}


def test_state_machine_survives_a_restart(spark, tmp_path):
    put(tmp_path, "a.json", [row(0, "click"), row(1, "session_start", "x"), row(2, "click"), row(3, "session_start", "y")])
    run = lambda name: S.stamped(spark.readStream.schema(ROW).json(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    run("a")
    put(tmp_path, "b.json", [row(4, "heartbeat"), row(5, "session_end"), row(6, "click"), row(7, "session_end"), row(8, "session_start", "z")])
    run("b")
    got = {r.arrival: (r.session_id, r.seq, r.t_ms, r.logged, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        0: (None, None, None, False, "no_active_session"), 1: ("x", 0, 0, True, None), 2: ("x", 1, 10, True, None), 3: (None, None, None, False, "already_active"),
        4: ("x", 2, 30, True, None), 5: ("x", 3, 40, True, None), 6: (None, None, None, False, "no_active_session"), 7: (None, None, None, False, "no_active_session"), 8: ("z", 0, 0, True, None),
    }


def made(n, seed=1):
    """n rows of one study: sessions of a few hundred rows, starts and ends out of place now and then."""
    dice = random.Random(seed)
    kinds = ["click"] * 300 + ["session_start"] * 2 + ["session_end"]
    return [row(k, kind, f"p{k}" if kind == "session_start" else None) for k, kind in enumerate(dice.choice(kinds) for _ in range(n))]


def plain(rows):
    """The loop that the stream must equal, with the state as a dictionary."""
    active, out = None, {}
    for r in rows:
        kind, k = r["event_type"], r["arrival"]
        if kind == "session_start" and active:
            out[k] = (None, None, None, False, "already_active")
            continue
        if kind == "session_start":
            active = {"id": r["session_id"], "next": 0, "at": r["server_ms"]}
        if not active:
            out[k] = (None, None, None, False, "no_active_session")
            continue
        out[k] = (active["id"], active["next"], r["server_ms"] - active["at"], True, None)
        active["next"] += 1
        if kind == "session_end":
            active = None
    return out


def through(spark, tmp_path, files, per_trigger=1000, **options):
    """What has come out after the files, put there in turn, and one run over all that are there."""
    for name, rows in files.items():
        put(tmp_path, name, rows)
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", per_trigger).json(f"{tmp_path}/in")
    query = S.stamped(source, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").where("coalesce(reason, '') != 'repeated'").collect()
    assert len({r.arrival for r in rows}) == len(rows)
    return {r.arrival: (r.session_id, r.seq, r.t_ms, r.logged, r.reason) for r in rows}


def interleaved(rows, seed=2):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return {f"{seed}-{k}.json": rows[k::4] for k in range(4)}


@pytest.mark.parametrize("n, batch", [(30_000, "10000"), (4_000, "500"), (300_000, "10000")])
def test_numbers_follow_arrival_over_arrow_batches_and_a_restart(spark, tmp_path, n, batch):
    rows = made(n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = through(spark, tmp_path, interleaved(rows[: n // 2]))
        assert got == {k: v for k, v in plain(rows).items() if k < n // 2}
        assert through(spark, tmp_path, interleaved(rows[n // 2 :], 3)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_ahead_of_their_turn_wait_over_micro_batches_and_a_restart(spark, tmp_path):
    rows = made(6_000, 5)
    files = interleaved(rows, 4)
    some = dict(list(files.items())[:2])
    got = through(spark, tmp_path, some, 1, dense=True)
    ready = min(set(range(6_000)) - {r["arrival"] for own in some.values() for r in own})
    assert got == {k: v for k, v in plain(rows).items() if k < ready}
    # the rest, and some rows once more
    rest = dict(list(files.items())[2:]) | {"again.json": rows[:50] + rows[4_000:4_010]}
    assert through(spark, tmp_path, rest, 1, dense=True) == plain(rows)


def test_rows_wait_for_later_ones_of_their_study(spark, tmp_path):
    rows = made(2_000, 6)
    dice = random.Random(1)
    late = sorted(rows, key=lambda r: r["arrival"] + dice.uniform(0, 90))
    files = {f"{k:02}.json": late[k * 200 : (k + 1) * 200] for k in range(10)}
    got = through(spark, tmp_path, files, 1, wait_ms=1_000)
    last = max(k for k in got)
    assert got == {k: v for k, v in plain(rows).items() if k <= last} and last >= 2_000 - 102
    far = [row(10_000, "heartbeat"), row(10_001, "heartbeat")]
    got = through(spark, tmp_path, {"99.json": far}, 1, wait_ms=1_000)
    assert {k: v for k, v in got.items() if k < 2_000} == plain(rows)


def test_patience_lets_waiting_rows_go(spark, tmp_path):
    put(tmp_path, "a.json", [row(1, "click"), row(0, "session_start", "x"), row(3, "click"), row(4, "click")])
    source = spark.readStream.schema(ROW).json(f"{tmp_path}/in")
    query = S.stamped(source, dense=True, patience_ms=1_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if query.lastProgress and spark.read.schema(S.STAMPED).parquet(f"{tmp_path}/out").count() == 4:
                break
    finally:
        query.stop()
    got = {r.arrival: (r.session_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: ("x", 0), 1: ("x", 1), 3: ("x", 2), 4: ("x", 3)}


def test_acceptance(spark):
    rows = [("click", "{}"), ("click", "x" * (64 * 1024 + 1)), ("session_start", "{}"), (None, "{}"), ("click", None)]
    taken, refused = S.accepted(spark.createDataFrame(rows, "event_type string, data string"))
    assert taken.count() == 2 and sorted(r.reason for r in refused.collect()) == ["too_large", "unknown_type", "unknown_type"]


def test_gap_sessions_in_batch_and_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    batch = {(r.user_id, r.start, r.n_events) for r in S.gap_sessions(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    got = {(r.user_id, r.start, r.n_events) for r in S.drained(spark, S.gap_sessions(stream, late="365 days"), "gaps", "complete").collect()}
    assert got == batch


def test_status_and_sinks(spark, tmp_path):
    rows = [("p", "s", 1000, "heartbeat", "results", 1), ("p", "s", 4000, "click", None, 2)]
    df = spark.createDataFrame(rows, "participant_id string, session_id string, server_ms long, event_type string, screen string, seq long")
    r = S.status(df, F.lit(5000).cast("long")).first()
    assert (r.last_event_age_s, r.last_heartbeat_age_s, r.screen, r.ended) == (1.0, 4.0, "results", False)
    said = []

    def fail(batch):
        raise ValueError("disk is full")

    S.best_effort(fail, lambda epoch, why: said.append((epoch, why)))(df, 3)
    assert said == [(3, "ValueError: disk is full")]
    write = S.idempotent(f"{tmp_path}/log")
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_rows_are_numbered_at_once_and_as_one_by_one(monkeypatch):
    r = random.Random(9)
    kinds = ["session_start", "session_end", "click", None]
    cases = [([r.choice(kinds) for _ in range(r.randint(0, 12))], r.choice([None, ("p", "old", 7, 100)])) for _ in range(200)]
    made_rows = lambda ks: S.pd.DataFrame({"arrival": range(len(ks)), "server_ms": [r.randint(0, 999) for _ in ks], "event_type": ks, "data": "{}", "participant_id": r.choice(["a", None]), "session_id": [f"s{i}" for i in range(len(ks))]})
    asked = []
    for ks, state in cases:
        pdf, now, want = made_rows(ks), state, []
        for x in pdf.itertuples(index=False):
            now, told = S.transition(now, x)
            want.append(told)
        asked.append((pdf, state, now, want))
    monkeypatch.setattr(S, "transition", None)  # no row is stepped by itself
    for pdf, state, now, want in asked:
        after, told = S.numbered_rows(state, pdf)
        assert after == now
        got = [{c: None if S.pd.isna(x) else x for c, x in row.items()} for row in told[["participant_id", "session_id", "seq", "t_ms", "logged", "reason"]].to_dict("records")]
        assert got == want
