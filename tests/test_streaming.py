"""Streams over JSON logs against the same computation on the whole."""

from scriptorium.streaming import events as E

DATA = "/root/testdata/sf0.001"


def _log(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", E.F.col("ts").cast("timestamp")).coalesce(1).write.json(path)
    with open(f"{path}/part-broken.json", "w") as f:
        f.write("not json\n\n")
    return E.read_log(spark, path)


def _drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_and_duplicates(spark, tmp_path):
    log = _log(spark, tmp_path)
    whole = spark.read.parquet(f"{DATA}/events.parquet")
    got = _drained(E.windowed(log, "1 day"), "windowed", "complete")
    assert got.agg(E.F.sum("n")).first()[0] == whole.count()
    assert _drained(E.unique(log.union(log)), "uniq").count() == whole.select("event_id").distinct().count()


def test_escalation_matches_a_plain_fold(spark, tmp_path):
    got = {r["event_id"]: (r["drifts"], r["locked"], r["delta"]) for r in _drained(E.escalation(_log(spark, tmp_path)), "esc").collect()}
    want, state = {}, {}
    for r in sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda r: r["event_id"]):
        d, n, t = state.get(r["user_id"], (0, 0, 0.0))
        state[r["user_id"]] = want[r["event_id"]] = (*E.locked_out(r["event_type"] == "error", d, n), E.chunk_delta(t, r["value"] - 50.0, r["event_type"] == "signup"))
    assert got == want


def test_machines():
    s = (0, 0)
    for _ in range(3):
        s = E.locked_out(True, *s)
    assert s == (0, 5) and E.locked_out(True, *s) == (0, 4)
    assert E.chunk_delta(19.5, 9, False) == 20.0 and E.chunk_delta(3, -9, False) == 1.0 and E.chunk_delta(3, 1, True) == 0.0


def test_sessions_end_after_a_gap(spark, tmp_path):
    """Events of a user no more than the gap apart are one session; a session ends a gap after its last event."""
    from datetime import UTC, timedelta

    log = _log(spark, tmp_path)
    got = {(r["user_id"], r["start"], r["stop"], r["n"]) for r in _drained(E.sessions(log, "6 hours"), "sessions", "complete").collect()}
    rows, gap, want = {}, timedelta(hours=6), set()
    for r in spark.read.parquet(f"{DATA}/events.parquet").collect():
        rows.setdefault(r["user_id"], []).append(r["ts"].replace(microsecond=r["ts"].microsecond // 1000 * 1000))  # as the log has it
    for user, at in rows.items():
        session = []
        for t in sorted(at):
            if session and t >= session[-1] + gap:
                want.add((user, session[0], session[-1] + gap, len(session)))
                session = []
            session.append(t)
        want.add((user, session[0], session[-1] + gap, len(session)))
    plain = lambda t: t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t
    assert {(u, plain(a), plain(z), n) for u, a, z, n in got} == want and 100 < len(want) < sum(map(len, rows.values()))
