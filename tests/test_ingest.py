"""Streams against their batch rules, over restarts and repeated batches."""

import datetime

from test_operators import FRAME, FRAMES

from parley.streaming import ingest, live

LINE = "meeting_id string, utterance_id string, seq long, offset_s double, speaker string, text string, final boolean"


def stamp(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_echo_gate_equals_batch_over_a_restart(spark, tmp_path):
    frames = spark.createDataFrame([(f"{m}{k}", *r[1:]) for k in range(3) for m, *_ in [("m",)] for r in FRAMES], FRAME)
    want = sorted(tuple(r) for r in live.echoes(frames).select("meeting_id", "utterance_id").collect())
    timed = frames.withColumn("ts", ingest.F.timestamp_micros((ingest.F.col("offset_s") * 1_000_000).cast("long")))
    read = lambda: spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
    half = timed.selectExpr("percentile_approx(offset_s, 0.5)").first()[0]
    for part in (f"offset_s <= {half}", f"offset_s > {half}"):
        # Each round starts the query anew from its checkpoint.
        timed.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.run(live.gated(read()), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["meeting_id"], r["utterance_id"]) for r in out.where("echo").collect()) == want and want
    assert out.count() == out.select("meeting_id", "utterance_id").distinct().count()


def test_pairing_waits_and_then_calls_it_a_crash(spark):
    begins = [(i, "ask", stamp(60 * i)) for i in range(60)]
    ends = [(i, "shipped", stamp(60 * i + 30)) for i in range(60) if i % 3] + [(3, "late", stamp(180 + 3 * 3600)), (99, "stray", stamp(5))]
    got = ingest.pair_runs(spark.createDataFrame(begins, "id long, kind string, started_at timestamp"), spark.createDataFrame(ends, "id long, outcome string, ended_at timestamp"))
    assert sorted((r["id"], r["outcome"], r["failure"]) for r in got.collect()) == [(i, "shipped", None) if i % 3 else (i, "failed", "crash") for i in range(60)]


def lines(*rows):
    return [(m, u, s, o, "You", t, f) for m, u, s, o, t, f in rows]


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    sink = ingest.FinalLines(str(tmp_path / "t"))
    state = lambda: sorted(tuple(r) for r in sink.read(spark).select("meeting_id", "idx", "utterance_id", "text").collect())
    first = spark.createDataFrame(lines(("m1", "a", 1, 5.0, "old", True), ("m1", "b", 2, 9.0, "bee", True), ("m2", "a", 1, 1.0, "two", True), ("m1", "p", 3, 1.0, "partial", False)), LINE)
    sink(first, 0)
    files = sorted(p.name for p in (tmp_path / "t/lines/meeting_id=m2").glob("*.parquet"))
    late = spark.createDataFrame(lines(("m1", "a", 7, 5.0, "new", True), ("m1", "c", 4, 0.5, "late", True)), LINE)
    sink(late, 1)
    want = [("m1", 0, "c", "late"), ("m1", 1, "a", "new"), ("m1", 2, "b", "bee"), ("m2", 0, "a", "two")]
    assert state() == want
    sink(late, 1)
    sink(first, 0)
    sink(late.limit(0), 2)
    assert state() == want
    sink(late, 3)
    assert state() == want and files


def test_finals_survive_a_kill_between_batches(spark, tmp_path):
    rows = spark.createDataFrame(lines(*((f"m{i % 3}", f"u{i // 2}", i, float(100 - i), f"t{i}", i % 4 != 0) for i in range(40))), LINE)
    sink = ingest.FinalLines(str(tmp_path / "t"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    class Killed(Exception):
        pass

    def dying(batch, number):
        sink(batch, number)
        if number == 1:
            raise Killed

    for part in ("seq < 15", "seq between 15 and 30", "seq > 30"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    try:
        ingest.run(stream(), "", str(tmp_path / "cp"), dying)
    except Exception as e:  # noqa: BLE001
        assert "Killed" in str(e)
    ingest.run(stream(), "", str(tmp_path / "cp"), sink)
    got = sorted((r["meeting_id"], r["utterance_id"], r["seq"]) for r in sink.read(spark).collect())
    best = {}
    for m, u, s, *_, f in rows.collect():
        if f:
            best[m, u] = max(best.get((m, u), -1), s)
    assert got == sorted((m, u, s) for (m, u), s in best.items())


def test_batches_of_several_files_stay_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "ROWS_OF_FILE", 100)
    monkeypatch.setattr(ingest, "LEAST_OF_FILE", 50)
    rows = spark.range(0, 900, 1, 3).selectExpr("id", "cast(id as double) offset_s")
    stream, at, files = ingest.replayed(rows, "offset_s")
    seen = {}
    ingest.run(stream, "", f"{at}/checkpoint", lambda batch, number: seen.update({number: sorted(r["id"] for r in batch.collect())}))
    assert files > 1 and len(seen) == 3 and sum((seen[k] for k in sorted(seen)), []) == list(range(900))
    few = rows.where("id < 30")
    assert ingest.replayed(few, "offset_s")[2] == 1


def test_meetings_share_a_gate(spark, monkeypatch):
    monkeypatch.setattr(live, "GATES", 2)
    monkeypatch.setattr(ingest, "ROWS_OF_FILE", 10)
    monkeypatch.setattr(ingest, "LEAST_OF_FILE", 4)
    frames = spark.createDataFrame([(f"m{k}", *r[1:]) for k in range(12) for r in FRAMES], FRAME)
    want = sorted(tuple(r) for r in live.echoes(frames).select("meeting_id", "utterance_id").collect())
    out = ingest.gate_echoes(frames)
    assert sorted((r["meeting_id"], r["utterance_id"]) for r in out.where("echo").collect()) == want and want
    assert out.count() == frames.where("channel = 0 and final").count()


class State:
    """One state variable, or the handle of all of them."""

    def __init__(self):
        self.rows, self.timers, self.made = [], set(), {}
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getListState(self, name, schema):
        return self.made.setdefault(name, State())

    getValueState = getListState

    def get(self):
        return self.rows if not self.rows or isinstance(self.rows[0], tuple) else tuple(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    update = put

    def clear(self):
        self.rows = []


def test_a_gate_forgets_only_meetings_that_the_watermark_passed():
    import pandas as pd

    handle, gate = State(), live.EchoGate()
    gate.init(handle)
    clock = lambda ms: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    rows = pd.DataFrame([(m, "u", 1, o, "some words of the other side", True, stamp(o)) for m, o in (("a", 5.0), ("b", 300.0))], columns=["meeting_id", "utterance_id", "channel", "offset_s", "text", "final", "ts"])
    list(gate.handleInputRows((0,), iter([rows]), clock(0)))
    assert [r[0] for r in handle.made["heard"].rows] == ["a", "b"] and len(handle.timers) == 1
    first = handle.timers.pop()
    list(gate.handleExpiredTimer((0,), clock(first), None))
    assert [r[0] for r in handle.made["heard"].rows] == ["b"] and handle.timers == {first + 295_000}
    second = handle.timers.pop()
    list(gate.handleExpiredTimer((0,), clock(second), None))
    assert not handle.made["heard"].rows and not handle.made["timer"].rows and not handle.timers
