"""Live transcripts: routing, finals, offsets, echo gate, sessions (STR-*, JN-22, JN-23, CP-16, FLT-13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StringType

from parley.functions import text as T

#: Horizon in seconds, overlap and least words of an echo; gap and overlap of bleed; shortest recording; lines kept.
HORIZON_S, ECHO, ECHO_WORDS, BLEED_GAP_S, BLEED, SHORTEST_S, LINES = 20, 0.6, 4, 4, 0.5, 15, 30
#: Keys of the echo gate's state. A stream goes on from its checkpoint only under the number that it began with.
GATES = 256


def routed(frames: DataFrame) -> DataFrame:
    """Frames with the speaker and role of their channel: 0 is the microphone, 1 the other side (STR-1)."""
    mic = F.col("channel") == 0
    return frames.withColumn("speaker", F.when(mic, "You").otherwise("Them")).withColumn("speaker_role", F.when(mic, "agent").otherwise("customer"))


def finals(frames: DataFrame) -> DataFrame:
    """Only final frames, the last of each utterance (STR-2). Batch or stream with a watermark on ts."""
    rows = frames.where("final")
    if rows.isStreaming:
        return rows.dropDuplicatesWithinWatermark(["meeting_id", "utterance_id"])
    by = Window.partitionBy("meeting_id", "utterance_id").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def event_offset(base: Column, t_ms: Column, audio_ms: Column) -> Column:
    """base + max(0, t - audio) in seconds (STR-3)."""
    return base + F.greatest(F.lit(0.0), (t_ms - audio_ms) / 1000)


def echoes(lines: DataFrame) -> DataFrame:
    """Microphone lines that repeat what the other channel said within HORIZON_S seconds before: four words or more
    that overlap one of those lines by ECHO (JN-23, as a batch). Lines fall into buckets of the
    horizon's width, so the join is an equi-join on meeting and bucket."""
    words = F.size(F.filter(F.split(T.echo_norm(F.col("text")), " "), lambda w: w != ""))
    mic = lines.where("channel = 0").where(words >= ECHO_WORDS).withColumn("b", F.floor(F.col("offset_s") / HORIZON_S))
    them = lines.where("channel = 1").select("meeting_id", F.col("offset_s").alias("o"), F.col("text").alias("t"), F.explode(F.array(F.floor(F.col("offset_s") / HORIZON_S), F.floor(F.col("offset_s") / HORIZON_S) + 1)).alias("b"))
    near = (F.col("o") <= F.col("offset_s")) & (F.col("offset_s") - F.col("o") <= HORIZON_S)
    return mic.join(them, ["meeting_id", "b"]).where(near & (T.word_overlap(F.col("text"), F.col("t")) >= ECHO)).select("meeting_id", "utterance_id").distinct()


def without_bleed(mic: DataFrame, call: DataFrame) -> DataFrame:
    """Microphone segments without those that start within four seconds of a call segment and share half
    its words (JN-22)."""
    b = lambda c: F.floor(c / BLEED_GAP_S)
    c = call.select("meeting_id", F.col("offset_s").alias("o"), F.col("text").alias("t"), F.explode(F.array(*(b(F.col("offset_s")) + d for d in (-1, 0, 1)))).alias("b"))
    m = mic.withColumn("b", b(F.col("offset_s")))
    same = (F.col("m.meeting_id") == F.col("c.meeting_id")) & (F.col("m.b") == F.col("c.b")) & (F.abs(F.col("m.offset_s") - F.col("c.o")) < BLEED_GAP_S)
    return m.alias("m").join(c.alias("c"), same & (T.word_overlap(F.col("m.text"), F.col("c.t")) >= BLEED), "left_anti").drop("b")


def reindexed(segments: DataFrame) -> DataFrame:
    """Merged segments in order of offset under dense indices (WN-7, STR-5)."""
    by = Window.partitionBy("meeting_id").orderBy("offset_s", "speaker", "text")
    return segments.withColumn("idx", F.row_number().over(by) - 1)


def resumed(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """A resumed meeting: fresh lines start two seconds after the last one ended (STR-6, AG-22)."""
    end = existing.groupBy("meeting_id").agg((F.max(F.col("offset_s") + F.col("duration_s")) + 2).alias("base"))
    shifted = fresh.join(end, "meeting_id", "left").withColumn("offset_s", F.col("offset_s") + F.coalesce("base", F.lit(0.0))).drop("base")
    return existing.unionByName(shifted.select(existing.columns))


def empty_cause(audio_bytes: Column, error: Column) -> Column:
    """Why a stream gave no words (STR-9)."""
    return F.when(error.isNotNull(), "recogniser-error").when(audio_bytes == 0, "no-audio").otherwise("silence")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start_ms, end_ms, n) of runs of events with gaps below `gap`; those shorter than
    SHORTEST_S seconds, measured between events, are discarded (STR-10, FLT-13). Batch or stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", "1 hour")
    s = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    ms = lambda c: F.unix_millis(c)
    return s.where(ms(F.col("last")) - ms(F.col("first")) >= SHORTEST_S * 1000).select("user_id", ms(F.col("first")).alias("start_ms"), ms(F.col("last")).alias("end_ms"), "n")


#: Bytes of a tape worth a job, lines and seconds worth splitting, words of a line that may be cut.
MIN_TAPE, MIN_LINES, MIN_SPOKEN_S, CUT_WORDS = 960_000, 2, 20.0, 6


def diarize_plan(tapes: DataFrame, utterances: DataFrame, runs: DataFrame) -> DataFrame:
    """(meeting_id, channel, action) of tapes (meeting_id, channel, bytes, resumed): what is done with each (CP-16).

    A meeting that shipped before is left alone; a resumed one, one without a tape of MIN_TAPE bytes and one whose
    speakers are told apart already is skipped; a channel with too few lines or too little speech has nothing to
    split; the others run. runs: meeting_id, status."""
    name = F.when(F.col("channel") == 0, "Them").otherwise("You")
    shipped = runs.where("status = 'shipped'").select("meeting_id").distinct().withColumn("shipped", F.lit(True))
    split = utterances.where("speaker like 'Speaker %' or speaker like 'Room %'").select("meeting_id").distinct().withColumn("split", F.lit(True))
    spoken = utterances.groupBy("meeting_id", F.col("speaker").alias("name")).agg(F.count("*").alias("lines"), F.sum("duration_s").alias("spoken_s"))
    whole = tapes.groupBy("meeting_id").agg(F.bool_or("resumed").alias("any_resumed"), F.max("bytes").alias("most"))
    rows = tapes.withColumn("name", name).join(whole, "meeting_id").join(shipped, "meeting_id", "left").join(split, "meeting_id", "left").join(spoken, ["meeting_id", "name"], "left")
    action = (
        F.when(F.col("shipped"), "done")
        .when(F.col("any_resumed"), "skip: resumed")
        .when(F.col("most") == 0, "skip: no tapes")
        .when(F.col("most") < MIN_TAPE, "skip: too short")
        .when(F.col("split"), "skip: told apart already")
        .when(F.col("bytes") < MIN_TAPE, "channel too short")
        .when((F.coalesce("lines", F.lit(0)) < MIN_LINES) | (F.coalesce("spoken_s", F.lit(0.0)) < MIN_SPOKEN_S), "nothing to split")
        .otherwise("run")
    )
    return rows.select("meeting_id", "channel", action.alias("action"))


def substituted(utterances: DataFrame, segments: DataFrame) -> DataFrame:
    """Utterances whose channel was split give way to its segments (meeting_id, channel, speaker, start, end, text):
    speakers are `Speaker N` on the call and `Room N` in the room, room segments that repeat a call segment go, and
    lines are numbered by time again (CP-16, JN-22, WN-7)."""
    number = F.coalesce(F.nullif(F.regexp_extract("speaker", r"(\d+)", 1), F.lit("")), F.lit("1"))
    call = F.col("channel") == 0
    seg = segments.where(F.trim("text") != "").select(
        "meeting_id", F.concat(F.when(call, "Speaker ").otherwise("Room "), number).alias("speaker"), F.when(call, "customer").otherwise("agent").alias("speaker_role"), F.trim("text").alias("text"),
        F.col("start").alias("offset_s"), F.greatest(F.lit(0.3), F.col("end") - F.col("start")).alias("duration_s"))
    room, theirs = seg.where("speaker_role = 'agent'"), seg.where("speaker_role = 'customer'")
    keyed = room.withColumn("idx", F.row_number().over(Window.partitionBy("meeting_id").orderBy("offset_s", "speaker", "text")))
    kept = without_bleed(keyed, theirs).select(seg.columns)
    replaced = segments.select("meeting_id", F.when(call, "Them").otherwise("You").alias("speaker")).distinct()
    left = utterances.join(replaced, ["meeting_id", "speaker"], "left_anti").select(seg.columns)
    return reindexed(left.unionByName(theirs).unionByName(kept))


def trim_echo(text: str, heard: list[str]) -> str:
    """A microphone line without the lines of CUT_WORDS words or more of the other channel that stand in it word
    for word; the hit is mapped back by counting words (SC-14)."""
    import re

    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s.lower())).strip()
    out = text
    for line in heard:
        at = norm(out).find(norm(line)) if len(line.split()) >= CUT_WORDS else -1
        if at >= 0:
            first, words = len(norm(out)[:at].split()), out.split()
            out = " ".join(words[:first] + words[first + len(norm(line).split(" ")) :]).strip()
    return out


@F.pandas_udf(StringType())
def trimmed(texts: pd.Series, heard: pd.Series) -> pd.Series:
    """trim_echo over columns: a line, and the array of the other channel's recent lines."""
    return pd.Series([trim_echo(t or "", list(h) if h is not None else []) for t, h in zip(texts, heard)])


class EchoGate(StatefulProcessor):
    """Per meeting: the last LINES lines of the other channel within the horizon are state; a microphone
    line of ECHO_WORDS words of three letters or more, of which one of them has ECHO, is an echo (STR-4). For
    transformWithStateInPandas.

    Input columns meeting_id, utterance_id, channel, offset_s, text, final, ts (the event time of offset_s); partial lines
    of the other channel feed the state, only final microphone lines come out.

    The key is a gate, which many meetings share: a call for a key costs some ms whatever it holds, and batches have many
    meetings of few lines. Lines in the state name their meeting, and the time up to which it is kept. A timer, one a gate,
    clears a meeting's lines once the watermark has passed the horizon of its newest line, so meetings that end leave
    nothing behind."""

    def init(self, handle) -> None:
        self.handle = handle
        self.heard = handle.getListState("heard", "meeting_id string, offset_s double, text string, until long")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        words = lambda s: [w for w in _bare(s) if len(w) > 2]
        kept, fresh = self._held(), {}
        for f in rows:
            for r in f.itertuples(index=False):
                fresh.setdefault(r.meeting_id, []).append(r)
        out = []
        for meeting, every in fresh.items():
            until, held = kept.get(meeting, (0, []))
            lines, said = list(held), {}
            # Of lines at one time the other channel's come first.
            for r in sorted(every, key=lambda r: (r.offset_s, -r.channel)):
                until = max(until, int(r.ts.timestamp() * 1000) + (HORIZON_S + 1) * 1000)
                if r.channel == 1:
                    lines.append((float(r.offset_s), r.text))
                elif r.final:
                    mine = words(r.text)
                    near = []
                    if len(mine) >= ECHO_WORDS:
                        for o, t in lines[-LINES:]:
                            if 0 <= r.offset_s - o <= HORIZON_S:
                                if t not in said:
                                    said[t] = {*words(t)}
                                near.append(said[t])
                    out.append((meeting, r.utterance_id, any(sum(w in t for w in mine) / len(mine) >= ECHO for t in near)))
            last = max((o for o, _ in lines), default=0.0)
            kept[meeting] = until, [x for x in lines if last - x[0] <= HORIZON_S][-LINES:]
        self._keep(kept, timerValues)
        yield pd.DataFrame(out, columns=["meeting_id", "utterance_id", "echo"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        self._keep(self._held(), timerValues)
        yield pd.DataFrame([], columns=["meeting_id", "utterance_id", "echo"])

    def _held(self) -> dict:
        """(until, lines) by meeting."""
        held = {}
        for meeting, offset, text, until in self.heard.get():
            held.setdefault(meeting, (until, []))[1].append((offset, text))
        return held

    def _keep(self, kept: dict, timerValues) -> None:
        """Store the lines of meetings that the watermark has not passed; the timer waits for the first that it will pass."""
        now = timerValues.getCurrentWatermarkInMs()
        rows = [(m, o, t, until) for m, (until, lines) in kept.items() if until > now for o, t in lines]
        self.heard.put(rows) if rows else self.heard.clear()
        old = self.timer.get()[0] if self.timer.exists() else None
        new = min((r[3] for r in rows), default=None)
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.timer.clear()
        else:
            self.timer.update((new,))
            self.handle.registerTimer(new)

    def close(self) -> None:
        pass


def _bare(text: str) -> list[str]:
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", text.lower())).split()


def gated(frames: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of frames with the echo gate's verdict for each final microphone line."""
    timed = frames.withColumn("gate", F.pmod(F.xxhash64("meeting_id"), F.lit(GATES))).withWatermark("ts", late)
    return timed.groupBy("gate").transformWithStateInPandas(EchoGate(), "meeting_id string, utterance_id string, echo boolean", "append", "eventtime")
