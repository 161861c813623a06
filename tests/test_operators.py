"""Operators on hand-made cases that the generated tables cannot cover."""

import json

import pytest
from pyspark.sql import functions as F

from parley.operators import chunks, corrections, entities, gates, graph, handoffs, maintenance, outline, resolution, runs, segments
from parley.sources import calendar, files
from parley.streaming import live


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def utterances(spark, data):
    return spark.createDataFrame([(m, i, s, "customer", t, float(o), 5.0, c) for m, i, s, t, o, c in data], "meeting_id string, idx int, speaker string, speaker_role string, text string, offset_s double, duration_s double, confidence double")


@pytest.mark.parametrize("n, starts", [(1, [0]), (2, [0]), (3, [0]), (4, [0, 2]), (5, [0, 2]), (6, [0, 2, 4])])
def test_chunk_stop_rule(spark, n, starts):
    u = utterances(spark, [("m1", i, None, "t" * 400, i * 6, None) for i in range(n)])
    found = chunks.windows(u).orderBy("src_id").collect()
    assert [r["src_id"] for r in found] == [s for s in starts if s == 0 or s < n - 1]
    assert all(len(r["text"]) <= 900 for r in found)


def test_segments(spark):
    u = utterances(spark, [("m1", 0, None, "hello", 1.2, None), ("m1", 999, " ", "x", 2, 7.0), ("m1", 1, "Ann", "low", 3, 0.42)])
    got = {r["id"]: r for r in segments.segments(u).collect()}
    assert set(got) == {"S001", "S1000", "S002"} and got["S001"]["confidence"] == 1 and got["S1000"]["confidence"] == 1 and got["S1000"]["speaker"] == "customer"
    assert "(heard poorly)" in segments.render(segments.segments(u)).first()["transcript"]


def test_meeting_types(spark):
    t = lambda m, o=None: spark.range(1).select(segments.meeting_type(F.lit(m), F.lit(o).cast("string"))).first()[0]
    assert [t("investor"), t("discovery"), t("standup"), t("one_on_one"), t(None), t("x", "vendor"), t("investor", "bogus")] == ["investor", "customer", "team", "one_on_one", "team", "vendor", "investor"]


def test_payload_shapes(spark):
    item = [{"speaker": "A", "text": "hi", "offset_s": 0.0}]
    p = spark.createDataFrame([("a", json.dumps(item)), ("b", json.dumps({"segments": item})), ("c", json.dumps({"utterances": item})), ("d", json.dumps({"results": item}))], "meeting_id string, payload string")
    assert [r["text"] for r in segments.from_payloads(p).collect()] == ["hi"] * 4
    with pytest.raises(Exception, match="unknown transcript payload"):
        segments.from_payloads(spark.createDataFrame([("a", '{"odd":1}')], "meeting_id string, payload string")).collect()


def test_grounding(spark):
    u = utterances(spark, [("m1", 0, "A", "We will ship the importer next week", 0, None)])
    c = spark.createDataFrame([(1, "m1", "ship the importer", None), (2, "m1", "buy a boat tomorrow", None), (3, "m1", None, 15.0), (4, "m1", None, 15.5), (5, "m1", None, None), (6, "m2", None, 1.0)], "id int, meeting_id string, quote string, offset_s double")
    assert {r["id"]: r["gate_reason"] is None for r in gates.grounded(c, u).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_sanitised_statements(spark):
    u = utterances(spark, [("m1", 0, "Ann", "It costs $40 a seat", 0, None), ("m1", 1, "Ben", "fine", 6, 0.4)])
    owners = spark.createDataFrame([("m1", ["Ann", "Ben"])], "meeting_id string, names array<string>")
    raw = spark.createDataFrame([("m1", 0, " ", "x", ["S001"], None), ("m1", 1, "a", "x", [], None), ("m1", 2, "a", "x", ["S9"], None), ("m1", 3, "costs $50", "number", ["S001"], None), ("m1", 4, 'says "no way"', "quote", ["S001"], None), ("m1", 5, "costs $40", "odd", ["S001"], "ann"), ("m1", 6, "fine", "opinion", ["S002"], "Zed")], "meeting_id string, pos int, text string, kind string, source array<string>, speaker string")
    got = {r["pos"]: r for r in gates.sanitize_statements(raw, segments.segments(u), owners).collect()}
    assert [got[i]["reason"].split(":")[0] for i in range(5)] == ["no text", "no source segment ids", "cites segments that do not exist", "figure/date not in cited text", "quoted span is not verbatim in one cited segment"]
    assert (got[5]["id"], got[5]["kind"], got[5]["speaker"], got[6]["id"], got[6]["speaker"], got[6]["heard_poorly"]) == ("ST1", "other", "ann", "ST2", None, True)


def test_resolution_cascade(spark):
    known = spark.createDataFrame([("topic:pricing-page", "topic", "pricing page", "pricing page", None), ("topic:anz-rollout", "topic", "ANZ rollout", "anz rollout", None)], "id string, kind string, label string, norm string, merged_into string")
    cands = spark.createDataFrame([("m1", "topic", "Pricing Page", 5), ("m1", "topic", "new pricing page", 4), ("m1", "topic", "hiring plan", 3), ("m1", "topic", "hiring plan draft", 2), ("m1", "topic", "ANZ pricing", 1)], "meeting_id string, kind string, surface string, weight int")
    got = {r["surface"]: (r["entity_id"], r["matcher"]) for r in resolution.resolve_all(cands, known).collect()}
    assert got["Pricing Page"] == ("topic:pricing-page", "alias") and got["new pricing page"] == ("topic:pricing-page", "contains")
    assert got["hiring plan"] == (None, "none") and got["hiring plan draft"] == ("topic:hiring-plan", "contains") and got["ANZ pricing"][1] in ("none", "contains")


def test_placeholders_get_no_identity(spark):
    r = spark.createDataFrame([("m1", "person", "Speaker 2", None, "none", 0.0, 0.0, True), ("m1", "person", "Ann", None, "none", 0.0, 0.0, True), ("m1", "topic", "x y", "topic:z", "lexical", 0.8, 0.78, True)], "meeting_id string, kind string, surface string, entity_id string, matcher string, score double, runner_up double, has_proof boolean")
    e, a, m = entities.store(entities.canonical_reason(r))
    assert rows(e.select("id")) == [("person:ann",), ("topic:x-y",)] and rows(m.select("entity_id", "gate")) == [("person:ann", "passed"), ("topic:x-y", "blocked")]


def test_corrections_apply_and_undo(spark):
    f = spark.createDataFrame([("utterance", "0", "text", "Katy met Kati"), ("utterance", "1", "text", "nobody"), ("node", "n", "label", "Katy")], "target string, key string, field string, text string")
    found = corrections.occurrences(f, "Katy", "Katie")
    assert rows(found.select("ref", "match")) == [("node:n#label#Katy", "exact"), ("utterance:0#text#Kati", "fuzzy"), ("utterance:0#text#Katy", "exact")]
    done = corrections.apply(f, found, ["utterance:0#text#Kati", "utterance:0#text#Katy"], "Katie")
    assert ("utterance", "0", "text", "Katie met Katie") in rows(done.select("target", "key", "field", "text"))
    assert rows(corrections.undo(done)) == rows(f)


@pytest.mark.parametrize("a, b, swap", [("Call Jon now", "Call John now", ("Jon", "John")), ("same", "same", None), ("Call jon", "Call John", None), ("A b c d e", "Z y x w e", None)])
def test_word_swap(a, b, swap):
    assert corrections.word_swap(a, b) == swap


def test_outline_round_trip():
    md = "- Decisions\n  - Ship it [S001, S002]\n  - Wait [S003 ?]\n- Topics\n\t- Price"
    got = outline.parse_markdown(md)
    assert got == [([0], "Decisions", [], False), ([0, 0], "Ship it", ["S001", "S002"], False), ([0, 1], "Wait", ["S003"], True), ([1], "Topics", [], False), ([1, 0], "Price", [], False)]


def test_sections_hoist_and_stray(spark):
    notes = {"themes": [{"text": "Topics", "children": [{"text": "Pricing", "source": ["S1"]}, {"text": "Next steps:", "children": [{"text": "Ann sends it", "source": ["S2"]}]}]}, {"text": "Stray", "source": ["S3"]}, {"text": "blockers", "children": [{"text": "No budget", "source": ["S4"]}]}]}
    b = outline.bullets(spark.createDataFrame([("d", json.dumps(notes))], "doc_id string, json string"))
    assert rows(outline.normalize_sections(b, "team").select("section", "order", "text")) == [("Action items", 0, "Ann sends it"), ("Discussion", 0, "Pricing"), ("Discussion", 1, "Stray"), ("Risks & concerns", 0, "No budget")]


CAL = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Stand\r\n up\r\nDTSTART;TZID=America/New_York:20240102T090000\r\nDTEND;TZID=America/New_York:20240102T091500\r\nRRULE:FREQ=WEEKLY;BYDAY=TU,TH;COUNT=4\r\nEXDATE;TZID=America/New_York:20240104T090000\r\nATTENDEE;CN=Ann:mailto:a@x\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nSUMMARY:Off\r\nDTSTART;VALUE=DATE:20240103\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:3\r\nSTATUS:CANCELLED\r\nDTSTART:20240103T100000Z\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:4\r\nSUMMARY:Daily\r\nDTSTART:20240101T080000Z\r\nRRULE:FREQ=DAILY;UNTIL=20240103T080000Z\r\nEND:VEVENT\r\nEND:VCALENDAR"


def test_calendar(spark):
    day = 86400000
    jan1 = 1704067200000
    got = calendar.events(spark.createDataFrame([(CAL,)], "value string"), jan1, jan1 + 30 * day).collect()
    assert [(r["title"], (r["start_ms"] - jan1) / 3600000) for r in got if r["uid"] == "1"] == [("Standup", 38.0), ("Standup", 24 * 8 + 14.0), ("Standup", 24 * 10 + 14.0)]
    assert len([r for r in got if r["uid"] == "4"]) == 3 and not [r for r in got if r["uid"] in ("2", "3")]
    assert next(r for r in got if r["uid"] == "1")["attendees"] == ["Ann"]


def test_bundles_round_trip(spark, tmp_path):
    u = utterances(spark, [("m1", 0, "A", "hi", 0, None)])
    m = spark.createDataFrame([("m1", "T", "team", 1, 5.0)], "id string, title string, mode string, started_at bigint, duration_s double")
    c = spark.createDataFrame([(1, "m1", "decision", "{}", "q", 0.0, "passed", 0)], "id bigint, meeting_id string, kind string, body string, quote string, offset_s double, gate string, done int")
    files.export(m, u, c, str(tmp_path / "out"))
    m2, u2, c2 = files.read_bundles(spark, str(tmp_path / "out"))
    assert rows(m2) == rows(m) and u2.first()["text"] == "hi" and c2.first()["kind"] == "decision"


def test_directory_skips_manifest(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"dataset": 1}')
    (tmp_path / "meeting_1.json").write_text(json.dumps({"id": "a", "title": "T", "transcript": [{"offset_seconds": 0, "speaker": "A", "text": "one two three four five six"}, {"offset_seconds": 2, "speaker": "B", "text": "ok"}]}))
    m, u = files.directory(spark, str(tmp_path))
    assert m.count() == 1 and [r["duration_s"] for r in u.orderBy("idx").collect()] == [2.0, 1.5]


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# hi", "b.bin": None}


def test_log_is_bounded(tmp_path):
    log = files.rotating_log(str(tmp_path / "x.log"), 500, 2)
    for i in range(200):
        log.info("line %s", i)
    assert len(list(tmp_path.iterdir())) == 3 and sum(p.stat().st_size for p in tmp_path.iterdir()) <= 1500


def test_exits(spark):
    steps = spark.createDataFrame([(1, [("core:a", "failed")], None), (2, [("a", "skipped")], None), (3, [("a", "ok")], None), (4, [("core:a", "failed")], "deadline-exceeded")], "id int, steps array<struct<name:string,status:string>>, reason string")
    assert [r["x"] for r in steps.select("id", runs.decide_exit(F.col("steps"), F.col("reason")).alias("x")).orderBy("id").collect()] == ["failed", "partial", "shipped", "deadline"]
    limit = lambda u, ms: spark.range(1).select(runs.budget_reason(F.lit(u), F.lit(ms), F.lit(3), F.lit(100))).first()[0]
    assert [limit(3, 100), limit(2, 100), limit(3, 101)] == ["budget-exhausted", None, "deadline-exceeded"]


def test_handoff_routing(spark):
    route = lambda t: spark.range(1).select(handoffs.match_handoff(F.lit(t))).first()[0]
    asked = ["draft a follow-up email", "what is a crm note?", "why did the pricing quote move?", "how about you draft a pricing quote", "collated feedback", "hello"]
    assert [route(t) for t in asked] == ["followup_email", "crm_note", None, "pricing_quote", "collated_feedback", None]


def test_handoff_render_and_prune(spark):
    h = handoffs.BY_ID["team_actions"]
    line = lambda text, owner, due=None: {"text": text, "owner": owner, "due": due, "source": ["S001"]}
    groups = [{"owner": "", "items": [line("wait", "")]}, {"owner": "Bo", "items": [line("send", "Ann", "Friday"), line("call", None), line(" ", "Ann")]}]
    d = spark.createDataFrame([("d", "m1", json.dumps({"perOwner": groups}))], "doc_id string, meeting_id string, json string")
    items = handoffs.items(d, h)
    assert rows(items.select("path", "owner")) == [("perOwner[0].items[0]", "Ann"), ("perOwner[1].items[0]", "Bo"), ("perOwner[2].items[0]", "Unassigned")]
    meta = spark.createDataFrame([("d", "Standup", "2024-01-02")], "doc_id string, title string, when string")
    text = handoffs.render(items, h, meta).first()["markdown"]
    assert text == "**Action items — Standup** (2024-01-02)\n\n### Ann\n- [ ] **Ann** — send _(Friday)_\n### Bo\n- [ ] **Bo** — call\n### Unassigned\n- [ ] **Unassigned** — wait"
    assert [r["owner"] for r in handoffs.regroup(items).orderBy("last", "first").collect()] == ["Ann", "Bo", "Unassigned"]
    failed = spark.createDataFrame([("d", "perOwner[0].items[0]")], "doc_id string, path string")
    assert rows(handoffs.prune(items, failed, h).select("path")) == [("perOwner[1].items[0]",), ("perOwner[2].items[0]",)]


def test_prose_that_fails_is_replaced(spark):
    h = handoffs.BY_ID["slack_update"]
    segs = spark.createDataFrame([("m1", "S001", "we ship on friday")], "meeting_id string, id string, text string")
    owners = spark.createDataFrame([("m1", ["Ann"])], "meeting_id string, names array<string>")
    doc = {"headline": "Up 40%", "points": [{"text": "Ship on Friday", "source": ["S001"]}, {"text": "Ship 12 units", "source": ["S001"]}], "blockers": [{"text": "none", "source": ["S009"]}]}
    items = handoffs.items(spark.createDataFrame([("d", "m1", json.dumps(doc))], "doc_id string, meeting_id string, json string"), h)
    bad = handoffs.validate(items, segs, owners, {s.kind for s in h.sections})
    assert rows(bad.select("path", "rule")) == [("blockers[0]", "source-exists"), ("headline", "verbatim-number"), ("points[1]", "verbatim-number")]
    assert rows(handoffs.prune(items, bad, h).select("path", "text")) == [("headline", "Update from today's meeting"), ("points[0]", "Ship on Friday")]


def test_cascade_takes_scoped_corrections(spark):
    c = spark.createDataFrame([(1, "global"), (2, "meeting:m1")], "id int, scope string")
    assert rows(maintenance.delete_meeting({"corrections": c}, "m1")["corrections"]) == [(1, "global")]


def test_related_topics_equal_all_pairs(spark):
    from parley.functions import text as T

    labels = ["red rod", "red bolt", "blue bolt", "green gear", "rod", "ab", "the of"]
    t = spark.createDataFrame([(f"topic:{x}", x) for x in labels], "id string, label string")
    got = rows(graph.relate(t).select("a", "b"))
    every = t.alias("x").crossJoin(t.alias("y")).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), T.similarity(F.col("x.label"), F.col("y.label")).alias("s"), F.size(T.anchors(F.col("x.label"), F.col("y.label"))).alias("n"))
    assert got == rows(every.where("s >= 0.15 and s < 0.72 and n > 0").select("a", "b")) and got


FRAMES = [("m1", "t1", 1, 10.0, "we should move the launch to friday", True), ("m1", "y1", 0, 11.0, "we should move the launch to friday", True), ("m1", "y2", 0, 12.0, "I disagree with that entirely my friend", True), ("m1", "y3", 0, 60.0, "we should move the launch to friday", True), ("m1", "y4", 0, 11.5, "to friday", True)]
FRAME = "meeting_id string, utterance_id string, channel int, offset_s double, text string, final boolean"


def test_echo_batch(spark):
    assert rows(live.echoes(spark.createDataFrame(FRAMES, FRAME))) == [("m1", "y1")]


def test_trim_echo():
    assert live.trim_echo("so, we move the launch to Friday please", ["We move the launch to friday", "too short to cut"]) == "so, please"
    assert live.trim_echo("hello there", ["hello there"]) == "hello there"


def test_texts_do_not_travel_with_the_grams_of_a_meeting(spark):
    text = "red rod pricing was fine and red rod pricing is final"
    rows = [("m1", 3, 1.0, text), ("m1", None, 2.0, "x red rod pricing"), (None, 1, 3.0, "big deal size then big deal size"), ("m2", 1, 4.0, "a-b cde. a-b cde"), ("m2", 1, 4.0, "other words here")]
    found = entities.repeated_ngrams(spark.createDataFrame(rows, "meeting_id string, idx int, offset_s double, text string"))
    got = {(r["meeting_id"], r["key"]): (r["surface"], r["n"], r["quote"], r["first"]["idx"], r["first"]["at"]) for r in found.collect()}
    assert got["m1", "red rod pricing"] == ("red rod pricing", 3, "x red rod pricing", None, 4)
    assert got[None, "big deal"] == ("big deal", 2, "big deal size then big deal size", 1, 0)
    assert got["m2", "a b cde"] == ("a-b cde", 2, "a-b cde. a-b cde", 1, 0) and len(got) == 7
    # A sum over grams that keeps a text would send it once for each gram.
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()
