"""Imports of bundles: replacement, skipped versions, and broken files that leave their meetings alone."""

import json

from parley.sources.bundle_store import BundleStore


def bundle(id_, title="T", lines=2, **more):
    meeting = {"id": id_, "title": title, "mode": "standup", "started_at": 5, "duration_s": 1.0}
    return {"version": 1, "meeting": meeting, "utterances": [{"idx": i, "speaker": None, "speaker_role": "agent", "text": f"{title} {i}", "offset_s": 1.0 * i, "duration_s": 1.0} for i in range(lines)], "claims": [{"kind": "risk", "body": "{}", "gate": "passed"}], **more}


def put(folder, **files):
    folder.mkdir()
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(folder)


def state(store):
    return sorted((m["id"], m["title"], store.utterances().where(f"meeting_id = '{m['id']}'").count(), store.claims().where(f"meeting_id = '{m['id']}'").count()) for m in store.meetings().collect())


def test_only_good_files_replace_their_meetings(spark, tmp_path):
    store = BundleStore(spark, str(tmp_path / "store"))
    store.import_files(put(tmp_path / "one", a=bundle("a"), b=bundle("b"), c=bundle("c"), d=bundle("d"), e=bundle("e")))
    assert state(store) == [(x, "T", 2, 1) for x in "abcde"]
    double = bundle("c", "new")
    double["utterances"][1]["idx"] = 0
    report = store.import_files(put(
        tmp_path / "two", a=bundle("a", "new", 3), b=json.dumps(bundle("b", "new"))[:50], c=double, d={**bundle("d", "new"), "version": 2}, e=bundle("e", "new", 0, claims=[]), f=bundle("f", "new"), f2=bundle("f", "newer"),
        g={**bundle("g"), "claims": [{"kind": "risk", "body": None, "gate": "passed"}]}, h={"version": 1}, i={**bundle("i"), "utterances": None}, j="[1, 2]"))
    got = {r["file"].rsplit("/", 1)[1][:-5]: r["status"] for r in report.collect()}
    assert got == {"a": "imported", "b": "failed", "c": "failed", "d": "skipped", "e": "imported", "f": "replaced", "f2": "imported", "g": "failed", "h": "skipped", "i": "failed", "j": got["j"]} and got["j"] in ("failed", "skipped")
    assert state(store) == [("a", "new", 3, 1), ("b", "T", 2, 1), ("c", "T", 2, 1), ("d", "T", 2, 1), ("e", "new", 0, 0), ("f", "newer", 2, 1)]
