"""Archive, repair sweep and prompt history over files."""

import json
import os
import time

from pyspark.sql import functions as F

from tidewell.operators import lines as L
from tidewell.plans.archive import Archive, History, Repairs
from tidewell.sources import transcripts as T


def put(root, rel, rows, end=b"\n"):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(b"\n".join(rows) + end)


def row(uid, text="hello there", kind="user", **more):
    return json.dumps({"type": kind, "uuid": uid, "message": {"content": text}} | more).encode()


def test_archive_never_loses_a_line(spark, tmp_path):
    live, a = tmp_path / "live", Archive(spark, str(tmp_path / "a"), str(tmp_path / "live"))
    one, two, odd = row("u1"), row("u2"), b"\xff not json\r"
    put(live, "p/s.jsonl", [one, two, odd])
    put(live, "p/t.jsonl", [one, b"half"], end=b"")
    assert a.sync() == "ok" and a.sync() == "skipped"
    assert [bytes(r.raw) for r in a.lines().where("rel = 'p/s.jsonl'").orderBy("line_no").collect()] == [one, two, odd]
    assert a.lines().where("rel = 'p/t.jsonl'").count() == 1
    put(live, "p/s.jsonl", [row("u1", "changed"), odd[:-1], row("u3")])
    (live / "p/t.jsonl").unlink()
    assert a.sync() == "ok"
    assert [r.key[:4] for r in a.lines().where("rel = 'p/s.jsonl'").orderBy("line_no").collect()] == ["u:u1", "u:u2", "r:FF", "u:u3"]
    assert [(r.key, r["class"]) for r in a.verify().collect()] == [("u:u2", "unexplained")]
    log = spark.createDataFrame([(json.dumps({"source_file": "p/s.jsonl", "content": two.decode()}),)], "value string")
    assert [r["class"] for r in a.verify(T.removal_keys(log)).collect()] == ["excused"]
    assert [(r.rel, r.status) for r in a.restore().collect()] == [("p/t.jsonl", "restored")]
    assert a.restore(merge_live=True).where("status = 'merged'").count() == 4
    assert a.status().first().files == 2 and {r.session for r in a.sessions().collect()} == {"s", "t"}
    assert len(a.versions()) == 2


def test_sweep(spark, tmp_path):
    gone = {"type": "thinking", "thinking": ""}
    rows = [row("a", [{"type": "text", "text": "x"}]), row("b", [gone], parentUuid="a"), row("c", [gone, {"type": "text", "text": "y"}], parentUuid="b"), b"", row("a", [{"type": "text", "text": "x"}]), b'{"uuid": "d"']
    put(tmp_path / "live", "p/s.jsonl", rows)
    put(tmp_path / "live", "p/busy.jsonl", rows)
    r = Repairs(spark, str(tmp_path / "r"), str(tmp_path / "live"))
    assert r.due(now=__import__("time").time()).count() == 0  # written to just now
    stats = r.sweep(running=["busy"], force=True).collect()
    assert len(stats) == 1 and (stats[0].valid, stats[0].repaired, stats[0].blank, stats[0].duplicates, stats[0].blocks_removed, stats[0].lines_removed) == (3, 1, 1, 1, 1, 1)
    left = [json.loads(bytes(x.raw)) for x in r.table("lines").orderBy("line_no").collect()]
    assert [x["uuid"] for x in left] == ["a", "c", "d"] and left[1]["parentUuid"] == "a"
    assert r.log().count() == 4
    assert r.due(now=0, running=["busy"], force=True).count() == 0  # clean since


def test_history(spark, tmp_path):
    put(tmp_path / "live", "proj/s.jsonl", [row("a", "find the needle", timestamp="2024-05-01T10:00:00Z"), row("b", "more hay", timestamp="2024-05-02T10:00:00Z")])
    h = History(spark, str(tmp_path / "h"))
    assert h.merge(str(tmp_path / "live"), 5) == "ok" and h.merge(str(tmp_path / "live"), 5) == "noop"
    got = h.find("NEEDLE").first()
    assert (got.session, got.project, got.first, got.last, got.n_matches) == ("s", "proj", "2024-05-01 10:00", "2024-05-02 10:00", 1)
    assert h.merge(str(tmp_path / "live"), int(time.time() * 1000), throttle_seconds=300) == "throttled"
    (tmp_path / "h/.writer").touch()
    assert h.merge(str(tmp_path / "live"), 5) == "busy"
    os.utime(tmp_path / "h/.writer", (1, 1))  # left behind long ago
    assert h.merge(str(tmp_path / "live"), 5) == "noop"
    assert h.find("needle", since="2024-05-03").count() == 0 and h.find("", project="PRO").count() == 1


def test_listing(spark, tmp_path):
    for rel in ("p/s.jsonl", "p/s/subagents/agent-1.jsonl", "p/s/subagents/workflows/w/agent-2.jsonl", "p/other.jsonl", "p/x.acompact.jsonl", "p/note.txt"):
        put(tmp_path, rel, [b"{}"])
    names = lambda **k: {r.rel for r in T.listing(spark, str(tmp_path), **k).collect()}
    assert names(prefix="p/s") == {"p/s.jsonl", "p/s/subagents/agent-1.jsonl", "p/s/subagents/workflows/w/agent-2.jsonl"}
    assert names(top_only=True) == {"p/s.jsonl", "p/other.jsonl"} and len(names(skip=None)) == 5
    assert T.listing(spark, str(tmp_path)).where(F.col("size") != 3).count() == 0


def test_ledger_and_resume(spark):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), ("s", "b", 2)], "session string, uuid string, tokens long")
    assert [r.uuid for r in L.append_ledger(rows.where("uuid = 'a'"), rows).collect()] == ["b"]
    ends = spark.createDataFrame([("Resume", None), ("", "resume"), ("exit", "resume"), (None, None)], "reason string, end_reason string")
    assert [r.reason for r in L.cleanable(ends).collect()] == ["exit", None]
