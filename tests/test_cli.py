"""Commands over real files: archive, restore, repair, history file, search, prices; bytes that were appended."""

import json
import os

from pyspark.sql import functions as F

from tidewell import cli
from tidewell.plans.archive import Archive, History, Repairs
from tidewell.sources import bytes as B
from tidewell.sources import transcripts as T

from .test_archive import put, row
from .test_store import line

OLD = 1_600_000_000


def aged(root):
    for d, _, names in os.walk(root):
        for n in names:
            os.utime(f"{d}/{n}", (OLD, OLD))


def run(capsys, *args):
    code = cli.main([str(x) for x in args])
    return code, capsys.readouterr().out.splitlines()


def test_appended_bytes(spark, tmp_path):
    root = str(tmp_path)
    put(tmp_path, "p/a.jsonl", [b"one", b"two"])
    put(tmp_path, "p/b.jsonl", [b"x" * 9000, b"half"], end=b"")
    put(tmp_path, "p/c.jsonl", [])
    state = spark.createDataFrame([], B.STATE)

    def step():
        nonlocal state
        lines, state = B.appended(T.listing(spark, root), state)
        return sorted((r.rel, r.start, bytes(r.raw)[:4], r.ended, r.anew) for r in lines.collect())

    assert step() == [("p/a.jsonl", 0, b"one", True, False), ("p/a.jsonl", 4, b"two", True, False), ("p/b.jsonl", 0, b"xxxx", True, False), ("p/b.jsonl", 9001, b"half", False, False), ("p/c.jsonl", 0, b"", True, False)]
    with open(tmp_path / "p/b.jsonl", "ab") as f:
        f.write(b" is whole\nnew\n")
    put(tmp_path, "p/a.jsonl", [b"ONE", b"two", b"three"])  # grew, but not by appending
    assert step() == [("p/a.jsonl", 0, b"ONE", True, True), ("p/a.jsonl", 4, b"two", True, True), ("p/a.jsonl", 8, b"thre", True, True), ("p/b.jsonl", 9001, b"half", True, False), ("p/b.jsonl", 9015, b"new", True, False)]
    put(tmp_path, "p/b.jsonl", [b"short"])
    assert step() == [("p/b.jsonl", 0, b"shor", True, True)]


def test_restore_files(spark, tmp_path):
    live, a = tmp_path / "live", Archive(spark, str(tmp_path / "a"), str(tmp_path / "live"))
    for s in ("gone", "cut", "same", "running", "half"):
        put(live, f"p/{s}.jsonl", [row(f"{s}1"), row(f"{s}2")])
    assert a.sync() == "ok"
    (live / "p/gone.jsonl").unlink()
    put(live, "p/cut.jsonl", [row("cut2"), row("cut3")])
    put(live, "p/running.jsonl", [row("running2")])
    put(live, "p/half.jsonl", [row("half2"), b"{"], end=b"")
    aged(live)
    got = {r.rel: r.status for r in a.restore_files(merge_live=True, running=["running"]).collect()}
    assert got == {"p/gone.jsonl": "restored", "p/cut.jsonl": "merged", "p/same.jsonl": "untouched", "p/running.jsonl": "skipped", "p/half.jsonl": "skipped"}
    assert (live / "p/gone.jsonl").read_bytes() == row("gone1") + b"\n" + row("gone2") + b"\n"
    assert (live / "p/cut.jsonl").read_bytes().split(b"\n") == [row("cut1"), row("cut2"), row("cut3"), b""]
    assert (live / "p/half.jsonl").read_bytes().endswith(b"{") and len(list((live / "p").glob("cut.jsonl.*.bak"))) == 1


def test_repairs_are_written_back(spark, tmp_path):
    live = tmp_path / "live"
    gone = {"type": "thinking", "thinking": " "}
    bad = [row("a"), b"", b'{"uuid": "x"', row("b", [gone], parentUuid="a"), row("c", parentUuid="b"), b"half"]
    put(live, "p/s.jsonl", bad, end=b"")
    put(live, "p/touched.jsonl", bad)
    put(live, "p/fine.jsonl", [row("z")])
    aged(live)
    r = Repairs(spark, str(tmp_path / "r"), str(live))
    r.sweep()
    totals = r.totals().first()
    assert (totals.files, totals.changed, totals.blank, totals.repaired, totals.lines_removed) == (3, 2, 2, 2, 2)
    put(live, "p/touched.jsonl", [row("other")])
    got = {x.rel: x.status for x in r.apply().collect()}
    assert got == {"p/s.jsonl": "written", "p/touched.jsonl": "changed"}
    out = (live / "p/s.jsonl").read_bytes().split(b"\n")
    assert [json.loads(x).get("uuid") for x in out[:3]] == ["a", "x", "c"] and json.loads(out[2])["parentUuid"] == "a" and out[3:] == [b"half"]
    assert (live / "p/touched.jsonl").read_bytes() == row("other") + b"\n"


def test_history_file(spark, tmp_path):
    live, path = tmp_path / "live", tmp_path / "history.jsonl"
    put(live, "proj/s.jsonl", [row("a", "find the needle", timestamp="2024-05-01T10:00:00Z"), row("b", "more hay", timestamp="2024-05-02T10:00:00Z")])
    path.write_text(json.dumps({"display": "more hay", "timestamp": 1714644000000, "project": "w", "sessionId": "s"}) + "\n")
    h = History(spark, str(tmp_path / "h"))
    assert h.merge_file(str(live), str(path), 5) == "ok" and h.merge_file(str(live), str(path), 5) == "noop"
    assert [json.loads(x)["display"] for x in path.read_text().splitlines()] == ["more hay", "find the needle"]
    with open(path, "a") as f:
        f.write('{"half')
    assert h.merge_file(str(live), str(path), 5) == "deferred"
    path.write_text("another\n")
    assert h.merge_file(str(live), str(path), 5) == "refused"
    assert h.merge_file(str(live), str(tmp_path / "live"), 5) == "error"


def test_commands(spark, tmp_path, capsys):
    store, held, live = tmp_path / "store", tmp_path / "held", tmp_path / "live"
    put(live, "p/s.jsonl", [line("u1", "s", "m1"), line("u2", "s", "m2", model="odd"), row("q", "find the needle", timestamp="2024-05-01T10:00:00Z", sessionId="s")])
    put(held, "p/old.jsonl", [line("u9", "old", "m")])
    (tmp_path / "prices.csv").write_text("pattern,in,out,5m,1h,read\nalpha,1000000,5000000,1250000,2000000,100000\n")
    do = lambda *a: run(capsys, store, held, live, *a)
    assert do("build", "--prices", tmp_path / "prices.csv")[0] == 0
    code, out = do("stats")
    shown = {x[:24].strip(): x[25:] for x in out}
    assert code == 0 and shown["events"] == "3" and shown["raw events"] == "3" and shown["total tokens"] == "30" and shown["cache read share"] == "40.0%" and len(shown) >= 14
    assert do("sync")[1] == ["nothing changed"] and do("pricing")[1][1].startswith("alpha\t1000000")
    assert do("sql", "SELECT count(*) AS n FROM v_events_dedup")[1] == ["n", "3"] and do("sql", "DROP TABLE x")[0] == 1
    assert do("sql", "SELECT sum(events) AS n FROM v_hourly")[1] == ["n", "3"]
    assert do("models")[1][0].startswith("model\tevents") and do("session", "p/s")[1] == ["nothing changed"] and do("nothing")[0] == 2
    assert do("archive")[1] == ["ok"] and do("archive")[1] == ["skipped"] and do("status")[1][1].split("\t")[:2] == ["1", "3"]
    (live / "p/s.jsonl").unlink()
    assert do("restore")[1] == ["rel\tstatus", "p/s.jsonl\trestored"]
    assert do("verify")[0] == 0 and do("find", "NEEDLE", "--resumable")[1][1].split("\t")[0] == "s" and do("find", "nope", "--all")[1][1:] == []
    assert do("detect", "s")[1][1].startswith("s\tRESUME") and do("detect", "t")[1][1].startswith("t\tNEW")
    assert do("register", tmp_path / "hist.jsonl")[1] == ["ok"] and do("merge", tmp_path / "hist.jsonl")[1] == ["noop"] and len(do("scan")[1]) == 2
    assert do("repair", "--dry-run", "--force")[1][1].startswith("p/s.jsonl") and do("repair", "--force")[0] == 0
