"""Transcripts on disk: parsing, source choice, dedup against a plain Python oracle, incremental equals full."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewell.functions.scalars import instant
from tidewell.operators import lines as L
from tidewell.operators import repair as R
from tidewell.operators import usage as U
from tidewell.functions.schemas import PRICING
from tidewell.plans.store import NotReadOnly, UsageStore, read_only
from tidewell.plans.tables import Busy, Lock, VersionedTables
from tidewell.sources import transcripts as T

PRICES = [("alpha", 1000000, 5000000, 1250000, 2000000, 100000), ("alpha-large", 3000000, 15000000, 3750000, 6000000, 300000)]


def line(uid, sid, mid, ts="2024-05-01T10:00:00.000Z", model="alpha-large-1", tokens=(1, 2, 3, 4), **more):
    usage = dict(zip(("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), tokens))
    return json.dumps({"type": "assistant", "uuid": uid, "sessionId": sid, "timestamp": ts, "cwd": "/w", "message": {"id": mid, "model": model, "usage": usage}} | more).encode()


def put(root, rel, lines, end=b"\n"):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(b"\n".join(lines) + end)


@pytest.fixture
def trees(tmp_path):
    rng = random.Random(7)
    archive, live = tmp_path / "archive", tmp_path / "live"
    for s in range(3):
        rows = [line(f"u{s}-{i}", f"s{s}", f"m{i // 2}", f"2024-05-{1 + i % 9:02}T1{i % 9}:00:00Z", tokens=[rng.randrange(50) for _ in range(4)]) for i in range(12)]
        put(archive, f"p/s{s}.jsonl", rows[:8])
        put(live, f"p/s{s}.jsonl", rows + [b'{"usage" torn', b'["usage"]', line("", f"s{s}", "m")])
    put(archive, "p/gone.jsonl", [line("g1", "gone", "m", "not a date")])
    put(live, "p/x.acompact.jsonl", [line("a1", "x", "m")])
    return archive, live


def oracle(archive, live):
    found = {}
    for root in (archive, live):
        for p in sorted(root.rglob("*.jsonl")):
            if "acompact" in str(p):
                continue
            for raw in p.read_bytes().split(b"\n"):
                try:
                    e = json.loads(raw)
                    u = e["message"]["usage"]
                except (ValueError, TypeError, KeyError):
                    continue
                if e.get("uuid"):
                    found[e["uuid"]] = (e["sessionId"], e["message"]["id"], sum(u.values()), e["timestamp"], e["uuid"])
    best = {}
    for sid, mid, total, ts, uid in found.values():
        kept = best.get((sid, mid))
        if kept is None or (-total, uid) < (-kept[0], kept[1]) and (total != kept[0] or ts >= kept[2]) or total == kept[0] and ts > kept[2]:
            best[sid, mid] = (total, uid, ts)
    return {k: v[0] for k, v in best.items()}


def test_build_sync_and_views(spark, tmp_path, trees):
    archive, live = trees
    store = UsageStore(spark, str(tmp_path / "store"), str(archive), str(live), PRICES)
    store.build()
    got = {(r.session_id, r.message_id): r.total_tokens for r in store.table("dedup").collect()}
    assert got == oracle(archive, live)
    assert store.sync() is None
    put(live, "p/s1.jsonl", (live / "p/s1.jsonl").read_bytes().split(b"\n")[:-1] + [line("new", "s1", "m0", tokens=(9, 900, 0, 0))], end=b"")
    assert store.sync()
    assert {(r.session_id, r.message_id): r.total_tokens for r in store.table("dedup").collect()} == oracle(archive, live)
    fresh = UsageStore(spark, str(tmp_path / "fresh"), str(archive), str(live), PRICES)
    fresh.build()
    for name in ("events", "dedup", "rollup"):
        a, b = store.table(name), fresh.table(name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert all(r.delta == 0 for r in U.reconcile(store.costed()).collect())
    before = store.stats().first().cost_usd
    store.set_pricing([(p, *[2 * x for x in rates]) for p, *rates in PRICES])
    assert store.stats().first().cost_usd == pytest.approx(2 * before, abs=2e-4)
    assert store.view("daily").where("date = ''").count() == 1
    assert store.sql("select count(*) as n from v_daily").first().n == store.view("daily").count()
    files = store.export(str(tmp_path / "csv"))
    assert len(files) == 13 and open(files[0]).readline().startswith("date,events,sessions")


@pytest.mark.parametrize("text", ["drop table x", "  insert into x values (1)", "with a as (select 1) insert into x select * from a"])
def test_only_queries(spark, text):
    with pytest.raises(NotReadOnly):
        read_only(spark, text)


def test_costs_and_prefixes(spark):
    rows = spark.createDataFrame([("ALPHA-LARGE-2", 1), ("alpha", 1), ("beta", 1)], "model string, input_tokens long")
    rows = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens", "ephemeral_5m_tokens", "ephemeral_1h_tokens")])
    from tidewell.functions.schemas import PRICING

    got = {r.model: r.c12 for r in U.costed(rows, spark.createDataFrame(PRICES, PRICING)).collect()}
    assert got == {"ALPHA-LARGE-2": 3000000, "alpha": 1000000, "beta": 0}


def test_raw_lines_and_repair(spark, tmp_path):
    rows = [b'{"a": 1}', b'{"a": 1}', b"", b'{"b": 2', b'{"c": [1, ]}', b"\x07\x00", b"broken \xff", b'{"d": 4}\r', b'{"b": 2}']
    put(tmp_path, "p/f.jsonl", rows)
    lines = T.raw_lines(spark, str(tmp_path))
    assert [bytes(r.raw) for r in lines.orderBy("line_no").collect()] == rows
    out = R.clean(lines).orderBy("line_no").collect()
    assert [r.fate for r in out] == ["valid", "duplicate", "blank", "repaired", "repaired", "control", "unparseable", "valid", "duplicate"]
    stay = [bytes(r.raw) for r in R.kept(R.clean(lines)).orderBy("line_no").collect()]
    assert stay == [rows[0], b'{"b": 2}', b'{"c": [1]}', rows[6], rows[7]]
    assert R.removed(R.clean(lines)).count() == 6


def test_empty_blocks_and_links(spark):
    msg = lambda uid, up, *blocks: json.dumps({"uuid": uid, "parentUuid": up, "message": {"content": list(blocks)}})
    gone, text = {"type": "thinking", "thinking": " \n"}, {"type": "text", "text": "hi"}
    rows = [msg("a", None, text), msg("b", "a", gone), msg("c", "b", gone), msg("d", "c", text, gone), msg("e", "c", text), "not json"]
    df = spark.createDataFrame([("f", i, r.encode()) for i, r in enumerate(rows)], "rel string, line_no long, raw binary")
    out = R.drop_empty_blocks(df).orderBy("line_no").collect()
    assert [r.action for r in out] == ["kept", "dropped", "dropped", "edited", "relinked", "kept"]
    assert json.loads(bytes(out[3].raw))["parentUuid"] == "a" == json.loads(bytes(out[4].raw))["parentUuid"]


def test_relink_cycle_and_deep_chain(spark):
    deep = [("f", f"r{i}", f"r{i - 1}" if i else "root") for i in range(300)] + [("g", "x", "y"), ("g", "y", "x")]
    lines = spark.createDataFrame([("f", "leaf", "r299"), ("g", "leaf", "x"), ("f", "other", "root")], "rel string, uuid string, parent string")
    got = {(r.rel, r.uuid): r.parent for r in L.relink(lines, spark.createDataFrame(deep, "rel string, uuid string, parent string")).collect()}
    assert got == {("f", "leaf"): "root", ("g", "leaf"): "x", ("f", "other"): "root"}


def test_prompts_and_removal_log(spark, tmp_path):
    user = lambda content, **more: json.dumps({"type": "user", "timestamp": "2024-05-01T10:00:00Z", "message": {"content": content}} | more).encode()
    rows = [user("first one"), user("hi"), user([{"type": "tool_result"}, {"text": "no"}]), user([{"text": "two"}, {"text": "parts"}], cwd="/w"), user("meta", isMeta=True), b"torn", b"[1]", user("after the end")]
    put(tmp_path, "proj/s1.jsonl", rows)
    got = T.prompt_rows(T.raw_lines(spark, str(tmp_path)), 5).orderBy("line_no").collect()
    assert [(r.session, r.display, r.project) for r in got] == [("s1", "first one", "proj"), ("s1", "two parts", "/w")]
    u = "0123abcd-0123-0123-0123-0123456789ab"
    log = spark.createDataFrame([(json.dumps({"source_file": "p/s.jsonl", "content": json.dumps({"uuid": "k1"})}),), (f'torn {{"uuid": "{u}"',)], "value string")
    assert {(r.kind, r.value) for r in T.removal_keys(log).collect() if r.kind != "record"} == {("uuid", "u:k1"), ("unreadable", "u:" + u)}


@pytest.mark.parametrize("text,epoch", [("2024-05-01T10:00:00Z", 1714557600), ("20240501T100000Z", 1714557600), ("2024-05-01T12:00:00+02:00", 1714557600), ("soon", None), ("", None)])
def test_times(spark, text, epoch):
    assert spark.range(1).select(instant(F.lit(T.iso_text(text)))["ts_epoch"].alias("t")).first().t == epoch


def test_times_as_python_reads_them(spark):
    texts = ["2024-02-29 23:59", "2024-02-30T00:00:00Z", "2024-05-01T10:00:00.123456789-05:30", "2024-05-01T10:00:00,5+0000", "1969-12-31T23:59:59.5Z", "2024-W18-3", "2024-05-01", "2024-05-01T10", "2024-05-01T10:00:61Z", "2024-05-01T24:00:00Z", "0001-01-01T00:00:00Z", "2024-05-01T10:00:00+02:00:30", "2024-13-01T10:00:00Z", "x2024-05-01T10:00:00Z", 5, True, None, [1]]
    rows = spark.createDataFrame([(i, T.iso_text(t)) for i, t in enumerate(texts)], "i int, t string").select("i", *[c.alias(n) for n, c in instant(F.col("t")).items()]).orderBy("i").collect()
    for text, r in zip(texts, rows, strict=True):
        shown = text if isinstance(text, str) else "" if not text else str(text)
        try:
            t = datetime.fromisoformat(shown)
            t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
            want = (t.isoformat(), int(t.timestamp()), f"{t:%Y-%m-%d}".rjust(10, "0"), f"{t:%Y-%m}".rjust(7, "0"), t.hour)
        except ValueError:
            want = (shown, None, "", "", None)
        assert tuple(r[1:]) == want, text


def test_streams_equal_batch(spark, tmp_path):
    from tidewell.streaming import usage as S

    rows = spark.range(200).select(F.concat(F.lit("u"), (F.col("id") % 60).cast("string")).alias("uuid"), F.col("id").alias("line_no"), (F.col("id") * 7 % 31).alias("total_tokens"))
    for i in range(4):
        rows.where(F.col("id") % 4 == i if "id" in rows.columns else F.col("line_no") % 4 == i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    S.upsert(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    merged = S.Merged(spark, str(tmp_path / "out"), "uuid")
    assert merged.rows().count() == 60
    before = merged.version()
    merged.merge(rows.limit(1), merged.state()["batch"], S.latest)  # a batch that runs again
    assert merged.version() == before


def test_sync_writes_touched_buckets_alone(spark, tmp_path):
    live = tmp_path / "live/p"
    live.mkdir(parents=True)
    for k in range(12):
        (live / f"s{k}.jsonl").write_bytes(line(f"u{k}", f"s{k}", "m") + b"\n")
    store = UsageStore(spark, str(tmp_path / "store"), str(tmp_path / "none"), str(tmp_path / "live"), PRICES)
    (tmp_path / "none").mkdir()
    store.build()
    before = store.state()["tables"]
    with open(live / "s3.jsonl", "ab") as f:
        f.write(line("u99", "s3", "m2") + b"\n")
    assert store.sync() and store.sync() is None
    after = store.state()["tables"]
    for name in ("events", "dedup", "rollup"):
        changed = {b for b in {*before[name]["parts"], *after[name]["parts"]} if before[name]["parts"].get(b) != after[name]["parts"].get(b)}
        assert changed == {str(spark.range(1).select(F.pmod(F.xxhash64(F.lit("s3")), F.lit(64)).alias("b")).first().b)}
    assert store.table("events").count() == 13 and before["pricing"] == after["pricing"]


def test_lock_of_another_writer(spark, tmp_path):
    """A lock that was taken over is neither removed by its earlier owner nor written past."""
    tables = VersionedTables(spark, str(tmp_path / "t"))
    with Lock(tables.files) as tables.lock:
        with pytest.raises(Busy):
            Lock(tables.files).__enter__()
        tables.files.write(".writer", "another")
        with pytest.raises(Busy):
            tables.commit({"x": spark.range(3)})
    assert (tmp_path / "t/.writer").read_text() == "another" and tables.version() is None


def test_costs_beyond_a_long(spark):
    rows = spark.range(30).select(F.lit("alpha").alias("model"), F.lit(9_000_000_000_000_000_000).alias("c12"))
    assert rows.groupBy("model").agg(U.measure("cost_usd")).first().cost_usd == 270_000_000.0


def test_price_lists(spark):
    """A list that becomes an expression and one that is joined give the same costs."""
    from itertools import product

    events = spark.createDataFrame([(m, *t) for m, t in product(["ALPHA-large-2", "alpha", "al", "", "p17-x", None], [(1, 2, 3, 4, 5, 6)])], "model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, ephemeral_5m_tokens long, ephemeral_1h_tokens long")
    more = [(f"p{k}", k, 2 * k, 3 * k, 4 * k, 5 * k) for k in range(U.FEW_PRICES)]
    few, many = (U.costed(events, spark.createDataFrame(p, PRICING)) for p in (PRICES + more[:20], PRICES + more))
    assert {(r.model, r.c12) for r in few.collect()} == {(r.model, r.c12) for r in many.collect()} and len({r.c12 for r in few.collect()}) == 4
