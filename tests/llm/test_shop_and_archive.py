"""Repair of conversations, archives of pages and heavy hitters against brute force, on small tables with nulls, ties and clashes."""

import hashlib
import heapq
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import conversation_repair as R
from sparkgauge.llm import heavy_hitters as H
from sparkgauge.llm import warc as A
from sparkgauge.llm.registry import ORACLES

STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def dijkstra(kinds):
    """(cost, audit) of the cheapest repair: every state of every turn, the cheapest first, then the least audit."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(kinds) and last in ("", "a"):
            return cost, audit
        fits = [r for r in STATES[last] if r != "s"]
        heap_more = [(2, "I", at, r) for r in fits]
        if at < len(kinds):
            letter, short = kinds[at].lower(), int(kinds[at].isupper())
            heap_more.append((3, "D", at + 1, last))
            if letter != "x":
                heap_more += [(short, "K", at + 1, letter)] * (letter in STATES[last]) + [(2 + short, "R", at + 1, r) for r in fits]
        for more, edit, to, role in heap_more:
            heapq.heappush(heap, (cost + more, audit + edit, to, role))


def test_cheapest_repair_is_the_least_of_all():
    rng = random.Random(3)
    short = ["".join(k) for n in range(4) for k in itertools.product(R.KINDS, repeat=n)]
    for kinds in short + ["".join(rng.choices(R.KINDS, k=rng.randint(4, 60))) for _ in range(500)]:
        cost, audit, turns = R.cheapest_repair(kinds)
        assert (cost, audit) == dijkstra(kinds), kinds
        roles = "".join((role or kinds[at].lower())[0] for at, role in turns)
        assert roles.removeprefix("s").replace("ua", "") == "" and (roles != "s")
        kept = [at for at, _ in turns if at >= 0]
        assert kept == sorted(set(kept)) and len(turns) == len(audit) - audit.count("D")
    assert R.cheapest_repair("u" * 20_000)[0] == 20_000 and len(R._STEPS) < 1000


@pytest.fixture(scope="module")
def chats(spark):
    rng, rows = random.Random(4), []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Good.", "good", "no end ", " \n", "", None, "é? ", "Good.", "x!\x0b"])))
    rows += [(None, None, "user", "a."), (None, 3, "assistant", "b."), (70, None, "user", "a."), (70, None, "user", "a."), (71, 5, "user", "z." * 5000)] + [(72, 1, "user", "t."), (72, 1, "assistant", "t.")]
    rows += [(73, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"conv": F.lit(1), "there": F.lit("x"), "again": F.lit(2), "turns": F.lit(3)}).repartition(5).persist(), rows


def plainly_repaired(rows):
    """conv -> what repair_conversations() says."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        seen, kinds, faults = set(), "", Counter()
        for _, _, role, text in turns:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            letter = role[:1] if role[:1] in tuple("sua") else "o"
            kinds += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        numbers = [n for there, n, _, _ in turns if there]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = dijkstra(kinds)
        at, last, repaired = 0, "", []
        for edit in audit:
            if edit in "IR":
                last = "a" if last == "u" else "u"
                repaired.append(({"u": "user", "a": "assistant"}[last], "" if edit == "I" else turns[at][3]))
            elif edit == "K":
                repaired.append(turns[at][2:])
                last = turns[at][2][0]
            at += edit != "I"
        out[conv] = (len(turns), gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, repaired)
    return out


def test_conversations_are_repaired(chats):
    df, rows = chats
    found = R.repair_conversations(df).collect()
    told = {r["conv"]: (*(r[c] for c in ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), [tuple(t) for t in r["repaired"]]) for r in found}
    assert told == plainly_repaired(rows) and len(found) == len(told)
    assert R.repair_conversations(df.filter("false")).count() == 0
    none = R.repair_conversations(df.filter("conv_id = 71"), present=F.lit(False)).first()
    assert (none["n_turns"], none["gaps"], none["cost"], none["audit"], none["repaired"]) == (0, 0, 0, "", [])


def test_op11_is_like_its_sql(spark, chats, tmp_path):
    import duckdb

    df, rows = chats
    df.select("conv_id", "turn", "role", "text").filter("role is null or role <> ''").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = R.op11_conversation_repair(spark, str(tmp_path))
    columns = found.columns
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op11_conversation_repair']})").fetchall()))


def test_damage(spark, chats):
    df, rows = chats
    damaged = R.damaged(df).collect()
    wanted = Counter()
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        harm = zlib.crc32(":".join(shown).encode()) % 20
        role, text = [" " if x is None else x for x in (role, text)]
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        wanted[conv, turn, "user" if harm == 4 else role, text, harm != 0] += 2 if harm == 3 else 1
    assert Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["there"]) for r in damaged) == wanted


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    long = ["<p>" + "".join(rng.choices("ab\r\n é", k=rng.randint(95, 400))) + "\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n" for _ in range(30)]
    rows = [(i, f"http://{rng.choice(['a', 'www.b', 'c.d'])}.example.com:80/{rng.randint(0, 5)}#x", rng.choice(long)) for i in range(150)]
    rows += [(i, "http://hot.example.com/", long[0]) for i in range(150, 400)] + [(i, "http://hot.example.com/", "small") for i in range(400, 420)]
    rows += [(500, None, None), (501, "no scheme\r\nWARC-Type: revisit", ""), (None, "http://n/", long[1]), (None, "http://n/", "y" * 100), (None, "http://n/", "y" * 100), (502, "http://z/", "z" * 99), (503, "http://z/", "z" * 99)]
    rows += [(504, "http://w/", "w" * 100), (504, "http://w/", "w" * 100), (505, "http://l/", "long " * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({"id": F.lit(1), "file": F.lit("x"), "payload": F.lit(2), "value": F.lit("v")}).repartition(7).persist(), rows


def test_archives_hold_every_page(spark, pages, tmp_path):
    df, rows = pages
    folder = f"file://{tmp_path}/archives"
    boundary = A.write_warc(df, folder, time=F.lit("2024-02-03 04:05:06").cast("timestamp_ntz"), records=40)
    found = A.read_warc(spark, folder, boundary).persist()
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, (True, 0)), (i is None, i or 0))
    told = defaultdict(list)
    for r in found.collect():
        told[None if r["id"] is None else int(r["id"]), r["payload_digest"]].append(r)
    wanted = Counter((i, hashlib.sha256((html or "").encode()).hexdigest()) for i, _, html in rows)
    assert {k: len(v) for k, v in told.items()} == wanted
    for i, url, html in rows:
        payload = (html or "").encode()
        records = told[i, hashlib.sha256(payload).hexdigest()]
        assert all(r["payload_bytes"] == len(payload) and r["timestamp"] == "20240203040506" for r in records)
        assert any(r["url"] == (url or "").replace("\r", "%0D").replace("\n", "%0A") for r in records)
        responses = [r for r in records if r["record_type"] == "response"]
        assert all(r["payload"] == (html or "") and r["refers_to"] is None for r in responses)
        if html not in first:
            assert len(responses) == len(records)
        else:
            assert len(responses) == (first[html] == (i is None, i or 0))
            assert {r["refers_to"] for r in records if r not in responses} <= {None if first[html][0] else str(first[html][1])}
    index = [r.asDict() for r in A.capture_index(found, run=50, block=8, stride=4, size=60).collect()]
    ordered = sorted(index, key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["timestamp"], r["record_id"]) for r in ordered]
    assert len(keys) == len(rows) == len(set(keys)) and keys == sorted(keys) and len({r["range"] for r in index}) > 4
    assert {k for k, _, _ in keys} >= {"", "com,example,hot)/", "no scheme%0d%0awarc-type): revisit"}
    assert A.capture_index(found.filter("false")).count() == 0
    assert A.archive(df.filter("false")).count() == 0
    with pytest.raises(Exception, match="damaged record"):
        part = next(p for p in (tmp_path / "archives").glob("*.gz"))
        import gzip

        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "a.txt").write_bytes(gzip.open(part).read()[:-30])
        A.read_warc(spark, f"file://{tmp_path}/bad", boundary).collect()


def test_loser_tree():
    rng = random.Random(7)
    for k in (0, 1, 2, 3, 5, 8, 33):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        got = [(runs[run][place], run, place) for run, place in A.LoserTree(runs)]
        assert got == sorted((key, run, place) for run, keys in enumerate(runs) for place, key in enumerate(keys))


def test_heavy_hitters(spark):
    rng, rows = random.Random(8), []
    for group in range(5):
        for _ in range((4000, 700, 60, 30, 1)[group]):
            rows.append((group, "g", rng.choice(["hot", "warm", f"k{int(rng.paretovariate(0.6)) % 5000}"]) if group else f"k{rng.randint(0, 900)}", rng.choice([0, 1, 1, 2, 7, 300]) if group == 1 else 1))
    rows += [(0, "g", "third", 1)] * 2000 + [(None, "g", "a", 1), (1, None, "a", 1), (1, "g", None, 1), (1, "g", "a", None), (1, "g", "a", -5), (9, "g", "zero", 0), (8, "h", "x", 1), (8, "h", "", 1)]
    df = spark.createDataFrame(rows, "a int, b string, item string, w int").withColumns({"low": F.lit(1), "total": F.lit("x"), "bit": F.lit(2), "n": F.lit(3)})
    whole = [r for r in rows if None not in r and r[3] >= 0]
    total, n, weight = Counter(), Counter(), Counter()
    for a, b, item, w in whole:
        total[a, b] += w
        n[a, b] += 1
        weight[a, b, item] += w
    wanted = {(a, b, item): (n[a, b], total[a, b], w) for (a, b, item), w in weight.items() if 50 * w > total[a, b]}
    for chunk, most in ((250_000, 1_000_000), (50, 10_000), (50, 120)):
        found = H.heavy_hitters(df.repartition(6), ["a", "b"], chunk=chunk, most=most, bits=15).collect()
        assert {(r["a"], r["b"], r["item"]): (r["n_entries"], r["total"], r["w"]) for r in found} == wanted and len(found) == len(wanted)
        for r in found:
            assert r["low"] <= r["w"] <= r["high"] and r["low"] <= r["estimate"] <= r["high"] and 100 * (r["high"] - r["low"]) <= r["total"]
    assert any(r["low"] < r["high"] for r in found)
    assert H.heavy_hitters(df.filter("false"), ["a", "b"]).count() == 0


def test_a_summary_is_bounded_however_many_keys_occur():
    import pyarrow as pa

    rng = random.Random(9)
    items = [f"k{rng.randint(0, 10**9)}" if rng.random() < 0.9 else "hot" for _ in range(60_000)]
    batches = [pa.record_batch([pa.array([1] * 500), pa.array(items[i : i + 500]), pa.array([1] * 500)], names=["g", "item", "w"]) for i in range(0, len(items), 500)]
    out = pa.Table.from_batches(list(H._summariser(["g"], "item", "w", 100, 500, 10**6)(iter(batches)))).to_pylist()
    group = next(r for r in out if r["item"] is None)
    entries = {r["item"]: r for r in out if r["item"] is not None}
    assert (group["total"], group["n"], group["epochs"]) == (60_000, 60_000, 600) and len(entries) < 1000
    for item, n in Counter(items).items():
        low = entries[item]["low"] if item in entries else 0
        high = low + group["epochs"] - (entries[item]["slack"] if item in entries else 0)
        assert low <= n <= high


def test_props():
    assert H.props_of('{"device": {"os": "ios"}, "tags": ["a", "a", null], "items": [{"sku": 5}, {"sku": "x"}, {}, 3]}') == ["os=ios", "tag=a", "tag=a", "sku=5", "sku=x"]
    for bad in ('{"tags": ["a"]} x', '{"tags": ["a"]', "", "null", "[1]", '{"tags": [NaN]}', '{"device": {"os": null}}', '{"device": 3, "tags": {}, "items": 1}', "[" * 100_000, json.dumps({"tags": []})):
        assert H.props_of(bad) == []
    assert H.props_of('{"tags": ["\\ud800", "' + "9" * 5000 + '"]}')[0] == "tag=?"
    assert H.props_of('{"items": [{"sku": ' + "9" * 5000 + "}]}") == ["sku=" + "9" * 5000]
