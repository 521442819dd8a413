"""Claims, coverage checks, the ledger: batches one after another, held against plain replays."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.plans import registry
from quillmesh.streaming import collaboration as co
from quillmesh.streaming.ledger import Ledger

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
at = lambda seconds: T0 + timedelta(seconds=seconds)


def batches(spark, tmp_path, schema, *parts):
    """A stream that takes each part as a batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:02}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")


REQUEST = "project string, ts timestamp, kind string, id string, agent string, path string, seconds double"


def test_claims_expire_are_released_and_leave_out_their_own(spark, tmp_path):
    first = [("p", at(0), "claim", "c1", "ann", "src/", 7200.0), ("p", at(1), "claim", "c2", "bob", "src/a.py", 10.0), ("q", at(1), "claim", "c3", "bob", "a.py", 50.0),
        ("p", at(2), "ask", "1", "cy", "src/x/y.py", None), ("p", at(2), "ask", "2", "ann", "src/x/y.py", None), ("p", at(5), "ask", "3", "ann", "src/a.py", None),
        ("p", at(11), "ask", "4", "ann", "src/a.py", None), ("p", at(3), "ask", "5", "cy", "src2/a.py", None), ("p", at(3), "ask", "6", "cy", "a.py", None)]
    second = [("p", at(100), "ask", "7", "cy", "src/z", None), ("p", at(200), "release", "c1", "eve", "src/", None), ("p", at(201), "ask", "8", "cy", "src/z", None),
        ("q", at(51), "ask", "9", "cy", "a.py", None), ("q", at(50.5), "ask", "10", "cy", "a.py", None), ("p", at(300), "claim", "c4", "ann", "src/", 100000.0)]
    third = [("p", at(90_000), "ask", "11", "cy", "src/z", None), ("p", at(100_301), "ask", "12", "cy", "src/z", None), ("p", at(200_000), "ask", "13", "cy", "src", None)]
    got = co.claimed(co.settled(co.answers(batches(spark, tmp_path, REQUEST, first, second, third)))).collect()
    assert {r.id for r in got if r.claimed} == {"1", "3", "7", "10", "11"} and len(got) == 13
    assert spark.conf.get(co.PROVIDER).endswith("HDFSBackedStateStoreProvider")


def replay(rows):
    """Checks on a grid of five minutes from the first row, straight from their description."""
    out = []
    for project in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == project), key=lambda r: (r[1], r[3], r[2]))
        status, fired, seen, skips, hold = {}, None, None, 0, 0
        t, end, i = mine[0][1] + 300, max(r[1] for r in rows) - 3600, 0
        last = mine[-1][1]
        while t <= max(end, last):
            while i < len(mine) and mine[i][1] <= t:
                _, _, kind, path = mine[i]
                status[path] = "traced" if kind == "traced" else "untraced" if status.get(path) in (None, "untraced") else "stale"
                i += 1
            # a row of the very second of a check comes first
            untraced, stale = frozenset(p for p, s in status.items() if s == "untraced"), sum(s == "stale" for s in status.values())
            if (untraced or stale) and (fired is None or t - fired >= 1800) and t >= hold:
                if not stale and seen == untraced:
                    skips += 1
                    hold = t + min(1800 * 2**skips, 6 * 3600)
                    out.append((project, t, "wait", len(untraced), stale, skips))
                else:
                    fired, seen, skips = t, None if stale else untraced, 0
                    out.append((project, t, "rebuild", len(untraced), stale, 0))
            t += 300
        # what lies behind the last row of the project and the watermark stays open
        out = [x for x in out if x[0] != project or x[1] < max(last, end)]
    return sorted(out)


FILE = "project string, ts timestamp, kind string, path string"


def test_coverage_checks_fire_rest_and_back_off(spark, tmp_path):
    parts = [[("p", 0, "seen", "a"), ("p", 10, "seen", "b"), ("p", 1000, "traced", "a"), ("q", 5, "seen", "x"), ("q", 6, "traced", "x")],
        [("p", 9000, "seen", "a"), ("p", 9100, "traced", "a"), ("q", 20_000, "seen", "x")], [("p", 40_000, "seen", "c"), ("q", 26_000, "traced", "x"), ("p", 60_000, "traced", "b")],
        [("p", 60_001, "traced", "c"), ("r", 130_000, "seen", "z")]]
    made = [[(p, at(t), k, f) for p, t, k, f in part] for part in parts]
    got = co.settled(co.coverage_checks(batches(spark, tmp_path, FILE, *made)))
    base = int(T0.timestamp())
    rows = sorted((r.project, r.at - base, r.action, r.untraced, r.stale, r.waits) for r in got.collect())
    assert rows == replay([x for part in parts for x in part])
    assert [r[:3] for r in rows[:4]] == [("p", 300, "rebuild"), ("p", 2100, "rebuild"), ("p", 3900, "wait"), ("p", 7500, "wait")]


def test_coverage_query_equals_a_replay(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(user_id % 4 as string)", "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint)",
        "if(event_type = 'purchase', 'traced', 'seen')", "concat('src/f', event_id % 7)").collect()
    got = sorted(tuple(r) for r in registry.QUERIES["st_coverage_tick"](spark, sf).collect())
    want = replay([tuple(r) for r in events])
    assert len(got) > 300 and got == want


def test_ledger_takes_each_row_once_and_drops_old_days(spark, tmp_path):
    sinks = {"all": F.lit(True), "errors": F.col("kind") == "error"}
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", sinks)
    schema = "event_id int, ts timestamp, kind string"
    rows = [[(i, T0 + timedelta(days=i), "error" if i % 2 else "view") for i in range(b * 5, b * 5 + 5)] for b in range(2)]
    stream = batches(spark, tmp_path, schema, *rows)
    ledger.follow(stream, "s")
    ledger.follow(stream, "s")  # nothing new
    ledger.put("s")(spark.createDataFrame(rows[0], schema), 0)  # the first batch again
    assert sorted(r.event_id for r in ledger.read("all").collect()) == list(range(10)) and ledger.read("errors").count() == 5
    ledger.put("other")(spark.createDataFrame(rows[0], schema), 0)  # another stream's first batch
    assert ledger.read("all").count() == 15
    assert ledger.prune("all", date(2024, 1, 10), 4) == [date(2024, 1, d) for d in range(1, 6)]
    assert sorted(r.event_id for r in ledger.read("all").collect()) == [5, 6, 7, 8, 9]
    recent = ledger.recent("all", F.lit(True), 2, date(2024, 1, 8))
    assert [r.event_id for r in recent.collect()] == [9, 8]
    plan = recent._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-08" in plan


@pytest.mark.parametrize(("path", "keys"), [("a/b/c", ["a/b/c", "a/", "a/b/"]), ("a", ["a"])])
def test_claim_keys(spark, path, keys):
    assert spark.createDataFrame([(path,)], "p string").select(co.claim_keys(F.col("p"))).first()[0] == keys


def test_holders_equal_a_plain_list():
    r = random.Random(3)
    for _ in range(50):
        now, plain, at = co.Holders({"old": ("a", 9)}), {"old": ("a", 9)}, 0
        for i in range(200):
            at, agent = at + r.randint(0, 2), r.choice("abc")
            what = r.random()
            if what < 0.4:
                id_, until = r.choice([f"c{i}", f"c{r.randint(0, i)}"]), at + r.randint(0, 40)
                now.claim(id_, agent, until)
                plain[id_] = agent, until
            elif what < 0.6:
                id_ = f"c{r.randint(0, i)}"
                now.release(id_, agent)
                plain = {k: v for k, v in plain.items() if k != id_ and v[0] != agent}
            else:
                assert now.held(at, agent) == any(until > at and whose != agent for whose, until in plain.values())
            assert now.claims == plain


def test_claims_of_one_path_don_t_read_the_state_for_each_row():
    class Handle:
        def __init__(self):
            self.reads, self.timers, self.map = 0, set(), {}

        def getMapState(self, *_):
            return self

        def iterator(self):
            self.reads += 1
            return iter(list(self.map.items()))

        def updateValue(self, k, v):
            self.map[k] = v

        def removeKey(self, k):
            del self.map[k]

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.discard(t)

        def registerTimer(self, t):
            self.timers.add(t)

    claims, handle = co.Claims(), Handle()
    claims.init(handle)
    rows = [(at(i), "claim" if i % 2 else "ask", str(i), "ab"[i % 4 // 2], 3600.0) for i in range(500)]
    frame = pd.DataFrame(rows, columns=["ts", "kind", "id", "agent", "seconds"])
    frame["ts"] = frame["ts"].dt.tz_localize(None)
    out = pd.concat(claims.handleInputRows(("p", "src/"), iter([frame]), None))
    assert len(out) == 250 and handle.reads == 1 and len(handle.timers) == 1 and len(handle.map) == 250


def test_coverage_reads_the_state_of_a_file_once_a_batch():
    class Handle:
        def __init__(self):
            self.calls, self.map = 0, {}

        def getMapState(self, *_):
            return self

        def getValueState(self, *_):
            return type("Checks", (), {"exists": lambda _: False, "update": lambda _, x: None})()

        def containsKey(self, k):
            self.calls += 1
            return k in self.map

        def updateValue(self, k, v):
            self.calls += 1
            self.map[k] = v

        def listTimers(self):
            return iter(())

        def registerTimer(self, t):
            pass

    coverage, handle = co.Coverage(), Handle()
    coverage.init(handle)
    frame = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=700, freq="s"), "kind": ["seen", "traced"] * 350, "path": [f"f{i % 7}" for i in range(700)], "digest": [5] * 700})
    list(coverage.handleInputRows(("p",), iter([frame]), None))
    assert handle.calls == 14 and set(handle.map) == {(f"f{i}",) for i in range(7)}
