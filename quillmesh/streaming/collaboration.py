"""Claims on paths that expire, and the periodic check of what the index has not seen: state with timers, a key at a time.

Both are processors for ``transformWithStateInPandas`` in event time. Rows of a key are taken in order of their time inside a batch; timers fire
when the watermark passes them, so what is still open when a stream rests is settled by the batch that the watermark's move triggers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import drain

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """These processors need the state store on disk; the caller's session keeps its own setting."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def settled(flow: DataFrame) -> DataFrame:
    with rocksdb(flow.sparkSession):
        return drain(flow)


def micros(x: pd.Series) -> list[int]:
    return x.astype("datetime64[us]").astype("int64").tolist()


# Claims -------------------------------------------------------------------------------------------------------------------------------------


class Holders:
    """The claims on one path: (agent, until) by id, and the agents by their latest end, so that a request costs the logarithm of the claims."""

    def __init__(self, claims: dict[str, tuple[str, int]]):
        self.claims: dict[str, tuple[str, int]] = {}
        self.own: dict[str, dict[str, int]] = {}
        self.ends: dict[str, list[tuple[int, str]]] = {}
        self.latest: list[tuple[int, str]] = []
        for id_, (agent, until) in claims.items():
            self.claim(id_, agent, until)

    def claim(self, id_: str, agent: str, until: int) -> None:
        if id_ in self.claims:
            self.drop(id_)
        self.claims[id_] = agent, until
        self.own.setdefault(agent, {})[id_] = until
        heapq.heappush(self.ends.setdefault(agent, []), (-until, id_))
        heapq.heappush(self.latest, (-until, agent))

    def drop(self, id_: str) -> None:
        agent = self.claims.pop(id_)[0]
        del self.own[agent][id_]
        if (end := self.end(agent)) is not None:
            heapq.heappush(self.latest, (-end, agent))

    def release(self, id_: str, agent: str) -> None:
        """That claim, and all of the agent's."""
        if id_ in self.claims:
            self.drop(id_)
        for k in self.own.pop(agent, {}):
            del self.claims[k]
        self.ends.pop(agent, None)

    def end(self, agent: str) -> int | None:
        """The end of an agent's longest claim."""
        ends, own = self.ends.get(agent, []), self.own.get(agent, {})
        while ends and own.get(ends[0][1]) != -ends[0][0]:
            heapq.heappop(ends)
        return -ends[0][0] if ends else None

    def held(self, at: int, agent: str) -> bool:
        """Whether another agent's claim lasts beyond at."""
        mine, found = None, False
        while self.latest and -self.latest[0][0] > at:
            until, whose = self.latest[0]
            if self.end(whose) != -until or (whose == agent and mine):
                heapq.heappop(self.latest)
            elif whose == agent:
                mine = heapq.heappop(self.latest)
            else:
                found = True
                break
        if mine:
            heapq.heappush(self.latest, mine)
        return found


class Claims(StatefulProcessor):
    """The claims on one path or folder of a project, by id; each goes when it is released or its time is over.

    The state is read and written once a batch, and one timer waits for the first end of all claims.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "id string", "agent string, until bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        every = pd.concat(list(rows)).sort_values(["ts", "id"])
        before = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        now = Holders(before)
        for at, kind, id_, agent, seconds in zip(micros(every["ts"]), every["kind"], every["id"], every["agent"], every["seconds"], strict=True):
            if kind == "claim":
                now.claim(id_, agent, at + round(seconds * 1e6))
            elif kind == "release":
                now.release(id_, agent)
            else:
                out.append((id_, key[0], key[1], now.held(at, agent)))
        for k in before.keys() - now.claims.keys():
            self.held.removeKey((k,))
        for k, v in now.claims.items():
            if before.get(k) != v:
                self.held.updateValue((k,), v)
        self.wait([v[1] for v in now.claims.values()])
        yield pd.DataFrame(out, columns=["id", "project", "key", "claimed"])

    def wait(self, ends: list[int]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs() * 1000, []
        for k, v in list(self.held.iterator()):
            if v[1] <= now:
                self.held.removeKey(k)
            else:
                left.append(v[1])
        self.wait(left)
        yield pd.DataFrame({"id": [], "project": [], "key": [], "claimed": []}).astype({"id": str, "project": str, "key": str, "claimed": bool})

    def close(self) -> None:
        pass


def claim_keys(path: Column) -> Column:
    """Where a claim that covers a path may be held: the path itself, and each folder above it, with its final slash."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, F.concat(F.array(path), folders)).otherwise(F.array(path))


def answers(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, project, key, claimed) of each ask for each key that may cover its path. requests: project, ts, kind (claim, release, ask), id, agent, path, seconds; a stream.

    A claim of a folder has a path with a final slash. An agent's own claims don't count for it.
    """
    key = F.explode(F.when(F.col("kind") == "ask", claim_keys(F.col("path"))).otherwise(F.array("path")))
    rows = requests.withColumn("key", key).withColumn("id", F.col("id").cast("string")).withColumn("agent", F.col("agent").cast("string"))
    rows = rows.select("project", "key", "ts", "kind", "id", "agent", F.col("seconds").cast("double").alias("seconds")).withWatermark("ts", late)
    return rows.groupBy("project", "key").transformWithStateInPandas(Claims(), "id string, project string, key string, claimed boolean", "append", "eventTime")


def claimed(answered: DataFrame) -> DataFrame:
    """(id, project, claimed): whether any key that covers the path of an ask was claimed."""
    return answered.groupBy("id", "project").agg(F.bool_or("claimed").alias("claimed"))


# Coverage -----------------------------------------------------------------------------------------------------------------------------------

EVERY, COOLDOWN, CAP = 300, 1_800, 6 * 3_600
UNTRACED, STALE, TRACED = 1, 2, 0


class Ticks:
    """When an index that lags behind its files is rebuilt: a check every EVERY seconds, a rest after a rebuild, and growing waits while the same
    files stay untraced. Times are whole seconds; the untraced set is a count and a sum of digests, whatever the order."""

    def __init__(self, first: int, tick: int, untraced: int = 0, stale: int = 0, mark: int = 0, fired: int = -1, seen: int = -1, skips: int = 0, hold: int = -1):
        self.first, self.tick, self.untraced, self.stale, self.mark = first, tick, untraced, stale, mark
        self.fired, self.seen, self.skips, self.hold = fired, seen, skips, hold

    def state(self) -> tuple:
        return self.first, self.tick, self.untraced, self.stale, self.mark, self.fired, self.seen, self.skips, self.hold

    def due(self) -> int | None:
        """The next check that may do something, on the grid of checks."""
        if not self.untraced + self.stale:
            return None
        at = max(self.tick, self.fired + COOLDOWN if self.fired >= 0 else 0, self.hold)
        return self.first + -(-(at - self.first) // EVERY) * EVERY

    def until(self, now: int) -> Iterator[tuple[int, str, int, int, int]]:
        """(time, action, untraced, stale, waits in a row) of the checks before now."""
        while (at := self.due()) is not None and at < now:
            sign = self.mark if not self.stale else -1
            if sign >= 0 and sign == self.seen:
                self.skips += 1
                self.hold = at + min(COOLDOWN * 2**self.skips, CAP)
                yield at, "wait", self.untraced, self.stale, self.skips
            else:
                self.fired, self.seen, self.skips = at, sign, 0
                yield at, "rebuild", self.untraced, self.stale, 0
            self.tick = at + EVERY
        if now >= self.tick:
            self.tick = self.first + -(-(now - self.first) // EVERY) * EVERY

    def change(self, old: int, new: int, digest: int) -> None:
        for status, way in ((old, -1), (new, 1)):
            self.untraced += way * (status == UNTRACED)
            self.stale += way * (status == STALE)
            self.mark = (self.mark + way * digest * (status == UNTRACED)) % (1 << 62)


class Coverage(StatefulProcessor):
    """The state of a project's files and of its checks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", "status int")
        self.checks = handle.getValueState("checks", ", ".join(f"x{i} bigint" for i in range(9)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "path", "kind"])
        times = [t // 1_000_000 for t in micros(every["ts"])]
        ticks = Ticks(*(int(x) for x in self.checks.get())) if self.checks.exists() else Ticks(times[0], times[0] + EVERY)
        out = []
        before: dict[str, int | None] = {}  # the files of this batch as they were, each read once
        files: dict[str, int | None] = {}
        for at, kind, path, digest in zip(times, every["kind"], every["path"], every["digest"], strict=True):
            out += ticks.until(at)
            if path not in files:
                before[path] = files[path] = self.files.getValue((path,))[0] if self.files.containsKey((path,)) else None
            old = files[path]
            new = TRACED if kind == "traced" else UNTRACED if old in (None, UNTRACED) else STALE
            if new != old:
                ticks.change(TRACED if old is None else old, new, int(digest))
                files[path] = new
        for path, new in files.items():
            if new != before[path]:
                self.files.updateValue((path,), (new,))
        yield self.done(key, ticks, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ticks = Ticks(*(int(x) for x in self.checks.get()))
        out = list(ticks.until(timerValues.getCurrentWatermarkInMs() // 1000))
        yield self.done(key, ticks, out)

    def done(self, key: Any, ticks: Ticks, out: list) -> pd.DataFrame:
        self.checks.update(ticks.state())
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (at := ticks.due()) is not None:
            self.handle.registerTimer((at + 1) * 1000)
        return pd.DataFrame([(key[0], *x) for x in out], columns=["project", "at", "action", "untraced", "stale", "waits"])

    def close(self) -> None:
        pass


def coverage_checks(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """(project, at in seconds, action, untraced, stale, waits) of the checks that rebuild or wait. files: project, ts, kind (seen, traced), path; a stream."""
    digest = F.abs(F.xxhash64("path")) % (1 << 61)
    rows = files.select(F.col("project").cast("string").alias("project"), "ts", "kind", "path", digest.alias("digest")).withWatermark("ts", late)
    return rows.groupBy("project").transformWithStateInPandas(Coverage(), "project string, at bigint, action string, untraced bigint, stale bigint, waits bigint", "append", "eventTime")
