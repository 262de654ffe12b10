"""Structured Streaming forms of ingestion, sessions, limits and statistics.

Event times have to be TIMESTAMP (not NTZ). Each operator says what bounds its state. Those that keep values of their own
(`rate_limit`, `reply_state`, `turn_counter`) need the RocksDB state store, which they set on the session; a key's rows of
one batch are held as two or three numbers a row, so a source's limit on a batch bounds the memory of a hot key.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunks import chunk_words
from ..operators.insight import anomalies
from ..sources.files import DOCUMENT


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, put: Callable[[DataFrame, int], None], size: int = 100, overlap: int = 20, empty: bool = False) -> StreamingQuery:
    """Reads new JSON files of documents below ``path``, chunks them, and gives each batch of chunks to ``put``, which
    has to be safe to run twice (an upsert is). Ends when all files are read; the next start goes on from there. With
    ``empty`` a document without words comes as one empty chunk."""
    docs = spark.readStream.schema(DOCUMENT).json(path).filter("id IS NOT NULL AND content IS NOT NULL")
    chunks = chunk_words(docs, size, overlap, empty=empty)
    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, id_col: str, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Drops rows whose id came within ``delay`` before; state holds the ids of that time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def log_stats_stream(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """start, total, answered of closed windows."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("is_no_answer") == 0).alias("answered"))
    return w.select(F.col("w.start").alias("start"), "total", "answered")


def session_stream(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """key, start, end, turns of sessions that were quiet for ``gap``."""
    marked = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    s = marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("turns"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def accept_calls(times: list[float], kept: list[float], limit: int, span: float = 60.0) -> tuple[list[bool], list[float]]:
    """Which calls (times in order, in the unit of ``span``) are accepted when at most ``limit`` accepted ones lie within
    ``span`` before; 0 or less: all. ``kept``: accepted times so far; at most ``limit`` are kept."""
    out = []
    for t in times:
        kept = [x for x in kept if t - x <= span]
        out.append(limit <= 0 or len(kept) < limit)
        if out[-1] and limit > 0:
            kept.append(t)
    return out, kept


_LIMITED = "client_id long, id long, us long, accepted boolean"


def _with_own_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _columns(parts: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    """Columns of all ``parts``."""
    held = [[part[n].to_numpy() for n in names] for part in parts]
    return [np.concatenate(c) for c in zip(*held, strict=True)]


class _Quiet(StatefulProcessor):
    """A key's values end with a timer when the watermark is past what it was last told. A time to live by the clock is not
    used: it would not end with a replay, and a query that reads all there is would wait for it for ever."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")
        self.values = self.open(handle)

    def renew(self, ms: int) -> None:
        if self.until.exists():
            if (old := self.until.get()[0]) >= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.until.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Limiter(_Quiet):
    """Accepted times of a client (at most ``limit``), until the watermark is past all that they can rule out."""

    def __init__(self, limit: int, span_us: int) -> None:
        self.limit, self.span = limit, span_us

    def open(self, handle: StatefulProcessorHandle):
        return handle.getListState("kept", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids = _columns(rows, "us", "id")
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        ok, kept = accept_calls(us.tolist(), [r[0] for r in self.values.get()] if self.values.exists() else [], self.limit, self.span)
        if kept:
            self.values.put([(int(x),) for x in kept])
            self.renew((max(kept) + self.span) // 1000 + 1)
        yield pd.DataFrame({"client_id": np.full(len(us), key[0]), "id": ids, "us": us, "accepted": ok})


def rate_limit(stream: DataFrame, limit: int = 30, span: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """client_id, id, us (microseconds), accepted of calls (client_id, id, created_at). A client's calls of a batch are taken
    in order of time; calls that come more than ``delay`` late are dropped. State: at most ``limit`` times of each client
    that called within ``span`` and ``delay`` before the newest call of all; a timer ends it. The result is that of the
    batch form over each client's calls in the order that they are taken in."""
    timed = stream.select("client_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"))
    span_us = round(span * 1e6)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = None, []
        for part in parts:
            for c, rows in part.groupby("client_id", sort=False, dropna=False):
                client, kept = (client, kept) if c == client else (c, [])
                ok, kept = accept_calls(rows["us"].tolist(), kept, limit, span_us)
                yield rows.assign(accepted=ok)[["client_id", "id", "us", "accepted"]]

    if not stream.isStreaming:
        return timed.drop("created_at").repartition("client_id").sortWithinPartitions("client_id", "us", "id").mapInPandas(walk, _LIMITED)
    _with_own_state(stream.sparkSession)
    return timed.withWatermark("created_at", delay).groupBy("client_id").transformWithStateInPandas(_Limiter(limit, span_us), _LIMITED, "append", "eventtime")


class _Replies(_Quiet):
    """First document and newest time of a question."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet = quiet_ms

    def open(self, handle: StatefulProcessorHandle):
        return handle.getValueState("reply", "first long, newest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, newest = self.values.get() if self.values.exists() else (None, None)
        earliest, best = None, None
        for part in rows:  # the first and the newest row are all that is held
            places = list(zip(part["created_at"].tolist(), part["doc_id"].tolist(), part["reply"].tolist(), strict=True))
            low, high = min(places, key=lambda x: x[:2]), max(places, key=lambda x: x[:2])
            earliest = low if earliest is None or low[:2] < earliest[:2] else earliest
            best = high if best is None or high[:2] > best[:2] else best
        first = int(earliest[1]) if first is None else first
        if newest is None or best[0] >= newest:
            newest = int(best[0])
            yield pd.DataFrame({"question": [key[0]], "doc_id": [first], "reply": [best[2]], "created_at": [newest]})
        self.values.update((first, newest))
        self.renew(newest + self.quiet)


#: How long (of event time, in milliseconds) a question or session may be quiet before it is begun anew.
QUIET_MS = 90 * 86_400_000


def reply_state(stream: DataFrame, quiet_ms: int = QUIET_MS, delay: str = "1 day") -> DataFrame:
    """question, doc_id, reply, created_at (milliseconds) whenever a question's active reply changes: the newest reply, under
    the document that answered the question first. Replies that come more than ``delay`` late are dropped. State: three
    numbers for each question that had a reply within ``quiet_ms`` and ``delay`` before the newest reply of all; a later
    reply begins the question anew."""
    _with_own_state(stream.sparkSession)
    timed = stream.select("question", "doc_id", "reply", "created_at", F.timestamp_millis("created_at").alias("at")).withWatermark("at", delay)
    return timed.groupBy("question").transformWithStateInPandas(_Replies(quiet_ms), "question string, doc_id long, reply string, created_at long", "update", "eventtime")


def _drop_expired(spark: SparkSession, sink: str, last: date) -> None:
    """Deletes the day folders below ``sink`` (batch=n/day=d) up to ``last``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sink}/batch=*/day=*")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in fs.globStatus(path) or []:
        day = found.getPath().getName().removeprefix("day=")
        if day != "__HIVE_DEFAULT_PARTITION__" and date.fromisoformat(day) <= last:
            fs.delete(found.getPath(), True)


def retain_stream(stream: DataFrame, days: int, sink: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Writes rows by day and, after each batch, deletes days that are ``days`` or more before the newest one of all
    batches so far, which is kept beside the sink; rows of such days that come late are not written. A batch may run
    twice."""
    sink = sink.rstrip("/")
    schema = "newest date"

    def put(batch: DataFrame, number: int) -> None:
        spark, dated = batch.sparkSession, batch.withColumn("day", F.to_date(ts))
        own = dated.agg(F.max("day").alias("newest")).first()[0]
        spark.createDataFrame([(own,)], schema).coalesce(1).write.mode("overwrite").parquet(f"{sink}-newest/batch={number}")
        newest = spark.read.schema(schema).parquet(f"{sink}-newest").agg(F.max("newest")).first()[0]
        if newest is not None:
            last = newest - timedelta(days=days)
            dated.filter(F.col("day") > F.lit(last)).write.mode("overwrite").partitionBy("day").parquet(f"{sink}/batch={number}")
            _drop_expired(spark, sink, last)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def surge_stream(stream: DataFrame, put: Callable[[DataFrame, int], None], ring: str, checkpoint: str, days: int = 7, z: float = 2.5, ts: str = "ts", delay: str = "1 hour") -> StreamingQuery:
    """After each batch that closes a day, ``put`` gets those of the last ``days`` closed days whose counts stand out. A day
    is closed, and counted once, when ``delay`` after its end is reached. State: open days; the counts of the last
    ``days`` closed ones are rows below ``ring``, one folder a batch, of which the newest two stay. A batch may run twice."""
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("date"), "n")
    schema, ring = "date date, n long", ring.rstrip("/")

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _batches(spark, ring) if b < number]
        held = spark.read.schema(schema).parquet(f"{ring}/batch={before[-1]}") if before else spark.createDataFrame([], schema)
        newest = held.unionByName(batch).orderBy(F.desc("date")).limit(days)
        newest.write.mode("overwrite").parquet(f"{ring}/batch={number}")
        if not batch.isEmpty():
            put(anomalies(spark.read.schema(schema).parquet(f"{ring}/batch={number}"), "n", z, least_days=3), number)
        for old in before[:-1]:
            _delete(spark, f"{ring}/batch={old}")

    return counts.writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in found)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Parts that sessions are dealt to by a hash, groups of sessions in a part whose state is one value, and how often a part
#: is looked through for ended sessions in the time that a session is kept.
PARTS, GROUPS, SWEEPS = 1024, 256, 8


class _Turns(StatefulProcessor):
    """Turns so far, and the time when it ends, of each session of a part, kept by groups. Ended ones go when their group
    is written, or when the part is looked through; one that is still there counts as gone."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet, self.step = quiet_ms, max(1, quiet_ms // SWEEPS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups = handle.getMapState("groups", "in_group int", "names array<string>, n array<long>, until array<long>")
        self.sweep = handle.getValueState("sweep", "ms long")  # there as long as the part has sessions

    def _sweep_after(self, until: int, old: tuple | None) -> None:
        ms = (until // self.step + 1) * self.step
        if old is None or ms < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(ms)
            self.sweep.update((ms,))

    def _put(self, group: int, kept: dict) -> None:
        turns, until = zip(*kept.values(), strict=True)
        self.groups.updateValue((group,), (list(kept), list(turns), list(until)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, ids, names, groups = _columns(rows, "created_at", "id", "session_id", "in_group")
        codes, sessions = pd.factorize(names, use_na_sentinel=False)
        order, counts = np.lexsort((ids, at, codes)), np.bincount(codes)
        ends, first = np.cumsum(counts), np.zeros(len(counts), dtype=np.int64)
        until, own = (at[order][ends - 1] // 1000 + self.quiet).tolist(), groups[order][ends - 1]
        old, mark = self.sweep.get(), timerValues.getCurrentWatermarkInMs()
        members = np.argsort(own, kind="stable")
        for some in np.split(members, np.flatnonzero(np.diff(own[members])) + 1):
            group = int(own[some[0]])
            held = old and self.groups.getValue((group,))
            kept = {x: (n, t) for x, n, t in zip(*held, strict=True) if t >= mark} if held else {}
            for i in some.tolist():
                name = sessions[i] if isinstance(sessions[i], str) else None
                first[i], t = kept.get(name, (0, until[i]))
                kept[name] = int(first[i] + counts[i]), max(t, until[i])
            self._put(group, kept)
        self._sweep_after(min(until), old)
        turns = np.arange(len(ids)) - np.repeat(ends - counts - first, counts)
        yield pd.DataFrame({"session_id": names[order], "id": ids[order], "turn_index": turns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, fewer, least = timerValues.getCurrentWatermarkInMs(), {}, []
        for (group,), held in self.groups.iterator():
            kept = {x: (n, t) for x, n, t in zip(*held, strict=True) if t >= mark}
            if len(kept) < len(held[0]):
                fewer[group] = kept
            least.extend(sorted(t for _, t in kept.values())[:1])
        for group, kept in fewer.items():
            if kept:
                self._put(group, kept)
            else:
                self.groups.removeKey((group,))
        self.sweep.clear()
        if least:
            self._sweep_after(min(least), None)
        return iter(())

    def close(self) -> None:
        pass


def turn_counter(stream: DataFrame, quiet_ms: int = QUIET_MS, delay: str = "1 day", parts: int = PARTS) -> DataFrame:
    """session_id, id, turn_index (from 0) in order of arrival, and of time (created_at, microseconds) within a batch. Turns
    that come more than ``delay`` late are dropped. State: two numbers for each session with a turn within ``quiet_ms``
    (an eighth more at most) and ``delay`` before the newest turn of all; a later turn is number 0 again. Python takes a
    part of the sessions at a time, as a call for each session costs more than its turns; a part's rows of one batch are
    held, so a source's limit on a batch bounds the memory. ``parts`` can't be changed for a checkpoint that is there."""
    _with_own_state(stream.sparkSession)
    timed = stream.select("session_id", "id", "created_at", F.timestamp_micros("created_at").alias("at")).withWatermark("at", delay)
    code = F.xxhash64("session_id")
    dealt = timed.withColumn("part", F.pmod(code, F.lit(parts))).withColumn("in_group", F.pmod(F.shiftright(code, 32), F.lit(GROUPS)).cast("int"))
    return dealt.groupBy("part").transformWithStateInPandas(_Turns(quiet_ms), "session_id string, id long, turn_index long", "append", "eventtime")


class LateRows(StreamingQueryListener):
    """Adds up, for all batches of all queries, how many rows each stateful operator dropped as too late: a small JSON file
    below ``folder`` for each batch that dropped any, named by query and batch, so that one that runs twice counts once.
    Add it to ``spark.streams`` before the query starts, and `wait` for the query's end before reading."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.ended = spark, folder.rstrip("/"), {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [{"query": str(p.id), "batch": p.batchId, "operator": op.operatorName, "late": op.numRowsDroppedByWatermark} for op in p.stateOperators if op.numRowsDroppedByWatermark]
        if rows:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.id}-{p.batchId}.json")
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray("\n".join(map(json.dumps, rows)).encode()))
            out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all that the query told has come in."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"query {query.runId} has not ended")

    def rows(self) -> DataFrame:
        """query, batch, operator, late."""
        schema = "query string, batch long, operator string, late long"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).json(self.folder) if there else self.spark.createDataFrame([], schema)
