"""Message sessions and incremental ingest as Structured Streaming, and what a batch gives for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

TTL = "30 minutes"


def stream_sessions(messages: DataFrame, key: str, ts: str, ttl: str = TTL, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream: a session ends when nothing came for ``ttl``; rows later than ``late`` are passed over."""
    return (
        messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, ttl).alias("w"))
        .agg(F.count("*").alias("n"), F.max(ts).alias("last"))
        .select(key, F.col("w.start").alias("start"), "last", "n")
    )


def batch_sessions(messages: DataFrame, key: str, ts: str, ttl_seconds: int = 1800) -> DataFrame:
    """The same sessions from a table: a gap of more than ``ttl_seconds`` begins a new one."""
    w = Window.partitionBy(key).orderBy(ts)
    at = F.col(ts).cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    new = F.coalesce((gap > ttl_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = messages.withColumn("__new", new).withColumn("__s", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__s").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("__s")


HISTORY = "array<struct<role: string, content: string, at: timestamp>>"


def replay_sessions(commands: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """What each read of a session's history gives: ``session, seq, at, history`` from a table of commands.

    ``commands`` has ``session, seq, at, op, role, content``, in the order of ``at``, then ``seq``. ``append`` adds a message,
    ``clear`` empties the history, ``read`` asks for it. A history whole expires ``ttl_seconds`` after its last message. Commands
    without a session, time or known op are passed over.
    """
    rows = commands.filter("session is not null and at is not null and op in ('append', 'clear', 'read')")
    w = Window.partitionBy("session").orderBy("at", "seq")
    said = F.when(F.col("op") == "append", F.col("at"))
    before = F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", before)
    over = (F.col("op") == "clear") | (F.unix_micros("at") - F.unix_micros("__before") >= ttl_seconds * 1_000_000)
    rows = rows.withColumn("__epoch", F.sum(F.coalesce(over, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy("session", "__epoch").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    message = F.when(F.col("op") == "append", F.struct("role", "content", "at"))
    rows = rows.withColumn("history", F.collect_list(message).over(same))
    return rows.filter("op = 'read'").select("session", "seq", "at", F.col("history").cast(HISTORY).alias("history"))


class _Sessions(StatefulProcessor):
    """The state of one session: commands that wait for the clock, the messages, and when the last one came.

    Commands are put aside until the watermark has passed them and then carried out in order, whatever the order of their
    arrival; a timer empties the history when its time is up. All that is due is carried out at once, so that a session
    reads and writes its state a few times a batch, however many commands it has.
    """

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, op string, role string, content string")
        self.messages = handle.getListState("messages", "role string, content string, at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        fresh = [(r["micros"], r["seq"], r["op"], r["role"], r["content"]) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(c[0] for c in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000  # whatever came before has arrived
        waiting = sorted(self.waiting.get(), key=lambda c: (c[0], c[1])) if self.waiting.exists() else []
        due, rest = [c for c in waiting if c[0] < now], [c for c in waiting if c[0] >= now]
        last = self.last.get()[0] if self.last.exists() else None
        if not due and (last is None or now - last < self.ttl):
            return
        held = [tuple(m) for m in self.messages.get()] if due and last is not None else []
        kept = len(held)  # how many of them are in the state
        for at, seq, op, role, content in due:
            if op == "clear" or (last is not None and at - last >= self.ttl):
                held, kept, last = [], -1, None
            if op == "append":
                held.append((role, content, at))
                last = at
            elif op == "read":
                yield Row(session=key[0], seq=seq, at=at, history=[Row(role=m[0], content=m[1], at=m[2]) for m in held])
        if last is None or now - last >= self.ttl:
            self.messages.clear()
            self.last.clear()
        elif kept < 0 or len(held) > kept:
            if kept < 0:
                self.messages.put(held)
            else:
                self.messages.appendList(held[kept:])
            self.last.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
        if due:
            self.waiting.clear()
        if due and rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    def close(self) -> None:
        pass


def session_state(commands: DataFrame, ttl_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """``replay_sessions`` of a stream: each read comes out once the watermark (``late`` behind the latest command) has passed it.

    Histories are keyed state in RocksDB and survive a restart from the checkpoint; those that expire leave it by a timer.
    Commands later than ``late`` are passed over.
    """
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = commands.filter("session is not null and at is not null and op in ('append', 'clear', 'read')")
    kind = commands.schema["session"].dataType.simpleString()
    keyed = rows.withColumn("micros", F.unix_micros("at")).withWatermark("at", late).groupBy("session")
    out = keyed.transformWithState(_Sessions(ttl_seconds * 1_000_000), f"session {kind}, seq long, at long, history {HISTORY.replace('timestamp', 'long')}", "append", "eventTime")
    message = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.timestamp_micros(m["at"]).alias("at"))
    return out.select("session", "seq", F.timestamp_micros("at").alias("at"), F.transform("history", message).alias("history"))


def history(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation's non-empty messages by user and assistant, in order, as one array."""
    kept = turns.filter(F.col(role).isin("user", "assistant") & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0))
    ordered = kept.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, role, text))).alias("messages"))
    return ordered.select(conv, F.size("messages").alias("n"), "messages")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source has now and give the outcome as a table in memory (for results of a proven small size)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now into Parquet files, each row once, and read them."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key did not come within the watermark before."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
