"""Session histories as streaming state and from tables; change logs with deletes and compaction."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarnflow.streaming import sessions
from tarnflow.streaming.changelog import ChangeLog

SCHEMA = "session string, seq long, at timestamp, op string, role string, content string"
T0 = dt.datetime(2024, 5, 1, 12)


def command(session, seq, seconds, op="append"):
    return (session, seq, None if seconds is None else T0 + dt.timedelta(seconds=seconds), op, "user", f"m{seq}")


def plain(commands, ttl=1800):
    """One command after the other against a dict."""
    held, out = {}, []
    for s, seq, at, op, _, content in sorted((c for c in commands if c[0] and c[2]), key=lambda c: (c[2], c[1])):
        if s in held and (at - held[s][0]).total_seconds() >= ttl:
            del held[s]
        if op == "append":
            held[s] = (at, [*held.get(s, (at, []))[1], content])
        elif op == "clear":
            held.pop(s, None)
        elif op == "read":
            out.append((s, seq, held.get(s, (at, []))[1]))
    return sorted(out)


def said(reads):
    return sorted((r.session, r.seq, [m.content for m in r.history]) for r in reads.collect())


def some(n=300):
    rng, t, out = random.Random(6), 0, []
    for seq in range(n):
        t += rng.choice([0, 1, 60, 900, 1799, 1800, 1801])
        out.append(command(rng.choice("abc"), seq, t, rng.choice(["append", "append", "append", "read", "read", "clear"])))
    return out


def test_replay_equals_one_after_the_other(spark):
    commands = [*some(), command(None, 900, 1), command("a", 901, None), command("a", 902, 5, "other")]
    got = sessions.replay_sessions(spark.createDataFrame(commands, SCHEMA))
    assert said(got) == plain(commands)
    assert sessions.replay_sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_history_expires_after_the_last_message(spark):
    commands = [command("a", 1, 0), command("a", 2, 1799), command("a", 3, 3598, "read"), command("a", 4, 3599, "read"), command("a", 5, 3600), command("a", 6, 3600, "read"), command("a", 7, 3601, "clear"), command("a", 8, 3602, "read")]
    assert said(sessions.replay_sessions(spark.createDataFrame(commands, SCHEMA))) == [("a", 3, ["m1", "m2"]), ("a", 4, []), ("a", 6, ["m5"]), ("a", 8, [])]


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    commands = some()
    source, out, check = (str(tmp_path / n) for n in ("source", "out", "check"))
    end = [(None, 0, commands[-1][2] + dt.timedelta(days=k), "read", None, None) for k in (2, 3)]
    end = [("z", *e[1:]) for e in end]

    def run(rows):
        for r in rows:
            spark.createDataFrame(r, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return sessions.run_to_table(sessions.session_state(stream, late="10 seconds"), out, check)

    rng = random.Random(1)
    first = commands[:150]
    rng.shuffle(first)  # within a batch the order of arrival says nothing
    run([first])
    got = run([commands[150:220], commands[220:], end[:1], end[1:]])
    assert said(got.filter("session <> 'z'")) == plain(commands)


class Counted:
    """A state or handle in memory that counts its calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def appendList(self, rows):
        self.calls += 1
        self.value = [*(self.value or []), *rows]

    def appendValue(self, row):
        self.appendList([row])

    def put(self, rows):
        self.calls += 1
        self.value = list(rows)

    update = lambda self, v: setattr(self, "value", v)
    clear = lambda self: setattr(self, "value", None)
    registerTimer = lambda self, t: self.timers.add(t)


def test_calls_to_the_state_do_not_grow_with_the_commands():
    from types import SimpleNamespace as Any

    def run(n):
        p, states = sessions._Sessions(1_800_000_000), [Counted() for _ in range(4)]
        p.waiting, p.messages, p.last, p.handle = states
        rows = [{"micros": i * 1_000_000, "seq": i, "op": "read" if i % 3 == 2 else "append", "role": "user", "content": f"m{i}"} for i in range(n)]
        p.handleInputRows(("a",), iter(rows), None)
        clock, out = Any(getCurrentWatermarkInMs=lambda: n * 1000 + 1), []
        for t in sorted(states[3].timers):
            if t <= n * 1000 + 1:
                out += p.handleExpiredTimer(("a",), clock, Any(getExpiryTimeInMs=lambda t=t: t))
        assert [(r["seq"], len(r["history"])) for r in out] == [(i, i - i // 3) for i in range(2, n, 3)]
        assert states[0].value is None and len(states[1].value) == n - n // 3
        return sum(s.calls for s in states)

    assert run(300) == run(30) < 20


CHANGES = "k int, at int, v string, deleted boolean"


def live(changes):
    """Key and value of the rows that stand after batches of changes."""
    best = {}
    for n, batch in enumerate(changes):
        for k, at, v, gone in batch:
            if k is not None and (k not in best or (at, n) >= best[k][:2]):
                best[k] = (at, n, v, gone)
    return sorted((k, v) for k, (_, _, v, gone) in best.items() if not gone)


def batches():
    rng, out, at = random.Random(2), [], 0
    for n in range(7):
        batch = {}
        for _ in range(40 if n == 0 else 9):
            at += 1
            k = rng.randrange(60)
            batch[k] = (k, at - rng.choice([0, 0, 30]), f"v{at}", rng.random() < 0.3)
        out.append([*batch.values(), (None, 1, "no key", False)])
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


def test_same_rows_with_and_without_compaction(spark, tmp_path):
    logs = [ChangeLog(spark, str(tmp_path / n), "k", "at", share) for n, share in (("some", 0.25), ("none", 1e9), ("always", 0.0))]
    every = batches()
    for n, batch in enumerate(every):
        for log in logs:
            log.apply(spark.createDataFrame(batch, CHANGES), n)
            assert rows(log.read()) == live(every[: n + 1])
    some, none, always = ([v.base for v in log.versions()] for log in logs)
    assert none[1:] == [0] * 6 and always == list(range(7)) and 0 < len(set(some)) < 7  # the first batch is always merged
    for n in range(7):  # a reader of an older version goes on reading it
        assert rows(logs[0].read(n)) == live(every[: n + 1])
    assert logs[2].superseded() and not any("version=6" in p for p in logs[2].superseded())


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    log, every = ChangeLog(spark, str(tmp_path / "log"), "k", "at"), batches()
    for n, batch in [*enumerate(every[:4]), (3, every[3]), *list(enumerate(every))[4:]]:
        log.apply(spark.createDataFrame(batch, CHANGES), n)
    assert rows(log.read()) == live(every)


def test_follow_and_restart_between_compactions(spark, tmp_path):
    source, check = str(tmp_path / "source"), str(tmp_path / "check")
    every = batches()
    for part in (every[:3], every[3:]):
        for batch in part:
            spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(source)
        log = ChangeLog(spark, str(tmp_path / "state"), "k", "at")  # a new reader and writer each time
        log.follow(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source), check)
    assert rows(log.read()) == live(every) and len(log.versions()) == 7


def test_get_and_delete_by_key(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k", "at")
    log.apply(spark.createDataFrame([(k, 1, f"v{k}", False) for k in range(6)], CHANGES), 0)
    log.delete(spark.createDataFrame([(2, 5), (9, 5)], "k int, at int"))
    keys = spark.createDataFrame([(1,), (1,), (2,), (7,), (None,)], "k int")
    assert rows(log.get(keys)) == [(1, "v1")] and rows(log.get(keys, 0)) == [(1, "v1"), (2, "v2")]
    log.apply(spark.createDataFrame([(2, 3, "older than its deletion", False), (9, 6, "later", False)], CHANGES), 2)
    assert rows(log.read()) == [(k, f"v{k}") for k in (0, 1, 3, 4, 5)] + [(9, "later")]


def test_change_log_without_rows(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k", "at")
    assert log.versions() == []
    log.apply(spark.createDataFrame([], CHANGES), 0)
    assert rows(log.read()) == []
    log.apply(spark.createDataFrame([(1, 1, "a", False)], CHANGES), 1)
    assert rows(log.read()) == [(1, "a")] and rows(log.read(0)) == []
