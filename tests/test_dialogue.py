"""The registration dialogue: a fold over each chat's messages, as a table and as a stream that comes out of order."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from marlspar.streaming import dialogue, streams

IDLE = 3600
START = datetime(2024, 1, 1)


def messages(n, seed):
    """(chat_id, message_id, ts, text, mime_type): mostly answers, with commands, files, pauses and equal times."""
    rng, out = random.Random(seed), []
    for chat in range(6):
        at = START + timedelta(seconds=chat)
        for i in range(n):
            at += timedelta(seconds=rng.choice([0, 5, 60, 600, 600, 600, 600, 4000]))
            kind = rng.random()
            text, mime = f"a{i}", None
            if kind < 0.08:
                text = "/start"
            elif kind < 0.15:
                text = "/cancel"
            elif kind < 0.25:
                text = rng.choice(["/edit email new", "/edit full_name A B", "/edit nothing x", "/edit email"])
            elif kind < 0.45:
                mime = rng.choice([dialogue.PDF, "image/png"])
                text = rng.choice([f"cv{i}", None])
            elif kind < 0.48:
                text = None
            out.append((chat, i, at, text, mime))
    return out


def fold(rows, until=None):
    out = []
    for chat in sorted({r[0] for r in rows}):
        talk = dialogue.Dialogue()
        seconds = lambda ts: (ts - START).total_seconds()

        def give_up(at):
            if (lost := talk.given_up(seconds(at), IDLE)) is not None:
                out.append((chat, *lost, *[None] * (4 - len(lost)), None, "given up", START + timedelta(seconds=talk.last)))

        for _, _, ts, text, mime in sorted((r for r in rows if r[0] == chat), key=lambda r: (r[2], r[1])):
            give_up(ts)
            if done := talk.heard(seconds(ts), text, mime):
                status, answers, resume = done
                out.append((chat, *answers, *[None] * (4 - len(answers)), resume, status, ts))
        if until:
            give_up(until)
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_rules():
    talk = dialogue.Dialogue()
    assert [talk.heard(i, t, None) for i, t in enumerate(["hi", "/start", "n", "p", "e", "/edit email f", "/edit years_of_experience 9", "1.3", "not a file"])] == [None] * 9
    assert talk.heard(9, "cv", "image/png") is None
    assert talk.heard(10, "cv", dialogue.PDF) == ("registered", ["n", "p", "f", "1.3"], "cv")
    assert talk.heard(11, "more", None) is None
    talk.heard(12, "/start", None)
    assert talk.heard(13, "/cancel", None) == ("cancelled", [], None)


def test_a_table_equals_the_fold(spark):
    for seed in range(2):
        rows = messages(80, seed)
        df = spark.createDataFrame(rows + rows[:9], dialogue.MESSAGE).repartition(5)
        assert got(dialogue.registrations(df, IDLE)) == fold(rows)
        assert got(dialogue.registrations(df, IDLE, until="2030-01-01")) == fold(rows, datetime(2030, 1, 1))
    assert {"registered", "cancelled", "given up"} <= {r.status for r in dialogue.registrations(df, IDLE).collect()}
    assert dialogue.registrations(df.limit(0), IDLE).count() == 0


def test_a_stream_out_of_order_equals_the_fold(spark, tmp_path):
    """Messages come up to 20 minutes late in three runs, each of which goes on where the one before has ended; one that comes too late is dropped."""
    rows = messages(25, 9)
    rng = random.Random(1)
    comes = {r[:2]: r[2] + timedelta(seconds=rng.choice([0, 0, 1100])) for r in rows}
    ordered = sorted(rows, key=lambda r: comes[r[:2]])
    cut = [0, len(ordered) // 3, 2 * len(ordered) // 3, len(ordered)]
    lots = [ordered[a:b] for a, b in zip(cut, cut[1:])]
    lots[1] += lots[0][-5:]  # the same messages again
    lots[2] += [(0, 999, START - timedelta(days=1), "/start", None)]
    lots.append([(-1, 0, datetime(2030, 1, 1), None, None)])
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, dialogue.MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(dialogue.MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = streams.to_table(dialogue.registrations_stream(stream, "20 minutes", IDLE), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert got(out.filter(F.col("chat_id") >= 0)) == fold(rows, datetime(2029, 1, 1))


class Store:
    """A chat's state and timers, which counts the calls."""

    def __init__(self):
        self.rows, self.value, self.calls, self.timers = [], None, 0, []

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):
        self.timers.append(at)


class Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_calls_to_the_store_do_not_follow_the_messages():
    """Messages of a batch are added in one call and taken in another, the last of those with the same time and number."""
    waiting, talk = Store(), Store()
    talk.get, talk.update = lambda: None, lambda row: talk.timers.append(row)
    chat = dialogue.Registration(IDLE)
    chat.handle, chat.waiting, chat.state = waiting, waiting, talk
    texts = ["/start", *[f"a{i}" for i in range(300)]]
    frame = pd.DataFrame({"message_id": range(301), "ts": [START + timedelta(seconds=i) for i in range(301)], "text": texts, "mime_type": [None] * 301})
    at = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    list(chat.handleInputRows((1,), iter([frame, frame.assign(text="again").tail(1)]), Times(at - 1)))
    list(chat.handleExpiredTimer((1,), Times(at + 200_000), Times(at + 200_000)))
    assert waiting.calls == 3 and len(waiting.rows) == 100 and waiting.rows[-1][2] == "again"
    assert talk.timers[0][0] == '["a0", "a1", "a2", "a3"]'
