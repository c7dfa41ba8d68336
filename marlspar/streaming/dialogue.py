"""The registration dialogue: five answers a chat, in order, over a stream of messages or a table of them.

/start begins a dialogue, also within one; /cancel ends it. The next four texts
are name, phone number, email and years of experience; then the first PDF
completes it, and whatever else comes is asked for again. ``/edit field value``
corrects an answer that has been given. A dialogue in which nothing comes for
IDLE is given up. Messages outside of one are ignored.

A message counts by its time, ties by its number. The stream holds messages back
until the watermark has passed them, so those that come late, but within the
bound, are taken in their order; later ones are dropped, as are repeated numbers.
What the stream gives out to the end is what ``registrations`` gives for a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlspar.session import ship

FIELDS = ("full_name", "phone_number", "email", "years_of_experience")
IDLE = 24 * 3600
PDF = "application/pdf"

MESSAGE = "chat_id long, message_id long, ts timestamp, text string, mime_type string"
RESULT = "chat_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", resume string, status string, ts timestamp"

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Dialogue:
    """One chat's dialogue; ``heard`` gives (status, answers, resume) when a message ends it."""

    def __init__(self, answers: list[str] | None = None, last: float | None = None):
        self.answers, self.last = answers, last

    def given_up(self, now: float, idle: float) -> list[str] | None:
        """The answers of a dialogue in which nothing has come for too long."""
        if self.answers is None or now - self.last <= idle:
            return None
        answers, self.answers = self.answers, None
        return answers

    def heard(self, now: float, text: str | None, mime_type: str | None) -> tuple[str, list[str], str | None] | None:
        words = (text or "").split(" ", 2)
        done = None
        if words[0] == "/start":
            self.answers = []
        elif self.answers is None:
            return None
        elif words[0] == "/cancel":
            done = ("cancelled", self.answers, None)
        elif words[0] == "/edit":
            if len(words) == 3 and words[1] in FIELDS[: len(self.answers)]:
                self.answers[FIELDS.index(words[1])] = words[2]
        elif len(self.answers) < len(FIELDS):
            if text is not None and mime_type is None:
                self.answers.append(text)
        elif mime_type == PDF:
            done = ("registered", self.answers, text)
        self.last = now
        if done:
            self.answers = None
        return done


def _row(chat: int, status: str, answers: list[str], resume: str | None, at: pd.Timestamp) -> tuple:
    return (chat, *answers, *[None] * (len(FIELDS) - len(answers)), resume, status, at)


_COLUMNS = ["chat_id", *FIELDS, "resume", "status", "ts"]


class Registration(StatefulProcessor):
    """State of a chat: the messages that the watermark hasn't passed, the dialogue, and the numbers seen at the time of the last message taken."""

    def __init__(self, idle: float = IDLE):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, message_id long, text string, mime_type string")
        self.state = handle.getValueState("dialogue", "answers string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A call to the store costs more than a message, so all that came is added at once.
        passed, came = timerValues.getCurrentWatermarkInMs() * 1000, []
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            came += [x for x in zip(times.tolist(), frame["message_id"].tolist(), frame["text"], frame["mime_type"]) if x[0] > passed]
        if came:
            self.waiting.appendList(came)
            self._wake(min(x[0] for x in came))
        yield pd.DataFrame(columns=_COLUMNS)

    def _wake(self, at: int | None) -> None:
        """Come back when the watermark has passed a time in microseconds."""
        if at is not None:
            self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is there, so it is taken at once.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = self.state.get()
        answers, last = (json.loads(held[0]), held[1]) if held else (None, None)
        talk, out = Dialogue(answers, last), []

        def give_up(at: int) -> None:
            if (lost := talk.given_up(at, self.idle * 1e6)) is not None:
                out.append(_row(key[0], "given up", lost, None, pd.Timestamp(talk.last, unit="us")))

        waiting = {(at, number): (text, mime) for at, number, text, mime in self.waiting.get()}  # of the same message, the last
        later = sorted(place for place in waiting if place[0] > now)
        for at, number in sorted(waiting.keys() - later):
            text, mime = waiting[at, number]
            give_up(at)
            if done := talk.heard(at, text, mime):
                out.append(_row(key[0], *done, pd.Timestamp(at, unit="us")))
        if later:
            self.waiting.put([(*place, *waiting[place]) for place in later])
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        give_up(now)
        if talk.answers is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(talk.answers), talk.last))
            self._wake(int(talk.last + self.idle * 1e6))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def registrations_stream(messages: DataFrame, late: str = "10 minutes", idle: float = IDLE) -> DataFrame:
    """messages: a stream of MESSAGE. Rows as those of ``registrations``, when the watermark has passed them."""
    ship(messages.sparkSession)
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what timers and maps need
    keyed = messages.withWatermark("ts", late).groupBy("chat_id")
    return keyed.transformWithStateInPandas(Registration(idle), RESULT, "Append", "EventTime")


def registrations(messages: DataFrame, idle: float = IDLE, until: str | None = None) -> DataFrame:
    """messages: a table of MESSAGE. A row for each dialogue that has ended: its answers, resume (the text of the PDF's message), status and time.

    status: registered, cancelled, or given up (the time is that of the last
    message). A dialogue that is begun anew leaves no row. The messages of a chat
    meet in one task, which may spill them. until: a time up to
    which idle dialogues are known to be given up; by default only messages tell.
    """
    order = [F.col("ts"), F.col("message_id")]
    chat = Window.partitionBy("chat_id").orderBy(*order)
    rows = messages.dropDuplicates(["chat_id", "ts", "message_id"])
    word = F.split(F.coalesce("text", F.lit("")), " ", 3)
    rows = rows.withColumns({"command": word[0], "field": F.get(word, F.lit(1)), "value": F.get(word, F.lit(2))})
    gap = F.col("ts").cast("double") - F.lag("ts").over(chat).cast("double") > idle
    rows = rows.withColumn("next", F.coalesce(F.lead("ts").over(chat), F.lit(until).cast("timestamp")))
    rows = rows.withColumn("cut", F.coalesce(gap, F.lit(False))).withColumn("starts", F.col("command") == "/start")
    # A dialogue is what follows a /start, up to the next one or to a pause; what follows a pause otherwise is none.
    rows = rows.withColumn("talk", F.sum((F.col("starts") | F.col("cut")).cast("int")).over(chat))
    talk = Window.partitionBy("chat_id", "talk").orderBy(*order)
    rows = rows.withColumn("opened", F.first("starts").over(talk)).filter("opened")
    plain = ~F.col("command").isin("/start", "/cancel", "/edit")
    answer = plain & F.col("text").isNotNull() & F.col("mime_type").isNull()
    rows = rows.withColumn("answers", F.least(F.lit(len(FIELDS)), F.sum(answer.cast("int")).over(talk)))
    given = F.coalesce(F.lag("answers").over(talk), F.lit(0))
    ends = F.when(F.col("command") == "/cancel", "cancelled").when(plain & (given == len(FIELDS)) & (F.col("mime_type") == PDF), "registered")
    rows = rows.withColumn("given", given).withColumn("ends", ends)
    ended = F.coalesce(F.max(F.when(F.col("ends").isNotNull(), 1)).over(talk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("ended", ended).filter("ended = 0")
    place = F.struct(*order)

    def field(i: int, name: str):
        first = (F.col("answers") == i + 1) & (F.col("given") == i)
        edits = (F.col("command") == "/edit") & (F.col("field") == name) & F.col("value").isNotNull() & (F.col("given") > i)
        return F.max_by(F.when(edits, F.col("value")).otherwise(F.col("text")), F.when(first | edits, place)).alias(name)

    found = rows.groupBy("chat_id", "talk").agg(
        *[field(i, f) for i, f in enumerate(FIELDS)],
        F.max(F.when(F.col("ends") == "registered", F.col("text"))).alias("resume"), F.max("ends").alias("ends"), F.max("ts").alias("ts"), F.max_by("next", place).alias("next"),
    )
    status = F.coalesce("ends", F.when(F.col("next").cast("double") - F.col("ts").cast("double") > idle, "given up"))
    return found.withColumn("status", status).filter("status IS NOT NULL").select("chat_id", *FIELDS, "resume", "status", "ts")
