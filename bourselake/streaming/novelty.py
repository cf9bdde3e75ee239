"""Novelty of announcements as they come: each key keeps what it has said within the window, and nothing older."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..functions import rules

OUT = "id long, is_novel boolean, novelty double"
_DAY_MS = 86_400_000
#: Rows that are handed on at once.
_CHUNK = 5_000
#: Days whose rows wait together, and rows that are held before they are put to those that wait.
_BLOCK, _HELD = 32, 50_000


def _alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class Novelty(StatefulProcessor):
    """Rows of a key, in order of (day, id), against those before them within so many days.

    A row waits in a map by block of days until the watermark has passed its day; an event-time timer then takes the days in order. So the result
    does not depend on how rows are cut into Arrow batches or micro-batches, as long as none comes later than the watermark's delay. What has been
    said is a map by day: of each day the different word sets, each with its first id, which is all that a later row can be
    compared with. While days are taken, those that fall out of the window go: one block of rows and one window of word sets are held.
    Each step to the state costs as much as many rows, so steps go by blocks and by so many rows, not by days and Arrow batches.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a row's words are a place in texts, as few are different
        self.waiting = handle.getMapState("waiting", "block int", "days array<int>, ids array<long>, fixed array<double>, words array<int>, texts array<string>")
        self.said = handle.getMapState("said", "day int", "ids array<long>, words array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least, held = None, []
        for batch in rows:
            held.append(batch[batch.id.notna()])
            if sum(map(len, held)) >= _HELD:
                least, held = self._waits(held, least), []
        if held:
            least = self._waits(held, least)
        if least is not None:
            self.handle.registerTimer((least + 1) * _DAY_MS)
        return iter(())

    def _waits(self, held: list[pd.DataFrame], least: int | None) -> int | None:
        """Puts rows to those of their blocks; the least day so far."""
        rows = pd.concat(held)
        for block, some in rows.groupby(rows.day.astype("int64") // _BLOCK):
            at = (int(block),)
            days, ids, fixed, words, texts = self.waiting.getValue(at) or ([], [], [], [], [])
            place = {t: i for i, t in enumerate(texts)}
            words = [*words, *(place.setdefault(t, len(place)) for t in some.words.tolist())]
            self.waiting.updateValue(at, ([*days, *some.day.astype("int64").tolist()], [*ids, *some.id.astype("int64").tolist()], [*fixed, *some.fixed.tolist()], words, list(place)))
        return least if rows.empty else int(rows.day.min()) if least is None else min(int(rows.day.min()), least)

    def _due(self, passed: int) -> Iterator[tuple[int, list[tuple]]]:
        """Each day before passed with its rows in order of their ids; they leave the state. The timer is set to the first day that stays."""
        stays = None
        for block in sorted(int(k[0]) for k in self.waiting.keys()) if self.waiting.exists() else []:
            if block * _BLOCK >= passed:
                stays = block * _BLOCK if stays is None else stays
                break
            days, ids, fixed, words, texts = self.waiting.getValue((block,))
            rows = sorted(zip(days, ids, words, fixed, strict=True), key=lambda r: r[:2])
            at = bisect_left(rows, passed, key=lambda r: r[0])
            for day, some in groupby(rows[:at], key=lambda r: r[0]):
                yield int(day), [(i, texts[w], x) for _, i, w, x in some]
            if at == len(rows):
                self.waiting.removeKey((block,))
                continue
            stays = int(rows[at][0])
            if at:
                left = rows[at:]
                self.waiting.updateValue((block,), ([r[0] for r in left], [r[1] for r in left], [r[3] for r in left], [r[2] for r in left], texts))
        if stays is not None:
            self.handle.registerTimer((stays + 1) * _DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, kept, taken, out = None, set(), set(), []
        for day, rows in self._due(timerValues.getCurrentWatermarkInMs() // _DAY_MS):
            if window is None:
                window = {}
                for at, (ids, words) in list(self.said.iterator()) if self.said.exists() else []:
                    window[int(at[0])] = [(int(i), set(w.split())) for i, w in zip(ids, words, strict=True)]
                kept = set(window)
            window = {d: s for d, s in sorted(window.items()) if d >= day - self.days}
            taken.add(day)
            for row in self._day(day, rows, window):
                out.append(row)
                if len(out) >= _CHUNK:
                    yield pd.DataFrame(out, columns=["id", "is_novel", "novelty"])
                    out = []
        if window is None:
            return
        for day in kept - set(window):
            self.said.removeKey((day,))
        for day in taken & set(window):
            self.said.updateValue((day,), ([i for i, _ in window[day]], [" ".join(sorted(w)) for _, w in window[day]]))
        if out:
            yield pd.DataFrame(out, columns=["id", "is_novel", "novelty"])

    @staticmethod
    def _day(day: int, rows: list[tuple], window: dict[int, list[tuple[int, set[str]]]]) -> Iterator[tuple[int, bool, float]]:
        """The day's rows in order of their ids; the window takes the word sets that are new on that day."""
        found: dict[str, float | None] = {}
        for i, text, fixed in rows:
            some = bool(window)
            if text in found:
                alike = found[text]
            else:
                words = set(text.split())
                alike = next((x for said in window.values() for _, s in said if (x := _alike(words, s)) > 0.6), None)
                today = window.setdefault(day, [])
                if all(s != words for _, s in today):
                    today.append((int(i), words))
                # sets come behind those before them, so a later row finds the same one, or this row where it is the first
                found[text] = 1.0 if alike is None and words else alike
            if not math.isnan(fixed):
                score = fixed
            elif alike is not None:
                score = math.floor((1 - alike) * 100 + 0.5) / 100
            else:
                score = 0.65 if some else 0.95
            yield int(i), bool(math.isnan(fixed) and alike is None), float(score)

    def close(self) -> None:
        pass


def novelty(stream: DataFrame, days: int = 30, delay: str = "0 days") -> DataFrame:
    """id, is_novel, novelty of a stream of id, symbol, subject, details, day. Recurring subjects and repeat words have fixed scores.

    A day's rows come out when rows have come that are later by more than the delay; rows that come later than that are dropped. A row without
    an id has no result but moves the time on: closing_row() makes one that lets a whole feed out. A null day has no order: such rows are left out.
    """
    repeated = F.concat_ws(" ", "subject", "details").rlike("(?i)" + rules.REPEATED)
    fixed = F.when(F.col("subject").isin(rules.RECURRING_SUBJECTS), 0.1).when(repeated, 0.2)
    day = F.unix_date(F.col("day"))
    rows = stream.where("day is not null").select(F.timestamp_seconds(day.cast("long") * 86400).alias("ts"), F.concat_ws("\u0001", "symbol", "subject").alias("key"), "id", day.alias("day"), F.coalesce(F.array_join(C.words(F.col("details")), " "), F.lit("")).alias("words"), F.coalesce(fixed, F.lit(float("nan"))).alias("fixed"))
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Novelty(days), OUT, "Append", "EventTime")


def closing_row(feed: DataFrame, delay_days: int = 0) -> DataFrame:
    """One row of feed's columns without an id, so late that every row before it comes out."""
    last = feed.agg(F.max("day").alias("day"))
    of = {f.name: f.dataType for f in feed.schema.fields}
    return last.where("day is not null").select(*(F.date_add("day", delay_days + 2).alias("day") if c == "day" else F.lit(None).cast(k).alias(c) for c, k in of.items()))
