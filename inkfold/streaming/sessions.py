"""Keyed streaming state: word edits that harden with evidence, and learned patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkfold.functions.edits import diff

EVENT = "session_id string, seq long, kind string, draft string, candidate string, votes int, unanimous boolean"
OPTIONAL = {"at_word": "int", "size": "int"}
OUT = "session_id string, seq long, start int, end int, replacement string"
PATTERN_OUT = "profile_id string, shorthand string, expansion string, trust int"
_FIELDS = ["seq", "kind", "draft", "candidate", "votes", "unanimous", *OPTIONAL]


class Slot:
    """A proposed edit of one place in a draft."""

    __slots__ = ("replacement", "end", "agreements", "looks", "strong", "very_strong", "hardened")

    def __init__(self, end: int, replacement: str) -> None:
        self.replacement, self.end = replacement, end
        self.agreements = self.looks = 0
        self.strong = self.very_strong = self.hardened = False


class EditSession:
    """Evidence of one session. Pure, so that a batch replay and a stream give the same."""

    def __init__(self, slots: dict[int, Slot] | None = None, words: list[str | None] | None = None, frontier: int = 0) -> None:
        self.slots, self.words, self.frontier = slots or {}, words or [], frontier

    def offer(self, draft: str, candidate: str, votes: int, unanimous: bool, at_word: int = 0) -> list[tuple[int, int, str]]:
        """Take one proposal for the draft that begins at a word of the session in; the edits that harden by it.

        The same replacement at a place agrees; another one starts anew; a place within the draft's words for which
        nothing is proposed loses agreement and goes at zero. A hardened place is never reopened. An edit hardens when
        the session has gone two words beyond it, after three agreements, two with strong support, or as many as looks
        with very strong one. How far a session has gone never falls, however short a later draft is.
        """
        typed = draft.split()
        stop = at_word + len(typed)
        self.words += [None] * (stop - len(self.words))
        self.words[at_word:stop] = typed
        self.frontier = max(self.frontier, stop)
        strong, very = votes >= 3 or unanimous, votes >= 4 or unanimous
        edits = {a + at_word: (b + at_word, r) for a, b, r in diff(draft, candidate)}
        for at, (end, replacement) in edits.items():
            slot = self.slots.get(at)
            if slot is not None and slot.hardened:
                slot.looks += 1
                continue
            if slot is None or (slot.end, slot.replacement) != (end, replacement):
                slot = self.slots[at] = Slot(end, replacement)
            slot.agreements += 1
            slot.looks += 1
            slot.strong |= strong
            slot.very_strong |= very
        for at, slot in list(self.slots.items()):
            # an insertion takes up one word here
            if not slot.hardened and at not in edits and at_word <= at and max(slot.end, at + 1) <= stop:
                slot.looks += 1
                slot.agreements -= 1
                if slot.agreements <= 0:
                    del self.slots[at]
        out = []
        for at, slot in sorted(self.slots.items()):
            enough = slot.agreements >= 3 or (slot.agreements >= 2 and slot.strong) or (slot.agreements >= slot.looks and slot.very_strong)
            if not slot.hardened and self.frontier >= slot.end + 2 and enough:
                slot.hardened = True
                out.append((at, slot.end, slot.replacement))
        return out

    def commit(self, start: int, end: int, replacement: str) -> None:
        """The text has taken a replacement in: edits of its words go, and later ones shift by the words gained or lost."""
        new = replacement.split()
        gain = len(new) - (end - start)
        self.words[start:end] = new
        self.frontier = max(0, self.frontier + gain)
        moved = {}
        for at, slot in self.slots.items():
            if max(slot.end, at + 1) <= start:
                moved[at] = slot
            elif at >= end:
                slot.end += gain
                moved[at + gain] = slot
        self.slots = moved

    def text(self, corrected: bool) -> str | None:
        """The session's words, with hardened edits put in if ``corrected``; None where words were never seen."""
        out: list[str | None] = []
        i = 0
        while i < self.frontier:
            slot = self.slots.get(i) if corrected else None
            if slot is not None and slot.hardened:
                out += [slot.replacement] if slot.replacement else []
                if slot.end > i:
                    i = slot.end
                    continue
            out.append(self.words[i] if i < len(self.words) else None)
            i += 1
        return None if None in out else " ".join(w for w in out if w is not None)

    def hardened(self) -> list[tuple[int, int, str, str]]:
        """Hardened edits ``(start, end, original, replacement)``, in order."""
        return [(at, s.end, " ".join(w or "" for w in self.words[at : s.end]), s.replacement) for at, s in sorted(self.slots.items()) if s.hardened]

    def rows(self) -> list[tuple]:
        return [(at, s.end, s.replacement, s.agreements, s.looks, s.strong, s.very_strong, s.hardened) for at, s in self.slots.items()]

    @staticmethod
    def of(rows, words=None, frontier: int = 0) -> EditSession:
        slots = {}
        for at, end, replacement, agreements, looks, strong, very, hardened in rows:
            s = slots[at] = Slot(end, replacement)
            s.agreements, s.looks, s.strong, s.very_strong, s.hardened = agreements, looks, strong, very, hardened
        return EditSession(slots, list(words or []), frontier)


def _number(v, default: int = 0) -> int:
    return default if pd.isna(v) else int(v)


def _step(key: str, e, session: EditSession) -> list[tuple]:
    if e.kind in ("end", "cancel"):
        session.__init__()
    elif e.kind == "offer" and isinstance(e.draft, str):
        candidate = e.candidate if isinstance(e.candidate, str) else e.draft  # none: the text is fine as it is
        got = session.offer(e.draft, candidate, _number(e.votes), e.unanimous is True or e.unanimous == 1, _number(e.at_word))
        return [(key, int(e.seq), a, b, r) for a, b, r in got]
    elif e.kind == "commit" and isinstance(e.candidate, str):
        start = _number(e.at_word)
        session.commit(start, start + _number(e.size), e.candidate)
    return []


def _complete(events: DataFrame) -> DataFrame:
    """Events with all fields; those that a table lacks are null."""
    for name, kind in OPTIONAL.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events.where("session_id is not null and seq is not null").select("session_id", *_FIELDS)


def replay(events: DataFrame) -> DataFrame:
    """Hardened edits of whole sessions, in batch; events of a session in order of ``seq`` and, of equal ones, of their
    other fields; an event that is repeated in all fields counts once.

    Sessions are laid out by key and sequence and read as a stream, one session's evidence in memory at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, EditSession()
        for b in batches:
            out = []
            for e in b.itertuples():
                if e.session_id != key:
                    key, session = e.session_id, EditSession()
                out += _step(key, e, session)
            yield pd.DataFrame(out, columns=["session_id", "seq", "start", "end", "replacement"])

    rows = _complete(events).repartition("session_id").dropDuplicates(["session_id", *_FIELDS]).sortWithinPartitions("session_id", *_FIELDS)
    return rows.mapInPandas(run, OUT)


class EditProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("slots", "at int, end int, replacement string, agreements int, looks int, strong boolean, very_strong boolean, hardened boolean")
        self.past = handle.getValueState("past", "words array<string>, frontier int")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(_FIELDS).drop_duplicates(_FIELDS)
        words, frontier = self.past.get() if self.past.exists() else ([], 0)
        session = EditSession.of(self.state.get() if self.state.exists() else [], words, frontier)
        out = []
        for e in events.itertuples():
            out += _step(key[0], e, session)
        if session.slots:
            self.state.put(session.rows())
        else:
            self.state.clear()
        if session.words:
            self.past.update((session.words, session.frontier))
        else:
            self.past.clear()
        yield pd.DataFrame(out, columns=["session_id", "seq", "start", "end", "replacement"])

    def close(self) -> None:
        pass


def edit_stream(events: DataFrame) -> DataFrame:
    """Hardened edits of a stream of events, append mode; state is kept by session and goes when the session ends."""
    return _complete(events).groupBy("session_id").transformWithStateInPandas(EditProcessor(), OUT, "Append", "None")


class PatternProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pattern", "expansion string, trust int")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts_ms", "pos"])
        expansion, trust = self.state.get() if self.state.exists() else (None, 0)
        for e in events["expansion"]:
            expansion, trust = (expansion, trust + 1) if e == expansion else (e, 1)
        self.state.update((expansion, trust))
        yield pd.DataFrame([(key[0], key[1], expansion, trust)], columns=["profile_id", "shorthand", "expansion", "trust"])

    def close(self) -> None:
        pass


def pattern_stream(pairs: DataFrame) -> DataFrame:
    """Trust in each profile's patterns from a stream of mined pairs (profile_id, ts_ms, pos, shorthand, expansion)."""
    return pairs.groupBy("profile_id", "shorthand").transformWithStateInPandas(PatternProcessor(), PATTERN_OUT, "Update", "None")


def late_counts(events: DataFrame, ts: str, window: str, delay: str, by: list[str]) -> DataFrame:
    """Events of each window and group; what comes later than ``delay`` after the latest is dropped by the watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"))


def bursts(events: DataFrame, ts: str, gap: str, delay: str, by: list[str]) -> DataFrame:
    """Runs of events without a gap; the gap may be a duration or a column."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
