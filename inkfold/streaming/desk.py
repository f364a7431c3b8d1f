"""What a writer is offered and what becomes of it: a queue of offers of each session, and the labels that decisions leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.streaming.sessions import EditSession

EVENT = "session_id string, seq long, kind string, burst_id string, draft string, candidates array<string>, votes array<int>, at_word int, choice int, quiet boolean"
OUT = "session_id string, seq long, outcome string, burst_id string, label string, source string, draft string, committed string"
_ORDER = ["seq", "kind", "burst_id"]


class Desk:
    """One session's offers, pending request and evidence.

    Events: ``request`` names the burst whose answer is awaited; ``result`` brings its candidates, and that of any other
    burst is stale; candidates that are the draft fall out, and none left means that nothing is offered; a ``quiet``
    burst feeds evidence only; an offer takes the place of one whose draft it goes on from, or queues. ``select`` and
    ``dismiss`` decide the first offer, ``apply`` and ``revert`` the hardened edits, ``end`` dismisses what is shown and
    offers the corrected text in whole, ``retract`` takes a burst back, ``cancel`` forgets everything.
    """

    def __init__(self) -> None:
        self.pending: str | None = None
        self.offers: list[tuple[str, str, list[str], int | None, str]] = []  # burst, draft, candidates, at word, source
        self.edits = EditSession()
        self.ended = 0

    def take(self, e) -> list[tuple]:
        """The outcomes ``(outcome, burst, label, source, draft, committed)`` of one event."""
        return getattr(self, f"_{e.kind}", lambda _: [])(e)

    def _request(self, e) -> list[tuple]:
        self.pending = e.burst_id
        return []

    def _result(self, e) -> list[tuple]:
        if e.burst_id != self.pending or not isinstance(e.draft, str):
            return [("stale", e.burst_id, None, None, None, None)]
        self.pending = None
        given = [] if e.candidates is None else list(e.candidates)
        votes = [1] * len(given) if e.votes is None else list(e.votes)
        kept = [(c, v) for c, v in zip(given, votes) if c.strip() != e.draft]
        at = None if pd.isna(e.at_word) else int(e.at_word)
        if at is not None:
            best, n = kept[0] if kept else (e.draft, 0)
            self.edits.offer(e.draft, best, n, bool(kept) and len(given) == 1, at)
        if not kept or (e.quiet is True or e.quiet == 1):
            return [("skipped", e.burst_id, None, None, None, None)]
        offer = (e.burst_id, e.draft, [c for c, _ in kept], at, "confirmed_candidate")
        earlier = next((i for i, o in enumerate(self.offers) if e.draft.startswith(o[1])), None)
        if earlier is None:
            self.offers.append(offer)
        else:
            self.offers[earlier] = offer
        return [("offered", e.burst_id, None, None, e.draft, offer[2][0])]

    def _keep(self, offer) -> list[tuple]:
        burst, draft, candidates, _, _ = offer
        return [("label", burst, "keep", "dismissal", draft, None)] if candidates else []

    def _select(self, e) -> list[tuple]:
        choice = 0 if pd.isna(e.choice) else int(e.choice)
        if not self.offers or not 0 <= choice < len(self.offers[0][2]):
            return []
        burst, draft, candidates, at, source = self.offers.pop(0)
        if at is not None:
            self.edits.commit(at, at + len(draft.split()), candidates[choice])
        return [("label", burst, "replace", source, draft, candidates[choice])]

    def _dismiss(self, e) -> list[tuple]:
        return self._keep(self.offers.pop(0)) if self.offers else []

    def _apply(self, e) -> list[tuple]:
        done = self.edits.hardened()
        for start, end, _, replacement in reversed(done):
            self.edits.commit(start, end, replacement)
        return [("label", f"mark_{start}", "replace", "hardened_edit", was, now) for start, _, was, now in done]

    def _revert(self, e) -> list[tuple]:
        done, self.edits = self.edits.hardened(), EditSession()
        return [("label", f"mark_{start}", "keep", "revert", was, None) for start, _, was, _ in done]

    def _end(self, e) -> list[tuple]:
        out = self._keep(self.offers[0]) if self.offers else []
        before, after, some = self.edits.text(False), self.edits.text(True), bool(self.edits.hardened())
        self.offers, self.pending, self.edits = [], None, EditSession()
        if some and after is not None:
            self.ended += 1
            offer = (f"whole_{self.ended}", before or "", [after], None, "sentence_pass")
            self.offers.append(offer)
            out.append(("offered", offer[0], None, None, offer[1], after))
        return out

    def _cancel(self, e) -> list[tuple]:
        self.__init__()
        return []

    def _retract(self, e) -> list[tuple]:
        self.offers = [o for o in self.offers if o[0] != e.burst_id]
        self.pending = None if self.pending == e.burst_id else self.pending
        return []


def outcomes(events: DataFrame) -> DataFrame:
    """What each event of whole sessions leads to, in batch; events in order of ``seq``, then of kind and burst.

    Sessions are laid out by key and read as a stream, one desk in memory at a time. Events without a session or a
    sequence number are left out; an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, desk = None, Desk()
        for b in batches:
            out = []
            for e in b.itertuples():
                if e.session_id != key:
                    key, desk = e.session_id, Desk()
                out += [(key, int(e.seq), *x) for x in desk.take(e)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    names = [c.split(" ")[0] for c in EVENT.split(", ")]
    rows = events.where("session_id is not null and seq is not null").select(*names)
    return rows.repartition("session_id").sortWithinPartitions("session_id", *_ORDER).mapInPandas(run, OUT)


def labels(events: DataFrame) -> DataFrame:
    """The labels alone, for an append-only sink."""
    return outcomes(events).where(F.col("outcome") == "label").drop("outcome")
