"""Keyed state machines of streams: packing, shuffling, splitting and rollouts, whose state has a fixed bound.

A row without a key (``id`` null) is an end marker: it ends its shard's input, and what waits is given
out.  Numbers of rows travel as text: pandas makes doubles of whole numbers where there are nulls, and
large ids would change.  In time mode "None" streams end by such markers only; with ``idle`` milliseconds a timer does the
same once a shard has had no rows for so long, and with ``keep`` milliseconds unused state is forgotten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loom.operators.sequential import pack, rollout_step

#: Rows of a shuffled batch that are tuples at a time.
PART_ROWS = 10_000


def plain(value):
    """A number as Python's, missing as None: what state stores take."""
    return None if value is None or value is pd.NaT or value != value else value.item() if hasattr(value, "item") else value


class Waiting(StatefulProcessor):
    """A processor that holds rows of a shard until there are enough of them, a marker comes, or a timer runs out."""

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def later(self, timers) -> None:
        """Puts the timer off, now that rows have come."""
        if self.idle:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def close(self) -> None:
        pass


class Packing(Waiting):
    """Packs rows when ``interval`` of them have come since the last time; the last bin goes back and waits with the next ones."""

    def __init__(self, shard: str, key: str, length: str, most: int, interval: int, idle: int | None = None) -> None:
        super().__init__(idle)
        self.names, self.length, self.most, self.interval = (shard, key, "bin"), length, most, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows, self.counts = handle.getListState("waiting", "id long, length long"), handle.getValueState("counts", "fresh int, done int")

    def _step(self, shard, new: list[tuple[int, int]], end: bool) -> pd.DataFrame:
        fresh, done = self.counts.get() if self.counts.exists() else (0, 0)
        waiting = [(int(k), int(n)) for k, n in self.rows.get()] if self.rows.exists() else []
        out, at = [], 0
        while at < len(new) or end:
            took = new[at : at + self.interval - fresh]
            waiting, fresh, at = waiting + took, fresh + len(took), at + len(took)
            last = end and at >= len(new)
            if fresh < self.interval and not last:
                break
            bins = pack([n for _, n in waiting], self.most)
            keep = max(bins, default=0) if not last else max(bins, default=-1) + 1
            out += [(shard, k, done + b) for (k, _), b in zip(waiting, bins, strict=True) if b < keep]
            waiting, done, fresh = [w for w, b in zip(waiting, bins, strict=True) if b >= keep], done + keep, 0
            if last:
                break
        if waiting:
            self.rows.put(waiting)
        elif self.rows.exists():
            self.rows.clear()
        self.counts.update((fresh, done))
        return pd.DataFrame(out, columns=list(self.names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """Rows of a batch are taken by their ids."""
        shard, name, _ = self.names
        given = pd.concat([pdf[[name, self.length]] for pdf in rows])
        new = given.dropna(subset=[name])
        self.later(timers)
        rows = sorted(zip(new[name].astype(int).tolist(), new[self.length].fillna(0).astype(int).tolist(), strict=True))
        yield self._step(plain(key[0]), rows, bool(given[name].isna().any()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(plain(key[0]), [], True)


def draw(seed: int, shard, n: int, most: int) -> int:
    """A number below ``most`` that seed, shard and n decide."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{shard}:{n}".encode(), digest_size=8).digest(), "big") % most


class Shuffling(Waiting):
    """One row in, one row out: a full buffer gives the row at a drawn place and keeps the new one there; the end gives the rest, shuffled."""

    def __init__(self, columns: list[str], state: str, key: str, whole: bool, buffer: int, seed: int, idle: int | None = None) -> None:
        """whole: keys are whole numbers, as text."""
        super().__init__(idle)
        self.columns, self.state, self.key, self.whole, self.buffer, self.seed = columns, state, key, whole, buffer, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held, self.seen = handle.getListState("held", self.state), handle.getValueState("seen", "seen long, given long")

    def _step(self, shard, parts: Iterable[list[tuple]], end: bool) -> Iterator[pd.DataFrame]:
        """What each part gives out, then what the end does: no more than a part's rows are held twice."""
        seen, given = self.seen.get() if self.seen.exists() else (0, 0)
        held = [tuple(map(plain, r)) for r in self.held.get()] if self.held.exists() else []
        for new in parts:
            out = []
            for row in new:
                if len(held) < self.buffer:
                    held.append(row)
                else:
                    at = draw(self.seed, shard, seen, self.buffer)
                    out.append(held[at])
                    held[at] = row
                seen += 1
            yield self._placed(out, given)
            given += len(out)
        out = []
        while end and held:
            out.append(held.pop(draw(self.seed, shard, seen + len(held), len(held))))
        if held:
            self.held.put(held)
        elif self.held.exists():
            self.held.clear()
        self.seen.update((seen, given + len(out)))
        yield self._placed(out, given)

    def _placed(self, rows: list[tuple], given: int) -> pd.DataFrame:
        return pd.DataFrame([(*row, given + i) for i, row in enumerate(rows)], columns=[*self.columns, "at"], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """Rows of a batch are taken by their keys, and become tuples PART_ROWS at a time."""
        new = pd.concat([pdf[self.columns] for pdf in rows], ignore_index=True)
        known = new[self.key].notna().to_numpy()
        at = np.flatnonzero(known)
        keys = new[self.key].iloc[at]
        order = at[(keys.astype("int64") if self.whole else keys).argsort(kind="stable").to_numpy()]
        self.later(timers)
        parts = ([tuple(map(plain, r)) for r in new.iloc[order[a : a + PART_ROWS]].astype(object).itertuples(index=False)] for a in range(0, len(order), PART_ROWS))
        yield from self._step(plain(key[0]), parts, not known.all())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(plain(key[0]), [], True)


class Splitting(StatefulProcessor):
    """The first ``val`` rows of a shard are "val", those up to ``sample`` "train"; more are left out.  The state is a count."""

    def __init__(self, columns: list[str], key: str, whole: bool, val: int, sample: int) -> None:
        self.columns, self.key, self.whole, self.val, self.sample = columns, key, whole, val, sample

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        if n < self.sample:
            new = pd.concat(list(rows))[self.columns].dropna(subset=[self.key]).sort_values(self.key, key=(lambda k: k.astype(int)) if self.whole else None)
            self.count.update((n + len(new),))
            new = new.iloc[: self.sample - n]
            yield new.assign(part=["val" if n + i < self.val else "train" for i in range(len(new))])

    def close(self) -> None:
        pass


class Rollouts(StatefulProcessor):
    """Folds a request's outputs in the order of ``place`` (0, 1, ...); those that come early wait, and after ``most`` none counts.

    State: the fold (next place, rounds, how it ended), accepted segments, early outputs: at most ``most`` of each.
    """

    FIELDS = ("reason", "start", "end", "duration")

    def __init__(self, request: str, place: str, threshold: float, most: int, keep: int | None = None) -> None:
        self.request, self.place, self.threshold, self.most, self.keep = request, place, threshold, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", "rounds int, finish string", self.keep)
        self.used = handle.getListState("used", "start double, end double", self.keep)
        self.early = handle.getMapState("early", "place long", "reason string, start double, end double, duration double", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rounds, finish = self.fold.get() if self.fold.exists() else (0, "open")
        used = [(float(a), float(b)) for a, b in self.used.get()] if self.used.exists() else []
        early = {int(k[0]): tuple(v) for k, v in self.early.iterator()} if finish == "open" and self.early.exists() else {}
        for pdf in rows:
            for place, *output in pdf[[self.place, *self.FIELDS]].astype(object).itertuples(index=False):
                if rounds <= int(place) < self.most:
                    early.setdefault(int(place), tuple(map(plain, output)))
        while finish == "open" and rounds in early:
            finish = rollout_step(used, dict(zip(self.FIELDS, early.pop(rounds), strict=True)), rounds + 1, self.threshold, self.most) or "open"
            rounds += 1
        self.fold.update((rounds, finish))
        if used:
            self.used.put(used)
        if self.early.exists():
            self.early.clear()
        for place, output in early.items() if finish == "open" else ():
            self.early.updateValue((place,), output)
        yield pd.DataFrame([(plain(key[0]), rounds, len(used), finish)], columns=[self.request, "rounds", "segments", "finish"])

    def close(self) -> None:
        pass
