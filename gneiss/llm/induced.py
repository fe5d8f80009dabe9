"""External induced suffix sorting with common prefixes.

Suffixes are sorted by recursive induction: the suffixes that begin with a local
minimum (seeds) are ordered first, by naming the pieces between them and, where
names repeat, by sorting the string of names in the same way; seeds then induce
the larger (L) suffixes and those the smaller (S) ones.  Inducing goes through
priority queues of suffix tuples (symbol, kind, turn, position, common prefix).
A queue holds ``memory`` tuples and spills sorted runs to the task's own scratch
folder, merging them when there are RUNS; text, types, names and the last turn of
each symbol beyond ``memory`` are memory-mapped files, so a shard may be far larger
than memory.  Levels of the recursion that fit in
``memory`` order their seeds by a plain sort of the pieces, larger ones by
induction; both give the same order.  The folder is removed at the end.

The common prefix of an induced suffix with its neighbour is one more than the
smallest common prefix passed since the last suffix induced into the same
symbol; where kinds or seeds meet, it is read off the text.
"""

from __future__ import annotations

import heapq
import mmap
import os
import tempfile
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

BLOCK = 4096
#: Runs of a queue that are open at once.
RUNS = 64


class DiskQueue:
    """A priority queue of equally long tuples of integers that spills sorted runs to disk."""

    def __init__(self, folder: str, memory: int, width: int):
        self.folder, self.memory, self.width = folder, max(2, memory), width
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self.spill()

    def extend(self, rows: np.ndarray) -> None:
        """All rows of a table, as sorted runs of at most ``memory`` rows."""
        for at in range(0, len(rows), self.memory):
            part = rows[at : at + self.memory]
            self.write(part[np.lexsort(part.T[::-1])])

    def spill(self) -> None:
        self.write(np.array(sorted(self.heap), np.int64))
        self.heap = []

    def write(self, rows: np.ndarray) -> None:
        self.open(_written(self.folder, [rows.astype(np.int64)]))
        if len(self.runs) >= RUNS:
            path = _written(self.folder, _tables(self.merged()))
            self.runs, self.heads = [], []
            self.open(path)

    def open(self, path: str) -> None:
        self.runs.append(_read(path, self.width, block=max(16, self.memory // RUNS)))
        self.advance(len(self.runs) - 1)

    def merged(self) -> Iterator[tuple]:
        """What is left of all runs, in order."""
        while self.heads:
            item, run = heapq.heappop(self.heads)
            self.advance(run)
            yield item

    def advance(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item, run))

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heapq.heappop(self.heads)
            self.advance(run)
            return item
        return heapq.heappop(self.heap)


class BucketQueue:
    """A priority queue of (symbol, position, common prefix), first in first out within a symbol.

    Suffixes are induced into a symbol in their order, so a heap of the symbols
    over a queue for each is enough.  Beyond ``memory`` entries all that is held
    goes to disk as a run in symbol order; earlier runs come before later ones.
    """

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held = folder, max(2, memory), 0
        self.queues: dict[int, deque] = {}
        self.symbols: list[int] = []
        self.heads: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, symbol: int, position: int, common: int) -> None:
        queue = self.queues.get(symbol)
        if queue is None:
            queue = self.queues[symbol] = deque()
            heapq.heappush(self.symbols, symbol)
        queue.append((position, common))
        self.held += 1
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        rows = [(s, p, c) for s in sorted(self.queues) for p, c in self.queues[s]]
        self.queues, self.symbols, self.held = {}, [], 0
        self.open(_written(self.folder, [np.array(rows, np.int64)]))
        if len(self.runs) >= RUNS:
            path = _written(self.folder, _tables(self.merged()))
            self.runs, self.heads = [], []
            self.open(path)

    def open(self, path: str) -> None:
        self.runs.append(_read(path, 3, block=max(16, self.memory // RUNS)))
        self.advance(len(self.runs) - 1)

    def merged(self) -> Iterator[tuple]:
        """What is left of all runs, by symbol and then by run."""
        while self.heads:
            symbol, run, position, common = heapq.heappop(self.heads)
            self.advance(run)
            yield symbol, position, common

    def advance(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item[0], run, item[1], item[2]))

    def first(self) -> int | None:
        """The smallest symbol held."""
        if not self.heads:
            return self.symbols[0] if self.symbols else None
        return min(self.heads[0][0], self.symbols[0]) if self.symbols else self.heads[0][0]

    def pop(self) -> tuple[int, int]:
        if self.heads and (not self.symbols or self.heads[0][0] <= self.symbols[0]):
            _, run, position, common = heapq.heappop(self.heads)
            self.advance(run)
            return position, common
        queue = self.queues[self.symbols[0]]
        item = queue.popleft()
        self.held -= 1
        if not queue:
            del self.queues[heapq.heappop(self.symbols)]
        return item


def _written(folder: str, tables: Iterable[np.ndarray]) -> str:
    """A new file with the rows of some tables."""
    number, path = tempfile.mkstemp(dir=folder)
    with os.fdopen(number, "wb") as f:
        for table in tables:
            table.tofile(f)
    return path


def _tables(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
    while block := list(islice(rows, BLOCK)):
        yield np.array(block, np.int64)


def _read(path: str, width: int, backwards: bool = False, block: int = BLOCK) -> Iterator[tuple]:
    rows = os.path.getsize(path) // (8 * width)
    starts = range(0, rows, block)
    with open(path, "rb") as f:
        for at in reversed(starts) if backwards else starts:
            f.seek(at * 8 * width)
            part = np.fromfile(f, np.int64, min(block, rows - at) * width).reshape(-1, width)
            yield from map(tuple, (part[::-1] if backwards else part).tolist())
    os.unlink(path)


class DiskList:
    """An append-only list of tuples, read once from either end."""

    def __init__(self, folder: str, memory: int, width: int):
        self.folder, self.memory, self.width, self.path = folder, memory, width, None
        self.held: list[tuple] = []

    def append(self, item: tuple) -> None:
        self.held.append(item)
        if len(self.held) > self.memory:
            self.flush()

    def flush(self) -> None:
        if self.path is None:
            number, self.path = tempfile.mkstemp(dir=self.folder)
            os.close(number)
        with open(self.path, "ab") as f:
            np.array(self.held, np.int64).tofile(f)
        self.held = []

    def read(self, backwards: bool = False) -> Iterator[tuple]:
        if self.path is None:
            yield from reversed(self.held) if backwards else self.held
        else:
            if self.held:
                self.flush()
            yield from _read(self.path, self.width, backwards)


class _Passed:
    """Smallest common prefix among those passed since a turn."""

    def __init__(self):
        self.turns: list[int] = []
        self.values: list[int] = []

    def add(self, turn: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.turns.pop()
            self.values.pop()
        self.turns.append(turn)
        self.values.append(value)

    def least_since(self, turn: int) -> int:
        return self.values[bisect_left(self.turns, turn + 1)]


def _common(text, a: int, b: int) -> int:
    n = 0
    while text[a + n] == text[b + n]:
        n += 1
    return n


class _LastTurns:
    """The turn in which each symbol was last induced into, from 1; symbols below zero stand once and have none."""

    def __init__(self, space):
        self.space = space

    def replaced(self, symbol: int, turn: int) -> int:
        """The turn before, 0 if there was none."""
        if symbol < 0:
            return 0
        before = self.space[symbol]
        self.space[symbol] = turn
        return before


class Sorter:
    def __init__(self, folder: str, memory: int = 1 << 20):
        self.folder, self.memory = folder, memory
        self.spilled = 0  # levels that went to disk

    def space(self, size: int, width: int = 8):
        """Room for integers (width 8) or bytes (width 1); beyond ``memory`` it is a mapped file."""
        if size <= self.memory:
            return [0] * size if width == 8 else bytearray(size)
        self.spilled += width == 8
        number, path = tempfile.mkstemp(dir=self.folder)
        os.truncate(path, size * width)
        view = memoryview(mmap.mmap(number, size * width))
        os.close(number)
        os.unlink(path)
        return view.cast("q") if width == 8 else view

    def suffixes(self, symbols: Iterable[int], size: int) -> Iterator[tuple[int, int]]:
        """(position, common prefix with the one before) of all suffixes, largest first.

        The last symbol must be smaller than all others.
        """
        text = self.space(size)
        for n, s in enumerate(symbols):
            text[n] = s
        return self._sorted(text, size)

    def suffixes_of_file(self, path: str, size: int) -> Iterator[tuple[int, int]]:
        """As suffixes, of a file of 64-bit integers, which is mapped."""
        with open(path, "rb") as f:
            view = memoryview(mmap.mmap(f.fileno(), size * 8, access=mmap.ACCESS_READ)).cast("q")
        return self._sorted(view.tolist() if size <= self.memory else view, size)

    def _types(self, text, size: int):
        """1 for each suffix that is smaller than the one after it, else 0; block by block from the end."""
        small, after = self.space(size, 1), 1
        small[size - 1] = 1
        for past in range(size - 1, 0, -self.memory):
            low = max(0, past - self.memory)
            step = np.diff(np.array(text[low : past + 1], np.int64))
            at = np.where(step != 0, np.arange(len(step)), len(step))
            at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
            found = np.append(step > 0, bool(after))[at].astype(np.uint8)
            small[low:past] = found.tobytes()
            after = int(found[0])
        return small

    def _seeds(self, text, small, size: int) -> Iterator[np.ndarray]:
        """(symbol, position) of the seeds, by position."""
        for low in range(1, size, self.memory):
            past = min(size, low + self.memory)
            kind = np.frombuffer(small[low - 1 : past], np.uint8)
            at = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 0))
            yield np.stack([np.array(text[low:past], np.int64)[at], at + low], axis=1)

    def _sorted(self, text, size: int) -> Iterator[tuple[int, int]]:
        small = self._types(text, size)

        def is_seed(i):
            return i > 0 and small[i] and not small[i - 1]

        found = (rows for rows in self._seeds(text, small, size) if len(rows))
        rows = next(found, None)
        if rows is None:
            seeds = DiskList(self.folder, self.memory, 2)
            seeds.append((size - 1, 0))
            yield from self._induce(text, small, seeds.read(), True)
            return
        order = DiskList(self.folder, self.memory, 1)  # largest first
        if size <= self.memory:
            starts = rows[:, 1].tolist()
            # of two pieces one of which begins the other, the longer comes first
            ends = dict(zip(starts, [*starts[1:], size - 1]))
            for i in sorted(starts, key=lambda i: (*text[i : ends[i] + 1], float("inf")), reverse=True):
                order.append((i,))
        else:
            rough = DiskQueue(self.folder, self.memory, 2)
            while rows is not None:
                rough.extend(rows)
                rows = next(found, None)
            for i, _ in self._induce(text, small, _drain(rough), False):
                if is_seed(i):
                    order.append((i,))
        name, last, named = 0, None, DiskQueue(self.folder, self.memory, 2)
        for (i,) in order.read(backwards=True):
            if last is not None and not self._same_piece(text, last, i, is_seed, size):
                name += 1
            named.push((i, name))
            last = i
        count = 0
        places, names = DiskList(self.folder, self.memory, 1), DiskList(self.folder, self.memory, 1)
        sorted_seeds = DiskQueue(self.folder, self.memory, 2)
        while named.peek() is not None:
            i, n = named.pop()
            places.append((i,))
            names.append((n,))
            sorted_seeds.push((n, i))
            count += 1
        if name + 1 < count:  # names repeat: sort the string of names
            place = self.space(count)
            for n, (i,) in enumerate(places.read()):
                place[n] = i
            sorted_seeds = DiskQueue(self.folder, self.memory, 2)
            reduced = self.space(count)
            for n, (x,) in enumerate(names.read()):
                reduced[n] = x
            for turn, (n, _) in enumerate(self._sorted(reduced, count)):
                sorted_seeds.push((-turn, int(place[n])))
        yield from self._induce(text, small, self._with_prefixes(text, sorted_seeds), True)

    def _with_prefixes(self, text, queue: DiskQueue) -> Iterator[tuple[int, int]]:
        last = None
        while queue.peek() is not None:
            i = queue.pop()[1]
            yield i, _common(text, last, i) if last is not None else 0
            last = i

    def _same_piece(self, text, a: int, b: int, is_seed, size: int) -> bool:
        n = 0
        while True:
            if b + n >= size or a + n >= size or text[a + n] != text[b + n]:
                return False
            if n and (is_seed(a + n) or is_seed(b + n)):
                return bool(is_seed(a + n) and is_seed(b + n))
            n += 1

    def _last_turns(self, text, prefixes: bool) -> _LastTurns:
        highest = max((max(text[low : low + self.memory]) for low in range(0, len(text), self.memory)), default=0) if prefixes else 0
        return _LastTurns(self.space(max(0, int(highest)) + 1))

    def _induce(self, text, small, seeds: Iterator[tuple[int, int]], prefixes: bool) -> Iterator[tuple[int, int]]:
        larger = DiskList(self.folder, self.memory, 2)
        self._pass(text, small, seeds, prefixes, larger)
        yield from self._back(text, small, larger.read(backwards=True), prefixes)

    def _pass(self, text, small, seeds, prefixes: bool, larger: DiskList) -> None:
        queue = BucketQueue(self.folder, self.memory)
        passed, last_into = _Passed(), self._last_turns(text, prefixes)
        turn, before, seed = 0, None, next(seeds, None)
        while True:
            top = queue.first()
            if top is None and seed is None:
                return
            if seed is None or (top is not None and top <= text[seed[0]]):
                symbol = top
                i, common = queue.pop()
                larger.append((i, common))
                kind = 0
            else:
                i, common = seed
                symbol, kind = int(text[i]), 1
                seed = next(seeds, None)
                if prefixes and before is not None and before[1] == 0:
                    common = _common(text, before[0], i) if text[before[0]] == symbol else 0
            turn += 1
            if prefixes:
                passed.add(turn, common)
            before = (i, kind)
            if i > 0 and not small[i - 1]:
                into = int(text[i - 1])
                shared = 0
                if prefixes:
                    earlier = last_into.replaced(into, turn)
                    shared = 1 + passed.least_since(earlier) if earlier else 0
                queue.push(into, i - 1, shared)

    def _back(self, text, small, larger, prefixes: bool) -> Iterator[tuple[int, int]]:
        queue = BucketQueue(self.folder, self.memory)  # of negated symbols: the largest first
        passed, last_into = _Passed(), self._last_turns(text, prefixes)
        turn, before, item = 0, None, next(larger, None)
        first = len(text) - 1  # the last suffix induces from nothing
        if small[first]:
            queue.push(-int(text[first]), first, 0)
        while True:
            top = queue.first()
            if top is None and item is None:
                return
            if item is None or (top is not None and -top >= text[item[0]]):
                i, common = queue.pop()
                kind, lower = 1, 0
            else:
                i, lower = item
                kind, common = 0, before[2] if before is not None and before[1] == 0 else 0
                item = next(larger, None)
            if before is not None and before[1] != kind:
                common = _common(text, before[0], i) if prefixes and text[before[0]] == text[i] else 0
            elif before is not None and text[before[0]] != text[i]:
                common = 0
            turn += 1
            if prefixes:
                passed.add(turn, common)
            before = (i, kind, lower)
            yield i, common
            if i > 0 and small[i - 1]:
                into = int(text[i - 1])
                shared = 0
                if prefixes:
                    earlier = last_into.replaced(into, turn)
                    shared = 1 + passed.least_since(earlier) if earlier else 0
                queue.push(-into, i - 1, shared)


def _drain(queue: DiskQueue) -> Iterator[tuple[int, int]]:
    while queue.peek() is not None:
        yield queue.pop()[1], 0
