"""External induced suffix sorting with common-prefix values.

A suffix is L if it is larger than the next one, else S; an S after an L is S*. One scan in
ascending order takes the sorted S* suffixes and gives all L suffixes: what it reaches puts the
suffix before it into a priority queue, if its first symbol is larger. The same scan over
complemented symbols takes the L suffixes in falling order and gives all S suffixes. The queue's
priority is the first symbol; within a symbol, order of arrival is the order of the suffixes.
S* suffixes are sorted by the same two scans over their substrings, which are then named; equal
names leave a string of at most half the length, sorted by recursion until all names differ.

Common prefixes are carried along, up to ``depth``: two suffixes induced one after the other
share one symbol more than the least value between their sources. Those of S* suffixes come
from the recursion: the names that two share give the symbols, and only what follows is looked
at, which is less than one substring.

Memory. Whatever is as long as the text is held in parts of the budget and otherwise in files:
queue entries (what is needed last goes first), the L suffixes, the result. They are written and
read in order. Text, S* places and names beyond the budget are mapped files. A symbol whose
entries exceed the budget is passed through in blocks. What stays in memory besides is one
block, or the entries of a range of symbols, which is split until it fits.

A scan handles a range of symbols at once. What the range puts back into itself is followed to
where it started; the symbols passed on the way, with the lengths of runs, are its sort key.
Where such ways are long, only the symbols below the least that is put back are handled, and
then the rest of the range.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

MEMORY = 48 << 20
#: Alphabets with a range for each symbol; ranges for others; parts that a range beyond the budget is split into.
SMALL, RANGES, PARTS = 512, 32, 64
#: Steps that a suffix is followed back inside a range.
STEPS = 10
BLOCK = 1 << 17
Block = tuple[np.ndarray, ...]


class Scratch:
    """Budget and folder of a sort, and what it had to do."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.folder = memory, None
        self.files = self.spills = self.levels = 0

    def path(self) -> str:
        self.folder = self.folder or tempfile.mkdtemp(prefix="induced-")
        self.files += 1
        return os.path.join(self.folder, f"{self.files}.bin")

    def save(self, arrays: Block) -> str:
        path = self.path()
        self.spills += 1
        with open(path, "wb") as f:
            for a in arrays:
                np.save(f, a)
        return path

    @staticmethod
    def load(path: str, n: int, keep: bool = False) -> Block:
        with open(path, "rb") as f:
            out = tuple(np.load(f) for _ in range(n))
        if not keep:
            os.unlink(path)
        return out

    def array(self, n: int, kind) -> np.ndarray:
        """An array of ``n``; a mapped file where it is large."""
        if n * np.dtype(kind).itemsize <= self.memory // 4 or n == 0:
            return np.empty(n, kind)
        return np.lib.format.open_memmap(self.path(), mode="w+", dtype=kind, shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Tape:
    """Blocks appended in order and read forwards or backwards; beyond a share of the budget in files."""

    def __init__(self, scratch: Scratch, share: int = 8):
        self.scratch, self.room = scratch, scratch.memory // share
        self.items: list[Block | str] = []
        self.waiting: list[Block] = []
        self.n = self.waiting_n = self.width = 0

    def append(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.width = len(arrays)
            self.waiting.append(arrays)
            self.n += len(arrays[0])
            self.waiting_n += len(arrays[0])
            if self.waiting_n >= BLOCK:
                self._settle()

    def _settle(self) -> None:
        if self.waiting:
            block = tuple(np.concatenate(c) for c in zip(*self.waiting, strict=True)) if len(self.waiting) > 1 else self.waiting[0]
            size = sum(a.nbytes for a in block)
            if size > self.room:
                self.items.append(self.scratch.save(block))
            else:
                self.room -= size
                self.items.append(block)
            self.waiting, self.waiting_n = [], 0

    def _read(self, items) -> Iterator[Block]:
        for x in items:
            yield self.scratch.load(x, self.width, keep=True) if isinstance(x, str) else x

    def forward(self) -> Iterator[Block]:
        self._settle()
        return self._read(self.items)

    def backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in reverse, each with the common prefix to the one that now stands before it."""
        self._settle()
        ahead = 0
        for at, lcp in self._read(reversed(self.items)):
            out = np.empty_like(lcp)
            out[0], out[1:] = ahead, lcp[:0:-1]
            ahead = lcp[0]
            yield at[::-1], out

    def drop(self) -> None:
        for x in self.items:
            if isinstance(x, str):
                os.unlink(x)
        self.items = []


class BucketQueue:
    """Entries (key, position, common prefix) by ranges of symbols; a key is twice the symbol, plus one for seeds."""

    def __init__(self, sigma: int, scratch: Scratch):
        self.scratch = scratch
        step = 1 if sigma <= SMALL else -(-sigma // RANGES)
        self.edges = [*range(0, sigma, step), sigma]
        n = len(self.edges) - 1
        self.blocks: list[list[Block]] = [[] for _ in range(n)]
        self.files: list[list[str]] = [[] for _ in range(n)]
        self.size = [0] * n
        self.held = 0
        self._marks = 2 * np.array(self.edges)

    def push(self, key: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """``key`` in order."""
        if not len(key):
            return
        cut = np.searchsorted(key, self._marks)
        filled = np.flatnonzero(cut[1:] > cut[:-1])
        for g, a, e in zip(filled.tolist(), cut[filled].tolist(), cut[filled + 1].tolist(), strict=True):
            self.blocks[g].append((key[a:e].copy(), at[a:e].copy(), lcp[a:e].copy()))
            self.size[g] += e - a
        self.held += key.nbytes + at.nbytes + lcp.nbytes
        if self.held > self.scratch.memory // 2:
            self._spill()

    @staticmethod
    def join(blocks: list[Block]) -> Block:
        return blocks[0] if len(blocks) == 1 else tuple(np.concatenate(c) for c in zip(*blocks, strict=True))

    def _spill(self) -> None:
        """Moves the ranges that are needed last to files until a quarter of the budget is left."""
        for g in range(len(self.size) - 1, -1, -1):
            if self.held <= self.scratch.memory // 4:
                return
            if self.blocks[g]:
                block = self.join(self.blocks[g])
                self.files[g].append(self.scratch.save(block))
                self.blocks[g] = []
                self.held -= sum(x.nbytes for x in block)

    def read(self, g: int) -> Iterator[Block]:
        """Blocks of a range in order of arrival; they stay."""
        for path in self.files[g]:
            yield self.scratch.load(path, 3, keep=True)
        yield from self.blocks[g]

    def clear(self, g: int) -> None:
        for path in self.files[g]:
            os.unlink(path)
        self.held -= sum(x.nbytes for b in self.blocks[g] for x in b)
        self.blocks[g], self.files[g], self.size[g] = [], [], 0

    def take(self, g: int) -> Block:
        """All entries of a range in order of key, then arrival."""
        block = self.join(list(self.read(g)))
        self.clear(g)
        order = np.argsort(block[0], kind="stable")
        return tuple(x[order] for x in block)

    def split(self, g: int) -> None:
        """Deals a range to smaller ones, block by block."""
        lo, hi = self.edges[g], self.edges[g + 1]
        step = -(-(hi - lo) // PARTS)
        inner = [*range(lo, hi, step)]
        files, blocks = self.files[g], self.blocks[g]
        self.held -= sum(x.nbytes for b in blocks for x in b)
        self.edges[g : g + 1] = inner
        n = len(inner)
        self.blocks[g : g + 1], self.files[g : g + 1], self.size[g : g + 1] = [[] for _ in range(n)], [[] for _ in range(n)], [0] * n
        self._marks = 2 * np.array(self.edges)
        for path in files:
            self._deal(self.scratch.load(path, 3))
        for b in blocks:
            self._deal(b)

    def _deal(self, block: Block) -> None:
        order = np.argsort(block[0], kind="stable")
        self.push(*(x[order] for x in block))


class RangeMin:
    """Minimum over ranges of an array in memory."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        p = 1
        while 2 * p <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-p], last[p:]))
            p *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of x[lo..hi], both included."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in range(int(k.max()) + 1):
            here = np.flatnonzero(k == level)
            if len(here):
                t = self.levels[level]
                out[here] = np.minimum(t[lo[here]], t[hi[here] - (1 << level) + 1])
        return out


def look(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, ``known`` symbols of which are known, up to ``depth``."""
    out = known.copy()
    live = np.flatnonzero(out < depth)
    n = len(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[text[x] == text[y]]
        out[live] += 1
        live = live[out[live] < depth]
    return out


class Scan:
    """One induction: seeds in order give all suffixes of the other type, in order among the seeds."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, scratch: Scratch, down: bool, sink: Callable):
        self.text, self.sigma, self.depth, self.scratch, self.down, self.sink = text, sigma, depth, scratch, down, sink
        self.queue = BucketQueue(sigma, scratch)
        self.index = np.int32 if len(text) < 1 << 30 else np.int64
        # narrow keys sort faster
        self.key = np.uint16 if sigma < 1 << 15 else np.int32 if sigma < 1 << 29 else np.int64
        self.lcp = np.uint8 if depth < 255 else np.int32
        self.room = max(1, scratch.memory // 8 // 17)

    def symbols(self, at: np.ndarray) -> np.ndarray:
        c = self.text[at].astype(np.int32 if self.sigma < 1 << 30 else np.int64)
        return self.sigma - 1 - c if self.down else c

    def before(self, at: np.ndarray) -> np.ndarray:
        """Symbols before the suffixes; -1 at the text's start."""
        out = self.symbols(at - 1)
        out[at == 0] = -1
        return out

    def run(self, seeds: Iterator[Block]) -> None:
        for at, lcp in seeds:
            key = (2 * self.symbols(at) + 1).astype(self.key)
            order = np.argsort(key, kind="stable")
            self.queue.push(key[order], at[order].astype(self.index), lcp[order].astype(self.lcp))
        g = 0
        while g < len(self.queue.size):
            lo, hi = self.queue.edges[g], self.queue.edges[g + 1]
            if self.queue.size[g] > self.room:
                if hi - lo > 1:
                    self.queue.split(g)
                    continue
                self._stream(g, lo)
            elif self.queue.size[g]:
                self._range(g, hi)
            g += 1

    def _range(self, g: int, hi: int) -> None:
        """A range of symbols in memory."""
        key, at, lcp = self.queue.take(g)
        if hi - self.queue.edges[g] > 1 and self._chains(key, at, lcp, hi):
            return
        while len(key):
            prev = self.before(at)
            after = prev.copy()
            own = np.flatnonzero((prev == key >> 1) & (key & 1 == 0))
            if len(own):
                # what a run puts back is before all of it
                after[own] = self.before(at[own] - self._run_lengths(at[own], prev[own]))
            inside = after[(after > key >> 1) & (after < hi)]
            cut = int(np.searchsorted(key, 2 * int(inside.min()))) if len(inside) else len(key)
            self._batch(key[:cut], at[:cut], lcp[:cut], prev[:cut])
            key, at, lcp = key[cut:], at[cut:], lcp[cut:]
            if self.queue.size[g]:
                more = self.queue.take(g)
                key, at, lcp = (np.concatenate(c) for c in zip((key, at, lcp), more, strict=True))
                order = np.argsort(key, kind="stable")
                key, at, lcp = key[order], at[order], lcp[order]

    def _chains(self, key: np.ndarray, at: np.ndarray, lcp: np.ndarray, hi: int) -> bool:
        """All of a range with what it puts back into itself, unless that takes more than ``STEPS`` steps.

        A suffix's code is (symbol, run before its first step down, 0 if it was here, 1 if put back, 2 for a
        seed); those of the suffixes that it came from follow, and last the place of the one that was here.
        """
        n = len(self.text) + 1
        seeded = (key & 1).astype(bool)
        sym = (key >> 1).astype(np.int64)
        # seeds follow all runs of their symbol
        codes = [np.where(seeded, (sym * n + n - 1) * 3 + 2, sym * n * 3)]
        root, here, may = np.arange(len(at)), at.astype(np.int64), ~seeded
        found = [(here, key.astype(np.int64), codes, root)]
        for _ in range(STEPS):
            prev = self.before(here).astype(np.int64)
            own = np.flatnonzero((prev == sym) & may)
            if len(own):
                r = self._run_lengths(here[own], sym[own])
                which = np.repeat(own, r)
                k = np.arange(len(which)) - np.repeat(np.cumsum(r) - r, r) + 1
                found.append((here[which] - k, 2 * sym[which], [codes[0][which] + 3 * k, *(c[which] for c in codes[1:])], root[which]))
                here, codes = here.copy(), [codes[0].copy(), *codes[1:]]
                here[own] -= r
                codes[0][own] += 3 * r
                prev[own] = self.before(here[own])
            go = np.flatnonzero((prev > sym) & (prev < hi))
            if not len(go):
                break
            codes = [prev[go] * n * 3 + 1, *(c[go] for c in codes)]
            root, here, sym = root[go], here[go] - 1, prev[go]
            may = np.ones(len(go), bool)
            found.append((here, 2 * sym, codes, root))
        else:
            return False
        put_back = np.zeros(len(key), bool)
        if len(found) > 1:
            put_back = np.concatenate([put_back, np.ones(sum(len(f[0]) for f in found[1:]), bool)])
            width = max(len(f[2]) for f in found)
            filled = [np.concatenate([f[2][k] if k < len(f[2]) else np.zeros(len(f[0]), np.int64) for f in found]) for k in range(width)]
            order = np.lexsort((np.concatenate([f[3] for f in found]), *reversed(filled)))
            key, at = np.concatenate([f[1] for f in found])[order], np.concatenate([f[0] for f in found])[order]
            lcp = np.concatenate([lcp, np.zeros(len(order) - len(lcp), lcp.dtype)])[order]
            put_back = put_back[order]
        seed = (key & 1).astype(bool)
        sym = key >> 1
        if self.depth:
            first = np.concatenate([[True], sym[1:] != sym[:-1]])
            lcp = lcp.copy()
            lcp[first] = 0
            put_back[1:] |= seed[1:] & ~seed[:-1]
            unknown = np.flatnonzero(put_back & ~first)
            if len(unknown):
                lcp[unknown] = look(self.text, at[unknown - 1], at[unknown], np.zeros(len(unknown), np.int32), self.depth)
        self.sink(at, lcp, seed)
        prev = self.before(at)
        self._feed(at, lcp, sym, np.where(prev >= hi, prev, -1))
        return True

    def _batch(self, key: np.ndarray, at: np.ndarray, lcp: np.ndarray, prev: np.ndarray) -> None:
        seed = (key & 1).astype(bool)
        sym = (key >> 1).astype(prev.dtype)
        if ((prev == sym) & ~seed).any():
            own = np.flatnonzero(~seed)
            a, v, s = self._runs(at[own], lcp[own], sym[own], 0)
            other = np.flatnonzero(seed)
            key = np.concatenate([2 * s, 2 * sym[other] + 1])
            order = np.argsort(key, kind="stable")
            key = key[order]
            at, lcp = np.concatenate([a, at[other]])[order], np.concatenate([v, lcp[other]])[order]
            seed, sym = (key & 1).astype(bool), key >> 1
            prev = self.before(at)
        if self.depth:
            first = np.concatenate([[True], sym[1:] != sym[:-1]])
            lcp = lcp.copy()
            lcp[first] = 0
            seam = np.flatnonzero(seed[1:] & ~seed[:-1] & ~first[1:]) + 1
            if len(seam):
                lcp[seam] = look(self.text, at[seam - 1], at[seam], np.zeros(len(seam), np.int32), self.depth)
        self.sink(at, lcp, seed)
        self._feed(at, lcp, sym, prev)

    def _feed(self, at: np.ndarray, lcp: np.ndarray, sym: np.ndarray, prev: np.ndarray, carry: Carry | None = None, own: Tape | None = None) -> None:
        """Puts the suffixes before ``at`` into the queue, those of the same symbol on ``own``."""
        pick = np.flatnonzero(prev > sym if own is None else prev >= sym)
        c = prev[pick]
        key = (2 * c).astype(self.key)
        order = np.argsort(key, kind="stable")
        key, place = key[order], pick[order]
        value = np.ones(len(key), self.lcp)
        if self.depth:
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            later = np.flatnonzero(~new)
            if len(later):
                value[later] = np.minimum(RangeMin(lcp).least(place[later - 1] + 1, place[later]).astype(np.int32) + 1, self.depth)
            if carry is not None:
                carry.through(key, place, new, value, lcp, self.depth)
        src = (at[place] - 1).astype(self.index)
        if own is not None:
            n = int(np.searchsorted(key, 2 * int(sym[0]), side="right"))
            own.append(src[:n], value[:n])
            key, src, value = key[n:], src[n:], value[n:]
        self.queue.push(key, src, value)

    def _run_lengths(self, at: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """How many symbols before each place equal the one there."""
        n = np.zeros(len(at), np.int64)
        live, k = np.arange(len(at)), 0
        while len(live) and k < 64:
            live = live[self.before(at[live] - k) == sym[live]]
            k += 1
            n[live] = k
            live = live[at[live] > k]
        for i in live.tolist():
            here, p = self.text[at[i]], int(at[i]) - k
            while p > 0:
                a = max(0, p - (1 << 16))
                other = np.flatnonzero(self.text[a:p] != here)
                if len(other):
                    p = a + int(other[-1]) + 1
                    break
                p = a
            n[i] = int(at[i]) - p
        return n

    def _runs(self, at: np.ndarray, lcp: np.ndarray, sym: np.ndarray, base: int) -> Block:
        """Positions with their runs laid out: by symbol, then by length of the run, then as they were."""
        n = self._run_lengths(at, sym) + 1
        which = np.repeat(np.arange(len(at)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((which, k, sym[which]))
        which, k = which[order], k[order]
        s = sym[which]
        value = lcp[which]
        up = np.flatnonzero(k)
        if self.depth and len(up):
            # up is never 0: a run of one comes first
            first = (s[up] != s[up - 1]) | (k[up] != k[up - 1])
            v = base + k[up]
            rest = up[~first]
            if len(rest):
                v[~first] = RangeMin(lcp).least(which[rest - 1] + 1, which[rest]).astype(np.int64) + k[rest]
            value[up] = np.minimum(v, self.depth)
        return (at[which] - k).astype(self.index), value, s

    def _stream(self, g: int, c: int) -> None:
        """A symbol beyond the budget: block by block, runs of one length after another until they fit."""
        carry, last = Carry(), None

        def of(kind: int) -> Iterator[Block]:
            for key, at, lcp in self.queue.read(g):
                m = (key & 1) == kind
                for k in range(0, int(m.sum()), self.room):
                    yield at[m][k : k + self.room], lcp[m][k : k + self.room]

        def block(at: np.ndarray, lcp: np.ndarray, seed: bool, start: int | None, own: Tape | None) -> None:
            if start is not None:
                lcp = lcp.copy()
                lcp[0] = min(start, self.depth)
            self.sink(at, lcp, np.full(len(at), seed))
            self._feed(at, lcp, np.full(len(at), c), self.before(at), carry, own)

        source, length = of(0), 0
        while True:
            more, fresh = Tape(self.scratch), True
            for at, lcp in source:
                block(at, lcp, False, length if fresh else None, more)
                last, fresh = at[-1:], False
            length += 1
            if not more.n:
                break
            if more.n <= self.room:
                at, lcp = BucketQueue.join(list(more.forward()))
                more.drop()
                lcp = lcp.copy()
                lcp[0] = min(length, self.depth)
                at, lcp, _ = self._runs(at, lcp, np.full(len(at), c), length)
                for k in range(0, len(at), self.room):
                    block(at[k : k + self.room], lcp[k : k + self.room], False, None, None)
                last = at[-1:]
                break
            source = more.forward()
        fresh = True
        for at, lcp in of(1):
            start = None
            if fresh:
                start = 0 if last is None else int(look(self.text, last, at[:1], np.zeros(1, np.int32), self.depth)[0])
            block(at, lcp, True, start, None)
            fresh = False
        self.queue.clear(g)


class Carry:
    """Least common prefix since each target's last source, through the blocks of one symbol."""

    def __init__(self):
        self.key, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def through(self, key: np.ndarray, place: np.ndarray, new: np.ndarray, value: np.ndarray, lcp: np.ndarray, depth: int) -> None:
        """Sets the values of each target's first entry in a block, and goes on past the block."""
        if not len(lcp):
            return
        first = np.flatnonzero(new)
        target = key[first].astype(np.int64)
        at = np.searchsorted(self.key, target)
        at = np.minimum(at, max(0, len(self.key) - 1))
        known = self.key[at] == target if len(self.key) else np.zeros(len(target), bool)
        ahead = np.minimum.accumulate(lcp)
        if known.any():
            value[first[known]] = np.minimum(np.minimum(self.value[at[known]], ahead[place[first[known]]]) + 1, depth)
        behind = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1][1:], [depth]]).astype(np.int64)
        tail = behind[place[np.concatenate([first[1:], [len(key)]])[: len(first)] - 1]]
        old = ~np.isin(self.key, target)
        keys = np.concatenate([self.key[old], target])
        values = np.concatenate([np.minimum(self.value[old], int(ahead[-1])), tail])
        order = np.argsort(keys)
        self.key, self.value = keys[order], values[order]


def star_places(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places of S* suffixes: a run below both its neighbours, and the end."""
    n = len(text)
    tape = Tape(scratch)
    at, sym = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = BLOCK * 4
    for k in range(0, n, step):
        piece = np.asarray(text[k : k + step]).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[k == 0 or piece[0] != text[k - 1]], piece[1:] != piece[:-1]]))
        at, sym = np.concatenate([at, starts + k]), np.concatenate([sym, piece[starts]])
        low = np.flatnonzero((sym[1:-1] < sym[:-2]) & (sym[1:-1] < sym[2:])) + 1
        tape.append(at[low])
        at, sym = at[-2:], sym[-2:]
    tape.append(np.array([n - 1]))
    out = scratch.array(tape.n, np.int32 if n < 1 << 30 else np.int64)
    k = 0
    for (block,) in tape.forward():
        out[k : k + len(block)] = block
        k += len(block)
    tape.drop()
    return out


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` symbols at a and b are equal."""
    out = np.zeros(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        done = size[live] <= k
        out[live[done]] = True
        live = live[~done]
    return out


def _induced(text: np.ndarray, sigma: int, depth: int, scratch: Scratch, seeds: Iterator[Block], sink: Callable) -> None:
    """From S* suffixes in rising order all S and L suffixes in falling order, but for the end."""
    rising = Tape(scratch)
    Scan(text, sigma, depth, scratch, False, lambda at, lcp, seed: rising.append(at[~seed], lcp[~seed])).run(seeds)
    Scan(text, sigma, depth, scratch, True, sink).run(rising.backward())
    rising.drop()


def descending(text: np.ndarray, sigma: int, depth: int, scratch: Scratch, level: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in falling order, with common prefixes to the one before; ``text`` ends in a single 0."""
    scratch.levels = max(scratch.levels, level)
    n = len(text)
    star = star_places(text, scratch)
    m = len(star)
    tape = Tape(scratch)
    if m > 1:
        found = Tape(scratch)

        def stars(at, lcp, seed):
            at = at[~seed]
            at = at[at > 0]
            found.append(at[text[at - 1] > text[at]])

        def blocks():
            for k in range(0, m, BLOCK):
                yield star[k : k + BLOCK], np.zeros(len(star[k : k + BLOCK]), np.uint8)

        _induced(text, sigma, 0, scratch, blocks(), stars)
        found.append(star[m - 1 :])
        # names in falling order
        name = scratch.array(m, np.int32 if m < 1 << 30 else np.int64)
        total, last = 0, None
        for (at,) in found.forward():
            i = np.searchsorted(star, at)
            size = np.where(i + 1 < m, star[np.minimum(i + 1, m - 1)] - at, 0) + 1
            if last is not None:
                at, size = np.concatenate([last[0], at]), np.concatenate([last[1], size])
            same = size[1:] == size[:-1]
            both = np.flatnonzero(same)
            same[both] = _equal(text, at[both], at[both + 1], size[both])
            new = np.concatenate([[last is None], ~same]) if last is None else ~same
            number = total - 1 + np.cumsum(new)
            name[i] = number
            total = int(number[-1]) + 1
            last = at[-1:], size[-1:]
        if total == m:
            order = ((at, None) for (at,) in found.forward())
        else:
            found.drop()
            for k in range(0, m, BLOCK):
                name[k : k + BLOCK] = total - 1 - name[k : k + BLOCK]
            order = descending(name, total, (depth + 1) // 2, scratch, level + 1)
        last = None
        for at, shared in order:
            if shared is None:
                known = np.zeros(len(at), np.int32)
            else:
                # names shared with the one before, in symbols
                i = at
                at = star[i]
                known = np.where(shared >= (depth + 1) // 2, depth, star[np.minimum(i + shared, m - 1)] - at)
                known = np.minimum(known, depth).astype(np.int32)
            ahead = np.concatenate([at[:1] if last is None else last, at[:-1]])
            known[0] = depth if last is None else known[0]
            lcp = look(text, ahead, at, known, depth)
            if last is None:
                lcp[0] = 0
            tape.append(at, lcp.astype(np.uint8 if depth < 255 else np.int32))
            last = at[-1:]
    else:
        tape.append(star, np.zeros(1, np.uint8))
    out = Tape(scratch)
    _induced(text, sigma, depth, scratch, tape.backward(), lambda at, lcp, seed: out.append(at, lcp))
    tape.drop()
    out.append(np.array([n - 1], np.int32 if n < 1 << 30 else np.int64), np.zeros(1, np.uint8 if depth < 255 else np.int32))
    yield from out.forward()
    out.drop()


def falling_suffixes(text: np.ndarray, sigma: int, depth: int, memory: int = MEMORY, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffixes in falling order with common prefixes (up to ``depth``) to the one before.

    ``text`` ends in 0, which occurs nowhere else; its other symbols are below ``sigma``.
    """
    scratch = scratch or Scratch(memory)
    try:
        if text.nbytes > scratch.memory:
            path = scratch.path()
            np.save(path + ".npy", text)
            text = np.load(path + ".npy", mmap_mode="r")
        yield from descending(text, sigma, depth, scratch)
    finally:
        scratch.close()


def suffixes(text: np.ndarray, sigma: int, depth: int, memory: int = MEMORY, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in rising order and common prefixes with the one before."""
    at, lcp = (np.concatenate(c)[::-1] for c in zip(*falling_suffixes(text, sigma, depth, memory, scratch), strict=True))
    return at, np.concatenate([[0], lcp[:-1]]).astype(lcp.dtype)
