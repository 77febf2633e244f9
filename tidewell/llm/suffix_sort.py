"""External induced sorting of suffixes.

The text, the suffixes that wait and every order that comes out are files; `held` entries are in memory at a time. As in
every induced sort, suffixes are larger (L) or smaller (S) than the one after them, and an S suffix after an L suffix is
an LMS suffix. LMS substrings are sorted by one induction and named, the names are sorted by the same function, and a
second induction carries their order to all suffixes.

An induction sweeps the alphabet twice, up for L and down for S suffixes. Each sorted suffix hands the one before it to
the queue of that suffix's first character. Queues are on disk and are read in the order they were filled, so together
they are a priority queue by (first character, rank of the suffix after it). A frequent character is swept alone, as a
stream: suffixes that stay at the character wait for its next wave. Rarer characters, of which the names of a recursion
may be millions, are swept many at a time: the suffixes of such a stretch are gathered in memory, and those whose order
depends on others of the stretch are ranked by following the chain after them in doubled steps.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np

#: Entries in memory; a character with more suffixes than this is swept alone; stretches of a level; cells of its count.
HELD, SOLO, STRETCHES, CELLS = 2_000_000, 2_048, 16, 8_192


class Queues:
    """First-in first-out queues of 64-bit numbers by key, on disk once they hold more than `most` together."""

    def __init__(self, folder: str, most: int):
        self.stem, self.most, self.parts, self.count, self.disk = os.path.join(folder, uuid.uuid4().hex), most, {}, 0, {}

    def put(self, key, rows: np.ndarray) -> None:
        if len(rows):
            self.parts.setdefault(key, []).append(rows)
            self.count += len(rows)
            if self.count > self.most:
                for k, parts in self.parts.items():
                    path = self.disk.setdefault(k, f"{self.stem}-{len(self.disk)}-{k}".replace(" ", ""))
                    with open(path, "ab") as f:
                        for p in parts:
                            np.ascontiguousarray(p, np.int64).tofile(f)
                self.parts, self.count = {}, 0

    def chunks(self, key, size: int, back: bool = False) -> Iterator[np.ndarray]:
        """A queue's entries, first to last or, with `back`, last to first; then it is gone."""
        parts, path = self.parts.pop(key, []), self.disk.pop(key, None)
        self.count -= sum(map(len, parts))
        held = joined(parts, size)
        if back:
            yield from (p[::-1] for p in reversed(list(held)))
        if path:
            yield from read(path, size, back)
            os.unlink(path)
        if not back:
            yield from held

    def drop(self) -> None:
        for path in self.disk.values():
            os.unlink(path)
        self.parts, self.count, self.disk = {}, 0, {}

    def all(self, key) -> np.ndarray:
        parts = list(self.chunks(key, 1 << 62))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def joined(parts: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Arrays put together to about `size` rows each."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on as 16 bits if they fit: those are sorted by radix."""
    return x.astype(np.uint16) if len(x) and x.max() < 65_536 else x


def read(path: str, size: int, back: bool = False) -> Iterator[np.ndarray]:
    """A file of 64-bit numbers in chunks, from either end."""
    n = os.path.getsize(path) // 8
    size = min(size, n) or 1
    with open(path, "rb") as f:
        for a in range(-(-n // size) - 1, -1, -1) if back else range(-(-n // size)):
            f.seek(8 * a * size)
            rows = np.fromfile(f, np.int64, size)
            yield rows[::-1] if back else rows


class Level:
    """One text of the recursion. t: its characters on disk; the last one is 0 and stands nowhere else."""

    def __init__(self, t: np.ndarray, folder: str, held: int):
        self.t, self.n, self.folder, self.held = np.asarray(t), len(t), folder, held
        self.chunk = max(1, held // 8)
        self.stretch()

    def path(self) -> str:
        return os.path.join(self.folder, uuid.uuid4().hex)

    # ---- characters

    def stretch(self) -> None:
        """Lowest character of each stretch of the alphabet, and whether it is swept alone."""
        blocks = range(0, self.n, self.chunk)
        top = max(int(self.t[a : a + self.chunk].max()) for a in blocks) + 1
        width = -(-top // CELLS)

        def counted(low: int, high: int, width: int) -> np.ndarray:
            out = np.zeros(-(-(high - low) // width), np.int64)
            for a in blocks:
                x = self.t[a : a + self.chunk]
                x = x if (low, high) == (0, top) else x[(x >= low) & (x < high)]
                out += np.bincount((x - low) // width, minlength=len(out)) if len(x) else 0
            return out

        most = max(1, min(self.held // 4, max(self.n // STRETCHES, self.held // 64)))
        alone = max(1, min(most, SOLO))
        self.low, self.solo = [], []
        room = 0

        def add(low: int, n: int, one: bool) -> None:
            nonlocal room
            if n == 0 and self.low and not self.solo[-1]:
                return
            if one and n > alone:
                self.low.append(low)
                self.solo.append(True)
                room = 0
            elif n > room or self.solo[-1]:
                self.low.append(low)
                self.solo.append(False)
                room = most - n
            else:
                room -= n

        for i, n in enumerate(counted(0, top, width).tolist()):
            if width > 1 and n > most:
                for k, m in enumerate(counted(i * width, min(top, (i + 1) * width), 1).tolist()):
                    add(i * width + k, m, True)
            else:
                add(i * width, n, width == 1)
        self.low, self.top, self.table = np.array(self.low, np.int64), top, None
        if top <= max(CELLS, self.held // 8):
            self.table = (np.searchsorted(self.low, np.arange(top), "right") - 1).astype(np.uint16 if len(self.low) < 65_536 else np.int32)

    def deal(self, queues: Queues, chars: np.ndarray, rows: np.ndarray) -> None:
        """Rows to the queues of their characters' stretches, in order."""
        if not len(rows):
            return
        if self.table is not None:
            of = self.table[chars]
        else:
            of = np.searchsorted(self.low, chars, "right") - 1
            of = of.astype(np.uint16) if len(self.low) < 65_536 else of
        order = np.argsort(of, kind="stable")
        of, rows = of[order], rows[order]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            queues.put(int(of[a]), rows[a:b])

    def before(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = rows[rows > 0] - 1
        return b, self.t[b].astype(np.int64)

    # ---- LMS suffixes

    def mark(self) -> None:
        """Writes is_lms (a byte for each place) and lms (places in text order)."""
        flags, s, path = np.memmap(self.path(), np.uint8, "w+", shape=(self.n,)), True, self.path()
        for b in range(self.n, 0, -self.chunk):  # s: the type of place b
            a = max(0, b - self.chunk)
            x = np.asarray(self.t[a : b + 1]).astype(np.int64)
            if b == self.n:
                x = np.append(x, -1)  # the last character is S by definition
            turns = x[:-1] != x[1:]
            differ, at = np.flatnonzero(turns), np.zeros(b - a, np.int64)
            np.cumsum(turns[: b - a - 1], out=at[1:])  # how many places before differ from the next
            types = np.full(b - a, s)
            inner = at < len(differ)
            k = differ[at[inner]]
            types[inner] = x[k] < x[k + 1]
            if b == self.n:
                types[-1] = True
                if b - a > 1:
                    types[-2] = False
                    for i in range(b - a - 3, -1, -1):  # those equal to the one before the last, if any
                        if x[i] != x[b - a - 2]:
                            break
                        types[i] = False
            else:
                flags[b] = s and not types[-1]
            flags[a + 1 : b] = types[1:] & ~types[:-1]
            s = bool(types[0])
        flags[0] = 0
        with open(path, "wb") as f:
            for a in range(0, self.n, self.chunk):
                (np.flatnonzero(flags[a : a + self.chunk]) + a).astype(np.int64).tofile(f)
        flags.flush()
        self.files = (flags.filename, path)
        self.is_lms, self.lms = np.asarray(flags), np.asarray(np.memmap(path, np.int64, "r"))

    # ---- induction

    def induce(self, lms: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """Suffixes from last to first, in chunks, from LMS suffixes in order."""
        seeds, up, large = (Queues(self.folder, self.held // 8) for _ in range(3))
        for rows in lms:
            self.deal(seeds, self.t[rows], rows)
        for r in range(len(self.low)):
            for rows in self._alone(r, up, seeds) if self.solo[r] else self._together(r, up, seeds):
                large.put(r, rows)
        down = Queues(self.folder, self.held // 8)
        for r in range(len(self.low) - 1, -1, -1):
            yield from self._alone_down(r, down, large) if self.solo[r] else self._together_down(r, down, large)

    def _waves(self, r: int, queue: Queues, step) -> Iterator[np.ndarray]:
        """A character's own queue, then what its suffixes put before themselves at the same character, and so on."""
        waves, k, now = Queues(self.folder, self.held // 8), 0, queue.chunks(r, self.chunk)
        while True:
            some = False
            for rows in now:
                yield rows
                more = step(rows)
                some |= len(more) > 0
                waves.put(k, more)
            if not some:
                return
            now, k = waves.chunks(k, self.chunk), k + 1

    def _alone(self, r: int, up: Queues, seeds: Queues) -> Iterator[np.ndarray]:
        c = int(self.low[r])

        def step(rows):
            b, ch = self.before(rows)
            on = ch > c
            self.deal(up, ch[on], b[on])
            return b[ch == c]

        yield from self._waves(r, up, step)
        for rows in seeds.chunks(r, self.chunk):
            b, ch = self.before(rows)
            self.deal(up, ch, b)

    def _alone_down(self, r: int, down: Queues, large: Queues) -> Iterator[np.ndarray]:
        c = int(self.low[r])

        def step(rows):
            b, ch = self.before(rows)
            on = ch < c
            self.deal(down, ch[on], b[on])
            return b[ch == c]

        yield from self._waves(r, down, step)
        for rows in large.chunks(r, self.chunk, back=True):
            yield rows
            b, ch = self.before(rows)
            self.deal(down, ch[ch < c], b[ch < c])

    def _ranked(self, groups: list[np.ndarray], far: int, near) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of a stretch in order: (places, whether each is a group's last kind). groups: suffixes whose order is
        known, of the kind that is sorted and of the other; each is sorted by character here. near: (character before,
        character, kind) -> whether the suffix before is of the kind and in the stretch. far: sign of the sweep."""
        char = [self.t[g].astype(np.int64) * far for g in groups]
        order = [np.argsort(narrow(c - c.min() if len(c) else c), kind="stable") for c in char]
        pos = [g[o] for g, o in zip(groups, order, strict=True)]
        char = [c[o] for c, o in zip(char, order, strict=True)]
        kind = [np.full(len(pos[0]), 0, np.int8), np.full(len(pos[1]), 2, np.int8)]
        after = [np.arange(len(pos[0]) + len(pos[1]))]
        front, n = (np.concatenate(pos), np.concatenate(char), np.concatenate(kind), after[0]), len(after[0])
        while len(front[0]):
            p, c, k, i = front
            some = p > 0
            p, c, k, i = p[some] - 1, c[some], k[some], i[some]
            ch = self.t[p].astype(np.int64) * far
            some = near(ch, c, k)
            p, ch, i = p[some], ch[some], i[some]
            pos.append(p), char.append(ch), kind.append(np.full(len(p), 1, np.int8)), after.append(i)
            front, n = (p, ch, np.zeros(len(p), np.int8), np.arange(n, n + len(p))), n + len(p)
        pos, char, kind, after = (np.concatenate(x) for x in (pos, char, kind, after))
        # Ranks: known suffixes have their own, those that depend on others share the first place of their character.
        cls = narrow((char - char.min() if n else char) * 4 + kind)
        order = np.argsort(cls, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        mine = np.flatnonzero(kind == 1)
        if len(mine):
            sorted_cls, first = cls[order], np.zeros(n, np.int64)
            first[1:] = np.where(sorted_cls[1:] != sorted_cls[:-1], np.arange(1, n), 0)
            rank[mine] = np.maximum.accumulate(first)[rank[mine]]
            jump, todo = after.copy(), mine
            while len(todo):
                a, b = rank[todo], rank[jump[todo]]
                o = np.argsort(a * n + b)
                a, b, todo = a[o], b[o], todo[o]
                new_a = np.concatenate([[True], a[1:] != a[:-1]])
                new = new_a | np.concatenate([[True], b[1:] != b[:-1]])
                at = np.arange(len(a))
                start = np.maximum.accumulate(np.where(new_a, at, 0))
                first = np.maximum.accumulate(np.where(new, at, 0))
                further = jump[jump[todo]]
                rank[todo], jump[todo] = a + first - start, further
                todo = todo[~new | np.append(~new[1:], False)]  # those that still share a rank
        order[rank] = np.arange(n)
        return pos[order], kind[order] == 2

    def _together(self, r: int, up: Queues, seeds: Queues) -> Iterator[np.ndarray]:
        high = int(self.low[r + 1]) if r + 1 < len(self.low) else self.top
        rows, seed = self._ranked([up.all(r), seeds.all(r)], 1, lambda ch, c, k: (ch >= c) & (ch < high))
        b, ch = self.before(rows)
        self.deal(up, ch[ch >= high], b[ch >= high])
        yield rows[~seed]

    def _together_down(self, r: int, down: Queues, large: Queues) -> Iterator[np.ndarray]:
        low = int(self.low[r])
        known = down.all(r)
        if low == 0:
            known = np.append(known, self.n - 1)  # the last character is handed on by none
        others = list(large.chunks(r, 1 << 62, back=True))
        # Characters are counted downwards: an S suffix is before an L suffix, and may stay at the character of an S one.
        near = lambda ch, c, k: np.where(k == 2, ch > c, ch >= c) & (ch <= -low)
        rows, _ = self._ranked([known, np.concatenate(others) if others else np.zeros(0, np.int64)], -1, near)
        yield rows
        b, ch = self.before(rows)
        self.deal(down, ch[ch < low], b[ch < low])

    # ---- names

    def unlike(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether the LMS substring at each place differs from the one before. of: numbers of the LMS suffixes."""
        size = self.lms[np.minimum(of + 1, len(self.lms) - 1)] - rows
        a, b, length = rows[:-1], rows[1:], size[:-1]
        out = length != size[1:]
        live, k = np.flatnonzero(~out), 0
        while len(live):
            fail = self.t[a[live] + k] != self.t[b[live] + k]
            out[live[fail]] = True
            live = live[~fail]
            live = live[length[live] > k]
            k += 1
        return out

    def order(self) -> str:
        """Path of the suffixes from last to first."""
        out = self.path()
        self.mark()
        if self.n == 1:
            np.zeros(1, np.int64).tofile(out)
            return out
        first = self.path()
        with open(first, "wb") as f:
            for rows in self.induce(self.lms[a : a + self.chunk] for a in range(0, len(self.lms), self.chunk)):
                rows[self.is_lms[rows] > 0].tofile(f)
        named, last, count = Queues(self.folder, self.held // 8), None, 0
        for rows in read(first, self.chunk, back=True):
            rows = np.ascontiguousarray(rows)
            new, of = np.ones(len(rows), np.int64), np.searchsorted(self.lms, rows)
            both = [rows, of] if last is None else [np.append(x, y) for x, y in zip(last, (rows, of), strict=True)]
            new[len(rows) - len(both[0]) + 1 :] = self.unlike(*both)
            names, last = count + np.cumsum(new) - 1, (rows[-1:], of[-1:])
            count += int(new.sum())
            block = of // self.chunk
            for k in np.unique(block) if self.chunk < len(self.lms) else (0,):
                mine = block == k
                named.put(int(k), np.stack([of[mine], names[mine]], 1).ravel())
        if count < len(self.lms):
            path = self.path()
            with open(path, "wb") as f:
                for k in range(-(-len(self.lms) // self.chunk)):
                    pairs = named.all(k).reshape(-1, 2)
                    block = np.empty(len(pairs), np.uint32)
                    block[pairs[:, 0] - k * self.chunk] = pairs[:, 1]
                    block.tofile(f)
            ranked = Level(np.memmap(path, np.uint32, "r"), self.folder, self.held).order()
            os.unlink(path)
            seeds = (self.lms[rows] for rows in read(ranked, self.chunk, back=True))
        else:
            named.drop()
            ranked, seeds = first, read(first, self.chunk, back=True)
        with open(out, "wb") as f:
            for rows in self.induce(seeds):
                rows.tofile(f)
        for path in {first, ranked, *self.files}:
            os.unlink(path)
        return out


def suffixes(t: np.ndarray, folder: str, held: int = HELD) -> Iterator[np.ndarray]:
    """Suffixes of t in order, in chunks. The last entry of t is 0 and occurs nowhere else; files are kept in `folder`."""
    path = Level(t, folder, held).order()
    yield from read(path, max(1, held // 8), back=True)
    os.unlink(path)
