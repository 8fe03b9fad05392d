"""Phrases between rolling-hash triggers, for windows of a fixed number of bytes.

A window of ``window`` bytes has ``window - gram + 1`` grams; the gram with
the smallest rolling hash (the first of equals) is its trigger. That is a
function of the window's bytes alone, so equal windows have equal triggers at
equal places. Windows in a row with one trigger form a phrase: the bytes from
the first window's start to the last one's end. A phrase's windows are found
in another text wherever an equal phrase stands, so phrases, not windows, are
what is compared first.
"""

from __future__ import annotations

import numpy as np

#: A block of texts has fewer bytes than this; longer texts are cut with an overlap.
BLOCK_BITS = 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, modulo 2**64."""
    if k not in _powers:
        n = (1 << BLOCK_BITS) + 1
        both = []
        for base in (_BASE[k], pow(_BASE[k], -1, 1 << 64)):
            out = np.ones(n, np.uint64)
            done, step = 1, base
            while done < n:
                m = min(done, n - done)
                out[done : done + m] = out[:m] * np.uint64(step)
                step, done = step * step % (1 << 64), done + m
            both.append(out)
        _powers[k] = (both[0], both[1])
    return _powers[k]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: the low bits of a power sum are weak."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a block."""

    def __init__(self, block: np.ndarray, k: int):
        self.inverse = powers(k)[1]
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE[k][block] * powers(k)[0][: len(block)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, gram: int) -> np.ndarray:
        n = len(self.sums) - gram
        return mixed((self.sums[gram:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Phrases:
    """The phrases of texts laid end to end; no window crosses from one into the next.

    first, last: the phrase's first and last window start in the block;
    trigger: its trigger's place; text: the text's index; at: where it starts.
    """

    def __init__(self, texts: list[bytes], window: int = 100, gram: int = 40):
        self.window = window
        block = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(size)
        self.start = end - size
        self.order, self.check = Rolling(block, 0), Rolling(block, 1)
        n = len(block) - window + 1
        if n < 1:
            empty = np.zeros(0, np.int64)
            self.first = self.last = self.trigger = self.text = empty
            self.key = self.whole = empty.astype(np.uint64)
            return
        mask = np.uint64((1 << BLOCK_BITS) - 1)
        place = np.arange(len(block) - gram + 1, dtype=np.uint64)
        trigger = (sliding_min((self.order.grams(gram) & ~mask) | place, window - gram + 1) & mask).astype(np.int64)
        inside = np.zeros(n + 1, np.int8)
        long = size >= window
        np.add.at(inside, self.start[long], 1)
        np.add.at(inside, np.minimum(end[long] - window + 1, n), -1)
        valid = np.cumsum(inside[:n]) > 0
        change = np.ones(n, bool)
        change[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
        # a text of exactly ``window`` bytes can touch the next text's first window
        change[np.minimum(self.start[long], n - 1)] = True
        self.first = np.flatnonzero(valid & change)
        stop = np.ones(n, bool)
        stop[:-1] = change[1:] | ~valid[1:]
        self.last = np.flatnonzero(valid & stop)
        self.trigger = trigger[self.first]
        self.text = np.searchsorted(end, self.first, "right")
        self.key = self.check.of(self.trigger, self.trigger + gram)
        self.whole = self.hash(self.first, self.last + window, self.trigger)

    def cells(self, pick: np.ndarray, width: int) -> "Phrases":
        """The picked phrases in cells: windows whose distance to their trigger, divided by ``width``, is the same.

        A cell's key is the hash of the bytes that all windows of a full cell
        share, so a window occurs elsewhere only where its cell's key does.
        """
        first, last, trigger = self.first[pick], self.last[pick], self.trigger[pick]
        low, high = (trigger - last) // width, (trigger - first) // width
        n = high - low + 1
        of = np.repeat(np.arange(len(n)), n)
        cell = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = object.__new__(Phrases)
        out.window, out.start, out.order, out.check = self.window, self.start, self.order, self.check
        out.trigger, out.text = trigger[of], self.text[pick][of]
        out.first = np.maximum(first[of], out.trigger - (cell + 1) * width + 1)
        out.last = np.minimum(last[of], out.trigger - cell * width)
        core = out.trigger - cell * width
        out.key = mixed(self.check.of(core, core - (width - 1) + self.window) + cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.whole = out.hash(out.first, out.last + self.window, out.trigger)
        return out

    def hash(self, start: np.ndarray, end: np.ndarray, trigger: np.ndarray) -> np.ndarray:
        """Of bytes and of where the trigger stands in them."""
        return mixed(self.order.of(start, end) + (trigger - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
