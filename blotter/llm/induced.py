"""External induced sorting of one shard: suffix order and common prefixes, with queues that spill to disk.

Suffixes are S-type or L-type; S* suffixes are S-type after an L-type. The order of the S* suffixes induces that of the L-type
ones and these that of the S-type ones. Whatever is induced into a symbol's bucket arrives there in rank order, so the
priority queue over (symbol, rank) is one first-in, first-out queue per symbol; a queue's stretches go to disk once the
queues together hold more than ``memory`` tuples. A tuple carries position and rank of its source, and the common prefix of
two neighbours is one more than the smallest prefix between their sources. Sequences that grow with the shard are
memory-mapped files.

Sorting is bounded: prefixes count up to ``depth`` symbols, suffixes equal that far come in any order. Below the first level
names are ranked by doubling up to that depth, as induction over a large alphabet would take one step per name.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Tuples that queues hold in memory before they spill.
MEMORY = 1 << 21
#: Sequences longer than this are memory-mapped.
MAPPED = 1 << 22


class Scratch:
    """Files of one shard, in a folder of the task that goes when the task ends."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.number = 0

    def path(self) -> str:
        self.number += 1
        return os.path.join(self.folder.name, str(self.number))

    def array(self, size: int, dtype) -> np.ndarray:
        return np.empty(size, dtype) if size <= MAPPED else np.memmap(self.path(), dtype, "w+", shape=(size,))

    def close(self) -> None:
        self.folder.cleanup()


class Queues:
    """A queue of (position, rank) per symbol, in rank order, partly on disk."""

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.held = scratch, memory, 0
        self.parts: dict[int, list] = {}

    def push(self, symbols: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        pairs = np.empty((2, len(order)), np.int32)
        pairs[0], pairs[1] = positions[order], ranks[order]
        starts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist()]
        for symbol, start, end in zip(symbols[starts].tolist(), starts, [*starts[1:], len(order)]):
            self.parts.setdefault(symbol, []).append(pairs[:, start:end])
        self.held += pairs.shape[1]
        if self.held > self.memory:
            for parts in self.parts.values():
                for i, part in enumerate(parts):
                    if isinstance(part, np.ndarray) and part.shape[1] > 256:
                        path = self.scratch.path()
                        np.save(path, part)
                        self.held -= part.shape[1]
                        parts[i] = path + ".npy"

    def take(self, symbol: int) -> np.ndarray | None:
        """The oldest stretches of a symbol's queue, all up to the next one on disk together, or None."""
        parts = self.parts.get(symbol)
        if not parts:
            return None
        if isinstance(parts[0], str):
            path = parts.pop(0)
            whole = np.load(path)
            os.unlink(path)
            return whole
        count = next((i for i, part in enumerate(parts) if isinstance(part, str)), len(parts))
        whole = parts[0] if count == 1 else np.concatenate(parts[:count], axis=1)
        del parts[:count]
        self.held -= whole.shape[1]
        return whole


class Ranked:
    """The growing sequence of suffixes in order, each with its common prefix with the one before."""

    def __init__(self, scratch: Scratch, size: int):
        self.positions = scratch.array(size, np.int32)
        self.prefix = scratch.array(size, np.int16)
        self.size = 0

    def add(self, positions: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        end = self.size + len(positions)
        self.positions[self.size : end] = positions
        self.prefix[self.size : end] = prefix
        ranks = np.arange(self.size, end, dtype=np.int32)
        self.size = end
        return ranks


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S-type, and how often its first symbol repeats from there."""
    size = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    ends = np.append(change, size - 1).astype(np.int32)
    last = np.repeat(ends, np.diff(np.append(-1, ends)))
    small = np.append(text[change] < text[change + 1], True)
    return np.repeat(small, np.diff(np.append(-1, ends))), last - np.arange(size, dtype=np.int32) + 1


def _phase(text, wanted, repeats, seeds, seed_prefix, symbols, scratch, memory, depth, size):
    """One induction over ``symbols``: sources and what they induce, in order.

    ``seeds`` maps a symbol to the given suffixes of its bucket, which come after the induced ones; ``wanted`` marks the
    suffixes to be induced, the last position never. With ``depth`` 0 prefixes stay 0. Returns the whole sequence and a mask
    of the induced ones.
    """
    queues, out = Queues(scratch, memory), Ranked(scratch, size)
    induced = scratch.array(size, np.bool_)
    for symbol in symbols:
        before, source = None, -1  # last suffix of this bucket, rank of its source

        def follow(positions: np.ndarray, ranks: np.ndarray) -> None:
            # Before the first position lies the last one, which is not wanted.
            prior = positions - 1
            good = np.flatnonzero(wanted[prior])
            if len(good):
                prior = prior[good]
                queues.push(text[prior], prior, ranks[good])

        while (part := queues.take(symbol)) is not None:
            positions, sources = part
            prefix = np.zeros(len(positions), np.int16)
            borders = sources if source < 0 else np.append(source, sources)
            if depth and len(borders) > 1:
                least = np.minimum.reduceat(out.prefix[: int(borders[-1]) + 1], borders[:-1].astype(np.int64) + 1)
                prefix[len(positions) - len(least) :] = np.minimum(least + 1, depth)
            before, source = int(positions[-1]), int(sources[-1])
            induced[out.size : out.size + len(positions)] = True
            follow(positions, out.add(positions, prefix))
        given = seeds.get(symbol)
        if given is not None:
            positions, prefix = given, seed_prefix[symbol].copy()
            # Induced and given suffixes of a bucket part where the shorter repetition ends.
            prefix[0] = 0 if before is None else min(int(repeats[before]), int(repeats[positions[0]]), depth)
            induced[out.size : out.size + len(positions)] = False
            follow(positions, out.add(positions, prefix))
    return out, induced[: out.size]


def _by_symbol(text: np.ndarray, positions: np.ndarray, prefix: np.ndarray) -> tuple[dict, dict]:
    """Suffixes in bucket order, cut into buckets."""
    first = text[positions]
    cuts = np.flatnonzero(np.diff(first.astype(np.int32))) + 1
    names = [int(first[i]) for i in [0, *cuts.tolist()]] if len(positions) else []
    return dict(zip(names, np.split(positions, cuts))), dict(zip(names, np.split(prefix, cuts)))


def _induce(text, small, repeats, stars, star_prefix, scratch, memory, depth) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in descending order with their prefixes, from the S* suffixes in ascending order."""
    symbols = np.unique(text).tolist()
    large = ~small
    seeds, seed_prefix = _by_symbol(text, stars, star_prefix)
    first, induced = _phase(text, large, repeats, seeds, seed_prefix, symbols, scratch, memory, depth, int(large.sum()) + len(stars))
    ascending, prefix = first.positions[: first.size][induced], first.prefix[: first.size][induced]
    # Downwards the neighbour before is the one after: prefixes move by one.
    descending = ascending[::-1]
    down = np.zeros(len(prefix), np.int16)
    down[1:] = prefix[::-1][:-1]
    end = len(text) - 1
    seeds, seed_prefix = _by_symbol(text, np.append(descending, end).astype(np.int32), np.append(down, 0).astype(np.int16))
    inner = small.copy()
    inner[-1] = False
    second, _ = _phase(text, inner, repeats, seeds, seed_prefix, symbols[::-1], scratch, memory, depth, len(text))
    return second.positions[: second.size], second.prefix[: second.size]


def _names(text: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the S* substrings in their order: equal substrings share a name. ``ends``: last position of each."""
    lengths = ends - ordered + 1
    alike = np.flatnonzero(lengths[1:] == lengths[:-1])
    size = lengths[alike]
    start = np.repeat(np.cumsum(size) - size, size)
    step = np.arange(int(size.sum())) - start
    equal = text[np.repeat(ordered[alike], size) + step] == text[np.repeat(ordered[alike + 1], size) + step]
    same = np.zeros(len(ordered), bool)
    if len(alike):
        same[alike + 1] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return np.cumsum(~same) - 1


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of whole numbers from 0, equal ones as they come: if they fit, sorted with their places in one number each."""
    bits = int(len(keys)).bit_length()
    if int(keys.max(initial=0)) >> (62 - bits):
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def _ranked_stars(text, stars, names, depth) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, with prefixes, by doubling of the names of their substrings (in text order)."""
    levels = [names.astype(np.int64)]
    count = len(names)
    reach = 1
    while reach * 2 <= depth and levels[-1].max(initial=-1) + 1 < count:
        rank = levels[-1]
        next_ = np.zeros(count, np.int64)
        next_[: count - reach] = rank[reach:] + 1
        key = rank * (count + 1) + next_
        order = _order(key)
        fresh = np.zeros(count, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        levels.append(fresh)
        reach *= 2
    order = _order(levels[-1])
    prefix = np.zeros(count, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        inside = (left < count) & (right < count)
        equal = inside.copy()
        equal[inside] = rank[left[inside]] == rank[right[inside]]
        left[equal] += 1 << level
        right[equal] += 1 << level
    where = np.append(stars, len(text) - 1)
    gone = where[np.minimum(left, count)] - stars[order[:-1]]
    active = np.flatnonzero(gone < depth)
    while len(active):
        a, b = stars[order[active]] + gone[active], stars[order[active + 1]] + gone[active]
        inside = (a < len(text)) & (b < len(text))
        active, a, b = active[inside], a[inside], b[inside]
        active = active[text[a] == text[b]]
        gone[active] += 1
        active = active[gone[active] < depth]
    prefix[1:] = np.minimum(gone, depth)
    return stars[order].astype(np.int32), prefix.astype(np.int16)


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in descending order and the prefix of each with the one before, up to ``depth``.

    ``text`` holds small integers and ends with its only 0, its smallest symbol.
    """
    own = scratch is None
    scratch = scratch or Scratch()
    try:
        small, repeats = _types(text)
        star = small.copy()
        star[0] = False
        star[1:] &= ~small[:-1]
        stars = np.flatnonzero(star).astype(np.int32)
        # Sort the S* substrings by inducing from unsorted S* suffixes.
        loose = stars[np.argsort(text[stars], kind="stable")]
        rough, _ = _induce(text, small, repeats, loose, np.zeros(len(loose), np.int16), scratch, memory, 0)
        ordered = rough[star[rough]][::-1]
        place = np.empty(len(text), np.int32)
        place[stars] = np.arange(len(stars))
        ends = np.append(stars[1:], len(text) - 1)[place[ordered]]
        names = np.empty(len(stars), np.int64)
        names[place[ordered]] = _names(text, ordered, ends)
        ranked, prefix = _ranked_stars(text, stars, names, depth)
        positions, prefix = _induce(text, small, repeats, ranked, prefix, scratch, memory, depth)
        return np.array(positions), np.array(prefix)
    finally:
        if own:
            scratch.close()
