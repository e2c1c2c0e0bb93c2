"""Suffix-array dedup of byte strings by difference-cover blockwise construction (operator 9).

Packed strings that may hold repeated windows come in blocks of bounded size (see ``repeats``). In a
block, the suffixes at a difference-cover sample of the positions are ranked first. Then the window
suffixes are sorted one bucket of leading bytes at a time: by their first bytes, and where those tie by
the ranks of the sample suffixes a short, known distance further on, which settles a tie of any length
in one comparison. Neighbours in suffix order that share a whole window are repeats of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, col, slices
from .repeats import Units, covered, repeated, runs_of

WINDOW, GRAM = 400, 128
BLOCK_BYTES, BUCKET = 1 << 20, 1 << 17
PERIOD = 31


def difference_cover(period: int, size: int) -> list[int]:
    """The first set of residues, by backtracking, whose differences give every residue of ``period``."""

    def grow(chosen: list[int], seen: set[int]) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len(seen) == period else None
        for x in range(chosen[-1] + 1, period):
            more = {(x - c) % period for c in chosen} | {(c - x) % period for c in chosen}
            if not more & (seen - {0}) and (found := grow([*chosen, x], seen | more)):
                return found
        return None

    return grow([0], {0}) or []


COVER = difference_cover(PERIOD, 6)  # a perfect one: 6 * 5 differences and 0
_IN = np.zeros(PERIOD, bool)
_IN[COVER] = True
#: SHIFT[a, b]: the least shift that takes residues a and b into the cover together.
SHIFT = np.array([[next(s for s in range(PERIOD) if _IN[(a + s) % PERIOD] and _IN[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])

#: LAST[a, b]: the same backwards, as a number from 1 - PERIOD to 0.
LAST = np.array([[next(-s for s in range(PERIOD) if _IN[(a - s) % PERIOD] and _IN[(b - s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def dense(key: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct ones, from 1."""
    return np.unique(key, return_inverse=True)[1].astype(np.uint64) + U(1)


class Block:
    """Text of one block, padded with zero bytes; ``words[i]`` holds the 8 bytes from i, big-endian."""

    def __init__(self, data: np.ndarray, window: int):
        self.n, self.window = len(data), window
        w = np.concatenate([data, np.zeros(window + 2 * PERIOD + 16, np.uint8)]).astype(np.uint64)
        for step in (1, 2, 4):
            w[:-step] = (w[:-step] << U(8 * step)) | w[step:]
        self.words = w
        #: A depth at which two sample ranks and the bytes at both ends settle whether windows are equal.
        self.near_depth = next((d for d in (PERIOD << k for k in range(20)) if window <= 2 * d and d + PERIOD <= window), 0)
        self._rank_sample()

    def _rank_sample(self) -> None:
        """Ranks of the sample suffixes to a depth of at least the window, by doubling multiples of the period."""
        at = np.flatnonzero(_IN[np.arange(self.n + PERIOD) % PERIOD])
        first = [self.words[at + 8 * k] for k in range(PERIOD // 8)] + [self.words[at + 8 * (PERIOD // 8)] >> U(8 * (8 - PERIOD % 8))]
        order = np.lexsort(first[::-1])
        new = np.zeros(len(at), bool)
        for k in first:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.zeros(self.n + 3 * PERIOD, np.uint64)
        rank[at[order]] = np.cumsum(new).astype(np.uint64) + U(1)
        depth = PERIOD
        while depth < self.window:
            if depth == self.near_depth:
                self.near = rank.copy()
            ahead = np.where(at + depth < len(rank), rank[np.minimum(at + depth, len(rank) - 1)], U(0))
            rank[at] = dense((rank[at] << U(32)) | ahead)
            depth *= 2
        self.rank = rank

    def sort_bucket(self, at: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes, to the depth of a window at least."""
        lead = [self.words[at + 8 * k] for k in range(4)]  # 32 bytes, more than the period
        order = np.lexsort(lead[::-1])
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = False
        for k in lead:
            new[1:] |= k[order][1:] != k[order][:-1]
        group = np.cumsum(new) - 1
        slot = np.flatnonzero(np.bincount(group)[group] > 1)
        group = group[slot]
        while len(slot):
            here = at[slot]
            start = np.searchsorted(group, group)  # group ids ascend
            pivot = here[start]
            shift = SHIFT[here % PERIOD, pivot % PERIOD]
            a, b = self.rank[here + shift], self.rank[pivot + shift]
            side = (a > b).astype(np.int64) - (a < b)
            order = np.lexsort((side, group))
            at[slot] = here[order]
            part = group * 3 + 1 + side[order]  # group is the same in the new order
            open_ = side[order] != 0
            _, index, size = np.unique(part, return_inverse=True, return_counts=True)
            keep = open_ & (size[index] > 1)
            slot, group = slot[keep], index[keep]
        return at

    def repeats(self, starts: np.ndarray) -> np.ndarray:
        """For each start whether its window also starts at another of the starts."""
        hit = np.zeros(self.n, bool)
        lead = self.words[starts] >> U(48)
        for bucket in buckets(lead):
            at = self.sort_bucket(starts[bucket])
            pair = self.equal_neighbours(at)
            hit[at[pair]] = True
            hit[at[pair + 1]] = True
        return hit[starts]

    def equal_neighbours(self, at: np.ndarray) -> np.ndarray:
        """The i for which the windows at ``at[i]`` and ``at[i + 1]`` have the same bytes.

        Bytes are compared one word after another. Where the window allows it, sample ranks stand for
        the middle: one right after the first bytes and one that ends right before the last bytes.
        """
        pair = np.arange(len(at) - 1)
        ends = (0, 8, 16, 24, *range(self.window - 32, self.window, 8))
        for k in ends if self.near_depth else range(0, self.window, 8):
            x, y = self.words[at[pair] + k], self.words[at[pair + 1] + k]
            if self.window - k < 8:
                x, y = x >> U(8 * (8 - self.window + k)), y >> U(8 * (8 - self.window + k))
            pair = pair[x == y]
        if self.near_depth:
            rest = self.window - self.near_depth
            for table, base in ((SHIFT, 0), (LAST, rest)):
                x, y = at[pair], at[pair + 1]
                step = base + table[(x + base) % PERIOD, (y + base) % PERIOD]
                pair = pair[self.near[x + step] == self.near[y + step]]
        return pair


def buckets(lead: np.ndarray) -> Iterator[np.ndarray]:
    """Indices by ranges of leading bytes, about BUCKET in each; equal leads stay together."""
    order = np.argsort(lead, kind="stable")
    ordered, at = lead[order], 0
    while at < len(order):
        end = len(order) if at + BUCKET >= len(order) else int(np.searchsorted(ordered, ordered[at + BUCKET], side="right"))
        yield order[at:end]
        at = end


def suffix_windows(window: int):
    """A decider that ranks the cover sample of a block of buckets and sorts the suffixes of their windows.

    A string with copies stands twice in the block. Buckets that share a block can't share a window.
    """

    def decide(groups: Iterator[tuple[list[bytes], list[bool]]]) -> Iterator[list[list[tuple[int, int]]]]:
        held: list[tuple[list[bytes], list[bool]]] = []
        size = 0

        def flush() -> Iterator[list[list[tuple[int, int]]]]:
            once = [s for strings, _ in held for s in strings]
            second = [s for strings, copied in held for s, twice in zip(strings, copied, strict=True) if twice]
            block = Block(np.frombuffer(b"".join([*once, *second]), np.uint8), window)
            lengths = np.array([len(s) for s in (*once, *second)])
            windows, begin = lengths - window + 1, np.cumsum(lengths) - lengths
            first = np.cumsum(windows) - windows
            hit = block.repeats(np.arange(int(windows.sum())) + np.repeat(begin - first, windows))
            k = 0
            for strings, _ in held:
                yield [runs_of(hit[first[i] : first[i] + windows[i]]) for i in range(k, k + len(strings))]
                k += len(strings)

        for group in groups:
            held.append(group)
            size += sum(len(s) * (1 + twice) for s, twice in zip(*group, strict=True))
            if size >= BLOCK_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return decide


def map_repeated_bytes(docs: DataFrame, make: Callable[[pa.RecordBatch, list[list[tuple[int, int]]]], pa.RecordBatch], schema: str, *, window: int = WINDOW, gram: int = GRAM, more: tuple[str, ...] = ()) -> DataFrame:
    """``make`` over batches of doc_id, text (null: empty) and the columns named in ``more``, with each
    text's spans: the maximal runs [first, last) of bytes that repeated windows cover.

    A window is ``window`` bytes of the UTF-8 text; it is repeated if its bytes also start anywhere
    else, in the same document or another, overlapping or not. A shorter text has none. Repeated rows
    are other places.
    """
    units = Units(False, window, min(gram, window))
    texts, flags = repeated(docs, units, suffix_windows(window), more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield make(b, [covered(s, 1 << 30, window) for s in col(b, "spans").to_pylist()])

    return texts.join(flags.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", *more, "spans").mapInArrow(run, schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    at, parts = 0, []
    for first, last in spans:
        parts.append(text[at:first])
        at = last
    return b"".join([*parts, text[at:]])


def remove_repeated_bytes(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the other bytes, joined (binary, since a cut may split a character)."""

    def make(b: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        raw = [t.encode("utf-8") for t in col(b, "text").to_pylist()]
        kept = [without(t, s) for t, s in zip(raw, spans, strict=True)]
        counts = [[len(t) for t in raw], [len(t) - len(k) for t, k in zip(raw, kept, strict=True)], [len(s) for s in spans]]
        return pa.RecordBatch.from_arrays([col(b, "doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_repeated_bytes(docs, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", window=window, gram=gram)
