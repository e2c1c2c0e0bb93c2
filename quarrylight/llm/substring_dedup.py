"""Substring dedup by super-k-mers of words (operator 7).

Consecutive windows of words that share a minimiser travel as one packed string to its bucket, where
sorting the windows counts them exactly (see ``repeats`` for the way there and back).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, slices
from .repeats import Units, covered, repeated, runs_of

WINDOW, GRAM = 35, 8


def sorted_windows(window: int):
    """A decider that sorts all windows of a bucket and looks for equal neighbours; a string with copies comes twice."""

    def decide(groups: Iterator[tuple[list[bytes], list[bool]]]) -> Iterator[list[list[tuple[int, int]]]]:
        for strings, copied in groups:
            entries = []
            for si, (s, twice) in enumerate(zip(strings, copied, strict=True)):
                ends = [i for i, c in enumerate(s) if c == 32] + [len(s)]
                starts = [0, *(e + 1 for e in ends[:-1])]
                own = [(s[a:b], si, i) for i, (a, b) in enumerate(zip(starts, ends[window - 1 :], strict=False))]
                entries += own * (1 + twice)
            entries.sort()
            hits = [set() for _ in strings]
            for one, two in itertools.pairwise(entries):
                if one[0] == two[0]:
                    hits[one[1]].add(one[2])
                    hits[two[1]].add(two[2])
            yield [runs_of(np.isin(np.arange(max(h) + 1), list(h))) if h else [] for h in hits]

    return decide


def remove_repeated_words(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose words also start anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none), unchanged; windows stay within a
    document and are judged on the input. Returns doc_id, n_words, n_removed, kept (the other words
    joined by one space). A text shorter than a window keeps all its words. Repeated rows are other
    places: their windows repeat each other's.
    """
    units = Units(True, window, min(gram, window))
    texts, flags = repeated(docs, units, sorted_windows(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, removed, kept = [], [], []
            for text, spans in zip(col(b, "text").to_pylist(), col(b, "spans").to_pylist(), strict=True):
                ws = text.encode("utf-8").split()
                gone = covered(spans, len(ws), window)
                counts.append(len(ws))
                removed.append(sum(y - x for x, y in gone))
                for x, y in reversed(gone):
                    del ws[x:y]
                kept.append(b" ".join(ws).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(flags.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest_of(kept: str) -> str:
    return hashlib.sha256(kept.encode("utf-8")).hexdigest()
