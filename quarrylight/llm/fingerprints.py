"""Document fingerprints by content-defined chunking (operator 1).

A gear hash runs over the UTF-8 bytes; its value depends on the last 16 bytes only, so boundaries move
with the content. Chunking is normalised: up to the target length a boundary needs six zero bits, beyond
it four, between a smallest and a largest length. A fingerprint is the set of the chunks' 64-bit digests,
each weighted by the bytes that chunks with this digest cover. Likeness is containment: the weight of a
fingerprint that the other one covers, as a share of its whole weight.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import SLICE_BYTES, byte_values, col, keyed, partitions

SMALLEST, TARGET, LARGEST, REACH = 8, 32, 128, 16
STRICT, LOOSE = np.uint16(0xFC00), np.uint16(0xF000)
GEAR = (byte_values(1) >> np.uint64(48)).astype(np.uint16)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def boundaries(texts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each text; an empty text has none."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + REACH)  # zero gears before each text keep texts apart
    starts = ends - lengths
    gears = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    gears[np.arange(len(data)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)] = GEAR[data]
    for step in (1, 2, 4, 8):  # h[i] = sum of gear[i-j] << j for j < 16
        gears[step:] += gears[:-step] << np.uint16(step)
    loose = np.flatnonzero((gears & LOOSE) == 0)
    strict = (gears[loose] & STRICT) == 0
    first, last = np.searchsorted(loose, starts), np.searchsorted(loose, ends)
    loose += 1
    out = []
    for n, s, a, b in zip(lengths.tolist(), starts.tolist(), first.tolist(), last.tolist(), strict=True):
        cuts, at = [], 0
        for p, hard in zip((loose[a:b] - s).tolist(), strict[a:b].tolist(), strict=True):
            while p - at > LARGEST:
                at += LARGEST
                cuts.append(at)
            if p - at >= (SMALLEST if hard else TARGET):
                at = p
                cuts.append(p)
        while n - at > LARGEST:
            at += LARGEST
            cuts.append(at)
        if n > at:
            cuts.append(n)
        out.append(cuts)
    return out


def fingerprints(texts: list[bytes]) -> list[Counter]:
    """Weight by chunk digest of each text."""
    out = []
    for text, cuts in zip(texts, boundaries(texts), strict=True):
        weights: Counter = Counter()
        at = 0
        for cut in cuts:
            weights[xxh3_64_intdigest(text[at:cut])] += cut - at
            at = cut
        out.append(weights)
    return out


def render(weights: Counter) -> str:
    """digest:weight in hexadecimal, by digest, with commas between."""
    return ",".join([f"{d:016x}:{w:x}" for d, w in sorted(weights.items())])


def parse(fingerprint: str) -> Counter:
    return Counter({int(d, 16): int(w, 16) for d, w in (x.split(":") for x in fingerprint.split(",") if x)})


def likeness(one: Counter, other: Counter) -> float:
    """Share of one's weight that the other covers; two empty fingerprints are alike, an empty and another aren't."""
    if not one or not other:
        return float(one == other)
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    return sum([min(w, large[d]) for d, w in small.items() if d in large]) / sum(one.values())


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text (null: empty) and its edit by the next document.

    Documents follow each other by doc_id (null first, ties by text), the first follows the last, so a
    single document follows itself. Equal texts have equal fingerprints; an empty text has an empty one.

    Cut points from an approximate percentile of the ids (one number for each shuffle partition) deal
    the rows into ranges; a document that begins a range also goes to the range before, so every range
    is streamed in order by itself, holding one slice of text at a time. The texts are shuffled once.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = keyed(docs).select("doc_id", "text", F.col("k1").alias("place"))
    found = rows.agg(F.min("place").alias("least"), F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 8 * n).alias("cuts")).first()
    cuts = np.array(sorted({found["least"], *found["cuts"]}) if found["least"] is not None else [], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = col(b, "place").to_numpy()
            at = np.searchsorted(cuts, place, side="right") - 1
            heads = np.flatnonzero(place == cuts[at])
            take = pa.array(np.concatenate([np.arange(len(place)), heads]))
            ranges = np.concatenate([at, (at[heads] - 1) % len(cuts)]).astype(np.int32)
            follows = np.concatenate([np.zeros(len(place), bool), np.ones(len(heads), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(follows), *(col(b, c).take(take) for c in ("doc_id", "place", "text"))], names=["range", "follows", "doc_id", "place", "text"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size = 0

        def flush(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            """Of all rows but the last, which follows them."""
            texts = [t for _, t in rows]
            changed = [edited(a, b).encode("utf-8") for a, b in zip(texts, texts[1:], strict=False)]
            own = fingerprints([t.encode("utf-8") for t in texts])
            new = fingerprints(changed)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": [d for d, _ in rows[:-1]],
                    "n_chars": [len(t) for t in texts[:-1]],
                    "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
                    "fingerprint": [render(w) for w in own[:-1]],
                    "edited_fingerprint": [render(w) for w in new],
                    "near_edited": [likeness(a, b) for a, b in zip(own, new, strict=False)],
                    "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
                },
                schema=ARROW,
            )

        for b in batches:
            for doc_id, text, follows in zip(col(b, "doc_id").to_pylist(), col(b, "text").to_pylist(), col(b, "follows").to_pylist(), strict=True):
                held.append((doc_id, text))
                size += len(text)
                if follows:
                    break
                if size > SLICE_BYTES and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(held[-1][1])
            else:
                continue
            break
        if len(held) > 1:
            yield flush(held)
        for _ in batches:  # further rows with the first id of the next range
            pass

    dealt = rows.mapInArrow(deal, "range int, follows boolean, doc_id long, place long, text string")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("follows", "place", "text").select("doc_id", "text", "follows").mapInArrow(work, SCHEMA)
