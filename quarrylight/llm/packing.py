"""Cost-balanced sequence packing (operator 8).

Each task packs its own documents, block by block, so that no text or id is shuffled. A block holds
about ``BLOCK_TOKENS`` tokens. Documents longer than a sequence first fill whole sequences; what is
left goes, in descending length, to the sequence with the lowest estimated attention cost (a linear
and a quadratic term for each piece) that has room for it. Where none has, the document is cut and
fills the roomiest one. A block opens no more sequences than its tokens need, so less than one
sequence of padding is left in each block.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import library_ids
from .common import col, keyed, slices

CAPACITY = 2048
BLOCK_TOKENS = 2048 * CAPACITY
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, the share of projections and of attention scores.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block; lengths are positive."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest, sequence = [], 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
            start += capacity
        if n > start:
            rest.append((n - start, d, start))
    if not rest:
        return pieces
    count = -(-sum(r[0] for r in rest) // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        while n:
            fits = room >= n
            if fits.any():
                s, take = int(np.where(fits, cost, np.inf).argmin()), n
            else:
                s = int(room.argmax())
                take = int(room[s])
            pieces.append((d, start, take, sequence + s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += LINEAR * take + QUADRATIC * take * take
            start, n = start + take, n - take
    return pieces


def pack_documents(docs: DataFrame, path: str, *, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pack all documents (null text: empty), each with ``end_id`` appended, into sequences.

    One row for each piece; every id lies in exactly one. An empty text is a piece of one id. Repeated
    rows are packed each. Sequence ids are unique: the task's partition in the high bits. ``keep_ids``
    adds the piece's ids as little-endian uint32.
    """
    schema = pa.schema([*ARROW, ("ids", pa.binary())]) if keep_ids else ARROW
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = library_ids(path)
        first = TaskContext.get().partitionId() << 36
        used, held, names, tokens = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal used, held, names, tokens
            pieces = pack([len(x) // 4 for x in held], capacity)
            ids = [held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [[names[p[0]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], list(map(zlib.crc32, ids)), [len(held[p[0]]) // 4 for p in pieces], [first + used + p[3] for p in pieces], [p[4] for p in pieces]]
            used += max(p[3] for p in pieces) + 1
            held, names, tokens = [], [], 0
            arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(ids, pa.binary())] if keep_ids else [])
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for b in slices(batches, "text", 2 << 20):
            for doc_id, ids in zip(col(b, "doc_id").to_pylist(), source.encode_all(col(b, "text").to_pylist()), strict=True):
                held.append(ids + end)
                names.append(doc_id)
                tokens += len(ids) // 4 + 1
                if tokens >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return keyed(docs).select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary" * keep_ids)
