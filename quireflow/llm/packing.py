"""Cost-balanced packing of documents into fixed-length training sequences.

A task reads documents in order and packs them block by block (a bounded number
of tokens), so nothing is shuffled. In a block, a document longer than the
sequence length first gives whole sequences of its own. The rest are assigned
in descending order of length to the sequence with the lowest attention cost so
far (linear plus quadratic in each piece's length) that has room; where none
has room for all of it, it is cut. A block's sequences have as many places as
its tokens: full sequences, and for what is left the powers of two that sum to
it, so that no padding is needed.

Null texts count as empty (one piece with the end id). Repeated rows are packed
each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.wordcache import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; sequences are numbered from 0."""
    pieces, rest, n_sequences = [], [], 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append((d, start, capacity, n_sequences, 0))
            start, n_sequences = start + capacity, n_sequences + 1
        if n > start:
            rest.append((n - start, start, d))
    left = sum(r[0] for r in rest)
    room = [capacity] * (left // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if (left % capacity) >> k & 1]
    used = [0] * len(room)
    heap = [(0.0, s) for s in range(len(room))]
    for n, start, d in sorted(rest, key=lambda r: (-r[0], r[2])):
        while n:
            passed = []
            chosen = None
            while heap:
                cost, s = heapq.heappop(heap)
                if room[s] - used[s] >= n:
                    chosen = cost, s
                    break
                passed.append((cost, s))
            if chosen is None:  # cut it: the cheapest sequence takes what it can
                chosen = passed.pop(0)
            for x in passed:
                heapq.heappush(heap, x)
            cost, s = chosen
            take = min(n, room[s] - used[s])
            pieces.append((d, start, take, n_sequences + s, used[s]))
            used[s] += take
            start, n = start + take, n - take
            if used[s] < room[s]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s))
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, block_tokens: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the task's number times 2**40 plus a count in the task. A
    block ends when it holds block_tokens tokens, which bounds a task's memory
    by that and the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        next_sequence = (context.partitionId() if context else 0) << 40
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            pieces = pack([len(x) for x in ids], capacity)
            rows = [(names[d], s, n, zlib.crc32(ids[d][s : s + n]), len(ids[d]), next_sequence + q, o) for d, s, n, q, o in pieces]
            next_sequence += 1 + max((p[3] for p in pieces), default=-1)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, flat, counts in encode.encode(batch.column(1)):
                at = 0
                for k, n in enumerate(counts.tolist()):
                    ids.append(np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4"))
                    names.append(doc_ids[low + k])
                    at, held = at + n, held + n + 1
                    if held >= block_tokens:
                        yield flush()
                        ids, names, held = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, SCHEMA)
