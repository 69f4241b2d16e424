"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format (`.tok`, little-endian). One file holds a shard: documents of one
range of ids, in ascending order.

    magic    8 bytes "QFTOK001"
    payload  for each document: control bytes, then data bytes
    footer   n rows of 4 int64: doc id, tokens, payload offset, payload bytes
    tail     int64 n, int64 footer offset, magic

A token's value is the rank of its id by corpus frequency (0: most frequent;
ties by id), so most take one byte. A control byte holds the byte lengths (less
one) of four values, two bits each, lowest first; a data stream holds the
values' bytes. Decoding looks up a control byte's four lengths in a table.
`ranks.npy` in the same folder maps ranks to ids.

Null texts count as empty, a null id is written as the least int64. Repeated
ids stay, in the order of their encoded bytes. An empty table gives no shard.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import shared
from quireflow.llm.textkit import column_buffer, row_slices
from quireflow.llm.wordcache import encoder, release

MAGIC = b"QFTOK001"
NULL_ID = -(1 << 63)
READ_BYTES = 4 << 20
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def encode_rows(values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control bytes and data bytes of each row of values, as binary columns."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    n_control = -(-counts // 4)
    firsts = np.cumsum(counts) - counts
    codes = np.zeros(4 * int(n_control.sum()), np.uint8)
    codes[np.repeat(4 * (np.cumsum(n_control) - n_control) - firsts, counts) + np.arange(len(values))] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return _binary(control, np.concatenate([[0], np.cumsum(n_control)])), _binary(data, ends[np.concatenate([firsts, [len(values)]])])


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of slices of data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def decode_values(payload: bytes | memoryview, n: int) -> np.ndarray:
    """The n values whose control and data bytes make up the payload."""
    raw = np.frombuffer(payload, np.uint8)
    n_control = -(-n // 4)
    lengths = LENGTHS[raw[:n_control]].ravel()[:n]
    data = np.concatenate([raw[n_control:], np.zeros(3, np.uint8)]).astype(np.uint32)
    at = np.cumsum(lengths) - lengths
    values = data[at]
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        values[longer] |= data[at[longer] + k] << np.uint32(8 * k)
    return values


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shard(uri: str, batches: Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[int, int, int]:
    """Write batches of (doc ids, tokens, payloads) to a file, under another name until it is whole. Documents, tokens and bytes."""
    filesystem, path = _filesystem(uri)
    context = TaskContext.get()
    part = f"{path}.attempt{context.taskAttemptId() if context else 0}"
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    footer: list[np.ndarray] = []
    at = len(MAGIC)
    with filesystem.open_output_stream(part) as out:
        out.write(MAGIC)
        for doc_ids, n, payload in batches:
            raw, offsets = column_buffer(payload.cast(pa.large_binary()).view(pa.large_string()))
            out.write(raw.tobytes())
            footer.append(np.stack([doc_ids, n, at + offsets[:-1], np.diff(offsets)], axis=1).astype("<i8"))
            at += len(raw)
        rows = np.concatenate(footer) if footer else np.zeros((0, 4), "<i8")
        out.write(rows.tobytes())
        out.write(np.array([len(rows), at], "<i8").tobytes() + MAGIC)
    filesystem.move(part, path)
    return len(rows), int(rows[:, 1].sum()), at + 32 * len(rows) + 24


def read_shard(uri: str, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(doc id, ids) of a file's documents, in its order; READ_BYTES are read at once, or one document."""
    filesystem, path = _filesystem(uri)
    with filesystem.open_input_file(path) as source:
        size = source.size()
        source.seek(size - 24)
        tail = source.read(24)
        if tail[16:] != MAGIC:
            raise ValueError(f"{uri}: not a whole token file")
        n, at = np.frombuffer(tail[:16], "<i8")
        source.seek(int(at))
        footer = np.frombuffer(source.read(32 * int(n)), "<i8").reshape(-1, 4)
        offsets = np.append(footer[:, 2], at)
        for low, high in row_slices(offsets, READ_BYTES):
            source.seek(int(offsets[low]))
            raw = memoryview(source.read(int(offsets[high] - offsets[low])))
            for doc_id, tokens, offset, length in footer[low:high].tolist():
                yield doc_id, ranks[decode_values(raw[offset - offsets[low] : offset - offsets[low] + length], tokens)]


def load_ranks(folder: str) -> np.ndarray:
    filesystem, path = _filesystem(f"{folder}/ranks.npy")
    with filesystem.open_input_stream(path) as source:
        return np.frombuffer(source.read(), "<u4")


def _tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, raw: ids with the end id, in two bytes each where those of its batch fit, else in four.

    Each task ends with a row that has only seen: pairs of an id and how often it came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for low, flat, counts in encode.encode(batch.column(1)):
                ids = np.insert(flat, np.cumsum(counts), np.uint32(end_id)) if len(flat) else np.full(len(counts), end_id, np.uint32)
                more = np.bincount(ids, minlength=len(seen))
                more[: len(seen)] += seen
                seen = more
                width = 2 if int(ids.max(initial=0)) <= 0xFFFF else 4
                offsets = width * np.concatenate([[0], np.cumsum(counts + 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(counts)), pa.array(counts + 1, pa.int64()), _binary(ids.astype(f"<u{width}").view(np.uint8), offsets), pa.nulls(len(counts), pa.binary())], _STAGED_NAMES)
        found = np.flatnonzero(seen)
        if len(found):
            pairs = np.stack([found, seen[found]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([pairs], pa.binary())], _STAGED_NAMES)

    return docs.mapInArrow(run, _STAGED)


_STAGED_NAMES = ["doc_id", "n_tokens", "raw", "seen"]
_STAGED = "doc_id long, n_tokens long, raw binary, seen binary"


def _ids(counts: pa.Array, raw: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, flat ids, ids per row) of runs of rows of one width, of bounded size."""
    n = counts.to_numpy()
    if not len(n):
        return
    data = raw.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    values = np.frombuffer(data.buffers()[2], np.uint8)
    width = np.diff(offsets) // np.maximum(n, 1)
    for low, high in row_slices(offsets):
        cuts = [low, *(low + 1 + np.flatnonzero(np.diff(width[low:high]))).tolist(), high]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield a, np.frombuffer(values[offsets[a] : offsets[b]].tobytes(), f"<u{width[a]}").astype(np.uint32), n[a:b]


def _frequencies(staged: DataFrame) -> DataFrame:
    """id, n: how often each id occurs; a row per id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch.column(0):
                found = np.frombuffer(pairs.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "n"])

    return staged.select("seen").where("seen is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, shard_tokens: int = 8_000_000) -> list[dict]:
    """Encode docs and write its shards and rank table to folder (a URI). Returns the shards' manifest, in order.

    Texts are encoded once, to a scratch table; ranks need the counts of the
    whole corpus, and one row per id (bounded by the vocabulary) reaches the
    driver. The manifest has a row per shard of about shard_tokens tokens.
    """
    spark = docs.sparkSession
    scratch = shared.scratch_path(spark, "token-ids")
    _tokenised(docs.select(F.col(id_column).cast("long"), F.col(text_column)), tokenizer, end_id).write.option("compression", "zstd").parquet(scratch)
    staged = spark.read.schema(_STAGED).parquet(scratch)

    counted = _frequencies(staged).orderBy(F.desc("n"), "id").collect()
    ranks = np.array([r["id"] for r in counted], "<u4")
    total = sum(r["n"] for r in counted)
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks))
    filesystem, path = _filesystem(f"{folder}/ranks.npy")
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(ranks.tobytes())
    if not total:
        return []

    n_shards = max(1, -(-total // shard_tokens))
    bounds = sorted({int(x) for x in staged.approxQuantile("doc_id", [k / n_shards for k in range(1, n_shards)], 0.1 / n_shards)}) if n_shards > 1 else []
    cuts, rank_table = spark.sparkContext.broadcast(np.array(bounds, np.int64)), spark.sparkContext.broadcast(rank_of)

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        to_rank = rank_table.value
        for batch in batches:
            shard = pa.array(np.searchsorted(cuts.value, batch.column(0).fill_null(NULL_ID).to_numpy()), pa.int32())  # the bounds below the id
            for low, ids, counts in _ids(batch.column(1), batch.column(2)):
                payload = pc.binary_join_element_wise(*encode_rows(to_rank[ids], counts), b"")
                yield pa.RecordBatch.from_arrays([shard.slice(low, len(counts)), *(c.slice(low, len(counts)) for c in batch.columns[:2]), payload], ["shard", "doc_id", "n_tokens", "payload"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (b for b in batches if b.num_rows)
        if (first := next(given, None)) is None:
            return
        number = first.column(0)[0].as_py()
        uri = f"{folder}/shard-{number:06d}.tok"
        rows = ((b.column(1).fill_null(NULL_ID).to_numpy(), b.column(2).to_numpy(), b.column(3)) for part in ([first], given) for b in part)
        n_docs, n_tokens, size = write_shard(uri, rows)
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": uri, "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": size}])

    written = (
        staged.where("n_tokens is not null").select("doc_id", "n_tokens", "raw")
        .mapInArrow(recode, "shard int, doc_id long, n_tokens long, payload binary")
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("doc_id", "payload")
        .mapInArrow(save, "shard long, path string, n_docs long, n_tokens long, n_bytes long")
    )
    manifest = sorted((r.asDict() for r in written.collect()), key=lambda r: r["shard"])
    shared.remove(spark, scratch)
    start = 0
    for m in manifest:
        m["start"], start = start, start + m["n_tokens"]
    return manifest


def _column(values: tuple) -> pa.Array:
    return pa.array(list(values), pa.list_(pa.int64()) if isinstance(values[0], np.ndarray) else pa.int64())


def _read(spark: SparkSession, folder: str, manifest: list[dict], each, schema: str) -> DataFrame:
    """each(doc_id, start, ids) of every document in the shards, as rows: a task per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        columns = [c.split()[0] for c in schema.split(", ")]
        release()
        for batch in batches:
            ranks = load_ranks(folder) if ranks is None else ranks
            for m in batch.to_pylist():
                start, rows, held = m["start"], [], 0
                for doc_id, ids in read_shard(m["path"], ranks):
                    rows.append(each(None if doc_id == NULL_ID else doc_id, start, ids))
                    start, held = start + len(ids), held + len(ids)
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([_column(c) for c in zip(*rows, strict=True)], columns)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([_column(c) for c in zip(*rows, strict=True)], columns)

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(run, schema)


def read_corpus(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, decoded from the shards."""
    return _read(spark, folder, manifest, lambda i, start, ids: (i, start, len(ids), ids.astype(np.int64)), "doc_id long, start long, n_tokens long, ids array<long>")


def corpus_digest(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids) of each document in the files."""
    return _read(spark, folder, manifest, lambda i, start, ids: (i, start, len(ids), zlib.crc32(ids.astype("<u4"))), "doc_id long, start long, n_tokens long, ids_crc32 long")
