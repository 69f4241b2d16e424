"""MinHash near-duplicates by an LSH forest of sorted signature orders.

1. Each document's distinct 5-word shingles are hashed (numpy, whole texts); 64
   minimum values of 16 bits are its signature. Documents with equal shingle
   sets form a class with its least doc_id as representative; only
   representatives go on.
2. Each of 20 trees takes 16 of the signature's values in its own order as a
   label. All (tree, label) rows are sorted by range, and a task walks its
   sorted rows: a document's candidates are its neighbours by longest common
   prefix. The depth adapts to the region: where at most 8 documents share two
   values all of them are candidates of each other; in denser regions only those
   that share so long a prefix that at most 8 do, and always the direct
   neighbour. Rows at the borders of tasks are looked at in a second, small step.
3. Candidates whose set sizes or signatures rule out the similarity are left
   out; the rest is confirmed on the full sets, recomputed from the texts. First
   each document's most promising pairs are confirmed and joined to components;
   then all other pairs that lie between components, so that no pair is passed
   over but those within a component, which can't change it.
4. Regions of more than 8 documents that still lie in several components are
   compared whole, in pairs of blocks, except blocks within one component. Of a
   region of several blocks, members that share too few shingles with others to be
   linked with any are left out before: a shingle's least and greatest doc_id tell
   whether it is shared, so that this grows with the texts. Blocks meet first by
   signatures, which leaves members with a likely partner in another component;
   then those members' full sets meet, hubs (whose signatures agree most with the
   others') first. A task joins components as it finds links and hands on the links
   that joined them, at most one a member, so that no table of a region's pairs is
   ever made.

Null or empty texts have no set and are linked with nothing. Texts of fewer than
five words have one shingle, the whole sequence. A null doc_id is never linked.
Rows with one doc_id and different texts are joined through the doc_id: a link of
any of its texts is the id's. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm import shared, textkit
from quireflow.llm.components import components

SIGNATURE = 64
TREES = 20
DEPTH = 16
#: Values that a candidate shares at least, and documents of a region that are all compared.
LEAST_PREFIX, REGION = 2, 8
#: Documents of a crowded region that a task compares with as many others, and hubs of so many documents.
BLOCK, HUBS = 1_000, 4
#: Shingles of a block, about: texts longer than that have blocks to themselves.
BLOCK_SHINGLES = 1_000_000
#: Chance that the signatures of a pair of just the threshold's similarity rule it out.
MISSED = 1e-11
_RANDOM = np.random.RandomState(811)
_MULTIPLIERS = _RANDOM.randint(1, 1 << 62, SIGNATURE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.randint(0, 1 << 62, SIGNATURE).astype(np.uint64)
#: Each tree starts with values that no other tree starts with, as far as they go.
_ORDERS = np.array([np.concatenate([np.arange(3 * t, 3 * t + 3) % SIGNATURE, _RANDOM.permutation(np.setdiff1d(np.arange(SIGNATURE), np.arange(3 * t, 3 * t + 3) % SIGNATURE))[: DEPTH - 3]]) for t in range(TREES)])
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, and how many each text has."""
    lowered = textkit.LOWER[data]
    starts, ends, first = textkit.word_spans(lowered, offsets)
    words = textkit.span_hashes(lowered, starts, ends)
    n = np.diff(first)
    width = np.minimum(n, size)
    counts = np.where(n > 0, n - width + 1, 0)
    row = textkit.rows_of(counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row]
    hashes = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = k < width[row]
        hashes[inside] += words[at[inside] + k] * _WEIGHTS[k]
    hashes = textkit.mix(hashes + width[row].astype(np.uint64))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signature (16-bit minimum values) of each non-empty set."""
    begins = (np.cumsum(counts) - counts)[counts > 0]
    if not len(begins):
        return np.zeros((0, SIGNATURE), np.uint16)
    return np.stack([textkit.mix(np.minimum.reduceat(hashes * a + b, begins)) >> np.uint64(48) for a, b in zip(_MULTIPLIERS, _ADDENDS, strict=True)], axis=1).astype(np.uint16)


def features(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a digest of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.column_buffer(batch.column(1))
            for low, high in textkit.row_slices(offsets):
                hashes, counts = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                full = counts > 0
                d1, d2 = np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)
                if full.any():
                    begins = (np.cumsum(counts) - counts)[full]
                    d1[full] = np.add.reduceat(hashes, begins)
                    d2[full] = np.bitwise_xor.reduceat(textkit.mix(hashes * _WEIGHTS[0]), begins)
                raw = np.empty(high - low, object)
                raw[full] = [s.tobytes() for s in signatures(hashes, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def _labelled(representatives: DataFrame) -> DataFrame:
    """tree, l0..l3 (the label's 16 values of 16 bits), doc_id, n_shingles: a row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, SIGNATURE)
            for tree, order in enumerate(_ORDERS):
                packed = np.ascontiguousarray(values[:, order].astype(">u2")).view(">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), tree, np.int32)), *(pa.array(packed[:, k]) for k in range(4)), batch.column(0), batch.column(1)], ["tree", "l0", "l1", "l2", "l3", "doc_id", "n"])

    return representatives.select("doc_id", "n_shingles", "signature").mapInArrow(run, "tree int, l0 long, l1 long, l2 long, l3 long, doc_id long, n long")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that labels a and b (rows of four int64) have in common from the start."""
    differ = (np.ascontiguousarray(a.astype(">i8")).view(">u2") != np.ascontiguousarray(b.astype(">i8")).view(">u2")).reshape(len(a), DEPTH)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), DEPTH)


def neighbours(tree: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (earlier, later) of candidates among sorted rows."""
    n = len(tree)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lcp = np.where(tree[1:] == tree[:-1], _common(labels[1:], labels[:-1]), 0)
    padded = np.concatenate([np.zeros(REGION, np.int64), lcp, np.zeros(REGION, np.int64)])
    # the longest prefix that some REGION + 1 documents around a position share; a deeper one has few enough
    windows = np.lib.stride_tricks.sliding_window_view(padded, REGION).min(axis=1)
    crowded = np.lib.stride_tricks.sliding_window_view(windows, REGION + 1).max(axis=1)[:n]
    depth = np.maximum(LEAST_PREFIX, crowded + 1)
    first, second, shared_prefix = [], [], np.full(n - 1, DEPTH)
    for k in range(1, min(REGION, n)):
        shared_prefix = np.minimum(shared_prefix[: n - k], lcp[k - 1 :])
        good = shared_prefix >= (LEAST_PREFIX if k == 1 else np.minimum(depth[: n - k], depth[k:]))
        at = np.flatnonzero(good)
        first.append(at)
        second.append(at + k)
    return np.concatenate(first), np.concatenate(second)


_PAIR = "a long, b long, edge int, side int, tree int, l0 long, l1 long, l2 long, l3 long, n long"


def _paired(columns: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray, threshold: int) -> list[tuple]:
    """(lesser id, greater id) of the candidates whose sizes allow a similarity of the threshold."""
    n, ids = columns["n"], columns["doc_id"]
    fits = (100 * np.minimum(n[first], n[second]) >= threshold * np.maximum(n[first], n[second])) & (ids[first] != ids[second])
    a, b = ids[first[fits]], ids[second[fits]]
    return np.minimum(a, b), np.maximum(a, b)


def candidates(representatives: DataFrame, rows: int, threshold: int) -> DataFrame:
    """Distinct pairs a < b with the number of trees in which they were found."""
    spark = representatives.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * TREES // 500_000))
    names = ["tree", "l0", "l1", "l2", "l3", "doc_id", "n"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs; and the first and last rows of the task, marked with the border they lie at."""
        task, kept, outer = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_ = pa.Table.from_batches([batch])
            fresh = {c: rows_[c].to_numpy() for c in names}
            if outer is None:
                outer = {c: v[:REGION] for c, v in fresh.items()}
            elif len(outer["n"]) < REGION:
                outer = {c: np.concatenate([outer[c], v])[:REGION] for c, v in fresh.items()}
            now = fresh if kept is None else {c: np.concatenate([kept[c], v]) for c, v in fresh.items()}
            first, second = neighbours(now["tree"], np.stack([now[f"l{k}"] for k in range(4)], axis=1))
            if kept is not None:  # those among the kept rows are known
                new = second >= len(kept["n"])
                first, second = first[new], second[new]
            a, b = _paired(now, first, second, threshold)
            yield _pairs(a, b)
            kept = {c: v[-2 * REGION :] for c, v in now.items()}
        if kept is not None:
            yield _borders(outer, task - 1, 1)
            yield _borders({c: v[-REGION:] for c, v in kept.items()}, task, 0)

    def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        whole = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), whole, whole, whole, empty, empty, empty, empty, empty], [c.split()[0] for c in _PAIR.split(", ")])

    def _borders(rows_: dict, border: int, side: int) -> pa.RecordBatch:
        m = len(rows_["n"])
        return pa.RecordBatch.from_arrays([pa.array(rows_["doc_id"]), pa.nulls(m, pa.int64()), pa.array(np.full(m, border, np.int32)), pa.array(np.full(m, side, np.int32)), pa.array(rows_["tree"].astype(np.int32)), *(pa.array(rows_[f"l{k}"]) for k in range(4)), pa.array(rows_["n"])], [c.split()[0] for c in _PAIR.split(", ")])

    def across(key: tuple, table: pa.Table) -> pa.Table:
        """Candidates of one border: at most REGION rows of either side."""
        table = table.sort_by([(c, "ascending") for c in ("side", "tree", "l0", "l1", "l2", "l3", "a")])
        rows_ = {c: table["a" if c == "doc_id" else c].to_numpy() for c in names}
        first, second = neighbours(rows_["tree"], np.stack([rows_[f"l{k}"] for k in range(4)], axis=1))
        side = table["side"].to_numpy()
        over = side[first] != side[second]
        a, b = _paired(rows_, first[over], second[over], threshold)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    walked = shared.stored(
        _labelled(representatives).repartitionByRange(n_tasks, *names[:6]).sortWithinPartitions(*names[:6]).mapInArrow(walk, _PAIR), "forest"
    )
    border = walked.where("edge >= 0").groupBy("edge").applyInArrow(across, "a long, b long")
    return walked.where("edge is null").select("a", "b").union(border).groupBy("a", "b").agg(F.count("*").alias("n_trees"))


def least_estimate(threshold: int) -> float:
    """Estimated similarity below which a candidate isn't confirmed (binomial)."""
    t, below = threshold / 100, 0.0
    for k in range(SIGNATURE + 1):
        below += comb(SIGNATURE, k) * t**k * (1 - t) ** (SIGNATURE - k)
        if below > MISSED:
            return k / SIGNATURE
    return 1.0


def _estimated(pairs: DataFrame, representatives: DataFrame, threshold: int) -> DataFrame:
    """a, b, estimate: pairs that the signatures don't rule out."""
    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for k in (2, 3))
            estimate = (one == other).mean(axis=1)
            good = np.flatnonzero(estimate >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(estimate[good])], ["a", "b", "estimate"])

    signed = representatives.select("doc_id", "signature")
    joined = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for k in (2, 3):
                data, offsets = textkit.column_buffer(batch.column(k))
                sets.append([np.split(h, np.cumsum(c)[:-1]) for low, high in textkit.row_slices(offsets) for h, c in [shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])]])
            one, other = ([x for part in s for x in part] for s in sets)
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, other, strict=True)]
            good = pa.array([i for i, (x, y, n) in enumerate(zip(one, other, common, strict=True)) if 100 * n >= threshold * (len(x) + len(y) - n)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["a", "b"])

    # merge joins at every size: broadcast sides would change the plan between small and large tables
    joined = pairs.select("a", "b").join(texts.toDF("a", "ta").hint("merge"), "a").join(texts.toDF("b", "tb").hint("merge"), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def crowds(representatives: DataFrame) -> DataFrame:
    """crowd, doc_id, size: the members of the regions (tree and first two values) of more than REGION documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SIGNATURE).astype(np.int64)
            for tree, order in enumerate(_ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(tree << 32 | values[:, order[0]] << 16 | values[:, order[1]]), batch.column(0), batch.column(2)], ["crowd", "doc_id", "size"])

    rows = representatives.select("doc_id", "signature", "n_shingles").mapInArrow(run, "crowd long, doc_id long, size long")
    return rows.withColumn("m", F.count("*").over(Window.partitionBy("crowd"))).where(F.col("m") > REGION).select("crowd", "doc_id", "size")


def _blocks() -> Column:
    """Blocks of a region of m members with total shingles."""
    return F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")


def _several(rows: DataFrame) -> DataFrame:
    """The rows of the regions that lie in several components, with m and total."""
    whole = Window.partitionBy("crowd")
    spread = {"least": F.min("component").over(whole), "most": F.max("component").over(whole), "m": F.count("*").over(whole), "total": F.sum("size").over(whole)}
    return rows.select("crowd", "doc_id", "component", "size").withColumns(spread).where("least != most").drop("least", "most")


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """doc_id, n (shingles), common (those that another doc_id of sets has too); of several texts of a doc_id, the least n and all that are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shingle of some documents."""
        for batch in batches:
            found = batch.column(1).to_pylist()
            offsets = np.cumsum([0, *(len(x) for x in found)])
            for low, high in textkit.row_slices(offsets):
                hashes = np.frombuffer(b"".join(found[low:high]), np.int64)
                ids = np.repeat(batch.column(0).slice(low, high - low).to_numpy(), np.diff(offsets[low : high + 1]) // 8)
                order = np.lexsort((ids, hashes))
                hashes, ids = hashes[order], ids[order]
                begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[begins]), pa.array(ids[begins]), pa.array(ids[np.append(begins[1:], len(ids)) - 1])], ["shingle", "least", "most"])

    shingles = sets.select("doc_id", "shingles").mapInArrow(run, "shingle long, least long, most long")
    own = shingles.groupBy("shingle").agg(F.min("least").alias("doc_id"), F.max("most").alias("most")).where("doc_id = most").groupBy("doc_id").agg(F.count("*").alias("own"))
    n = (F.length("shingles") / 8).cast("long")
    counts = sets.groupBy("doc_id").agg(F.min(n).alias("n"), F.sum(n).alias("all")).join(own, "doc_id", "left")
    return counts.select("doc_id", "n", (F.col("all") - F.coalesce("own", F.lit(0))).alias("common"))


def _linkable(rows: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """The rows that have a row in their region with which sizes and common shingles allow a link.

    Two sets share no more than the lesser number of common shingles, so a link needs
    (100 + t) * least(common) >= t * (sum of n). Partners with more common shingles are
    judged by the least n among them, others by the best balance among them.
    """
    t = threshold
    rows = rows.join(counts, "doc_id").withColumn("balance", (100 + t) * F.col("common") - t * F.col("n"))
    more = Window.partitionBy("crowd").orderBy(F.desc("common")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    less = Window.partitionBy("crowd").orderBy("common").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"shortest": F.min("n").over(more), "best": F.max("balance").over(less)})
    return rows.where((F.col("balance") >= t * F.col("shortest")) | (F.col("best") >= t * F.col("n")))


def _divided(crowded: DataFrame, joined: DataFrame, representatives: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """crowd, doc_id, component, n, signature, block, low, high: the members of the regions in several components, a row for each pair of blocks.

    Of regions of several blocks, members that no member can be linked with are left out
    first; blocks within one component don't meet.
    """
    rows = crowded.join(joined.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    one = _several(rows).groupBy("crowd", "doc_id", "component", "m", "total").agg(F.sum("size").alias("size"))
    rows = shared.stored(one.withColumn("blocks", _blocks()), "divided")
    large = rows.where("blocks > 1")
    if not large.isEmpty():
        sets = shared.stored(_sets(texts.join(large.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")), "divided-sets")
        large = shared.stored(_several(_linkable(large, _shared_shingles(sets), threshold)), "linkable")
        rows = rows.where("blocks = 1").drop("blocks").unionByName(large)
    at = F.row_number().over(Window.partitionBy("crowd").orderBy(F.xxhash64("component"), "component", F.xxhash64("doc_id"))) - 1
    rows = rows.withColumn("blocks", _blocks()).withColumn("block", F.floor(at * F.col("blocks") / F.col("m")).cast("int"))
    inside = Window.partitionBy("crowd", "block")
    rows = rows.withColumn("pure", F.min("component").over(inside) == F.max("component").over(inside))
    alike = Window.partitionBy("crowd", "component", "pure")
    rows = rows.withColumns({"first": F.min("block").over(alike), "last": F.max("block").over(alike)})
    rows = rows.join(representatives.select("doc_id", F.col("n_shingles").alias("n"), "signature"), "doc_id")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: ~(F.col("pure") & k.between(F.col("first"), F.col("last"))))
    rows = rows.withColumn("other", F.explode(others)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return rows.select("crowd", "doc_id", "component", "block", "low", "high", "n", "signature")


def _likely(i: int, other: np.ndarray, component: np.ndarray, n: np.ndarray, values: np.ndarray, earlier: list[np.ndarray], threshold: int, least: float) -> np.ndarray:
    """Those of other, likeliest first, that lie in another component than i, in no earlier common region, and that sizes and signatures don't rule out."""
    at = other[(component[other] != component[i]) & (100 * np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i]))]
    for region in earlier:  # an earlier common region is one of few documents, or compares them
        if not len(at):
            return at
        at = at[region[at] != region[i]]
    estimate = (values[at] == values[i]).mean(axis=1)
    return at[np.argsort(-estimate, kind="stable")][: np.count_nonzero(estimate >= least)]


def _earlier(values: np.ndarray, tree: int) -> list[np.ndarray]:
    """The regions of the trees before one."""
    return [values[:, order[0]].astype(np.uint32) << 16 | values[:, order[1]] for order in _ORDERS[:tree]]


def _promising(members: DataFrame, threshold: int) -> DataFrame:
    """crowd, low, high, doc_id, component, block: the members with a likely partner in another component."""
    least = least_estimate(threshold)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        component, n, block = (table[c].to_numpy() for c in ("component", "n", "block"))
        values = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SIGNATURE)
        earlier, wanted = _earlier(values, key[0].as_py() >> 32), np.zeros(len(n), bool)
        other = np.flatnonzero(block == key[2].as_py())
        for i in np.flatnonzero(block == key[1].as_py()).tolist():
            at = _likely(i, other, component, n, values, earlier, threshold, least)
            if len(at):
                wanted[i] = wanted[at] = True
        return table.select(["crowd", "low", "high", "doc_id", "component", "block"]).filter(pa.array(wanted))

    return members.groupBy("crowd", "low", "high").applyInArrow(compare, "crowd long, low int, high int, doc_id long, component long, block int").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """doc_id, shingles (the sorted hashes of the set) of non-empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.column_buffer(batch.column(1))
            for low, high in textkit.row_slices(offsets):
                hashes, counts = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                sets = pa.array([x.tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sets], ["doc_id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary").where(F.length("shingles") > 0)


def _divided_links(promising: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """a < b: links between a region's components, confirmed on full sets; of links that join the same components, one."""
    least = least_estimate(threshold)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        ids, component, block = (table[c].to_numpy() for c in ("doc_id", "component", "block"))
        component = component.copy()
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        hashes = np.concatenate(sets)
        values = signatures(hashes, n)
        known, codes = np.unique(hashes, return_inverse=True)
        codes, marked = np.split(codes, np.cumsum(n)[:-1]), np.zeros(len(known), bool)
        agreeing = np.zeros(len(n), np.int64)
        for k in range(SIGNATURE):
            _, at, times = np.unique(values[:, k], return_inverse=True, return_counts=True)
            agreeing += times[at]
        earlier = _earlier(values, key[0].as_py() >> 32)
        blocks = [np.flatnonzero(block == k.as_py()) for k in (key[1], key[2])]
        hubs = np.lexsort((ids, -agreeing))[:HUBS]
        turns = [(i, blocks[0 if block[i] == key[2].as_py() else 1]) for i in hubs.tolist()] + [(i, blocks[1]) for i in blocks[0].tolist()]
        a, b = [], []
        for i, other in turns:
            at = _likely(i, other, component, n, values, earlier, threshold, least)
            if not len(at):
                continue
            marked[codes[i]] = True
            for j in at.tolist():
                if component[j] != component[i]:
                    common = np.count_nonzero(marked[codes[j]])
                    if 100 * common >= threshold * (n[i] + n[j] - common):
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
                        component[component == component[j]] = component[i]
            marked[codes[i]] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = shared.stored(_sets(texts.join(promising.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")), "crowd-sets")
    return promising.join(sets.hint("merge"), "doc_id").groupBy("crowd", "low", "high").applyInArrow(link, "a long, b long")


def _joined(joined: DataFrame, more: DataFrame) -> DataFrame:
    """Components of the components and further links."""
    return shared.stored(components(joined.where("node != component").toDF("v", "u").select("u", "v").union(more.toDF("u", "v"))), "joined")


def _through_ids(membership: DataFrame) -> DataFrame:
    """Links between the representatives of the different texts of one doc_id."""
    named = membership.where("doc_id is not null and representative is not null").select("doc_id", "representative")
    several = named.groupBy("doc_id").agg(F.min("representative").alias("a"), F.max("representative").alias("most")).where("a != most").select("doc_id", "a")
    return named.join(several, "doc_id").where("a != representative").select("a", F.col("representative").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs."""
    found = shared.stored(features(docs, id_column, text_column), "shingles")
    classes = shared.stored(
        found.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("representative")), "classes"
    )
    keys = ["n_shingles", "d1", "d2"]
    representatives = shared.stored(
        found.where("n_shingles > 0").join(classes, [found[k].eqNullSafe(classes[k]) for k in keys] + [found["doc_id"] == classes["representative"]], "left_semi").dropDuplicates(["doc_id", *keys]), "representatives"
    )
    # Rows with one id and different sets, and pairs with an id of their own
    pairs = shared.stored(_estimated(candidates(representatives, representatives.count(), threshold), representatives, threshold), "candidates")
    crowded = shared.stored(crowds(representatives), "crowds")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(crowded.select("doc_id")).distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    texts = shared.stored(texts.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    # first: each document's two likeliest pairs and its pair with the least id
    of = F.struct(F.col("estimate"), (-F.col("a")).alias("at"))
    best = pairs.groupBy("b").agg(F.max(of).alias("x"), F.min("a").alias("least"))
    first = best.select((-F.col("x.at")).alias("a"), "b").union(best.select(F.col("least").alias("a"), "b"))
    best = pairs.groupBy("a").agg(F.max(F.struct(F.col("estimate"), (-F.col("b")).alias("at"))).alias("x"))
    first = shared.stored(first.union(best.select("a", (-F.col("x.at")).alias("b"))).distinct(), "first-pairs")
    edges = shared.stored(_confirmed(first, texts, threshold), "links")
    joined = shared.stored(components(edges.toDF("u", "v")), "joined")
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        rest = rest.join(joined.toDF(side, f"c{side}"), side, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = shared.stored(_confirmed(shared.stored(rest, "rest-pairs"), texts, threshold), "more-links")
    membership = found.join(classes, keys, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("representative")).alias("representative"))
    more = more.union(_through_ids(membership))
    promising = shared.stored(_promising(_divided(crowded, joined, representatives, texts, threshold), threshold), "promising")
    joined = _joined(joined, more.union(shared.stored(_divided_links(promising, texts, threshold), "crowd-links")))
    result = membership.join(joined.toDF("representative", "component"), "representative", "left")
    component = F.coalesce("component", "representative", "doc_id")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
