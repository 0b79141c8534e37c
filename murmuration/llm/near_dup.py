"""N-gram Jaccard join by MinHash banding with exact verification.

Documents with equal n-gram sets form a text class; only classes go on, so copies cost one row each.
A class's minima under `bands` x `rows` hash functions are folded into band hashes; bands and rows are
chosen for a target recall at the threshold. Classes that share a band hash are chained to the least of
them (never paired with each other), and the chains' components are the candidate sets: all pairs that
share any band lie inside one. Every pair inside a candidate set is then verified on the full n-gram
sets. A set of many classes is cut into blocks, and each pair of blocks is a task of its own, so that no
task holds an unbounded group; a class goes only to the blocks that hold one of the n-grams which any link of it
must share. What comes out is one row per class and task (its links and the root of its local component), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm import scratch
from murmuration.llm.components import connected_components
from murmuration.llm.text_blocks import blocks, frugal, mix64, shingle_hashes, words_of

#: Classes, and n-grams, that a block of a candidate set holds on average.
BLOCK_CLASSES, BLOCK_GRAMS = 384, 1 << 20
_COLUMNS = 4096
NODE = "struct<a:bigint,b:bigint>"


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for the fewest false candidates, that reach the recall at the
    threshold with no more than most_hashes hash functions."""
    best = None
    for rows in range(1, most_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hash functions")
    return best


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, hashes, nodes): distinct n-gram hashes of each row in order, row r owning first[r]:first[r + 1],
    and a 128-bit digest of each row's set as two columns."""
    words = words_of(column)
    rows = len(words.counts)
    row, h = shingle_hashes(words, n)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    first = np.searchsorted(row, np.arange(rows + 1))
    nodes = np.zeros((rows, 2), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            nodes[full, k] = np.add.reduceat(mix64(h ^ np.uint64(salt)), first[full])
    return first, h, nodes.view(np.int64)


def band_hashes(first: np.ndarray, h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of the rows that have n-grams."""
    full = first[:-1][np.diff(first) > 0]
    low = (h >> np.uint64(32)).astype(np.uint32)
    seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).astype(np.uint32)
    out = np.zeros((len(full), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            k = 2 * (b * rows + r)
            v = (low ^ seeds[k]) * (seeds[k + 1] | np.uint32(1))
            acc = mix64(acc * np.uint64(31) + np.minimum.reduceat(v, full))
        out[:, b] = acc
    return out.view(np.int64)


def _node_array(nodes: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(nodes[:, 0].copy()), pa.array(nodes[:, 1].copy())], ["a", "b"])


def sketch(docs: DataFrame, id_col: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, n_grams, node (digest of the set), bands; bands are null where there are no n-grams."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                first, h, nodes = gram_sets(part.column("text"), n)
                sizes = np.diff(first)
                full = sizes > 0
                values = band_hashes(first, h, bands, rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), _node_array(nodes), lists], ["id", "n_grams", "node", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(frugal(run), f"id {kind}, n_grams bigint, node {NODE}, bands array<bigint>")


def link_block(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: Fraction) -> np.ndarray:
    """Boolean matrix of the pairs (a x b; b None: a x a without the diagonal) that reach the threshold."""
    own = b is None
    sets = a if own else a + b
    sizes = np.array([len(s) for s in sets])
    column, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    # n-grams of one set alone are in no intersection
    shared = np.bincount(inverse, minlength=len(column)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    of, at = of[keep], number[inverse[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    cuts = np.searchsorted(at, np.arange(0, (at[-1] if len(at) else 0) + _COLUMNS + 1, _COLUMNS))
    inter = np.zeros((len(a), len(sets) if own else len(b)), np.float64)
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if lo < hi:
            m = np.zeros((len(sets), min(_COLUMNS, int(at[hi - 1]) - k * _COLUMNS + 1)), np.float32)
            m[of[lo:hi], at[lo:hi] - k * _COLUMNS] = 1
            inter += m[: len(a)] @ (m if own else m[len(a) :]).T
    union = sizes[: len(a), None] + (sizes if own else sizes[len(a) :])[None, :] - inter
    linked = threshold.denominator * inter >= threshold.numerator * union
    if own:
        np.fill_diagonal(linked, False)
    return linked


def _roots(links: np.ndarray) -> np.ndarray:
    """Of a symmetric link matrix: the first member of each node's component."""
    label = np.arange(len(links))
    u, v = np.nonzero(links)
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _verify(threshold: Fraction):
    """Streams rows sorted by (root, i, j) and yields, for each class with a link in its group, its links and root."""

    def group(t: pa.Table) -> pa.RecordBatch | None:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        block, copies = t.column("block").to_numpy(), t.column("copies").to_numpy()
        nodes = t.column("node").combine_chunks()
        order = np.argsort(block != i, kind="stable")
        sets = [np.frombuffer(s, np.uint64) for s in t.column("grams").take(pa.array(order)).to_pylist()]
        copies, nodes = copies[order], nodes.take(pa.array(order))
        k = int((block == i).sum())
        if i == j:
            links = link_block(sets, None, threshold)
        elif 0 < k < len(sets):
            cross = link_block(sets[:k], sets[k:], threshold)
            links = np.zeros((len(sets), len(sets)), bool)
            links[:k, k:], links[k:, :k] = cross, cross.T
        else:
            return None
        some = np.flatnonzero(links.any(1))
        if not len(some):
            return None
        root = nodes.take(pa.array(_roots(links)))
        counts, docs = links.sum(1), links @ copies
        at = pa.array(some)
        return pa.RecordBatch.from_arrays([nodes.take(at), root.take(at), pa.array(counts[some].astype(np.int64)), pa.array(docs[some].astype(np.int64))], ["node", "hub", "links", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("root_a", "root_b", "i", "j")), strict=True))
            start = 0
            for at in range(len(keys) + 1):
                if at == len(keys) or keys[at] != last:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    if at < len(keys):
                        if held and (out := group(pa.Table.from_batches(held))):
                            yield out
                        held, start, last = [], at, keys[at]
        if held and (out := group(pa.Table.from_batches(held))):
            yield out

    return run


def _with_partners(full: DataFrame, threshold: Fraction) -> DataFrame:
    """full (node, root, blocks, block, grams, ...) and `others`: the blocks of its candidate set in which a class may have
    a link. Sets that reach the threshold share one of the first n - ceil(t * n) + 1 n-grams of each in any common
    order, here that of their hashes; so a class goes to the blocks of its first n-grams and no link is lost,
    but a long chain of classes is not copied to all blocks of its set."""
    large = full.filter(F.col("blocks") > 1).select("node", "root", "block", "grams")
    if not large.limit(1).count():
        return full.withColumn("others", F.array("block"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, np.int64) for s in batch.column("grams").to_pylist()]
            sizes = [len(s) + (-threshold.numerator * len(s) // threshold.denominator) + 1 for s in sets]
            row = pa.array(np.repeat(np.arange(len(sets)), sizes))
            gram = np.concatenate([s[:n] for s, n in zip(sets, sizes, strict=True)]) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("node", "root", "block")), pa.array(gram)], ["node", "root", "block", "gram"])

    at = large.mapInArrow(frugal(firsts), f"node {NODE}, root {NODE}, block int, gram bigint")
    met = at.groupBy("root", "gram").agg(F.collect_set("block").alias("met"))
    others = at.join(met, ["root", "gram"]).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set(F.array_sort("met")))).alias("others"))
    return full.join(others, "node", "left").withColumn("others", F.coalesce("others", F.array("block")))


@scratch.sized
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """One row per row of docs: id, class_id (least id of the documents that links connect), copy_of (least id
    with the same n-gram set), n_links (other documents at or above the threshold, copies included),
    n_text_links (different texts among them, as classes).

    Words are runs of `[^\\x20\\x09-\\x0D]`; a text of 1 to n-1 words has one n-gram, of all of them. Null,
    empty and blank texts have no n-grams, no links and a class of their own each, named by their id.
    Similarity exactly at the threshold links. Repeated rows are documents each. A null id sorts below
    no other: it names a class only if all its ids are null. Other columns are ignored. Texts of any length
    are compared whole. No rows give no rows.
    """
    bands, rows = choose_bands(threshold, recall)
    s = scratch.materialize(sketch(docs, id_col, text, n, bands, rows), "sketch")
    some = s.filter(F.col("n_grams") > 0)
    # equal sets have equal bands
    classes = scratch.materialize(some.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "classes")
    texts_n = classes.count()
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    chains = banded.join(hubs.select("band", "hub"), "band").select("node", "hub")
    roots = connected_components(chains, "node", "hub", bands * texts_n)
    members = roots.union(roots.select("root", "root").distinct())
    members = scratch.materialize(members.join(classes.drop("bands"), "node"), "members", texts_n)
    size = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    members = members.join(size, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                first, h, nodes = gram_sets(part.column("text"), n)
                wanted = part.column("node")
                # rows that only share an id with a class's document fall out here
                same = np.flatnonzero((wanted.field("a").to_numpy() == nodes[:, 0]) & (wanted.field("b").to_numpy() == nodes[:, 1]))
                grams = pa.array([h[first[r] : first[r + 1]].tobytes() for r in same], pa.binary())
                kept = [part.column(c).take(pa.array(same)) for c in ("node", "root", "copies", "blocks", "block")]
                yield pa.RecordBatch.from_arrays([*kept, grams], ["node", "root", "copies", "blocks", "block", "grams"])

    # one plan at every size: members grow with the corpus, so they are never broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(members.hint("merge"), F.col("id").eqNullSafe(F.col("rep"))).select("text", "node", "root", "copies", "blocks", "block")
    full = texts.mapInArrow(frugal(sets), f"node {NODE}, root {NODE}, copies bigint, blocks int, block int, grams binary")
    if docs.select(id_col).groupBy(id_col).count().filter("count > 1").limit(1).count():
        full = full.dropDuplicates(["node"])
    full = _with_partners(scratch.materialize(full, "sets"), Fraction(str(threshold)))
    full = full.withColumn("other", F.explode("others"))
    full = full.select(F.col("root.a").alias("root_a"), F.col("root.b").alias("root_b"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "grams")
    key = ["root_a", "root_b", "i", "j"]
    found = full.repartition(*key).sortWithinPartitions(*key).mapInArrow(frugal(_verify(Fraction(str(threshold)))), f"node {NODE}, hub {NODE}, links bigint, docs bigint")
    found = scratch.materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    forest = connected_components(found.select("node", "hub"), "node", "hub", texts_n)
    label = classes.select("node", "rep", "copies").join(links, "node", "left").join(forest, "node", "left")
    label = scratch.materialize(label.withColumn("root", F.coalesce("root", "node")), "labels", texts_n)
    least = label.groupBy("root").agg(F.min("rep").alias("class_id"))
    label = label.join(least, "root").select("node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("docs", F.lit(0)).alias("docs"), "class_id")
    out = some.select("id", "node").join(label, "node").select(F.col("id").alias(id_col), "class_id", F.col("rep").alias("copy_of"), (F.col("copies") - 1 + F.col("docs")).alias("n_links"), F.col("links").alias("n_text_links"))
    bare = s.filter(F.col("n_grams") == 0).select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return out.unionByName(bare)


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
