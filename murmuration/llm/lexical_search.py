"""Ranked lexical search with a hierarchy of maxima over document ranges.

Every document becomes (term, count) pairs of the terms that the queries hold; ranges of documents are rows of a
written index. A search task stacks ranges to a tree: for every term the maximum of its score over each range, over
groups of ranges, and over the tree's root. For a query the terms' maxima at a node sum to a bound on the score of any
document below it. Nodes are opened best first; a node whose bound equals the k-th score is still opened, as ties go to
the smaller id, and the descent ends at the first bound below it. What a task has found so far is the threshold
of its next tree, and a bounded sample of the index gives every task its first ones.

Queries come in blocks of bounded number and size, so that a block's terms fit every task; each block runs over
the whole index. A task hands k rows per query on, and a ranked window keeps the k best.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.llm import scratch
from murmuration.llm.text_blocks import frugal

#: Documents and (term, count) pairs of a range; ranges of a node, of a tree, and pairs of a tree.
RANGE, RANGE_PAIRS, FAN, TREE, TREE_PAIRS = 64, 1 << 15, 8, 64, 1 << 20
#: Ranges that give the first thresholds; queries and bytes of queries of a block; bytes of text split at a time.
SAMPLE, QUERIES, QUERY_BYTES, WINDOW = 64, 1000, 1 << 20, 1 << 20
#: Bytes of terms stay (A-Z as a-z), all others part terms; every byte of a character above 127 is a term's.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Stands for a null id while ids are compared; a document of this very id comes out with a null one.
_NO_ID = (1 << 63) - 1


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at, text = 0, text or b""
    while at < len(text):
        part = text[at : at + WINDOW].translate(_FOLD)
        if at + WINDOW < len(text) and (cut := part.rfind(b" ") + 1):
            part = part[:cut]  # else one term is longer than a window: the text is then split whole
        elif at + WINDOW < len(text):
            part = text[at:].translate(_FOLD)
        at += len(part)
        yield part.split()


def _ids(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())


def index(documents: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of documents in the order in which they are read: how many of them have terms, their terms with repeats,
    and for each document that holds a term of the vocabulary its id, its number of terms, and its (term, count) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, ids, sizes, ends, held, counts = 0, 0, [], [], [], [], []

        def row() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((ids, pa.int64()), (sizes, pa.int64()), (ends, pa.int32()), (held, pa.int32()), (counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([known], pa.int64()), pa.array([total], pa.int64()), *lists], ["known", "total", "ids", "sizes", "ends", "terms", "counts"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc, value in zip(_ids(batch.column("id")).to_pylist(), texts, strict=True):
                n, found = 0, Counter()
                for some in terms(value.as_py()):
                    n += len(some)
                    found.update(filter(None, map(vocabulary_of, some)))
                known, total = known + (n > 0), total + n
                if found:
                    ids.append(doc)
                    sizes.append(n)
                    held += [t - 1 for t in found]
                    counts += found.values()
                    ends.append(len(held))
                if len(ids) >= RANGE or len(held) >= RANGE_PAIRS:
                    yield row()
                    known, total, ids, sizes, ends, held, counts = 0, 0, [], [], [], [], []
        if known:
            yield row()

    vocabulary_of = {t: i + 1 for t, i in vocabulary.items()}.get
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "known bigint, total bigint, ids array<bigint>, sizes array<bigint>, ends array<int>, terms array<int>, counts array<bigint>")


class Tree:
    """A tree over consecutive ranges: node n of level l covers nodes FAN * n to FAN * n + FAN - 1 of level l + 1."""

    def __init__(self, ranges: list[dict], weights: np.ndarray, known: int, total: int):
        sizes = np.concatenate([r["sizes"] for r in ranges])
        self.ids = np.concatenate([r["ids"] for r in ranges])
        docs = np.repeat(np.arange(len(sizes)), np.concatenate([np.diff(r["ends"], prepend=0) for r in ranges]))
        held, counts = (np.concatenate([r[x] for r in ranges]) for x in ("terms", "counts"))
        m = 50 + (50 * sizes * known) // total
        self.scores = weights[held] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[docs]))
        self.terms, self.column = np.unique(held, return_inverse=True)
        self.docs = docs
        self.first_doc = np.concatenate([[0], np.cumsum([len(r["ids"]) for r in ranges])])
        self.first_pair = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in ranges])])
        lowest = np.zeros((len(self.terms), len(ranges)), np.int64)
        np.maximum.at(lowest, (self.column, np.repeat(np.arange(len(ranges)), np.diff(self.first_pair))), self.scores)
        self.levels = [lowest]
        while self.levels[0].shape[1] > 1:
            self.levels.insert(0, np.maximum.reduceat(self.levels[0], np.arange(0, self.levels[0].shape[1], FAN), axis=1))
        self.asked = np.zeros(len(self.terms), np.int64)

    def search(self, query: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, least: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k best (scores, ids) of this tree and of `best`, and the number of ranges scored; `least` is a score that
        k documents are known to reach."""
        at = np.searchsorted(self.terms, query)
        rows = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == query)]
        if not len(rows):
            return best, 0
        scored = 0
        self.asked[rows] = 1
        heap = [(-int(self.levels[0][rows, 0].sum()), 0, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            floor = max(1, least, int(best[0][-1]) if len(best[0]) == k else 1)
            if -bound < floor:
                break
            if level + 1 < len(self.levels):
                below = self.levels[level + 1]
                children = range(node * FAN, min(node * FAN + FAN, below.shape[1]))
                for child, b in zip(children, below[rows, children.start : children.stop].sum(0).tolist(), strict=True):
                    if b >= floor:
                        heapq.heappush(heap, (-b, level + 1, child))
                continue
            scored += 1
            pairs = slice(self.first_pair[node], self.first_pair[node + 1])
            docs = slice(self.first_doc[node], self.first_doc[node + 1])
            own = np.bincount(self.docs[pairs] - docs.start, self.scores[pairs] * self.asked[self.column[pairs]], docs.stop - docs.start).astype(np.int64)
            near = np.flatnonzero(own >= floor)
            if len(near):
                s, i = np.concatenate([best[0], own[near]]), np.concatenate([best[1], self.ids[docs][near]])
                top = np.lexsort((i, -s))[:k]
                best = s[top], i[top]
        self.asked[rows] = 0
        return best, scored


def _trees(batches: Iterator[pa.RecordBatch], weights: np.ndarray, known: int, total: int) -> Iterator[Tree]:
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {x: batch.column(x)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for x in ("sizes", "ends", "terms", "counts")}
            row["ids"] = batch.column("ids")[k].values.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            if not len(row["ids"]):
                continue
            held.append(row)
            if len(held) == TREE or sum(len(r["terms"]) for r in held) >= TREE_PAIRS:
                yield Tree(held, weights, known, total)
                held = []
    if held:
        yield Tree(held, weights, known, total)


def _found(ranges: DataFrame, queries: list[np.ndarray], weights: np.ndarray, known: int, total: int, k: int, least: list[int]) -> DataFrame:
    """query (its number), doc_id, score of each task's k best, and a row without score: the ranges it scored of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best, scored, there = [(none, none)] * len(queries), [0] * len(queries), 0
        for tree in _trees(batches, weights, known, total):
            there += tree.levels[-1].shape[1]
            for n, q in enumerate(queries):
                best[n], more = tree.search(q, best[n], k, least[n])
                scored[n] += more
        for n, (s, i) in enumerate(best):
            if there:
                docs = [None if x == _NO_ID else x for x in i.tolist()]
                more = len(docs)
                columns = [[n] * (more + 1), [*docs, None], [*s.tolist(), None], [None] * more + [there], [None] * more + [scored[n]]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["query", "doc_id", "score", "ranges", "scored"])

    return ranges.mapInArrow(frugal(run), "query int, doc_id bigint, score bigint, ranges bigint, scored bigint")


def _blocks(items: DataFrame) -> Iterator[list]:
    """The queries in blocks, a block at a time on the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append(r)
        size += len(r.text or "")
        if len(block) == QUERIES or size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(documents: DataFrame, items: DataFrame, k: int, id_col: str, text: str, item_col: str, item_text: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For every block of queries what `_found` returns, and (query, item_id)."""
    spark = documents.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).distinct().orderBy("item", "text")
    for block in _blocks(asked):
        own = [sorted({t for some in terms((r.text or "").encode()) for t in some}) for r in block]
        vocabulary = {t: n for n, t in enumerate(sorted({t for q in own for t in q}))}
        queries = [np.array([vocabulary[t] for t in q], np.int64) for q in own]
        ranges = scratch.materialize(index(documents, vocabulary, id_col, text), "lexical-index")
        known, total = ranges.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        df = ranges.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each of the block's terms
        weights = np.zeros(len(vocabulary), np.int64)
        for r in df:
            weights[r.term] = math.floor(1000 * math.log((2 * known + 2) / (2 * r["count"] + 1)))
        # the ranges of least hash; only hashes are sorted
        key = F.xxhash64("ids", "sizes")
        cut = ranges.select(key.alias("key")).orderBy("key").limit(SAMPLE + 1).agg(F.max("key").alias("last"), F.count("*").alias("n")).first()
        some = (ranges.filter(key < cut.last) if cut.n > SAMPLE else ranges).coalesce(1)
        least = [0] * len(queries)
        ranked = _found(some, queries, weights, known, max(total, 1), k, least).filter(F.col("score").isNotNull())
        for r in ranked.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n")).collect():
            least[r["query"]] = r.score if r.n >= k else 0
        names = spark.createDataFrame([(n, r.item) for n, r in enumerate(block)], f"number int, item_id {kind}")
        yield _found(ranges, queries, weights, known, max(total, 1), k, least), names


@scratch.sized
def rank(documents: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: every item's k documents of highest score above 0.

    Terms are maximal runs of letters, digits and characters above 127, only A-Z lower-cased; each of an item's terms
    counts once. Null and empty texts have no term: such documents don't count, such items have no rows. Documents that
    repeat an id are documents each. Rows of items that are wholly equal are one; items of one id with different texts
    are ranked apart, under that id. Equal scores by rising doc_id, nulls last. Empty tables give no rows. Only the
    named columns are read, whatever the others are called.
    """
    kind = items.schema[item_col].dataType.simpleString()
    out = documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for found, names in _search(documents, items, k, id_col, text, item_col, item_text):
        order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.filter(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best.join(F.broadcast(names), F.col("query") == F.col("number"))  # a block's numbers and ids
        out = out.unionByName(scratch.materialize(best.select("item_id", "rank", "doc_id", "score"), "lexical-ranks"))
    return out


def pruning(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, ranges, scored: the ranges of documents there are, and those that the search of `rank` scores."""
    out = documents.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, ranges bigint, scored bigint")
    for found, names in _search(documents, items, k, "doc_id", "text", "item_id", "text"):
        sums = found.filter(F.col("score").isNull()).groupBy("query").agg(F.sum("ranges").alias("ranges"), F.sum("scored").alias("scored"))
        out = out.unionByName(sums.join(F.broadcast(names), F.col("query") == F.col("number")).select("item_id", "ranges", "scored"))
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
                  row_number() OVER () AS row FROM documents),
d AS MATERIALIZED (SELECT doc_id, row, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
p AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, d.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * d.n * g.docs) // g.total))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row), g GROUP BY q.item_id, d.row, d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
