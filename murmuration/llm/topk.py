"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are dealt to chunks; inside a chunk they form document-range blocks (vectors in an order
that puts like ones together: halved again and again along their direction of most spread) with a forward
index, the block's rows, and the maximum and minimum of every term. For a query the terms' maxima sum to a bound
on any score in a block. Blocks are scored in order of their bounds until the next bound lies below the query's
k-th score so far, or below the k-th among a bounded sample of all candidates, which every chunk knows from the
start. Ties at the k-th score go to the smaller id, so a block whose bound equals it is still scored.

Queries are dealt to chunks as well: a task holds one chunk of each, whatever the tables' sizes.
Partial results have k rows per query and candidate chunk; a ranked window keeps the k best. `pruning` tells how
many blocks were scored: few where vectors cluster, nearly all where components are independent noise, as the
sum of maxima then lies far above any score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.llm import scratch
from murmuration.llm.text_blocks import frugal

CHUNK, BLOCK = 8192, 64
#: Candidates (those of least hash) that give every query its first threshold; they are broadcast.
SAMPLE = 1024
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def to_integers(vectors: DataFrame, scale: int, id_col: str, vector: str) -> DataFrame:
    """id, v = floor(scale * component) as doubles; rows with a null or non-finite component, or none, are left out."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _scores(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products. float64 is exact while all partial sums stay below 2^53; else Python integers, clamped to long."""
    if np.abs(q).sum() * (np.abs(block).max(initial=0)) < _EXACT:
        return (block @ q).astype(np.int64)
    own = [int(x) for x in q]
    return np.array([max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(own, row, strict=True)))) for row in block], np.int64)


def _alike(vectors: np.ndarray) -> np.ndarray:
    """An order of the rows in which blocks hold like ones: halves along the direction of most spread."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        own = vectors[at] - vectors[at].mean(0)
        v = own[np.argmax((own**2).sum(1))]
        for _ in range(4):
            v = own.T @ (own @ v)
            v /= np.abs(v).max(initial=0) or 1.0
        at = at[np.argsort(own @ v, kind="stable")]
        half = -(-len(at) // BLOCK) // 2 * BLOCK
        todo += [at[half:], at[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def search_chunk(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """The k best of one chunk for each query, of scores of at least `least`: (query, id, score) lists, and the number
    of blocks scored for each query."""
    order = _alike(vectors)
    ids, vectors = ids[order], vectors[order]
    cuts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(vectors, cuts)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    # beyond 2^53 a bound is rounded: lift it past its own error
    bounds += np.where(np.abs(bounds) < _EXACT / 4, 0.0, np.abs(queries).sum(1)[:, None] * np.abs(vectors).max(initial=0) * 1e-9)
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    scored = np.zeros(len(queries), np.int64)
    least = np.full(len(queries), -_LONG - 1) if least is None else least
    for row, q in enumerate(queries):
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[row], kind="stable"):
            if bounds[row, b] < least[row] or (len(best_s) == k and bounds[row, b] < best_s[-1]):
                break
            scored[row] += 1
            at = slice(cuts[b], cuts[b] + BLOCK)
            s, i = _scores(q, vectors[at]), ids[at]
            near = s >= (max(least[row], best_s[-1]) if len(best_s) == k else least[row])
            s, i = s[near], i[near]
            other = i != q_ids[row]
            s, i = np.concatenate([best_s, s[other]]), np.concatenate([best_i, i[other]])
            top = np.lexsort((i, -s))[:k]
            best_s, best_i = s[top], i[top]
        found[0].extend([int(q_ids[row])] * len(best_s))
        found[1].extend(best_i.tolist())
        found[2].extend(best_s.tolist())
    return *found, scored


def _first_thresholds(asked: DataFrame, cand: DataFrame, k: int, width: int) -> DataFrame:
    """asked and `least`: the k-th score among a sample of the candidates, or the least long."""
    sample = cand.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()
    some_ids, some = sample.column("id").to_numpy(), _matrix(sample.column("v").to_pylist(), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for i, q in zip(batch.column("id").to_pylist(), _matrix(batch.column("v").to_pylist(), width), strict=True):
                s = np.sort(_scores(q, some)[some_ids != i])
                least.append(int(s[-k]) if len(s) >= k else -_LONG - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["id", "v", "least"])

    return asked.mapInArrow(frugal(run), "id bigint, v array<double>, least bigint")


@scratch.sized
def _partial(candidates: DataFrame, queries: DataFrame, k: int, scale: int, id_col: str, vector: str, chunk: int) -> DataFrame:
    """query_id, vec_id, score of the best of every chunk, and a row without vec_id: blocks, and blocks scored."""
    cand = scratch.materialize(to_integers(candidates, scale, id_col, vector), "vectors")
    asked = to_integers(queries, scale, id_col, vector).dropDuplicates(["id"])
    width = max(t.agg(F.max(F.size("v"))).first()[0] or 0 for t in (cand, asked))
    asked = scratch.materialize(_first_thresholds(asked, cand, k, width), "queries")
    n_c, n_q = (max(1, -(-t.count() // chunk)) for t in (cand, asked))
    # by content too: rows that repeat an id don't fall into one chunk
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    # each chunk of queries meets each chunk of candidates in one group
    c = cand.select(deal(n_c).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), F.lit(False).alias("asks"), "id", "v", F.lit(0).cast("bigint").alias("least"))
    q = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), deal(n_q).alias("q"), F.lit(True).alias("asks"), "id", "v", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        asks, ids, least, v = t.column("asks").to_numpy(), t.column("id").to_numpy(), t.column("least").to_numpy(), t.column("v").combine_chunks()
        if asks.any() and not asks.all():
            m = _matrix(v.to_pylist(), width) if len(set(np.diff(v.offsets.to_numpy()).tolist())) > 1 else v.flatten().to_numpy().reshape(len(v), -1)
            m = np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m
            a, b, s, scored = search_chunk(ids[asks], m[asks], ids[~asks], m[~asks], k, least[asks])
            n, blocks = int(asks.sum()), -(-int((~asks).sum()) // BLOCK)
            rows = [[*a, *ids[asks].tolist()], [*b, *[None] * n], [*s, *[None] * n], [None] * len(a) + [blocks] * n, [None] * len(a) + scored.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["query_id", "vec_id", "score", "blocks", "scored"])

    return c.unionByName(q).groupBy("c", "q").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint, blocks bigint, scored bigint")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, its own id left out.

    Components x count as floor(scale * x). Vectors that are null or hold null, NaN or infinite
    components, and rows with a null id, take no part. Vectors of different lengths meet on their
    common prefix. Rows that repeat an id are candidates each; a query id that repeats is searched
    once. Scores beyond a long are clamped to it. Ties go to the smaller id. Empty tables give no rows.
    Only the two named columns are read, whatever the others are called.
    """
    part = _partial(candidates, queries, k, scale, id_col, vector, chunk).filter(F.col("vec_id").isNotNull())
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, blocks, scored: what the search of `top_k` reads of each query's blocks."""
    part = _partial(candidates, queries, k, scale, id_col, vector, chunk).filter(F.col("vec_id").isNull())
    return part.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"))


def op6_topk(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
