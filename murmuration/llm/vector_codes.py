"""Vector compression by codebooks, entries found by VA-file filtering.

A vector of integers is cut into parts; a part is replaced by the number of the nearest entry of its position's
codebook. To find that entry without a distance to each, the entries' coordinates are bit-quantised: every dimension
has 2^BITS cells of about equally many entries, and a cell knows the least and the greatest coordinate that stand in
it. A query's lookup table has for every dimension and cell the least and the greatest squared difference to it; sums
of table values over an entry's cells bound the entry's distance from below and above. Only entries whose lower bound does
not exceed the least upper bound are refined with integer distances. Sums for all entries at once are one product of the
tables with the cells' indicator matrix; products and sums of integers below 2^53 are exact in float64, and where
distances could exceed that, bounds are widened past their rounding and candidates are refined with Python integers.

The codebooks (parts x entries x coordinates) are all that the driver holds: sums by entry are added up inside tasks
first, then by Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm import scratch
from murmuration.llm.text_blocks import frugal

BITS = 4
#: Parts whose bounds are computed at a time.
ROWS = 2048
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Cells:
    """The entries of one part position with their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, (n, width) = entries, entries.shape
        cells = min(1 << bits, n)
        self.low, self.high = np.zeros((width, cells)), np.zeros((width, cells))
        #: Which cell of which dimension an entry stands in.
        self.stands = np.zeros((width * cells, n))
        rank_cell = np.arange(n) * cells // n
        starts = np.searchsorted(rank_cell, np.arange(cells))
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            sorted_ = entries[order, d].astype(float)
            self.low[d], self.high[d] = np.minimum.reduceat(sorted_, starts), np.maximum.reduceat(sorted_, starts)
            self.stands[d * cells + rank_cell, order] = 1.0
        self.largest = float(np.abs(entries.astype(float)).max(initial=0))

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of every part (row) to every entry (column)."""
        q = parts.astype(float)[:, :, None]
        under, over = self.low - q, q - self.high
        near = np.maximum(np.maximum(under, over), 0.0)
        far = np.maximum(np.abs(under), np.abs(over))
        lower, upper = ((x * x).reshape(len(parts), -1) @ self.stands for x in (near, far))
        if not self.exact(parts):
            lower, upper = lower * (1 - 1e-9), upper * (1 + 1e-9)
        return lower, upper

    def exact(self, parts: np.ndarray) -> bool:
        return parts.shape[1] * (self.largest + float(np.abs(parts.astype(float)).max(initial=0))) ** 2 < _EXACT

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of every part, ties to the lower entry, and the number of refined candidates."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        if self.exact(parts):
            gap = parts[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
        else:
            gap = parts[row].astype(object) - self.entries[entry].astype(object)
            distance = (gap * gap).sum(1)
        first = np.searchsorted(row, np.arange(len(parts)))
        if distance.dtype == object:
            ends = [*first[1:].tolist(), len(row)]
            best = [min(range(a, b), key=lambda k: (distance[k], entry[k])) for a, b in zip(first.tolist(), ends, strict=True)]
            return entry[best], distance[best], len(row)
        least = np.minimum.reduceat(distance, first)
        # candidates of a part stand in the order of their entries: the first that has the least distance
        hit = np.flatnonzero(distance == least[row])
        _, at = np.unique(row[hit], return_index=True)
        return entry[hit[at]], least, len(row)


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4) -> tuple[DataFrame, int]:
    """(vec_id, label, v) with v = floor(scale * component) as longs, written once, and the length of v. Rows whose vector
    is null or holds null, NaN or infinite components are left out. Shorter vectors, and lengths that the parts don't
    divide, are filled up with zeros."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    kept = vectors.filter(F.col(vector).isNotNull()).filter(finite)
    kept = scratch.materialize(kept.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), v.alias("v")), "integer-vectors")
    sizes = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    width = -(-(sizes[1] or 1) // parts) * parts
    if sizes[0] != width:
        kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v"))))
    return kept, width


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(vectors: np.ndarray, books: list[Cells]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(part position, rows, entries, distances), ROWS rows at a time."""
    own = vectors.shape[1] // len(books)
    for at in range(0, len(vectors), ROWS):
        rows = slice(at, min(at + ROWS, len(vectors)))
        for p, cells in enumerate(books):
            entry, distance, _ = cells.nearest(vectors[rows, p * own : (p + 1) * own])
            yield p, rows, entry, distance


def _sums(kept: DataFrame, books: list[np.ndarray], width: int) -> list:
    """For every entry that is some part's nearest: part, entry, count and the componentwise sums."""
    own = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            v = _rows(batch.column("v"), width)
            # sums of a batch fit a long unless components are huge; the task's are Python integers
            v = v if np.abs(v.astype(float)).max(initial=0) * len(v) < _EXACT else v.astype(object)
            for p, rows, entry, _ in _assigned(v if v.dtype != object else v.astype(np.int64), cells):
                order = np.argsort(entry, kind="stable")
                cuts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                sums = np.add.reduceat(v[rows, p * own : (p + 1) * own][order], cuts, axis=0)
                for e, s, n in zip(entry[order][cuts].tolist(), sums, np.diff([*cuts, len(order)]).tolist(), strict=True):
                    held = total.setdefault((p, e), [0, np.zeros(own, object)])
                    held[0] += n
                    held[1] += s.astype(object)
        if total:
            columns = [pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)]
            columns.append(pa.array([n for n, _ in total.values()], pa.int64()))
            columns += [pa.array([int(s[d]) for _, s in total.values()], pa.decimal128(38)) for d in range(own)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{d}" for d in range(own))])

    schema = ", ".join(["part int, entry int, n bigint", *(f"s{d} decimal(38,0)" for d in range(own))])
    added = kept.select("v").mapInArrow(frugal(run), schema).groupBy("part", "entry")
    return added.agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(own)]).collect()


def fit_codebooks(kept: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebook of every part position: the parts of the `entries` smallest vec_ids (ties by content, nulls
    last; all, if fewer), then in every round each entry becomes the floor of the mean of the parts it is nearest to."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = _rows(first.column("v").combine_chunks(), width) if len(first) else np.zeros((0, width), np.int64)
    books = [b.astype(np.int64) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds if len(first) else 0):
        for r in _sums(kept, books, width):
            books[r.part][r.entry] = [max(-_LONG - 1, min(_LONG, int(r[f"s{d}"]) // r.n)) for d in range(width // parts)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.flatten().tolist()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, label, code (the entries' numbers in hex, two digits each for up to 256) and error, clamped to a long."""
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            code, error = np.zeros((batch.num_rows, len(books)), np.int64), np.zeros(batch.num_rows, object)
            for p, rows, entry, distance in _assigned(_rows(batch.column("v"), width), cells):
                code[rows, p] = entry
                error[rows] += distance.astype(object)
            text = ["".join(f"{x:0{digits}x}" for x in c) for c in code.tolist()]
            error = pa.array([min(_LONG, int(x)) for x in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), error], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(frugal(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code") -> DataFrame:
    """codes and `approximation`, the entries that a code names, joined. A null code gives null."""
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books]
    number = lambda p: F.conv(F.substring(F.col(code), p * digits + 1, digits), 16, 10).cast("int") + 1
    return codes.withColumn("approximation", F.concat(*[F.element_at(t, number(p)) for p, t in enumerate(tables)]))


@scratch.sized
def compress(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept.

    Left out are rows whose vector is null or holds null or non-finite components; a null id stays and comes last
    in the order that fills the codebooks. Shorter vectors count as filled up with zeros, an empty one as all zeros.
    Rows that repeat an id or a vector are rows each. Equal labels, nulls together, share label_error; errors and
    their sums are clamped to a long. Components beyond a long are clamped to it. An empty table gives no rows. Only the
    three named columns are read, whatever the others are called.
    """
    kept, width = integer_vectors(vectors, scale, id_col, vector, label, parts)
    books = fit_codebooks(kept, width, parts, entries, rounds)
    coded = scratch.materialize(encode(kept, books, width), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    # written first: Spark knows its size and broadcasts it if small, and splits a hot label's rows if not
    by_label = scratch.materialize(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(rounds: int = 4) -> str:
    nearest = """a{r} AS MATERIALIZED (SELECT p.row, p.part, min(list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + b.e) AS best
  FROM p JOIN b{r} b USING (part) GROUP BY p.row, p.part)"""
    moved = """b{n} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN (
  SELECT part, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS q FROM (
    SELECT p.part, a.best % 256 AS e, i, sum(p.q[i])::BIGINT AS s, count(*) AS c FROM p JOIN a{r} a USING (row, part), range(1, len(p.q) + 1) t(i) GROUP BY p.part, a.best % 256, i)
  GROUP BY part, e) m USING (part, e))"""
    steps = [x for r in range(rounds) for x in (nearest.format(r=r), moved.format(r=r, n=r + 1))]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS q FROM k, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS e, q FROM p WHERE row <= 256),
{", ".join([*steps, nearest.format(r=rounds)])},
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (row), h
"""


ORACLE = _oracle()
