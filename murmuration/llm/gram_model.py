"""Modified Kneser-Ney model of order 6 over the bytes of UTF-8, counted by Spark and looked up in sorted hash arrays.

An n-gram is one long of six bytes, so all that differ stay apart: no class of characters is folded, and
the table grows with the corpus. Blanks, control bytes and edges are 0. n counts documents, not occurrences: what
a document adds itself is then one, and every n-gram is scored with that one left out (else a text that nothing
resembles would predict itself). Every language is a model of its own.

Probabilities are integers of 1 / SCALE in the logarithm: sums don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.llm import scratch
from murmuration.llm.text_blocks import blocks, distinct, frugal, mix64, string_buffers

ORDER, SCALE = 6, 1_000_000
#: The n-grams of most documents, at most so many, are looked up in arrays on every executor; all others are joined.
HEAD, MOST_N, SLOT_BITS = 1 << 20, 4096, 21
#: Bytes of text that become n-grams at a time, and n-grams that a counting task holds before it hands them on.
PIECE, HELD = 1 << 19, 1 << 21
#: Languages whose discounts are broadcast (one row each); more of them are joined by shuffle.
MOST_BROADCAST = 100_000


def pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram), piece by piece: the packed n-gram that ends at every byte of each row, and at its end."""
    lengths = np.diff(offsets)
    # rows stand apart by ORDER - 1 zeros before them and one behind
    begin = offsets[:-1] + np.arange(len(lengths)) * ORDER
    total = len(raw) + ORDER * len(lengths)
    for lo in range(0, total, PIECE):
        hi = min(total, lo + PIECE)
        a, b = max(0, lo - ORDER + 1), hi
        own = np.arange(max(0, int(np.searchsorted(begin, a, "right")) - 1), int(np.searchsorted(begin, b)))
        pad = np.zeros(b - a, np.uint8)
        for r in own.tolist():
            start = int(begin[r]) + ORDER - 1
            x, y = max(a, start), min(b, start + int(lengths[r]))
            if x < y:
                pad[x - a : y - a] = raw[offsets[r] + x - start : offsets[r] + y - start]
        pad[pad <= 32] = 0
        gram = np.zeros(hi - lo, np.int64)
        full = np.concatenate([np.zeros(ORDER - 1 - (lo - a), np.uint8), pad])
        for j in range(ORDER):
            gram <<= 8
            gram |= full[j : j + hi - lo]
        at = np.arange(lo, hi)
        row = np.searchsorted(begin, at, "right") - 1
        keep = at - begin[row] >= ORDER - 1
        yield row[keep], gram[keep]


def salt(model: str) -> int:
    """What Spark's xxhash64 gives for the name."""
    import xxhash

    return xxhash.xxh64_intdigest(model.encode(), 42)


def row_salts(names: list[str]) -> np.ndarray:
    salts = {name: salt(name) for name in set(names)}
    return np.array([salts[x] for x in names], np.uint64)


def key_of() -> Column:
    return F.col("gram").bitwiseXOR(F.xxhash64("model"))


def count(docs: DataFrame, learned: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """(model, gram, n, docs) over all documents (lang, text), written out; every language is a model. n is the number of
    documents that hold the n-gram, not of its occurrences: a passage that one document repeats counts once. Documents that
    `learned` doesn't mark add nothing to n, but their n-grams have a row as well, of n = 0 if nobody else has them; docs counts
    all documents, to tell which n-grams are looked up most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by language and whether the model learns from a document
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        loose: dict[tuple[str, bool], list[np.ndarray]] = {}

        def merged(name: tuple[str, bool]) -> None:
            """Loose n-grams into the held sums of their language."""
            gram, n = np.unique(np.concatenate(loose.pop(name)), return_counts=True)
            if name in held:
                both, more = np.concatenate([held[name][0], gram]), np.concatenate([held[name][1], n])
                order = np.argsort(both)
                both = both[order]
                at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                gram, n = both[at], np.add.reduceat(more[order], at)
            held[name] = gram, n

        def handed() -> Iterator[pa.RecordBatch]:
            for (name, teaches), (gram, n) in held.items():
                for at in range(0, len(gram), 1 << 16):
                    g, m = gram[at : at + (1 << 16)], n[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(m * teaches), pa.array(m)], ["model", "gram", "n", "docs"])
            held.clear()

        for batch in batches:
            for part in blocks(batch, "text"):
                teaches = np.ones(part.num_rows, bool) if learned is None else learned(part.column("text"))
                names = np.array([x or "" for x in part.column("lang").to_pylist()], object)
                own: list[np.ndarray] = []
                for row, gram in pieces(*string_buffers(part.column("text"))):
                    # once a document: of a block's rows each n-gram goes on once
                    own.append(distinct(row << 48 | gram))
                seen = own[0] if len(own) == 1 else distinct(np.concatenate(own))
                row, gram = seen >> 48, seen & ((1 << 48) - 1)
                for name, own_ in set(zip(names.tolist(), teaches.tolist(), strict=True)):
                    loose.setdefault((name, own_), []).append(gram[((names == name) & (teaches == own_))[row]])
                if sum(len(x) for xs in loose.values() for x in xs) > HELD:
                    for name in list(loose):
                        merged(name)
                    if sum(len(g) for g, _ in held.values()) > HELD:
                        yield from handed()
        for name in list(loose):
            merged(name)
        yield from handed()

    parts = docs.select("lang", "text").mapInArrow(frugal(run), "model string, gram bigint, n bigint, docs bigint")
    return scratch.materialize(parts.groupBy("model", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "grams")


def _last(k: int) -> Column:
    """The n-gram's last k bytes."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))


def scores(counted: DataFrame) -> DataFrame:
    """(model, gram, n, docs, plain, loo): the interpolated modified Kneser-Ney probability of the last byte after the
    others, and the same with one document left out. Written out."""
    levels, spark, mine = {ORDER: counted}, counted.sparkSession, scratch.unique()
    for k in range(ORDER, 1, -1):
        # a shorter n-gram counts once for each byte before it
        with scratch.scope(f"{mine}-{k - 1}"):
            levels[k - 1] = scratch.materialize(levels[k].groupBy("model", _last(k - 1).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")), "level")
    lower = None
    for k in range(1, ORDER + 1):
        t = levels[k]
        many = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        safe = lambda i: F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(i * 0.5))
        d = t.groupBy("model").agg(*many, F.count_if(F.col("n") > 0).alias("kinds")).select("model", "kinds", *[safe(i).alias(f"d{i}") for i in (1, 2, 3)])
        with scratch.scope(f"{mine}-{k}"):
            d = scratch.materialize(d, "discounts")
        # all n-grams of a context: at most one for each byte
        w = W.partitionBy("model", F.shiftright("gram", 8))
        t = t.select("*", F.sum("n").over(w).alias("total"), *[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).over(w).alias(f"c{i}") for i in (1, 2)], F.sum(F.when(F.col("n") > 2, 1).otherwise(0)).over(w).alias("c3"))
        t = t.join(F.broadcast(d) if d.count() <= MOST_BROADCAST else d, "model")
        if k == 1:
            t = t.withColumn("low_plain", 1 / (F.col("kinds") + 1)).withColumn("low_loo", F.col("low_plain"))
        else:
            below = lower.select("model", F.col("gram").alias("shorter"), F.col("plain").alias("low_plain"), F.col("loo").alias("low_loo"))
            t = t.withColumn("shorter", _last(k - 1)).join(below, ["model", "shorter"])
        cut = lambda n: F.when(n <= 0, F.lit(0.0)).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        n, total = F.col("n"), F.col("total")
        cuts = F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")
        # where nothing was learned of a context, the shorter one decides
        some = F.greatest(total, F.lit(1))
        plain = F.when(total > 0, (n - cut(n)) / some + cuts / some * F.col("low_plain")).otherwise(F.col("low_plain"))
        below_loo = F.when(n == 1, F.col("low_loo")).otherwise(F.col("low_plain"))
        rest = F.greatest(total - 1, F.lit(1))
        left = F.when(n == 0, plain).when(total > 1, (n - 1 - cut(n - 1)) / rest + (cuts - cut(n) + cut(n - 1)) / rest * below_loo).otherwise(F.col("low_loo"))
        t = t.select("model", "gram", "n", *(["docs"] if k == ORDER else []), plain.alias("plain"), left.alias("loo"))
        if k == ORDER:
            lower = scratch.materialize(t, "scores")
        else:
            with scratch.scope(f"{mine}-{k}"):
                lower = scratch.materialize(t, "scores")
        scratch.release(spark, f"{mine}-{k - 1}")
    scratch.release(spark, f"{mine}-{ORDER}")
    return lower


def table(model: DataFrame) -> DataFrame:
    """(key, n, lp) by 64-bit key, n documents."""
    return model.select(key_of().alias("key"), F.col("docs").alias("n"), F.round(F.log(F.greatest("loo", F.lit(1e-12))) * SCALE).cast("bigint").alias("lp"))


class Head:
    """The n-grams of most documents as a sorted array of hashes beside their values; slots tell where the hashes of a
    prefix start."""

    def __init__(self, scored: DataFrame, most: int = HEAD) -> None:
        by_n = {r["n"]: r["k"] for r in scored.groupBy(F.least("n", F.lit(MOST_N)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
        least, k = MOST_N, by_n.get(MOST_N, 0)
        while least > 1 and k + by_n.get(least - 1, 0) <= most:
            least -= 1
            k += by_n.get(least, 0)
        # where even those are too many, an equal share of the keys; the rest is joined
        t = scored.filter((F.col("n") >= least) & (F.pmod(F.xxhash64("key"), F.lit(max(1, -(-k // most)))) == 0)).select("key", "lp").toArrow()
        h = mix64(t.column("key").to_numpy().view(np.uint64))
        order = np.argsort(h)
        self.hash, self.lp = h[order], t.column("lp").to_numpy()[order].astype(np.int32)
        self.start = np.searchsorted(self.hash >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lp, found)."""
        h = mix64(key)
        lp, found = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            same = self.hash[here] == h[open_]
            hit = open_[same]
            lp[hit], found[hit] = self.lp[here[same]], True
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return lp, found


def with_tails(scored: DataFrame, model: DataFrame) -> DataFrame:
    """scored (row, head, tail, ...) with log_sum instead of head and tail, the keys that were not in the head."""
    tails = scored.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("m"))
    sums = tails.join(model.select("key", "lp"), "key").groupBy("row").agg(F.sum(F.col("m") * F.col("lp")).alias("tail_sum"))
    return scored.drop("tail").join(sums, "row", "left").withColumn("log_sum", F.col("head") + F.coalesce("tail_sum", F.lit(0))).drop("head", "tail_sum")
