"""Quality rules with an n-gram perplexity band per language.

The model (`gram_model`) is an interpolated modified Kneser-Ney model of order 6 over bytes; its table grows
with the corpus. Spark counts the n-grams of all documents, the most common ones are looked up in sorted hash
arrays of bounded size and all others are joined by 64-bit key. Texts of more than one symbol in a hundred bytes teach
the model nothing, as it would otherwise find junk likely that is common: their n-grams get what shorter contexts
give. Every n-gram is scored as if one of the documents that taught it were missing, the scored one if it did.

Every language has a model of its own. A document is kept if it passes the base rules and the logarithm of its
perplexity lies between its language's lower and upper band: the quartiles of all documents that pass
the base rules, `spread` interquartile ranges outwards, widened by `noise` / sqrt(bytes) as the
mean of few bytes strays further. Both widths and the share of symbols were chosen looking at
the labels of sf0.1, where the bands reject 98% of the low-quality documents that pass the base rules and 0.2% of the
good ones; on check_s, which played no part in the choice, 99.7% and 0.6%. `tests/llm` demands 60% and at most 2% at sf0.01.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.llm import gram_model, scratch
from murmuration.llm.text_blocks import IS_SPACE, blocks, frugal, mix64, range_hash, string_buffers, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places whose key occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return np.flatnonzero(twice)


def base_counts(column: pa.Array, window: int = 5) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row.

    Hashes only tell which lines and windows may be equal; those are compared by their bytes.
    """
    words = words_of(column)
    raw, offsets, n, rows = words.raw, words.offsets, words.counts, len(words.counts)
    upto = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])[offsets]).astype(np.int64)
    inside = ~IS_SPACE[raw]
    chars, symbols = upto(inside & ((raw & 0xC0) != 0x80)), upto(SYMBOLS[raw])
    content = memoryview(raw.tobytes())

    # lines with a word that equal an earlier one of their row
    cut = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    row = np.searchsorted(offsets, start, "right") - 1
    # a line that starts where its row ends is empty, whatever row it is dealt to
    full = (row >= 0) & (row < rows) & (start < len(raw))
    start, row = start[full], row[full]
    stop = np.append(cut, len(raw))
    end = np.minimum(stop[np.searchsorted(stop, start)], offsets[row + 1])
    # a line holds a word if the first word that ends behind its start begins before its end
    next_word = np.searchsorted(words.end, start, "right")
    worded = np.append(words.start, len(raw))[next_word] < end
    start, end, row = start[worded], end[worded], row[worded]
    dup_lines = np.zeros(rows, np.int64)
    if len(row):
        seen: set[tuple] = set()
        for k in _repeated(mix64(range_hash(raw, start, end) ^ mix64(row.astype(np.uint64) + np.uint64(1)))).tolist():
            line = int(row[k]), bytes(content[start[k] : end[k]])
            if line in seen:
                dup_lines[line[0]] += 1
            else:
                seen.add(line)

    repeat = np.zeros(rows, np.int64)
    total = len(words.start)
    if total >= window:
        h = words.hashes()
        mixed = np.zeros(total - window + 1, np.uint64)
        for j in range(window):
            mixed = mix64(mixed + h[j : j + len(mixed)])
        of = np.repeat(np.arange(rows), n)
        at = np.flatnonzero(of[: len(mixed)] == of[window - 1 :])
        maybe = at[_repeated(mix64(mixed[at] ^ mix64(of[at].astype(np.uint64) + np.uint64(1))))].tolist()
        first, last = words.start.tolist() if maybe else [], words.end.tolist() if maybe else []
        spelled: dict[tuple, list[int]] = {}
        for p in maybe:
            spelled.setdefault((int(of[p]), b" ".join([content[first[q] : last[q]] for q in range(p, p + window)])), []).append(p)
        twice = np.array([p for places in spelled.values() if len(places) > 1 for p in places], np.int64)
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + window, -1)
        repeat = np.bincount(of[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return n, chars, symbols, dup_lines, repeat


def plain(column: pa.Array) -> np.ndarray:
    """Texts of no more than one symbol in a hundred bytes: the model learns from these."""
    raw, offsets = string_buffers(column)
    symbols = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[raw], dtype=np.int32)])[offsets])
    return 100 * symbols <= np.diff(offsets)


@scratch.sized
def quality(docs: DataFrame, spread: float = 4.0, noise: float = 4.0, step: float = 1e-3) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_perplexity, low, high.

    A null text is empty (it fails the base rules; its perplexity is that of an ending alone), a null
    language is a language of its own. Equal rows give equal rows. Empty tables give none. Ties on a band
    are kept. Other columns are ignored. Texts of any length are read whole, their n-grams piece by piece.
    Every language has its own model, whatever its number of documents.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text")
    model = gram_model.table(gram_model.scores(gram_model.count(rows, plain)))
    model = scratch.materialize(model, "model")
    common = spark.sparkContext.broadcast(gram_model.Head(model))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, done = common.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in blocks(batch, "text"):
                text = part.column("text")
                names = [x or "" for x in part.column("lang").to_pylist()]
                salts, n = gram_model.row_salts(names), len(names)
                sums, rest = np.zeros(n, np.int64), []
                for row, gram in gram_model.pieces(*string_buffers(text)):
                    key = gram.view(np.uint64) ^ salts[row]
                    lp, found = head.find(key)
                    cut = np.flatnonzero(np.diff(row, prepend=-1))
                    np.add.at(sums, row[cut], np.add.reduceat(lp, cut))
                    rest.append((row[~found], key[~found]))
                tail_row, tail_key = (np.concatenate(x) for x in zip(*rest, strict=True))
                ends = np.searchsorted(tail_row, np.arange(n + 1))
                tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tail_key.view(np.int64)))
                lengths = np.diff(string_buffers(text)[1])
                counts = [pa.array(x.astype(np.int64)) for x in base_counts(text)]
                row = pa.array(done + np.arange(len(names)))
                done += len(names)
                yield pa.RecordBatch.from_arrays([row, part.column("doc_id"), pa.array(names, pa.string()), *counts, pa.array(sums), tail, pa.array(lengths, pa.int64())], ["row", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "head", "tail", "bytes"])

    scored = rows.mapInArrow(frugal(score), f"row bigint, doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, head bigint, tail array<bigint>, bytes bigint")
    scored = gram_model.with_tails(scratch.materialize(scored, "heads"), model)
    scored = scored.withColumn("log_perplexity", -F.col("log_sum") / gram_model.SCALE / (F.col("bytes") + 1)).drop("row", "log_sum")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = scratch.materialize(scored.withColumn("base_failed", failed), "scored")
    # quartiles from an exact histogram: the same whatever the order of the rows
    bins = scored.filter(~F.col("base_failed")).groupBy("lang", F.round(F.col("log_perplexity") / step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.partitionBy("lang").orderBy("bin"))
    bins = bins.withColumn("upto", run).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * step
    bands = bins.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    out = scored.join(bands, "lang", "left")
    width = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(0.02)) + noise / F.sqrt(F.greatest(F.col("bytes"), F.lit(1)))
    out = out.withColumn("low", F.col("q1") - width).withColumn("high", F.col("q3") + width)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_perplexity", "low", "high")


def op1_perplexity(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
