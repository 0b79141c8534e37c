"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is cut into words by the tokenizer's pattern. The block's distinct unseen words
are laid end to end as byte tokens, and an inverted index from token pair to the positions of its
left tokens is built. Pairs are taken in rank order from a heap; each is merged at all its positions
over all words at once, and only the neighbours of a merged place enter the index again. Where a
merge makes a pair of lower rank possible, that pair is merged before the sweep goes on, as in the
usual loop by word. A word that is a token as a whole is that token.

Blocks have bounded bytes, and the cache of encoded words a bounded size, so memory does not grow
with the corpus; nothing is shuffled and a lost task is simply run again. One vocabulary of the whole corpus,
replayed once and joined back by block and word, gives the same ids, but its shuffles take five times the input
in disk (README).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmuration.llm.text_blocks import blocks, frugal

#: Words kept between blocks, and the longest that is kept (bytes).
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Words up to so many bytes are replayed with arrays, longer ones place by place.
LONG_WORD = 128
BLOCK = 4 << 20
#: Texts of more characters give their words WORDS at a time.
LONG_TEXT, WORDS = 1 << 22, 1 << 19
#: Stand-ins for ids (below 2^20) between words and at merged places.
GAP, DEAD = (1 << 20) - 1, (1 << 20) - 2


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class MergeReplay:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.find, self.finditer = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        # every pair that spells a token: left << 20 | right -> rank of the token
        self.pairs = {a << 20 | b: r for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.spelled: dict[int, list[int]] = {}
        # tokens that can be merged on at a lower rank than their own: their places go one by one in each word
        self.risky: set[int] = set()
        for k, r in self.pairs.items():
            self.spelled.setdefault(r, []).append(k)
            self.risky.update(x for x in (k >> 20, k & 0xFFFFF) if x > r)
        # encoded words in two generations: those asked for since the last change, and those before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word as little-endian 32-bit integers."""
        out = [b"" if (r := self.ranks.get(w)) is None else r.to_bytes(4, "little") for w in words]
        for own, replay in ((range(0, LONG_WORD + 1), self._replay_short), (range(LONG_WORD + 1, 1 << 62), self._replay_long)):
            todo = [k for k, w in enumerate(words) if not out[k] and len(w) in own]
            if todo:
                tok, starts = replay([words[k] for k in todo])
                keep = tok < DEAD
                ends = np.concatenate([[0], np.cumsum(keep)])
                flat = tok[keep].astype("<u4").tobytes()
                for k, lo, hi in zip(todo, ends[starts[:-1]].tolist(), ends[starts[1:]].tolist(), strict=True):
                    out[k] = flat[4 * lo : 4 * hi]
        return out

    def _laid_out(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte tokens of the words end to end, each with a gap behind it; where each starts, and the end."""
        lengths = np.array([len(w) + 1 for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        tok = np.array(self.byte_ids, np.int64)[raw]
        tok[starts[1:] - 1] = GAP
        return tok, starts

    def _indexed(self, tok: np.ndarray) -> dict[int, list[np.ndarray]]:
        """The inverted index: rank of a pair -> places of its left tokens."""
        index: dict[int, list[np.ndarray]] = {}
        self._enter(index, tok[:-1] << 20 | tok[1:], np.arange(len(tok) - 1))
        return index

    def _enter(self, index: dict[int, list[np.ndarray]], pairs: np.ndarray, places: np.ndarray) -> list[int]:
        """Adds places to the index; returns the ranks that are new in it."""
        at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
        real = self.pair_keys[at] == pairs
        ranks, places = self.pair_ranks[at[real]], places[real]
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        new = []
        for r, lo, hi in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(ranks)], strict=True):
            if r in index:
                index[r].append(places[lo:hi])
            else:
                index[r] = [places[lo:hi]]
                new.append(r)
        return new

    def _replay_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All places of a rank at once, with arrays."""
        tok, starts = self._laid_out(words)
        n = len(tok)
        after, before = np.roll(np.arange(n), -1), np.roll(np.arange(n), 1)
        word = np.repeat(np.arange(len(words)), np.diff(starts))
        index = self._indexed(tok)
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            found = index.pop(r)
            i = np.unique(np.concatenate(found))  # a pair of two new tokens is entered from both sides
            pair = tok[i] << 20 | tok[after[i]]
            live = np.zeros(len(i), bool)
            for k in self.spelled[r]:
                live |= pair == k
            i = i[live]  # else one of the two has been merged since
            if len(i) > 1:
                if r in self.risky:
                    first = np.diff(word[i], prepend=-1) != 0
                    if not first.all():
                        index[r] = [i[~first]]
                        heappush(heap, r)
                        i = i[first]
                else:
                    chained = np.concatenate([[False], after[i[:-1]] == i[1:]])
                    if chained.any():  # of overlapping places every other one, from the left
                        at = np.arange(len(i))
                        i = i[(at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            e = after[j]
            tok[i], tok[j] = r, DEAD
            after[i] = e
            before[e] = i
            p = before[i]
            for x in self._enter(index, np.concatenate([r << 20 | tok[e], tok[p] << 20 | r]), np.concatenate([i, p])):
                heappush(heap, x)
        return tok, starts

    def _replay_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same place by place, in time that is near to linear in a word of any length."""
        laid, starts = self._laid_out(words)
        tok, n = laid.tolist(), len(laid)
        # neighbours; the place before the first is the last, a gap
        after, before = [*range(1, n), 0], [n - 1, *range(n - 1)]
        rank_of = self.pairs.get
        index = {r: np.concatenate(x).tolist() for r, x in self._indexed(laid).items()}
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = sorted(index.pop(r))
            for at, i in enumerate(places):
                j = after[i]
                if rank_of(tok[i] << 20 | tok[j], -1) != r:
                    continue  # one of them has been merged since
                e, p = after[j], before[i]
                tok[i], tok[j], after[i], before[e] = r, DEAD, e, i
                lower = False
                x = rank_of(r << 20 | tok[e], -1)
                if x >= 0:
                    lower = x < r
                    if x in index:
                        index[x].append(i)
                    else:
                        index[x] = [i]
                        heappush(heap, x)
                x = rank_of(tok[p] << 20 | r, -1)
                if x >= 0:
                    lower |= x < r
                    if x in index:
                        index[x].append(p)
                    else:
                        index[x] = [p]
                        heappush(heap, x)
                if lower and at + 1 < len(places):  # that pair comes first; then this rank goes on
                    index[r] = places[at + 1 :]
                    heappush(heap, r)
                    break
        return np.array(tok, np.int64), starts

    def encode_block(self, texts: list[str], put=b"".join) -> list:
        """`put` of the ids of each text's words: all of them in one, or their number (counted). Texts of bounded length
        share their new words; a longer one gives its words a bounded number at a time."""
        short = [k for k, t in enumerate(texts) if len(t) <= LONG_TEXT]
        out: list = [None] * len(texts)
        for k, x in zip(short, self.encode_words([self.find(texts[k]) for k in short], put), strict=True):
            out[k] = x
        for k in range(len(texts)):
            if out[k] is None:
                found, parts = self.finditer(texts[k]), []
                while some := [m.group() for m in islice(found, WORDS)]:
                    parts += self.encode_words([some], put)
                out[k] = b"".join(parts) if put is not counted else sum(parts)
        return out

    def encode_words(self, cut: list[list[str]], put) -> list:
        need = {w for words in cut for w in words}
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = need.difference(known)
        if older:
            again = fresh.intersection(older)
            known.update((w, older[w]) for w in again)
            fresh -= again
        fresh = list(fresh)
        if fresh:
            known.update(zip(fresh, self.replay([w.encode() for w in fresh]), strict=True))
        out = [put(map(known.__getitem__, words)) for words in cut]
        for w in fresh:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return out

    def decoded(self, ids: bytes) -> Iterator[bytes]:
        """The bytes that ids stand for, a bounded number of ids at a time."""
        flat = np.frombuffer(ids, "<u4")
        for at in range(0, len(flat), WORDS):
            yield b"".join(map(self.bytes_of.__getitem__, flat[at : at + WORDS].tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.decoded(ids))


def counted(ids: Iterator[bytes]) -> int:
    return sum(map(len, ids)) // 4


def _sha256(parts: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> MergeReplay:
    return MergeReplay(load_ranks(ranks_path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False, counts: bool = False) -> DataFrame:
    """Per row: the columns of keep, n_tokens and ids (binary, little-endian unsigned 32-bit); with
    digests, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to) instead of ids; with counts,
    n_tokens alone.

    Null and empty texts have no tokens. Equal rows give equal rows; an empty table gives none; the
    other columns are not read. A column of keep that is called as an output stands beside it under the same
    name: rename it first. A text of any length is encoded whole, its words a bounded number at a time.
    ranks_path is read on the executors.
    """
    kept = docs.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    names = [] if counts else ["ids_sha256", "decoded_sha256"] if digests else ["ids"]
    more = "".join(f", {n} {'binary' if n == 'ids' else 'string'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        own.known, own.older = {}, {}  # a task's words, not those of all tasks before it
        for batch in batches:
            for part in blocks(batch, text, BLOCK):
                texts = part.column(text).to_pylist()
                if counts:
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(own.encode_block([t or "" for t in texts], counted), pa.int64())], [*keep, "n_tokens"])
                    continue
                ids = own.encode_block([t or "" for t in texts])
                cols = [part.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([_sha256(own.decoded(x)) for x in ids])]
                else:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", *names])
        own.known, own.older = {}, {}

    return kept.mapInArrow(frugal(run), f"{fields}, n_tokens bigint{more}")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text (string): the text that the column ids stands for; bytes that are no UTF-8 become U+FFFD. Null
    ids give null. No column of keep may be called text; an empty table gives no rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(frugal(run), f"{fields}, text string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
