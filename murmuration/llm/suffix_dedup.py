"""Removal of byte strings that repeat anywhere, by threshold-bounded interval expansion on a
Burrows-Wheeler transform.

A string of `length` bytes that starts at two places is removed at both. The corpus is cut so that
equal strings meet: the anchor of a window of that length is its k-gram of least hash, so equal windows
have equal anchors, and the windows of one anchor in a text form one segment. Segments meet by anchor;
an anchor that occurs once holds no repeat. Segments of equal content (128-bit digest) travel as one, which
stands in the transform twice; what is found in it holds for all of them.

The segments of whole anchors are laid end to end, their rotations sorted to a depth beyond the threshold,
and the transform is expanded backwards, breadth first: level l holds the intervals of strings of length l
and sets the common prefix of each new right border to l. After `length` levels the borders that are still
open separate rotations that share at least `length` bytes, and the expansion stops: longer prefixes are
never found.

An anchor with more bytes of different segments than a transform should hold is cut finer: its windows are
dealt by where the anchor lies in them, and all windows of one such range share the bytes around the anchor,
which are the key under which they meet next. Ranges are halved until every key is small; in the end a key is
a window, and equal windows have travelled as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from murmuration.llm import scratch
from murmuration.llm.text_blocks import blocks, frugal, gram_hash, string_buffers

LENGTH, GRAM = 200, 32
#: Bytes that one transform takes at a time, and the most of one anchor.
TRANSFORM, HOT = 1 << 18, 1 << 20
#: Window starts that are cut into segments at a time, also inside one text.
PIECE = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
_SEED = 0x6D75726D75726174


def _digest(data: bytes | memoryview) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data, _SEED)


def segments_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple]:
    """(row, start, count, lead, anchor, content) of every segment, piece by piece: `count` windows from `start` in the
    row, the place of their anchor from there, the hash of the anchor and a digest of all their bytes."""
    k = min(GRAM, length)
    width, n = length - k + 1, len(raw)
    fits = offsets[1:] - length  # the last window start of each row
    for lo in range(0, n - length + 1, PIECE):
        hi = min(lo + PIECE, n - length + 1)
        text = raw[lo : hi + length - 1]
        h = gram_hash(text, k)
        keys = np.full(-(-len(text) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
        keys[: len(h)] = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        # least key of each window: of the rest of its stretch, and of the beginning of the next
        grid = keys.reshape(-1, width)
        least = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)[: hi - lo]
        np.minimum(least, np.minimum.accumulate(grid, axis=1).reshape(-1)[width - 1 : width - 1 + hi - lo], out=least)
        anchor = (least & _PLACE).astype(np.int32)
        del keys, grid, least
        # windows that lie in one row, cut where the row or the anchor changes
        a, b = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
        whole = np.zeros(hi - lo + 1, np.int8)
        own = np.arange(a, b + 1)
        begin, stop = np.maximum(offsets[own], lo) - lo, np.minimum(fits[own] + 1, hi) - lo
        some = begin < stop
        own, begin, stop = own[some], begin[some], stop[some]
        np.add.at(whole, begin, 1)
        np.add.at(whole, stop, -1)
        inside = np.cumsum(whole[:-1]) > 0
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        new[begin] = True
        at = np.flatnonzero(new)
        if not len(at):
            continue
        row = own[np.searchsorted(begin, at, "right") - 1]
        last = np.minimum(np.append(at[1:], hi - lo), stop[np.searchsorted(begin, at, "right") - 1])
        content = memoryview(text.tobytes())
        digests = [_digest(content[x:y]) for x, y in zip(at.tolist(), (last + length - 1).tolist(), strict=True)]
        yield row, at + lo - offsets[row], last - at, anchor[at] - at, h[anchor[at]], digests


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple:
    """(row, start, count, anchor, content) of every segment of a block."""
    parts = list(segments_of(raw, offsets, length))
    columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in list(zip(*parts, strict=True))[:5]] or [np.zeros(0, np.int64)] * 5
    return columns[0], columns[1], columns[2], columns[4], [d for p in parts for d in p[5]]


def _sorted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the order by (high, low), both below 2^21, and where a pair differs from the one before."""
    n = len(high)
    if n <= 1 << 21:  # the place rides in the key: a plain sort is faster than one that moves places beside it
        key = np.sort(high.astype(np.int64) << 42 | low.astype(np.int64) << 21 | np.arange(n))
        order = (key & ((1 << 21) - 1)).astype(np.int32)
        key >>= 21
    else:
        key = high.astype(np.int64) << 32 | low
        order = np.argsort(key).astype(np.int32)
        key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rotations of text (uint8) by their first `depth` symbols or more, by doubling: a rotation's rank is
    the place of the first that equals it so far, and only places that share their rank are sorted on."""
    n = len(text)
    used = np.zeros(256, bool)
    used[text] = True
    code = (np.cumsum(used) - 1).astype(np.int32)[text]
    bits = max(1, int(used.sum() - 1).bit_length())
    done = 21 // bits
    ahead = np.concatenate([code, np.resize(code, 2 * done)])
    high, low = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for j in range(done):
        high = high << bits | ahead[j : j + n]
        low = low << bits | ahead[done + j : done + j + n]
    done *= 2
    order, new = _sorted(high, low)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    place = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    while len(place) and done < depth:
        mine = order[place]
        after = mine + np.int32(done % n)
        after[after >= n] -= n
        by, new = _sorted(rank[mine], rank[after])
        mine = mine[by]
        order[place] = mine
        rank[mine] = np.maximum.accumulate(np.where(new, place, np.int32(0)))
        place = place[~(new & np.append(new[1:], True))]
        done *= 2
    return order


def open_borders(text: np.ndarray, length: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, open): open[i] says that rotations order[i - 1] and order[i] share at least `length` symbols.

    Common prefixes are found by increasing value from the transform alone: every interval of a string
    is extended backwards by each symbol before it, and only intervals with a new right border go on. weight tells how
    often each place of text stands in the transform: equal rotations are neighbours, so they are sorted once.
    """
    order = rotations(text, length)
    if weight is not None:
        order = np.repeat(order, weight[order])
    n = len(order)
    bwt = text[order - 1]
    column = np.sort(bwt)
    forward = np.empty(n, np.int32)
    forward[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    del bwt
    border = np.ones(n + 1, bool)
    owner = np.full(n, -1, np.int32)
    left, right = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        if not len(left):
            break
        sizes = right - left
        of = np.repeat(np.arange(len(left), dtype=np.int32), sizes)
        before = forward[np.arange(len(of), dtype=np.int32) + np.repeat(left - np.cumsum(sizes, dtype=np.int32) + sizes, sizes)]
        owner[before] = of
        touched = np.flatnonzero(owner >= 0) if len(before) > n >> 5 else np.sort(before)
        # an interval's rotations with one symbol before them lie side by side
        mine, symbol = owner[touched], column[touched]
        new = np.ones(len(touched), bool)
        np.not_equal(mine[1:], mine[:-1], out=new[1:])
        new[1:] |= symbol[1:] != symbol[:-1]
        new[1:] |= touched[1:] - touched[:-1] != 1
        cut = np.flatnonzero(new)
        lo, hi = touched[cut], touched[np.append(cut[1:], len(touched)) - 1] + 1
        owner[before] = -1
        fresh = border[hi]
        left, right = lo[fresh].astype(np.int32), hi[fresh].astype(np.int32)
        border[right] = False
    border[0] = False
    return order, border[:n]


def repeated_windows(parts: list[bytes], counts: np.ndarray, length: int = LENGTH, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to): maximal runs of window starts, within the first counts[part] of each part, whose windows
    start anywhere else in the parts. A part that is marked in twice stands for two equal ones."""
    # UTF-8 holds no 0xFF, so symbols shift by one and 0 is left to end the parts
    text = np.frombuffer(b"".join(p.translate(_SHIFT) + b"\0" for p in parts), np.uint8)
    sizes = np.array([len(p) + 1 for p in parts])
    order, open_ = open_borders(text, length, None if twice is None else np.repeat(1 + twice.astype(np.int8), sizes))
    marked = np.zeros(len(text) + 1, bool)
    at = np.flatnonzero(open_)
    marked[order[at]] = True
    marked[order[at - 1]] = True
    begin = np.concatenate([[0], np.cumsum(sizes)])
    allowed = np.zeros(len(text) + 2, np.int8)
    np.add.at(allowed, begin[:-1], 1)
    np.add.at(allowed, begin[:-1] + counts, -1)
    marked[:-1] &= np.cumsum(allowed[: len(text)]) > 0
    marked[-1] = False
    edge = np.diff(marked.astype(np.int8), prepend=0)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    part = np.searchsorted(begin, lo, "right") - 1
    # runs of neighbouring parts cannot touch: a part ends `length` symbols after its last window start
    return part, lo - begin[part], hi - 1 - begin[part]


_SHIFT = bytes([*range(1, 256), 255])


_SEGMENT = "count int, lead int, key bigint, content binary, twice boolean, bytes binary"


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                ids = part.column("id")
                for row, start, count, lead, anchor, content in segments_of(*string_buffers(part.column("text")), length):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(start), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content, pa.binary())], ["id", "start", "count", "lead", "key", "content"])

    return docs.mapInArrow(frugal(run), "id bigint, start bigint, count int, lead int, key bigint, content binary")


def _cut_out(length: int):
    """Rows of a text and the segments wanted from it -> the segments with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                raw, offsets = string_buffers(part.column("text"))
                wanted = part.column("wanted")
                each = wanted.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
                start, count = each.field("start").to_numpy(), each.field("count").to_numpy()
                lo = offsets[row] + start
                content = memoryview(raw.tobytes())
                for at in range(0, len(lo), 2048):
                    s = slice(at, at + 2048)
                    data = [content[a:b] for a, b in zip(lo[s].tolist(), (lo[s] + count[s] + length - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(each.field(c)[s] for c in ("count", "lead", "key", "content", "twice")), pa.array(data, pa.binary())], ["count", "lead", "key", "content", "twice", "bytes"])

    return run


def _transforms(length: int):
    """Different segments sorted by key -> the runs of their windows that repeat, as bytes lo to hi of the segment; whole
    keys share a transform. A segment that stands for several stands in it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def found() -> pa.RecordBatch:
            part, lo, hi = repeated_windows([x[4] for x in held], np.array([x[2] for x in held]), length, np.array([x[3] for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in part], pa.int64()), pa.array([held[k][1] for k in part], pa.binary()), pa.array(lo.astype(np.int32)), pa.array((hi + length).astype(np.int32))], ["key", "content", "lo", "hi"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "content", "count", "twice", "bytes")]
            for x in zip(*columns, strict=True):
                if x[0] != last and size >= TRANSFORM:
                    yield found()
                    held, size = [], 0
                last = x[0]
                held.append(x)
                size += len(x[4]) * (2 if x[3] else 1)
        if held:
            yield found()

    return run


def _finer(length: int, width: int):
    """Segments -> their parts, each the windows whose anchor lies in one range of `width` places; the new key is a
    digest of the bytes that all windows of the range share."""
    places = length - min(GRAM, length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for count, lead, key, content, twice, data in zip(*(batch.column(c).to_pylist() for c in ("count", "lead", "key", "content", "twice", "bytes")), strict=True):
                for first in range((lead - count + 1) // width * width, lead + 1, width):
                    last = min(first + width, places) - 1
                    i, j = max(0, lead - last), min(count - 1, lead - first)
                    if i <= j:
                        shared = data[lead - first : lead - last + length]
                        mine = data[i : j + length]
                        out.append((key, content, i, j - i + 1, lead - i, xxhash.xxh3_64_intdigest(shared, _SEED + first) - (1 << 63), _digest(mine), twice, mine))
            for at in range(0, len(out), 4096):
                columns = list(zip(*out[at : at + 4096], strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["from_key", "from_content", "off", "count", "lead", "key", "content", "twice", "bytes"])

    return run


def _repeats(cut: DataFrame, length: int, width: int) -> DataFrame:
    """cut (see _SEGMENT): different segments, those of equal key to be compared. Gives key, content, lo, hi: the
    bytes of a segment that repeated windows cover."""
    size = cut.groupBy("key").agg(F.sum((F.col("count") + length) * F.when(F.col("twice"), 2).otherwise(1)).alias("size"))
    hot = scratch.materialize(size.filter(F.col("size") > HOT).select("key"), "hot-keys") if width > 1 else None
    if hot is None or not hot.limit(1).count():
        return cut.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(_transforms(length)), "key bigint, content binary, lo int, hi int")
    cold = cut.join(hot, "key", "left_anti")
    found = _repeats(cold, length, 1)
    width = -(-width // 2)
    parts = cut.join(hot, "key", "left_semi").select("count", "lead", "key", "content", "twice", "bytes")
    parts = scratch.materialize(parts.mapInArrow(frugal(_finer(length, width)), f"from_key bigint, from_content binary, off int, {_SEGMENT}"), "parts")
    once = parts.groupBy("key", "content").agg(F.first("count").alias("count"), F.first("lead").alias("lead"), ((F.count(F.lit(1)) > 1) | F.max("twice")).alias("twice"), F.first("bytes").alias("bytes"))
    once = scratch.materialize(once, "parts-once")
    meet = once.groupBy("key").agg(((F.count(F.lit(1)) > 1) | F.max("twice")).alias("meet")).filter("meet").select("key")
    again = _repeats(scratch.materialize(once.join(meet, "key", "left_semi"), "parts-met"), length, width)
    inner = parts.select("from_key", "from_content", "off", "key", "content").join(scratch.materialize(again, "parts-found"), ["key", "content"])
    return found.union(inner.select("from_key", "from_content", F.col("off") + F.col("lo"), F.col("off") + F.col("hi")))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (id bigint, unique; text): id, spans (array of lo, hi), the bytes covered by repeated strings; spans
    may overlap. Rows without repeats are left out."""
    seg = scratch.materialize(_anchors(docs, length), "segments")
    met = seg.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key")
    # written first, so that the join stands right above two exchanges and adaptive execution can split a hot anchor
    met = scratch.materialize(met, "anchors")
    seg = scratch.materialize(seg.join(met, "key"), "met")
    reps = seg.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start", "count", "lead")).alias("rep"))
    wanted = reps.groupBy("rep.id").agg(F.collect_list(F.struct("rep.start", "rep.count", "rep.lead", "key", "content", (F.col("n") > 1).alias("twice"))).alias("wanted"))
    cut = docs.join(wanted, "id").select("text", "wanted").mapInArrow(frugal(_cut_out(length)), _SEGMENT)
    cut = scratch.materialize(cut, "cut")
    found = scratch.materialize(_repeats(cut, length, length - min(GRAM, length) + 1), "found")
    spans = seg.select("id", "start", "key", "content").join(found, ["key", "content"]).select("id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and a column that is a unique bigint: id_col itself, or one that is drawn once and written with docs."""
    if docs.schema[id_col].dataType.simpleString() == "bigint":
        odd = docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull())
        if not odd.limit(1).count():
            return docs, id_col
    name = "row_id"
    while name in docs.columns:
        name += "_"
    return scratch.materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


@scratch.sized
def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", form: str = "bytes") -> DataFrame:
    """Every row of docs without its repeated bytes: n_bytes, n_removed, n_spans (maximal runs removed), and what is
    kept as `form` says: bytes (kept binary), text (in the text column itself, without characters of which
    a part was removed) or sha256 (kept_sha256; of docs' columns only the id stands beside it).

    Null texts are empty. A
    string that repeats inside one text is removed there, overlapping or not; matches never cross rows.
    Repeated rows lose all that is long enough. Rows may share or lack ids. Texts of less than `length`
    bytes lose nothing. Empty tables give no rows. Columns of docs that have an output's name are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept", "span_id", "spans_of_row")])
    rows, key = with_ids(docs.select(id_col, text) if form == "sha256" else docs, id_col)
    pairs = rows.select(F.col(key).alias("id"), F.col(text).alias("text"))
    spans = repeated_spans(pairs, length).select(F.col("id").alias("span_id"), F.col("spans").alias("spans_of_row"))
    keep = [id_col] if form == "sha256" else docs.columns
    joined = rows.join(spans, F.col(key) == F.col("span_id"), "left").select(*keep, *([text] if form == "sha256" else []), "spans_of_row")
    last = {"bytes": [T.StructField("kept", T.BinaryType())], "text": [], "sha256": [T.StructField("kept_sha256", T.StringType())]}[form]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                raws = [(t or "").encode() for t in part.column(text).to_pylist()]
                runs = [_merged(s) for s in part.column("spans_of_row").to_pylist()]
                kept = [_kept(r, s) for r, s in zip(raws, runs, strict=True)]
                counts = [[len(r) for r in raws], [len(r) - len(k) for r, k in zip(raws, kept, strict=True)], [len(s) for s in runs]]
                columns = {c: part.column(c) for c in keep} | dict(zip(("n_bytes", "n_removed", "n_spans"), (pa.array(c, pa.int64()) for c in counts), strict=True))
                if form == "bytes":
                    columns["kept"] = pa.array(kept, pa.binary())
                elif form == "text":
                    columns[text] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                else:
                    columns["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(frugal(run), schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), form="sha256")
