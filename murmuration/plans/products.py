"""What rows share, as products of blocks of their incidence matrix: for members that meet in so many groups that pairs by
group would outnumber the pairs of members many times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from murmuration.plans.checkpoints import stored
from murmuration.plans.joins import numbered

#: Members of a small block, members of a strip of a block inside a task, and groups of a product there.
BLOCK, STRIP, GROUPS = 2048, 2048, 4096
#: Blocks of all parts together, if their sizes allow, and how many small ones a block may hold: every block travels to all others of its part.
BLOCKS, WIDEST = 12, 8
#: A product's cell costs about so much less than a row of a join, and below so many rows a join is quick anyway.
CHEAPER, FEW = 200, 50_000_000


def crowded(left: DataFrame, right: DataFrame | None = None) -> bool:
    """left and right (part, node, group): whether products of blocks cost less than a join on part and group."""
    other = left if right is None else right
    count = lambda df, by: df.groupBy("part", *by).agg(F.count(F.lit(1)).alias("n"))
    met = count(left, ["group"]).join(count(other, ["group"]).withColumnRenamed("n", "m"), ["part", "group"])
    met = met.groupBy("part").agg(F.sum(F.col("n") * F.col("m")).alias("rows"), F.count(F.lit(1)).alias("groups"))
    sizes = [df.groupBy("part").agg(F.count_distinct("node").cast("double").alias(c)) for df, c in ((left, "a"), (other, "b"))]
    cells = met.join(sizes[0], "part").join(sizes[1], "part").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.sum(F.col("a") * F.col("b") * F.col("groups")))
    rows, n = cells.first()
    return rows >= FEW and n <= CHEAPER * rows


def incidence(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (part, node, tag, group, n), one for each node and group of a part, groups as `group_numbers` numbers them -> one for each node of a part: its block, its place in
    the order of names, its groups as numbers and their n. All of a node's rows have one tag."""
    rows = rows.filter(F.col("node").isNotNull() & F.col("group").isNotNull())
    nodes = numbered(rows.select("part", "node").distinct(), ["part", "node"], "at")
    first = nodes.groupBy("part").agg(F.min("at").alias("first"))
    width = nodes.agg(F.greatest(F.lit(block), F.least(F.lit(WIDEST * block), F.ceil(F.count(F.lit(1)) / BLOCKS))).alias("width"))  # one row
    nodes = nodes.join(first, "part").crossJoin(F.broadcast(width)).select("part", "node", "at", F.floor((F.col("at") - F.col("first")) / F.col("width")).cast("int").alias("block"))
    flat = rows.select("part", "node", "tag", F.struct(F.col("group").alias("g"), F.col("n").cast("double").alias("n")).alias("e"))
    lists = flat.groupBy("part", "node").agg(F.max("tag").alias("tag"), F.sort_array(F.collect_list("e")).alias("e"))
    return stored(lists.join(nodes, ["part", "node"]).select("part", "block", "at", "node", "tag", F.col("e.g").alias("groups"), F.col("e.n").alias("ns")))


def group_numbers(rows: DataFrame) -> DataFrame:
    """rows with their group as a number."""
    names = numbered(rows.select("group").filter(F.col("group").isNotNull()).distinct(), ["group"], "g")
    return rows.join(names.select("group", F.col("g").cast("int").alias("g")), "group").drop("group").withColumnRenamed("g", "group")


def gap_bytes(starts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of rising numbers (row k from starts[k] to starts[k + 1]) as gaps in bytes of 7 bits, the last byte of a gap under 128: (starts
    of the rows' bytes, bytes)."""
    gaps = np.diff(groups, prepend=0).astype(np.int64)
    first = starts[:-1][starts[:-1] < starts[1:]]
    gaps[first] = groups[first]
    size = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.r_[0, np.cumsum(size)]
    out = np.empty(at[-1], np.uint8)
    for k in range(5):
        on = size > k
        out[at[:-1][on] + k] = (gaps[on] >> 7 * k) & 127 | np.where(size[on] > k + 1, 128, 0)
    return at[starts], out


def from_gap_bytes(ends: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of `gap_bytes`: (starts, numbers)."""
    last = flat < 128
    starts = np.r_[0, np.cumsum(last)][ends]
    if not len(flat):
        return starts, np.array([], np.int32)
    begin = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    place = np.arange(len(flat)) - np.repeat(begin, np.diff(np.r_[begin, len(flat)]))
    run = np.cumsum(np.add.reduceat((flat & 127).astype(np.int64) << 7 * place, begin))
    before = np.r_[0, run][starts[:-1]]
    return starts, (run - np.repeat(before, np.diff(starts))).astype(np.int32)


def _packed(rows: DataFrame) -> DataFrame:
    """Members for their journey: groups as bytes of gaps, no ns where all are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            groups, ns = t.column("groups"), t.column("ns")
            starts = groups.offsets.to_numpy().astype(np.int64) - groups.offsets[0].as_py()
            ends, flat = gap_bytes(starts, groups.flatten().to_numpy())
            many = np.r_[0, np.cumsum(ns.flatten().to_numpy() != 1)][starts]
            data = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            ns = pc.if_else(pa.array(np.diff(many) > 0), ns, pa.scalar(None, ns.type))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("part", "block", "at", "node", "tag")), data, ns], ["part", "block", "at", "node", "tag", "groups", "ns"])

    return rows.select("part", "block", "at", "node", "tag", "groups", "ns").mapInArrow(run, "part string, block int, at bigint, node string, tag string, groups binary, ns array<double>")


class Side:
    """The members of a block, or of a strip of it, in the order of their names."""

    def __init__(self, names: pa.Array, tags: pa.Array, sizes: np.ndarray, groups: np.ndarray, ns: np.ndarray):
        self.names, self.tags, self.sizes, self.groups, self.ns = names, tags, sizes, groups, ns
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.distinct = np.unique(groups)
        self.most = float(ns.max(initial=0.0))

    @classmethod
    def strips(cls, t: pa.Table) -> list[Side]:
        t = t.sort_by("at").combine_chunks()
        one = lambda c: t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type)
        names, tags, groups = one("node"), one("tag"), one("groups")
        data = np.frombuffer(groups.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(groups.buffers()[1] or bytes(4), np.int32)[groups.offset : groups.offset + len(groups) + 1].astype(np.int64)
        ends, flat = from_gap_bytes(offsets - offsets[0], data[offsets[0] : offsets[-1]])
        given = one("ns")
        ns = np.ones(len(flat))
        ns[np.repeat(given.is_valid().to_numpy(False), np.diff(ends))] = given.flatten().to_numpy()
        cuts = range(0, len(names), STRIP)
        return [cls(names[k : k + STRIP], tags[k : k + STRIP], np.diff(ends[k : k + STRIP + 1]), *(x[ends[k] : ends[min(k + STRIP, len(names))]] for x in (flat, ns))) for k in cuts]

    def __len__(self) -> int:
        return len(self.sizes)

    def matrix(self, groups: np.ndarray, kind: type) -> np.ndarray:
        """Members by the given groups, which are in order."""
        at = np.minimum(np.searchsorted(groups, self.groups), len(groups) - 1)
        hit = groups[at] == self.groups
        m = np.zeros((len(self), len(groups)), kind)
        m[self.row[hit], at[hit]] = self.ns[hit]
        return m


def shared_groups(a: Side, b: Side) -> list[np.ndarray]:
    both = np.intersect1d(a.distinct, b.distinct, assume_unique=True)
    return [both[k : k + GROUPS] for k in range(0, len(both), GROUPS)]


def block_products(left: DataFrame, kernel, schema: str, right: DataFrame | None = None) -> DataFrame:
    """What kernel(part, a, b, m) yields (record batches) for every two strips of blocks of a part: m holds the sum of the products of n
    over the groups that members of a and b share. left and right as `incidence` gives them; without right, left meets itself, and m
    is 0 but for members of a that come before those of b. A task holds two blocks and the product of two strips, whatever the tables' size."""
    same, columns = right is None, ["at", "node", "tag", "groups", "ns"]
    left = _packed(left)
    other = left if same else _packed(right)
    ends = lambda df: df.groupBy("part").agg((F.max("block") + 1).alias("blocks"))
    here, there = ends(left), ends(other)
    span = lambda low, high: F.explode(F.sequence(low, high))
    last = F.col("blocks") - 1
    x = left.join(there, "part").withColumn("y", span(F.col("block") if same else F.lit(0), last)).select("part", F.col("block").alias("x"), "y", F.lit(True).alias("own"), *columns)
    y = other.join(here, "part").withColumn("x", span(F.lit(0), F.col("block") if same else last)).select("part", "x", F.col("block").alias("y"), F.lit(False).alias("own"), *columns)
    if same:
        y = y.filter(F.col("x") < F.col("y"))
    n = F.col("blocks")
    tasks = (here.agg(F.sum(n * (n + 1) / 2)) if same else here.join(there.select("part", F.col("blocks").alias("m")), "part").agg(F.sum(n * F.col("m")))).first()[0]
    out = left.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own = t.column("own")
        part, alone = t.column("part")[0].as_py(), same and t.column("x")[0] == t.column("y")[0]
        left = Side.strips(t.filter(own))
        right = left if alone else Side.strips(t.filter(pc.invert(own)))
        for i, a in enumerate(left):
            for b in right[i:] if alone else right:
                chunks = shared_groups(a, b)
                kind = np.float32 if a.most * b.most * sum(map(len, chunks)) < 2**24 else np.float64
                m = np.zeros((len(a), len(b)), kind)
                for groups in chunks:
                    m += a.matrix(groups, kind) @ b.matrix(groups, kind).T
                yield from kernel(part, a, b, np.triu(m, 1) if b is a else m)

    return x.union(y).repartition(int(min(max(tasks or 1, 1), 2000)), "part", "x", "y").groupBy("part", "x", "y").applyInArrow(run, out)


# --- kernels


def named(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def pairs(part, a: Side, b: Side, m: np.ndarray, strip: int = 128) -> Iterator[pa.RecordBatch]:
    """(a, b, met) of all pairs that share something."""
    for k in range(0, len(a), strip):
        at = np.flatnonzero(m[k : k + strip] > 0)
        i, j = np.divmod(at, max(len(b), 1))
        if len(at):
            yield named(["a", "b", "met"], a.names.take(pa.array(i + k)), b.names.take(pa.array(j)), m[k : k + strip].ravel()[at].astype(float))


def taken(names: pa.Array, at: np.ndarray) -> pa.Array:
    return names.take(pa.array(at))


def overlaps(part, a: Side, b: Side, m: np.ndarray, strip: int = 128) -> Iterator[pa.RecordBatch]:
    """(a, b, both, either) of all pairs that share something: groups that both hold, and that one of them holds; n is 1 throughout."""
    for k in range(0, len(a), strip):
        i, j = np.nonzero(m[k : k + strip] > 0)
        both = m[k : k + strip][i, j].astype(np.int64)
        yield named(["a", "b", "both", "either"], taken(a.names, i + k), taken(b.names, j), both, a.sizes[i + k] + b.sizes[j] - both)


def most(part, a: Side, b: Side, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(met), the largest product."""
    yield named(["met"], [float(m.max(initial=0))])


def degrees(part, a: Side, b: Side, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, node, degree): with how many of the block a member shares something."""
    for side, n in ((a, (m > 0).sum(1)), (b, (m > 0).sum(0))):
        hit = np.flatnonzero(n)
        yield named(["part", "node", "degree"], pa.array([part] * len(hit), pa.string()), side.names.take(pa.array(hit)), n[hit].astype(np.int64))


def tagged(part, a: Side, b: Side, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(tag_a, tag_b, links): pairs that share something by the tags of both."""
    left, right = a.tags.dictionary_encode(), b.tags.dictionary_encode()
    one = lambda d: np.eye(len(d.dictionary), dtype=np.float32)[d.indices.to_numpy()]
    n = one(left).T @ ((m > 0).astype(np.float32) @ one(right))
    i, j = np.nonzero(n)
    yield named(["tag_a", "tag_b", "links"], left.dictionary.take(pa.array(i)), right.dictionary.take(pa.array(j)), n[i, j].astype(np.int64))


def alike(bar: float):
    """(part, like): pairs whose groups, as sets, have a Jaccard above the bar; n is 1 throughout."""

    def kernel(part, a: Side, b: Side, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(m)
        shared = m[i, j].astype(float)
        like = int((shared / (a.sizes[i] + b.sizes[j] - shared) > bar).sum())
        yield named(["part", "like"], pa.array([part], pa.string()), np.array([like], np.int64))

    return kernel


def partners(least: int):
    """(node, k): members of a and how many of the block b share at least so much with them."""

    def kernel(part, a: Side, b: Side, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = (m >= least).sum(1)
        hit = np.flatnonzero(k)
        yield named(["node", "k"], a.names.take(pa.array(hit)), k[hit].astype(np.int64))

    return kernel


def company(least: int):
    """(node, met, tagged, word, mask): members of b, with how many of the block a, and how many tagged ones, share at least so much
    with them; and, in words of 63 bits, the groups that they share with these."""

    def kernel(part, a: Side, b: Side, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["node", "met", "tagged", "word", "mask"]
        near = (m >= least).astype(np.float32)
        met, own = near.sum(0), near[np.array(a.tags.is_valid())].sum(0)
        hit = np.flatnonzero(met)
        none = pa.nulls(len(hit), pa.int64())
        yield named(names, b.names.take(pa.array(hit)), met[hit].astype(np.int64), own[hit].astype(np.int64), none, none)
        for groups in shared_groups(a, b):
            on = (near.T @ (a.matrix(groups, np.float32) > 0).astype(np.float32) > 0) & (b.matrix(groups, np.float32) > 0)
            i, j = np.nonzero(on)
            word, bit = np.divmod(groups[j].astype(np.int64), 63)
            first = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(word) != 0)]) if len(i) else np.array([], int)
            mask = np.bitwise_or.reduceat(np.int64(1) << bit, first) if len(i) else np.array([], np.int64)
            none = pa.nulls(len(first), pa.int64())
            yield named(names, b.names.take(pa.array(i[first])), none, none, word[first], mask)

    return kernel
