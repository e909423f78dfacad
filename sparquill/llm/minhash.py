"""Near-duplicate groups of documents by SetSketch registers.

A document's set holds the hashes of its distinct five-word shingles. Each of the m
registers keeps the smallest of the set's exponential variates, truncated to a power of the
base (an exponentially spaced minimum): registers of a union are the maxima of the parts'
registers, and two registers agree more often the more two sets overlap. Bands of registers
propose candidates, the joint likelihood of the two register vectors rejects most false
ones, and the full sets decide.

Large groups need no pairs within. Equal sets are one node. A bucket's smallest member is its leader.
The full sets of each member and its two likeliest leaders are compared, which links most of a group
by one comparison a member. The estimates alone then say outside of which wider groups no link can be:
members are compared with their other leaders, and what is in no group of its leader with all in its bucket. Only
where such a wider group is not one by links yet are all its full sets compared, in blocks of bounded size
that emit no more links than connect what is linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class SketchConfig:
    """shingle words a shingle; links need inter/union >= percent/100; bands x rows registers of base b.

    With 70 bands of 6 registers, a pair at similarity 0.75 shares no band with probability 3e-7.
    margin is six standard deviations of the estimated similarity. A leader is compared with about star members
    in one go. What leaders leave open is compared pair by pair in buckets of up to small open pairs, in larger
    ones in blocks of block members (and, for full sets, block_shingles).
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 70
    rows: int = 6
    b: float = 1.1
    a: float = 20.0
    small: int = 32
    margin: float = 0.13
    star: int = 64
    block: int = 1024
    block_shingles: int = 1_000_000
    broadcast_ids: int = 200_000

    @property
    def m(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: Iterable[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer than k words form one shingle, none an empty set."""
    factors = C.stream(k, 7) | C.U64(1)
    lengths = C.stream(k, 8)
    for words, bounds in C.word_hashes(t.lower() for t in texts):
        n = len(words) - k + 1
        sums = np.zeros(max(n, 0), C.U64)
        for i in range(k if n > 0 else 0):
            sums += words[i : i + n] * factors[i]
        sums = C.mix64(sums)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= k:
                s = np.sort(sums[lo : hi - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                yield C.mix64(np.atleast_1d((words[lo:hi] * factors[: hi - lo]).sum(dtype=C.U64) ^ lengths[hi - lo]))
            else:
                yield np.zeros(0, C.U64)


def registers(sets: list[np.ndarray], cfg: SketchConfig) -> np.ndarray:
    """SetSketch registers, one row of m bytes a set; the sets must not be empty."""
    seeds = C.stream(cfg.m, 11) | C.U64(1)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((cfg.m, len(sets)), C.U64)
    product = np.empty_like(flat)
    for i in range(cfg.m):
        np.multiply(flat, seeds[i], out=product)
        least[i] = np.minimum.reduceat(product, starts)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / cfg.a
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(cfg.b)), 0, 254).astype(np.uint8)


def similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, cfg: SketchConfig) -> np.ndarray:
    """The Jaccard similarity that makes two register vectors of sets of known sizes likeliest, row by row."""
    up, down = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    step = (cfg.b - 1) / cfg.b

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * step) / np.log(cfg.b)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave in j
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def sketch(rows: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """place, doc_id, n (set size), digest (of the set), sketch (registers; both null for empty sets) for every row of place, doc_id, text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 128):
            sets = list(shingle_sets(C.text_bytes(batch.column("text")), cfg.shingle))
            full = [s for s in sets if len(s)]
            regs = iter(registers(full, cfg) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place"),
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["place", "doc_id", "n", "digest", "sketch"],
            )

    return rows.select("place", "doc_id", "text").mapInArrow(run, f"place {C.PLACE}, doc_id long, n long, digest binary, sketch binary")


def _bands(nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """id, key: a row for each band of each node (id, sketch); the key is a hash of the band's number and registers."""
    factors, salts = C.stream(cfg.rows, 21) | C.U64(1), C.stream(cfg.bands, 22)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 2048):
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, cfg.bands, cfg.rows)
            sums = np.repeat(salts[None, :], len(regs), 0)
            for t in range(cfg.rows):
                sums += regs[:, :, t] * factors[t]
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), cfg.bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(C.mix64(sums).view(np.int64).ravel())], ["id", "key"])

    return nodes.select("id", "sketch").mapInArrow(run, "id long, key long")


def buckets(nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """key, a, b: a row for each member b of each bucket of two or more nodes; a is the bucket's smallest id, its leader."""
    rows = _bands(nodes, cfg)
    leaders = C.materialize(rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).filter("size > 1"), "leaders")
    found = C.join_counted(rows, leaders, "key", "size", nodes.count() * cfg.bands)
    return C.materialize(found.select("key", "a", F.col("id").alias("b")), "buckets")


def _stars(pairs: DataFrame, total: int, size: int) -> DataFrame:
    """a, s, side, id: the pairs a, b (total at most) as members (side 1, id = b) of their center's shares s, and the center itself (side 0) once a share.

    A share has about size members at most however many a center has, so there are at most twice as many rows as pairs.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(max(1, total // size))).cast("int").alias("s"))
    centers = salted.select("a", "s").distinct().select("a", "s", F.lit(0).alias("side"), F.col("a").alias("id"))
    return centers.unionByName(salted.select("a", "s", F.lit(1).alias("side"), F.col("b").alias("id")))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each share's rows one after the other, the center first."""
    return rows.repartition("a", "s").sortWithinPartitions("a", "s", "side")


def estimated(pairs: DataFrame, total: int, nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """a, b, est: those of the pairs a, b (total at most) of nodes whose sizes and estimated similarity allow a link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n = np.zeros((1, cfg.m), np.uint8), 1.0
        for batch in C.batches(it, 4096):
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, cfg.m)
            n, side = batch.column("n").to_numpy(zero_copy_only=False).astype(float), batch.column("side").to_numpy(zero_copy_only=False)
            center = np.maximum.accumulate(np.where(side == 0, np.arange(1, len(side) + 1), 0))  # 0: the last of the batch before
            regs_, n_ = np.concatenate((last, regs)), np.concatenate(([last_n], n))
            last, last_n = regs_[center[-1]][None, :], n_[center[-1]]
            own = np.flatnonzero(side == 1)
            own = own[np.minimum(n[own], n_[center[own]]) * 100 >= np.maximum(n[own], n_[center[own]]) * cfg.percent]
            est = similarity(regs_[center[own]], regs[own], n_[center[own]], n[own], cfg)
            good = est >= cfg.percent / 100 - cfg.margin
            kept = pa.array(own[good])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("id").take(kept), pa.array(est[good])], ["a", "b", "est"])

    rows = _stars(pairs, total, 16 * cfg.star).join(nodes.select("id", "n", "sketch"), "id")
    return _in_order(rows).mapInArrow(run, "a long, b long, est double")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _with_texts(rows: DataFrame, total: int, docs: DataFrame, nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """rows (total at most, with id, a node) and the node's text; docs: place, text."""
    at = rows.join(nodes.select("id", "place"), "id")
    return docs.select("place", "text").join(F.broadcast(at) if total <= cfg.broadcast_ids else at, "place").drop("place")


def confirmed(pairs: DataFrame, total: int, docs: DataFrame, nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """a, b: those of the pairs (total at most) of nodes that the full sets link; each text moves once a pair, a center's also once a share."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, C.U64)
        for batch in C.batches(it, 64):
            sets = shingle_sets(C.text_bytes(batch.column("text")), cfg.shingle)
            good = []
            for k, (side, own) in enumerate(zip(batch.column("side").to_pylist(), sets, strict=True)):
                if side == 0:
                    center = own
                elif min(len(own), len(center)) * 100 >= max(len(own), len(center)) * cfg.percent:
                    both = _common(center, own)
                    if both * 100 >= (len(center) + len(own) - both) * cfg.percent:
                        good.append(k)
            kept = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("id").take(kept)], ["a", "b"])

    return _in_order(_with_texts(_stars(pairs, total, cfg.star), 2 * total, docs, nodes, cfg)).mapInArrow(run, "a long, b long")


def _block_links(table: pa.Table, cfg: SketchConfig) -> tuple[list[int], list[int]]:
    """Links among the texts of one block pair, from the full sets: each connected member with its first."""
    ids = table.column("id").to_pylist()
    sets = list(shingle_sets(C.text_bytes(table.column("text").combine_chunks()), cfg.shingle))
    sizes = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[column] > 1  # a shingle of one text alone is in no intersection
    row, column = row[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    width = max(512, (1 << 21) // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        inter += part @ part.T
    linked = np.zeros(inter.shape, bool)
    for at in range(0, len(sets), 128):  # some rows at a time: the comparison needs several times their memory
        own = slice(at, at + 128)
        linked[own] = inter[own] * 100 >= (sizes[own, None] + sizes[None, :] - inter[own]) * cfg.percent
    a, b, seen = [], [], np.zeros(len(sets), bool)
    for i in np.argsort(ids, kind="stable"):
        if not seen[i]:
            reach, more = linked[i], True
            while more:
                wider = linked[reach].any(0) | reach
                more, reach = bool((wider != reach).any()), wider
            seen |= reach
            a += [ids[i]] * int(reach.sum())
            b += [ids[k] for k in np.flatnonzero(reach)]
    return a, b


def block_links(label: DataFrame, docs: DataFrame, nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """a, b: links by the full sets between members of a group (label: id, component) that keep all that are linked connected.

    A group beyond the size of a block is dealt into blocks, and each pair of blocks is a group of its own,
    so no task holds more than two blocks; a text then moves once for each block of its group.
    """
    sized = C.materialize(label.join(nodes.select("id", "n"), "id"), "sized")
    groups = sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    total = sized.count()
    count = F.ceil(F.greatest(F.col("size") / cfg.block, F.col("total") / cfg.block_shingles)).cast("int")
    dealt = C.join_salted(sized, groups.select("component", count.alias("blocks")), "component", total).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("id", "component", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("id", "component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    dealt = C.materialize(dealt, "blocks")

    def run(table: pa.Table) -> pa.Table:
        a, b = _block_links(table, cfg)
        return pa.table(list(map(pa.array, (a, b), [pa.int64()] * 2)), ["a", "b"])

    return _with_texts(dealt, dealt.count(), docs, nodes, cfg).groupBy("component", "i", "j").applyInArrow(run, "a long, b long").filter("a <> b")


def _close_pairs(rows: DataFrame, nodes: DataFrame, cfg: SketchConfig) -> DataFrame:
    """a, b: pairs of a bucket with a close estimate, at least one of them an outlier.

    rows: key, id, outlier, o and i (the bucket's numbers of outliers and others). The buckets are
    dealt into blocks and compared block by block; of the close pairs, as many leave a task as
    connect what they connect.
    """
    o, i = (F.ceil(F.col(c) / cfg.block).cast("int") for c in "oi")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("outlier"), o).otherwise(i)).cast("int") + F.when(F.col("outlier"), 0).otherwise(o))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("outlier"), o + i).otherwise(o) - 1))
    dealt = dealt.select("key", "id", "own", others.alias("other"))
    dealt = dealt.select("key", "id", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(table: pa.Table) -> pa.Table:
        ids, own, n = (table.column(c).to_numpy() for c in ("id", "own", "n"))
        regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, cfg.m)
        x, y = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        a, b = [], []
        for k in x:
            near = y[(regs[y] == regs[k]).sum(1) >= cfg.m * (cfg.percent / 100 - cfg.margin)]
            near = near[near != k]
            if len(near):
                close = similarity(regs[np.full(len(near), k)], regs[near], n[np.full(len(near), k)].astype(float), n[near].astype(float), cfg)
                near = near[close >= cfg.percent / 100 - cfg.margin]
                a += [ids[k]] * len(near)
                b += ids[near].tolist()
        return pa.table(list(map(pa.array, forest(a, b), [pa.int64()] * 2)), ["a", "b"])

    return dealt.join(nodes.select("id", "n", "sketch"), "id").groupBy("key", "p", "q").applyInArrow(run, "a long, b long")


def _open_members(members: DataFrame, label: DataFrame) -> DataFrame:
    """Of the buckets' members (key, a, b), those of buckets in which two that aren't leaders are of different groups, at least one of them not its leader's.

    key, id, group, outlier (not in its leader's group), o and i (the bucket's numbers of outliers and others, without the leader).
    """
    home = label.select(F.col("id").alias("a"), F.col("component").alias("la"))
    own = label.select(F.col("id").alias("b"), F.col("component").alias("lb"))
    total = members.count()
    rows = C.join_salted(members.filter("a <> b").join(own, "b", "left"), home, "a", total, "left")
    rows = rows.select("key", F.col("b").alias("id"), F.coalesce("lb", "b").alias("group"), (F.coalesce("la", "a") != F.coalesce("lb", "b")).alias("outlier"))
    rows = C.materialize(rows, "members")
    counts = rows.groupBy("key").agg(F.count_if("outlier").alias("o"), F.count_if(~F.col("outlier")).alias("i"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    return C.materialize(C.join_salted(rows, counts.filter("o > 0 and g0 <> g1").drop("g0", "g1"), "key", total), "rest")


def node_groups(docs: DataFrame, nodes: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """id, component (the smallest id reachable over links) for the nodes (id, place, n, sketch) that have a link; docs: place, text."""
    members = buckets(nodes, cfg)
    pairs = C.materialize(members.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
    total, most = pairs.count(), nodes.count()

    def likeliest(found: DataFrame) -> DataFrame:
        """Each member with the leader it shares most buckets with."""
        return found.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))

    def apart(found: DataFrame, groups: DataFrame) -> DataFrame:
        """Those of the pairs whose ends are in different groups."""
        la = groups.select(F.col("id").alias("a"), F.col("component").alias("la"))
        lb = groups.select(F.col("id").alias("b"), F.col("component").alias("lb"))
        both = C.join_salted(found.join(lb, "b", "left"), la, "a", total, "left")
        return both.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "shared")

    # Links: two leaders at most for each member.
    first = likeliest(pairs)
    close = C.materialize(estimated(first, most, nodes, cfg), "close")
    label = components(confirmed(close, close.count(), docs, nodes, cfg))
    others = C.materialize(apart(pairs.join(first, ["a", "b"], "left_anti"), label), "others")
    close_too = C.materialize(estimated(likeliest(others), most, nodes, cfg), "close")
    if not close_too.isEmpty():
        label = _joined(label, confirmed(close_too, close_too.count(), docs, nodes, cfg))

    # Groups outside of which no node has a link, by the estimates.
    wide = components(close.unionByName(close_too).select("a", "b").unionByName(label.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    more = C.materialize(apart(others, wide), "apart")
    close = C.materialize(estimated(more, more.count(), nodes, cfg), "close")
    wide = wide if close.isEmpty() else _joined(wide, close)
    rest = _open_members(members, wide)
    if not rest.isEmpty():
        work = F.col("o") * (F.col("o") + F.col("i"))
        x, y = rest.filter((work <= cfg.small) & F.col("outlier")).alias("x"), rest.filter(work <= cfg.small).alias("y")
        few = x.join(y, "key").filter("x.group <> y.group and (x.id < y.id or not y.outlier)").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        few = C.materialize(few.distinct(), "few")
        close = estimated(few, few.count(), nodes, cfg).select("a", "b")
        crowds = rest.filter(work > cfg.small).select("key", "id", "outlier", "o", "i")
        wide = _joined(wide, close.unionByName(_close_pairs(crowds, nodes, cfg)))

    # Such groups with several groups of links: all members, in blocks.
    inside = wide.join(label.select("id", F.col("component").alias("linked")), "id", "left").withColumn("linked", F.coalesce("linked", "id"))
    several = inside.groupBy("component").agg(F.min("linked").alias("g0"), F.max("linked").alias("g1")).filter("g0 <> g1").select("component")
    several = C.materialize(C.join_salted(inside.select("id", "component"), several, "component", most), "several")
    return label if several.isEmpty() else _joined(label, block_links(several, docs, nodes, cfg))


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """The components with further links a, b."""
    return components(more.select("a", "b").unionByName(label.select(F.col("component").alias("a"), F.col("id").alias("b"))))


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The components of some edges as edges from their smallest member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    ends = [x for x in parent if root(x) != x]
    return [root(x) for x in ends], ends


def _thinned(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Each partition's edges as forests of up to most edges."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, fresh = [], [], 0
        for batch in it:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            fresh += batch.num_rows
            if fresh > most:
                (a, b), fresh = forest(a, b), 0
                if len(a) > most:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, (a, b), [pa.int64()] * 2)), ["a", "b"])
                    a, b = [], []
        yield pa.RecordBatch.from_arrays(list(map(pa.array, forest(a, b), [pa.int64()] * 2)), ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, block: int = 20_000) -> DataFrame:
    """id, component (smallest id reachable) for every id of the edges a, b.

    Partitions of edges are first thinned to forests. What is at most a block then ends in one more forest; else
    large-star and small-star alternate until all components are stars, however many rounds that takes.
    """
    edges = C.materialize(_thinned(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")), "edges")
    if edges.count() <= block:
        edges = _thinned(edges.repartition(1))
    else:
        edges = C.materialize(edges.distinct(), "edges")
        while not _all_stars(edges):
            edges = C.materialize(_stars_of_stars(edges), "edges")
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return C.materialize(roots.unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("component"))), "label")


def _stars_of_stars(edges: DataFrame) -> DataFrame:
    """One round of large-star, then small-star, on edges a < b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = C.join_salted(edges, least, "a", edges.count()).select(F.least("a", "m").alias("a"), "b").distinct()
    large = C.materialize(large, "large")
    small = C.join_salted(large, large.groupBy("b").agg(F.min("a").alias("m")), "b", large.count())
    return small.select(F.col("m").alias("a"), "b").unionByName(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each end has one center and no center is an end."""
    ends = edges.select(F.col("b").alias("id"), F.lit(1).alias("end"), F.lit(0).alias("center"))
    ends = ends.unionByName(edges.select(F.col("a").alias("id"), F.lit(0).alias("end"), F.lit(1).alias("center")))
    return ends.groupBy("id").agg(F.sum("end").alias("end"), F.max("center").alias("center")).filter("end + center > 1").isEmpty()


def row_groups(docs: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """place, doc_id, n, row, grp for every row of docs (place, doc_id, text): row numbers the rows, grp is the smallest row reachable, null for an empty set."""
    sets = C.materialize(sketch(docs, cfg).withColumn("row", F.monotonically_increasing_id()), "sketch")
    named = sets.filter("n > 0")
    nodes = named.groupBy("digest").agg(F.min(F.struct("row", "place", "n", "sketch")).alias("r"))
    nodes = C.materialize(nodes.select("digest", F.col("r.row").alias("id"), "r.place", "r.n", "r.sketch"), "nodes")
    label = node_groups(docs, nodes, cfg)
    heads = nodes.join(label, "id", "left").select("digest", F.coalesce("component", "id").alias("grp"))
    rows = C.join_salted(named.select("place", "doc_id", "n", "row", "digest"), heads, "digest", sets.count())
    rest = sets.filter("n = 0").withColumn("grp", F.lit(None).cast("long"))
    columns = ("place", "doc_id", "n", "row", "grp")
    return C.materialize(rows.select(*columns).unionByName(rest.select(*columns)), "row_groups")


def _named(docs: DataFrame, id_col: str, text_col: str, scan: bool) -> tuple[DataFrame, DataFrame, str]:
    """docs as place, doc_id and text; docs with its own place column, and that column's name."""
    rows, place = C.placed(docs, scan)
    return rows.select(F.col(place).alias("place"), C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text")), rows, place


def near_duplicates(docs: DataFrame, cfg: SketchConfig = SketchConfig(), id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Null and empty texts have an empty set and link with nothing. Rows that share a doc_id count as
    one node of the graph. A row without doc_id takes the component of the rows it is linked with, and is kept only if
    none of them has a doc_id. Further columns of docs are not read. scan as in common.placed.
    """
    rows = row_groups(_named(docs, id_col, text_col, scan)[0], cfg)
    named = rows.filter("grp is not null")
    total = rows.count()
    shared = named.filter("doc_id is not null").groupBy("doc_id").agg(F.min("grp").alias("a"), F.max("grp").alias("z")).filter("a <> z").drop("z")
    if not shared.isEmpty():  # a doc_id on several texts joins their groups
        merged = components(C.join_salted(named.select("doc_id", "grp"), shared, "doc_id", total).select("a", F.col("grp").alias("b")))
        named = C.join_salted(named.select("doc_id", "n", "grp"), merged.withColumnRenamed("id", "grp"), "grp", total, "left")
        named = C.materialize(named.select("doc_id", "n", F.coalesce("component", "grp").alias("grp")), "regrouped")
    least = named.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    out = C.join_salted(named.select("doc_id", "n", "grp"), least, "grp", total).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.filter("grp is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def drop_near_duplicates(docs: DataFrame, cfg: SketchConfig = SketchConfig(), id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """The rows of docs that stay, all columns: of each group that with the smallest doc_id, of several with that doc_id one.

    A row is a document of its own, whatever its doc_id: a null doc_id comes last, repeated ones don't join groups.
    Null and empty texts stay.
    """
    texts, own, place = _named(docs, id_col, text_col, scan)
    rows = row_groups(texts, cfg).filter("grp is not null")
    first = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f"), F.count("*").alias("size")).filter("size > 1")
    gone = C.join_salted(rows.select("grp", "row", "place"), first.select("grp", F.col("f.row").alias("stays")), "grp", rows.count()).filter("row <> stays")
    return C.without(own, place, gone.select("place"))
