"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are token ids in a shared table; only the last piece of each, shorter than a sequence, has to be packed. Those
pieces are dealt by hash into blocks of bounded size, and each block into islands: a population of packings each. A
crossover copies whole well-filled bins of one parent into the other, takes out the bins that hold the same documents a
second time, and puts the documents displaced by that into the best-fitting gaps. Between epochs every island's elite
migrates to the next one. A block is done when a packing has no more bins than least_bins() proves to be needed. The least filled bins of all
blocks are opened again and packed together, until that is one block.

A task holds one block's sizes and some packings of them; the driver sees counts of blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import packing


@dataclass(frozen=True)
class GeneticConfig:
    """Blocks of about block_items pieces; islands of population packings, children of each in an epoch.

    A crossover injects up to inject of a parent's bins. The reopened least filled bins of a block are share of it, reopen at least.
    """

    block_items: int = 16_384
    islands: int = 4
    population: int = 6
    children: int = 24
    epochs: int = 3
    inject: float = 0.1
    share: float = 1 / 64
    reopen: int = 16


class Packing:
    """Pieces by bin, and each bin's tokens."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray) -> None:
        # Bins are renumbered without gaps.
        self.bins = np.unique(bins, return_inverse=True)[1].astype(np.int32)
        self.fill = np.bincount(self.bins, sizes).astype(np.int64)

    def worth(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; of as many, the less even fills, which leave larger gaps."""
        return -len(self.fill), float(((self.fill / capacity) ** 2).mean())


def best_fit(order: list[int], sizes: list[int], bins: np.ndarray, fill: np.ndarray, capacity: int) -> None:
    """Puts pieces, in the given order, each into the bin with the least sufficient gap, else into a new one; bins is changed.

    fill: the tokens of the bins that are there. The gaps in use are the bits of one long integer.
    """
    free = capacity - fill
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    for number in np.flatnonzero(free > 0).tolist():
        gaps[free[number]].append(number)
    mask = sum(1 << g for g in range(1, capacity + 1) if gaps[g])
    new = len(fill)
    for i in order:
        size = sizes[i]
        fits = mask >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            number = gaps[gap].pop()
            if not gaps[gap]:
                mask ^= 1 << gap
        else:
            gap, number = capacity, new
            new += 1
        bins[i] = number
        gap -= size
        if gap:
            if not gaps[gap]:
                mask |= 1 << gap
            gaps[gap].append(number)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: for every small size k, pieces over half a bin need one each, and those of k or more fit only in what these leave."""
    ordered = np.sort(sizes)
    sums = np.concatenate(([0], np.cumsum(ordered)))
    half = int(np.searchsorted(ordered, capacity // 2, "right"))
    k = np.unique(np.append(ordered[:half], 0))
    low, high = np.searchsorted(ordered, k, "left"), np.maximum(np.searchsorted(ordered, capacity - k, "right"), half)
    room = (high - half) * capacity - (sums[high] - sums[half])
    return int((len(ordered) - half + np.maximum(0, -((room - (sums[half] - sums[low])) // capacity))).max())


def first_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    """Best fit in decreasing order of sizes, each taken up to noise larger."""
    order = np.argsort(-sizes * (1 + noise * rng.random(len(sizes))), kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    best_fit(order.tolist(), sizes.tolist(), bins, np.zeros(0, np.int64), capacity)
    return Packing(bins, sizes)


def _refitted(kept: np.ndarray, moved: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The bins in kept (-1: none) with the moved pieces in their best-fitting gaps, larger ones first and equal ones in any order."""
    bins = np.full(len(sizes), -1, np.int64)
    there = kept >= 0
    numbers, bins[there] = np.unique(kept[there], return_inverse=True)
    fill = np.bincount(bins[there], sizes[there], len(numbers)).astype(np.int64)
    order = rng.permutation(moved)
    best_fit(order[np.argsort(-sizes[order], kind="stable")].tolist(), sizes.tolist(), bins, fill, capacity)
    return Packing(bins, sizes)


def crossover(giver: Packing, taker: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator, inject: float) -> Packing:
    """The taker with some of the giver's well-filled bins, chosen among the better half."""
    better = np.argsort(-giver.fill, kind="stable")[: max(1, len(giver.fill) // 2)]
    chosen = rng.choice(better, int(rng.integers(1, max(2, int(inject * len(giver.fill)) + 1))) if len(better) > 1 else 1, replace=False) if len(better) else better
    injected = np.isin(giver.bins, chosen)
    broken = np.zeros(len(taker.fill), bool)
    broken[taker.bins[injected]] = True
    displaced = broken[taker.bins] & ~injected
    kept = np.where(injected, len(taker.fill) + giver.bins, np.where(displaced, -1, taker.bins))
    return _refitted(kept, np.flatnonzero(displaced), sizes, capacity, rng)


def mutation(own: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator, n: int = 3) -> Packing:
    """Opens the n least filled bins and n others, and fits their pieces anew."""
    opened = np.zeros(len(own.fill), bool)
    opened[np.argsort(own.fill, kind="stable")[:n]] = True
    opened[rng.integers(0, len(own.fill), n)] = True
    out = opened[own.bins]
    return _refitted(np.where(out, -1, own.bins), np.flatnonzero(out), sizes, capacity, rng)


def evolve(sizes: np.ndarray, people: list[Packing], capacity: int, cfg: GeneticConfig, seed: list[int], island: int) -> list[Packing]:
    """The population after an epoch, best first; empty people begin one. Ends at once where no packing can have fewer bins than the best."""
    rng = np.random.default_rng(seed)
    least = least_bins(sizes, capacity)
    if not people:
        # Only the first island begins with the plain order, so that the islands differ.
        people = [first_packing(sizes, capacity, rng, 0.0 if not island else 0.02)]
        while len(people) < cfg.population and len(people[0].fill) > least:
            people.append(first_packing(sizes, capacity, rng, 0.05 * len(people) + 0.05 * island))
    people = sorted(people, key=lambda x: x.worth(capacity), reverse=True)
    for _ in range(cfg.children):
        if len(people[0].fill) == least:
            break
        a, b = (people[min(rng.integers(0, len(people), 2))] for _ in range(2))
        child = mutation(crossover(a, b, sizes, capacity, rng, cfg.inject), sizes, capacity, rng)
        people = sorted([*people, child], key=lambda x: x.worth(capacity), reverse=True)[: max(cfg.population, 2)]
    return people


_STATE = "block long, island int, sizes binary, people array<binary>, n_bins int, fitness double, done boolean"


def _epoch(state: DataFrame, tasks: int, capacity: int, cfg: GeneticConfig, seed: tuple[int, int]) -> DataFrame:
    """The state after an epoch of all islands that are not done; people are packings, best first.

    The number of tasks is given, as rows have so few bytes that they would be put together into a few tasks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 1):
            row = batch.to_pylist()[0]
            sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
            people = [Packing(np.frombuffer(p, "<i4"), sizes) for p in row["people"]]
            if not row["done"]:
                people = evolve(sizes, people, capacity, cfg, [*seed, row["block"], row["island"]], row["island"])
            bins, fitness = people[0].worth(capacity)
            done = -bins == least_bins(sizes, capacity)
            held = people[:1] if done else people
            yield pa.RecordBatch.from_pylist([{**row, "people": [p.bins.astype("<i4").tobytes() for p in held], "n_bins": -bins, "fitness": fitness, "done": done}], batch.schema)

    return state.repartition(tasks, "block", "island").mapInArrow(run, _STATE)


def _migrated(state: DataFrame, islands: int) -> DataFrame:
    """Every island with the elite of the one before it, in place of its own last; a block that is done on any island is done on all."""
    elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("people")[0].alias("guest"))
    done = state.groupBy("block").agg(F.max("done").alias("over"))
    last = F.greatest(F.size("people") - 1, F.lit(1))
    people = F.concat(F.slice("people", F.lit(1), last), F.array("guest"))
    return state.join(elite, ["block", "island"]).join(done, "block").select("block", "island", "sizes", people.alias("people"), "n_bins", "fitness", F.col("over").alias("done"))


def _blocks(items: DataFrame, n: int, level: int) -> DataFrame:
    """block, keys, sizes: the pieces dealt by hash into n blocks, larger ones first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("at", "ascending")])
        keys, sizes = table.column("at").to_numpy().astype("<i8").tobytes(), table.column("size").to_numpy().astype("<i4").tobytes()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([keys], pa.binary()), pa.array([sizes], pa.binary())], ["block", "keys", "sizes"])

    return items.groupBy(F.pmod(F.xxhash64("at", F.lit(level)), F.lit(n)).cast("long").alias("block")).applyInArrow(run, "block long, keys binary, sizes binary")


def _placed(best: DataFrame, capacity: int, cfg: GeneticConfig, last: bool) -> DataFrame:
    """at, size, bin, offset of every piece of the best packings; bin is the first piece's at, null in bins that are opened again.

    Opened are a block's least filled bins, none if all are full, and none at the last level.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 1):
            row = batch.to_pylist()[0]
            at, sizes = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
            own = Packing(np.frombuffer(row["people"][0], "<i4"), sizes)
            order = np.argsort(own.bins, kind="stable")
            at, sizes, bins = at[order], sizes[order], own.bins[order]
            first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
            before = np.cumsum(sizes) - sizes
            opened = np.zeros(len(own.fill), bool)
            if not last:
                opened[np.argsort(own.fill, kind="stable")[: max(cfg.reopen, int(cfg.share * len(own.fill)))]] = True
                opened &= bool((own.fill < capacity).any())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes), pa.array(at[first][bins], pa.int64(), mask=opened[bins]), pa.array(before - before[first][bins])], ["at", "size", "bin", "offset"])

    return best.mapInArrow(run, "at long, size long, bin long, offset long")


def pack_items(items: DataFrame, capacity: int, cfg: GeneticConfig = GeneticConfig()) -> DataFrame:
    """at, bin, offset for every row of items (at: long, unique; size: 1 to capacity): bins of at most capacity, gapless from offset 0, named by one of their pieces."""
    parts, level = [], 0
    while True:
        total = items.count()
        n = max(1, -(-total // cfg.block_items))
        blocks = C.materialize(_blocks(items, n, level), "blocks")
        islands = F.explode(F.sequence(F.lit(0), F.lit(cfg.islands - 1))).alias("island")
        state = blocks.select("block", islands, "sizes", F.array().cast("array<binary>").alias("people"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("fitness"), F.lit(False).alias("done"))
        for epoch in range(cfg.epochs):
            state = C.materialize(_epoch(state, min(n * cfg.islands, 10_000), capacity, cfg, (level, epoch)), "islands")
            if epoch + 1 == cfg.epochs or not state.groupBy("block").agg(F.max("done").alias("over")).filter("not over").take(1):
                break
            state = _migrated(state, cfg.islands)
        best = state.groupBy("block").agg(F.max_by("people", F.struct(-F.col("n_bins"), "fitness", -F.col("island"))).alias("people"))
        placed = C.materialize(_placed(blocks.join(best, "block").select("keys", "sizes", "people"), capacity, cfg, n == 1), "placed")
        parts.append(placed.filter("bin is not null").select("at", "bin", "offset"))
        if n == 1:
            break
        items, level = placed.filter("bin is null").select("at", "size"), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Bits of a token's place in its part of the tokens table; a piece is named by the place of its first token.
_PART_BITS = 40


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, cfg: GeneticConfig = GeneticConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset, ids: every document's pieces and their places in sequences of at most capacity tokens.

    A document is its text's ids (as in packing.tokenize) and end_id. Only longer ones are cut, into pieces of capacity tokens and a
    rest. ids holds little-endian integers of tokens.id_width(path) bytes. Each input row is one document, repeated ones and those
    without doc_id too; a null text is empty: end_id alone; an empty table has no pieces. Further columns are not read.
    """
    tokens = packing.tokenize(docs, path, end_id, id_col, text_col)
    width = packing.T.id_width(path)
    # The place of a document's first token, and of its rest's.
    first = F.shiftleft(F.col("part").cast("long"), _PART_BITS) + F.col("begin")
    rest = (F.col("n") % capacity).alias("size")
    items = tokens.select((first + F.col("n") - F.col("n") % capacity).alias("at"), rest).filter("size > 0")
    bins = pack_items(items, capacity, cfg)
    placed = tokens.withColumn("first", first).withColumn("rest", first + F.col("n") - F.col("n") % capacity)
    # The hint spares the sort of all ids; the bins' side is small beside them.
    placed = placed.join(bins.hint("shuffle_hash"), F.col("rest") == F.col("at"), "left").select("doc_id", "first", "n", "ids", "bin", "offset")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 256):
            out: list[tuple] = []
            for doc, at, n, ids, bin_, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    own = (at + start, 0) if size == capacity else (bin_, offset)
                    out.append((doc, piece, start, size, *own, ids[start * width : (start + size) * width]))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, starts, lengths, ids: the pieces of pack() as one row a sequence, in the order of their offsets."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return rows.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"), ids.alias("ids"))
