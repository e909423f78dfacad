"""Source divergence audit: how far the word shares of a language's sources lie apart.

Equal texts of a language collapse first, into one text with the number of its copies in each source, and only that one is
cut into terms: its counts and document frequencies are added as often as it has copies. What follows works on one row a
term and language, with the counts of the sources that have it, and on nothing for terms that a source lacks: a
source's share of a term that it lacks is the same for all such terms, so a pair's sum over all terms is that of two plain sources
plus corrections for the terms that the one, the other or both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


@dataclass(frozen=True)
class AuditConfig:
    """Terms of least_docs documents count; top terms are listed. Tasks compare blocks of about block_entries counts, of up to block_sources sources a side."""

    least_docs: int = 3
    top: int = 200
    block_entries: int = 100_000
    block_sources: int = 256


#: Bytes of lower-cased terms: ASCII letters and all of characters outside ASCII.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[ord("a") : ord("z") + 1] = _IN_TERM[128:] = True
#: Distinct (group, term) counts that a task holds before it sends them on.
_HELD = 1 << 20


class _Counts:
    """Occurrences and documents of the terms of groups, added up over texts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.slots, self.terms = np.zeros(0, C.U64), np.zeros(0, np.int64), []
        self.keys, self.n, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def _terms(self, text: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a block's distinct terms, and each occurrence's place among these."""
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        new = np.ones(len(own), bool)
        within = at < len(self.hashes)
        new[within] = self.hashes[at[within]] != own[within]
        if new.any():
            added = len(self.terms) + np.arange(int(new.sum()))
            self.terms += [text[starts[i] : ends[i]] for i in first[new].tolist()]
            self.hashes, self.slots = np.insert(self.hashes, at[new], own[new]), np.insert(self.slots, at[new], added)
            at = np.searchsorted(self.hashes, own)
        return self.slots[at], inverse

    def add(self, texts: list[bytes], shares: list[list[tuple[int, int]]]) -> None:
        """Counts texts, each with (group, copies) for the groups that have it."""
        text = b"\n".join(texts).lower()
        a = np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], _IN_TERM[a], [False])).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            return
        numbers, place = self._terms(text, starts, ends, C.span_hashes(a, starts, ends))
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        pairs, n = np.unique(doc * len(numbers) + place, return_counts=True)
        doc, term = pairs // len(numbers), numbers[pairs % len(numbers)]
        sizes = np.array([len(s) for s in shares])
        group, copies = (np.array([x[k] for s in shares for x in s], np.int64) for k in (0, 1))
        each = sizes[doc]
        take = np.repeat((np.cumsum(sizes) - sizes)[doc] - np.cumsum(each) + each, each) + np.arange(each.sum())
        self.waiting.append((group[take] << 32 | np.repeat(term, each), np.repeat(n, each) * copies[take], copies[take]))
        self.size += len(take)
        if self.size > 2 * _HELD:
            self._merge()

    def _merge(self) -> None:
        keys, n, d = (np.concatenate(c) for c in zip((self.keys, self.n, self.d), *self.waiting, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        self.keys, self.n, self.d = keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (n, d))
        self.waiting, self.size = [], 0

    def full(self) -> bool:
        return len(self.keys) > _HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        """All counts so far as rows; begins anew."""
        self._merge()
        names = list(self.groups)
        terms = pa.array(self.terms, pa.binary())
        for at in range(0, len(self.keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            group, term = self.keys[part] >> 32, self.keys[part] & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[g][0] for g in group.tolist()], pa.string()), pa.array([names[g][1] for g in group.tolist()], pa.string()), terms.take(pa.array(term)).cast(pa.string()), pa.array(self.n[part]), pa.array(self.d[part])],
                ["lang", "source", "term", "n", "d"],
            )
        self._empty()


def collapsed(docs: DataFrame, lang: str, source: str, text: str, scan: bool) -> tuple[DataFrame, DataFrame]:
    """lang, text, copies (array of source and m): every text of a language once; and lang, source of all rows.

    Rows are grouped by the hash of their text; of each group one row's text joins the numbers of copies, which are of one row each for all
    texts, so no key has many. Texts move once, those of further copies never arrive anywhere.
    """
    rows, place = C.placed(docs, scan)
    names = [F.coalesce(C.quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    body = F.coalesce(C.quoted(text).cast("string"), F.lit(""))
    digests = C.materialize(rows.select(*names, F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.col(place).alias("place")), "digests")
    shares = digests.groupBy("lang", "digest", "source").agg(F.count("*").alias("m"), F.min("place").alias("place"))
    own = shares.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "m")).alias("copies"), F.min("place").alias("first"))
    # The hint spares the sort of whole texts; a share of the copies' side is small beside its texts.
    texts = rows.select(F.col(place).alias("place"), body.alias("text")).join(own.hint("shuffle_hash"), F.expr("place = first"))
    return texts.select("lang", "text", "copies"), digests.select("lang", "source").distinct()


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n, d: occurrences in a source and documents that have the term, of collapsed() texts; a task adds its own up first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups = _Counts(), {}
        for batch in C.batches(it, 256):
            block, shares, size = [], [], 0
            for lang, text, copies in zip(batch.column("lang").to_pylist(), C.text_bytes(batch.column("text")), batch.column("copies").to_pylist(), strict=True):
                own = [(groups.setdefault((lang, c["source"]), len(groups)), c["m"]) for c in copies]
                if size + len(text) > C.CHUNK and block:
                    held.add(block, shares)
                    block, shares, size = [], [], 0
                block.append(text)
                shares.append(own)
                size += len(text) + 1
            held.groups = groups
            if block:
                held.add(block, shares)
            if held.full():
                yield from held.flush()
        held.groups = groups
        yield from held.flush()

    parts = texts.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _scaled(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * count / total) in whole numbers, three digits at a time: right for totals up to 9e15."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        wide = rest * 1000
        out, rest = out * 1000 + F.call_function("div", wide, total), wide % total
    return out + 1


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _common(entries: DataFrame, n_entries: int, n_sources: int, cfg: AuditConfig) -> DataFrame:
    """lang, source, item, value: each pair's corrections for the terms that both have; entries: lang, term, source, p, p0.

    Blocks of terms and of sources meet in tasks that emit a row a pair of their sources, never a row a term and pair.
    """
    terms, sides = -(-n_entries // cfg.block_entries) or 1, -(-n_sources // cfg.block_sources) or 1
    side = F.pmod(F.xxhash64("source"), F.lit(sides)).cast("int")
    meets = F.sequence(F.lit(0), F.lit(sides - 1))
    pairs = F.array_distinct(F.concat(F.transform(meets, lambda k: F.struct(F.col("side").alias("a"), k.alias("b"))), F.transform(meets, lambda k: F.struct(k.alias("a"), F.col("side").alias("b")))))
    dealt = entries.withColumns({"side": side, "block": F.pmod(F.xxhash64("term"), F.lit(terms)).cast("int")}).withColumn("pair", F.explode(pairs))
    dealt = dealt.select("lang", "block", "pair", "side", "term", "source", "p", "p0")

    def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def matrix(table: pa.Table, term: np.ndarray, n: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Sources, their shares of n terms, and their shares of terms that they lack."""
        codes = table.column("source").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        number = codes.indices.to_numpy()
        plain = np.zeros(len(codes.dictionary), np.int64)
        plain[number] = table.column("p0").to_numpy()
        shares = np.repeat(plain[None, :], n, 0)
        shares[term, number] = table.column("p").to_numpy()
        return codes.dictionary.to_pylist(), shares, plain

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pair = key[2].as_py()
        codes = table.column("term").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        term, side_ = codes.indices.to_numpy(), table.column("side").to_numpy()
        names: list[list] = [[], []]
        sums: dict[tuple, int] = {}
        step = max(1, 2_000_000 // cfg.block_sources)
        for at in range(0, len(codes.dictionary), step):
            here = (term >= at) & (term < at + step)
            one, two = ((here & (side_ == pair[k])) for k in ("a", "b"))
            if not one.any() or not two.any():
                continue
            n = min(step, len(codes.dictionary) - at)
            (names[0], p, p0), (names[1], q, q0) = (matrix(table.filter(pa.array(m)), term[m] - at, n) for m in (one, two))
            for j, b in enumerate(names[1]):
                shares = q[:, j : j + 1]
                value = (far(p, shares) - far(p, q0[j]) - far(p0[None, :], shares) + far(p0, q0[j])[None, :]).sum(0)
                for i, a in enumerate(names[0]):
                    if a != b:
                        sums[a, b] = sums.get((a, b), 0) + int(value[i])
        lang = key[0].as_py()
        return pa.table([pa.array([lang] * len(sums), pa.string()), pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])

    return dealt.groupBy("lang", "block", "pair").applyInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, cfg: AuditConfig = AuditConfig(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text", scan: bool = False) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of every source of a language to its others, and its most typical terms.

    Terms are runs of ASCII letters and of characters outside ASCII, A-Z lower-cased; a language keeps those in least_docs of its
    documents. A share is 1 + floor(10^9 * (count + 1) / (all counts + kept terms)). Part pair has every other source of the
    language, valued by the sum over all kept terms of floor((p - q)^2 / q); part term the top terms above the language's own share q.
    Ranks are by value, then the item's bytes. Null text, language and source count as empty; repeated rows are documents of their own; a group without
    terms has all shares at their least; a language with one source has no pairs; without kept terms all pairs are 0. An empty table has no rows.
    Further columns are not read. scan as in common.placed.
    """
    texts, groups = collapsed(docs, lang_col, source_col, text_col, scan)
    counts = C.materialize(term_counts(texts), "counts")
    kept = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("by"), F.sum("n").alias("all"), F.sum("d").alias("d")).filter(F.col("d") >= cfg.least_docs)
    kept = C.materialize(kept.drop("d"), "kept")
    entries = kept.select("lang", "term", "all", F.explode("by").alias("s")).select("lang", "term", "all", "s.source", "s.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    known = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    total = F.coalesce("own_n", F.lit(0)) + F.col("v")
    # v is null where a language keeps no term; so are its shares.
    known = C.materialize(known.select("lang", "source", "v", total.alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"), _scaled(F.lit(1).cast("long"), total).alias("p0")), "groups")
    shared = entries.join(known, ["lang", "source"]).select("lang", "term", "source", _scaled(F.col("n") + 1, F.col("total")).alias("p"), "p0", _scaled(F.col("all") + 1, F.col("lang_total")).alias("q"))
    shared = C.materialize(shared, "shares")

    best = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))
    others = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = known.join(others, "lang").filter("source <> item")
    plain = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * _far(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # A source's terms by their share: few different ones, however many terms it has.
    levels = C.materialize(shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")), "levels")
    met = levels.join(others, "lang").filter("source <> item")
    ahead = met.select("lang", "source", "item", (F.col("k") * (_far(F.col("p"), F.col("q0")) - _far(F.col("p0"), F.col("q0")))).alias("value"))
    behind = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (_far(F.col("q0"), F.col("p")) - _far(F.col("q0"), F.col("p0")))).alias("value"))
    most = known.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    both = _common(shared.drop("q"), shared.count(), most, cfg)
    summed = plain.unionByName(ahead).unionByName(behind).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    near = summed.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    # Spark keeps each task's first rows of a group before it deals them out by group.
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return near.select(columns).unionByName(top.select(columns))
