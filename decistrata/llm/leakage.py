"""Evaluation passages inside corpus documents.

A word of a passage is *held* where it lies in a run of ``window`` neighbouring words that the document
shares, and a passage is held where more than half of its words are, each weighted by how telling the
shared pair of words around it is: the square of its inverse frequency among the passages, as in a cosine
of two weighted texts, so that the mould which all puzzles share hardly counts. All of them must lie
within a stretch of the document of ``spread`` passage lengths, so that pieces strewn over a long text
don't add up.

Candidates: each run gets a 64-bit SimHash of its words. Of a passage those runs are indexed, rarest
first, without which no more than half of it can be held; a document that holds the passage therefore
shares one of them, and its fingerprint is within any radius. The fingerprint is cut into radius+1
blocks, four at least: two fingerprints within the radius agree in one block at least, so looking up
every block finds all of them. The candidates are then verified exactly. So the filter loses nothing.

The passages are a stated query set against all documents: each task of the scan holds the index of
a block of passages of bounded size, documents are never shuffled, and beyond the bound further
blocks follow.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ship
from .text import Hasher, plain, words_of

BLOCK_BITS = 16  #: of a block, at most
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Search:
    window: int = 3  #: words of a run; a passage of fewer words is one run
    radius: int = 3  #: bits, below 64
    share: float = 0.5  #: a passage of which more than this is held counts
    spread: float = 8.0  #: passage lengths that the held words may be spread over
    block: int = 1_000_000  #: words of passages of a pass over the documents; an index takes some 80 bytes a word
    words: int = 150_000  #: words of documents that are worked on at once


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every run of ``window`` word hashes: bit b is set where at least half of the words have it."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if window == 1:
        return hashes
    if window == 2:
        return hashes[1:] | hashes[:-1]
    if window == 3:
        a, b, c = hashes[:n], hashes[1:-1], hashes[2:]
        return (a & b) | (c & (a | b))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((n, 64), dtype=np.uint16)
    for k in range(window):
        total += bits[k : k + n]
    return np.packbits(2 * total >= window, axis=1).view(np.uint64).reshape(-1)


def runs_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """Hash of each run of ``window`` words in their order."""
    n = len(hashes) - window + 1
    out = hashes[: max(n, 0)].copy()
    for k in range(1, window):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : k + n]
    return out


class Passage:
    """Weights of a passage's words and pairs, and how much of it a set of its runs holds."""

    def __init__(self, ident: int, hashes: np.ndarray, window: int, weight: dict[int, float]):
        self.ident, self.words, self.window = ident, len(hashes), window
        self.pair = np.array([weight[p] for p in runs_of(hashes, min(2, len(hashes))).tolist()])
        self.total = float(self._words(self.pair).sum())

    def _words(self, pair: np.ndarray) -> np.ndarray:
        """Weight of each word: that of the greater of its pairs."""
        if self.words == 1:
            return pair
        out = np.zeros(self.words)
        out[:-1] = pair
        np.maximum(out[1:], pair, out=out[1:])
        return out

    def held(self, has: np.ndarray) -> float:
        """Share that the runs for which ``has`` is true hold."""
        seen = np.zeros(len(self.pair), dtype=bool)
        for k in range(max(self.window - 1, 1)):
            seen[k : k + len(has)] |= has
        return float(self._words(np.where(seen, self.pair, 0.0)).sum() / self.total)

    def reach(self) -> np.ndarray:
        """The most that each run can add to the share."""
        each, n = self._words(self.pair), self.words - self.window + 1
        return sum(each[k : k + n] for k in range(self.window)) / self.total

    def needed(self, rarity: np.ndarray, share: float) -> np.ndarray:
        """Runs, rarest first, without which no more than ``share`` can be held."""
        has, order = np.ones(len(rarity), dtype=bool), np.argsort(rarity, kind="stable")
        low, high = 0, len(order)  # the fewest that suffice; what is left over only shrinks
        while low < high:
            mid = (low + high) // 2
            has[:] = True
            has[order[:mid]] = False
            low, high = (low, mid) if self.held(has) <= share else (mid + 1, high)
        return order[:low]


class Index:
    """The passages of one block that have runs of one length: fingerprints by block value for the
    candidates, and all runs for their verification."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int, search: Search, weight: dict[int, float], rarity: dict[int, int]):
        if not 0 <= search.radius < 64:
            raise ValueError("radius must be 0 to 63 bits")
        self.window, self.search = window, search
        self.passages = [Passage(i, h, window, weight) for i, h in items]
        runs = [runs_of(h, window) for _, h in items]
        self.keys = np.unique(np.concatenate(runs)) if runs else np.empty(0, np.uint64)
        self.own = [np.searchsorted(self.keys, r) for r in runs]  # of each passage, the key of each run
        needed = [p.needed(np.array([rarity[x] for x in r.tolist()]), search.share) for p, r in zip(self.passages, runs, strict=True)]
        prints = [np.unique(fingerprints(h, window)[k]) for (_, h), k in zip(items, needed, strict=True)]
        self._lookup(np.concatenate(prints) if prints else np.empty(0, np.uint64), np.repeat(np.arange(len(prints)), [len(p) for p in prints]))

    def _lookup(self, prints: np.ndarray, owners: np.ndarray) -> None:
        self.prints, self.owners = prints, owners
        n = max(64 // BLOCK_BITS, self.search.radius + 1)
        self.cuts = [64 * b // n for b in range(n + 1)]
        self.blocks = []
        for b in range(n):
            v = self.block_of(prints, b)
            order = np.argsort(v, kind="stable")
            self.blocks.append((np.searchsorted(v[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32), order.astype(np.int32)))

    def block_of(self, prints: np.ndarray, b: int) -> np.ndarray:
        width = self.cuts[b + 1] - self.cuts[b]
        return ((prints >> np.uint64(self.cuts[b])) & np.uint64((1 << width) - 1)).astype(np.int32)

    def near(self, prints: np.ndarray, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, passage) of all fingerprints within the radius."""
        at, who = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for first in range(0, len(prints), chunk):
            part = prints[first : first + chunk]
            for b, (starts, order) in enumerate(self.blocks):
                v = self.block_of(part, b)
                count = starts[v + 1] - starts[v]
                hit = np.flatnonzero(count)
                count = count[hit]
                pos = np.repeat(hit, count)
                within = np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count)
                mine = order[np.repeat(starts[v[hit]], count) + within]
                ok = np.bitwise_count(part[pos] ^ self.prints[mine]) <= self.search.radius
                at.append(pos[ok] + first)
                who.append(self.owners[mine[ok]])
        return np.concatenate(at), np.concatenate(who)

    def occurrences(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key) of each run of a document that some passage has."""
        r = runs_of(hashes, self.window)
        key = np.searchsorted(self.keys, r)
        key[key == len(self.keys)] = 0
        at = np.flatnonzero(self.keys[key] == r)
        return at, key[at]

    def held(self, at: np.ndarray, key: np.ndarray, item: int) -> float:
        """The greatest share of a passage that one stretch of the document holds, from the places of runs;
        0 where not even the whole document holds enough."""
        p, own, s = self.passages[item], self.own[item], self.search
        mine = np.isin(key, own)
        at, key = at[mine], key[mine]
        share = p.held(np.isin(own, key))
        limit = int(s.spread * p.words) - p.window
        if share <= s.share or at[-1] - at[0] <= limit:
            return share if share > s.share else 0.0
        # a stretch that starts in a half lies in three halves; only where these hold enough, every start is tried
        half = limit // 2 + 1
        tile = (at // half)[:, None] - np.arange(3)
        names, number = np.unique(key, return_inverse=True)
        once = np.unique(tile.reshape(-1) * len(names) + np.repeat(number, 3))
        tiles, which = np.unique(once // len(names), return_inverse=True)
        there, reach = np.isin(own, names), np.zeros(len(names))
        np.add.at(reach, np.searchsorted(names, own[there]), p.reach()[there])
        best = 0.0
        for t in tiles[np.bincount(which, weights=reach[once % len(names)]) > s.share].tolist():
            a, b, c = np.searchsorted(at, [t * half, (t + 1) * half, (t + 3) * half])
            if p.held(np.isin(own, key[a:c])) > s.share:
                for k in range(a, b):
                    best = max(best, p.held(np.isin(own, key[k : np.searchsorted(at, at[k] + limit, side="right")])))
        return best if best > s.share else 0.0


def _scan(batches: Iterator[pa.RecordBatch], indexes: list[Index], search: Search) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()

    def found(ids: list[int], parts: list[list[str]]) -> pa.RecordBatch:
        ends = np.cumsum([len(p) for p in parts])
        h = hasher.array([w for p in parts for w in p])
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        for index in indexes:
            at, who = index.near(fingerprints(h, index.window))
            doc = np.searchsorted(ends, at, side="right")
            inside = at + index.window <= ends[doc]
            last, places = -1, None
            for d, i in np.unique(np.stack([doc[inside], who[inside]], axis=1), axis=0).tolist():
                if d != last:
                    last, places = d, index.occurrences(h[ends[d] - len(parts[d]) : ends[d]])
                share = index.held(*places, i) if len(places[0]) else 0.0
                if share:
                    for column, value in zip(out, (ids[d], index.passages[i].ident, share), strict=True):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "share"])

    for batch in batches:
        ids, parts, size = [], [], 0
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if text is not None and ident is not None:
                words = words_of(plain(text))
                if words:
                    ids.append(ident)
                    parts.append(words)
                    size += len(words)
            if size >= search.words:
                yield found(ids, parts)
                ids, parts, size = [], [], 0
        if ids:
            yield found(ids, parts)


def indexes(rows: list[tuple[int, str]], search: Search) -> Iterator[list[Index]]:
    """Indexes of blocks of passages, one for each length of run; weights and rarity are over all passages."""
    hasher = Hasher()
    items = [(i, h) for i, text in rows if len(h := hasher.array(words_of(plain(text))))]
    pairs, rarity = Counter(), Counter()
    for _, h in items:
        pairs.update(np.unique(runs_of(h, min(2, len(h)))).tolist())
        rarity.update(np.unique(runs_of(h, min(search.window, len(h)))).tolist())
    most = np.log(len(items) + 1)
    weight = {p: float(np.log((len(items) + 1) / n) / most) ** 2 for p, n in pairs.items()}
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, item in enumerate(items):
        block.append(item)
        size += len(item[1])
        if size >= search.block or k == len(items) - 1:
            lengths = sorted({min(search.window, len(h)) for _, h in block})
            yield [Index([(i, h) for i, h in block if min(search.window, len(h)) == w], w, search, weight, rarity) for w in lengths]
            block, size = [], 0


def held_passages(documents: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """``doc_id, item_id, share``: documents that hold more than half of a passage, once per pair;
    ``share`` is how much, by weight.

    Null, empty and blank texts hold nothing; rows without id are left out. A passage without words is
    held by nothing; one of fewer words than a run is held where all of them follow each other, whatever
    other passages are like. Passages are a query set: they are read to the driver and go to the tasks
    in blocks of ``search.block`` words.
    """
    rows = sorted({(r[0], r[1]) for r in items.select("item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).collect()})
    ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint"), "text")
    parts = []
    for block in indexes(rows, search):
        index = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(docs.mapInArrow(lambda it, index=index: _scan(it, index.value, search), "doc_id bigint, item_id bigint, share double"))
    if not parts:
        return docs.limit(0).select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("double").alias("share"))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
