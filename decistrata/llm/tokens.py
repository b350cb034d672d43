"""Encoding a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; a piece's ids depend on the piece alone, so
every distinct piece is merged once and remembered. New pieces go, bucketed by length, into padded
matrices of token ids. Each round every row merges its leftmost pair of least rank, found by hashed
lookup of all its pairs; rows without a pair left are finished and compacted away. Pieces longer
than ``LONGEST`` bytes go through an equivalent heap of pairs, so one endless word takes n log n steps
and not n squared.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ship

LONGEST = 512
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Pair of token ids to the id of their merger, open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(8, (4 * max(len(pairs), 1)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int64)
        slot, self.probes = self._slot(keys), 0
        while len(keys):  # each round places one key for each free slot, the others move on
            free = self.keys[slot] == -1
            first = np.unique(np.where(free, slot, -1), return_index=True)
            at = first[1][first[0] >= 0]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            rest = np.ones(len(keys), dtype=bool)
            rest[at] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.full(flat.shape, NONE, dtype=np.int64)
        todo = np.arange(len(flat))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            if not go.any():
                break
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out.reshape(keys.shape)


class Encoder:
    """Texts to ids. Remembers pieces, up to ``limit`` of them."""

    limit = 1_000_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        # the same cuts for texts of ASCII alone, by the standard module, which is several times as fast
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii = None if r"\p" in plain else re.compile(plain, re.ASCII)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs)
        self.known: dict[str, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        # \s of ASCII mode leaves out the separators 0x1c to 0x1f, which are rare and go the long way
        if self.ascii is not None and text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.ascii.findall(text)
        return self.pattern.findall(text)

    def _long(self, piece: bytes) -> list[int]:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                k = after[j]
                if (x := self.pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (x := self.pairs.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        cells = np.zeros((n, width), dtype=np.int64)
        inside = np.arange(width) < lengths[:, None]
        cells[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[list[int]] = [[]] * n
        rows = np.arange(n)
        while len(rows):
            width = cells.shape[1]
            rank = self.table.get(cells[:, :-1], cells[:, 1:])
            rank[np.arange(1, width) >= lengths[:, None]] = NONE
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)  # the leftmost least
            least = rank[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NONE)
            done = least == NONE
            for r, c, k in zip(rows[done], cells[done], lengths[done], strict=True):
                out[r] = c[:k].tolist()
            rows, cells, lengths, at, least = rows[~done], cells[~done], lengths[~done], at[~done], least[~done]
            if len(rows):
                column = np.arange(width - 1)
                cells = np.where(column <= at[:, None], cells[:, :-1], cells[:, 1:])
                cells[np.arange(len(rows)), at] = least
                lengths = lengths - 1
                cells = cells[:, : lengths.max()]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Merge pieces that aren't known yet."""
        coded = [(p, p.encode("utf-8", "surrogatepass")) for p in pieces]
        coded.sort(key=lambda x: len(x[1]))
        short = [x for x in coded if len(x[1]) <= LONGEST]
        k = 0
        while k < len(short):
            top = max(8, 2 * len(short[k][1]))  # a bucket holds lengths up to twice the least
            end = k
            while end < len(short) and len(short[end][1]) <= top and (end - k) * top < 2_000_000:
                end += 1
            for (p, _), ids in zip(short[k:end], self._matrix([b for _, b in short[k:end]]), strict=True):
                self.known[p] = ids
            k = end
        for p, b in coded[len(short) :]:
            self.known[p] = self._long(b)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, one after the other."""
        cuts = [self.cut(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = set(itertools.chain.from_iterable(cuts)).difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        ids = [np.fromiter(itertools.chain.from_iterable(map(get, c)), dtype=np.int32) for c in cuts]
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return offsets, np.concatenate(ids) if ids else np.empty(0, np.int32)


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for a worker process, as long as the vocabulary stays the same."""
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def _encode(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str, chars: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks, pattern)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        size, start = 0, 0
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        for k, n in enumerate(lengths):
            size += n
            if size >= chars or k == len(lengths) - 1:
                offsets, flat = encoder.encode([t or "" for t in texts.slice(start, k + 1 - start).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(start, k + 1 - start), lists], ["doc_id", "ids"])
                start, size = k + 1, 0


def token_ids(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None, chars: int = 2_000_000) -> DataFrame:
    """``doc_id, ids`` for every row of ``documents``, without special tokens.

    Empty and null texts give an empty list; strings of special tokens are ordinary text; repeated
    rows give repeated rows. ``vocabulary`` is the path of a rank file on the driver (default: the
    installed byte_bpe_50k); its ranks, under 1 MB, go to the workers as a broadcast. ``chars`` bounds
    the texts that a worker holds at once; one text is never cut.
    """
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    ship(documents.sparkSession)
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(str(vocabulary)))
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(lambda it: _encode(it, ranks.value, pattern, chars), "doc_id bigint, ids array<int>")
