"""Reading level of each document.

A linear ranker is learned from pairs of graded documents of one script (Han or another; languages of one
script share their scale, as words of their own tell them apart): the one that raters put higher must
score higher. Features are the document's vocabulary (share of each word) and its syntax
(lengths of words and sentences, links within sentences). Scores of short passages are calibrated
into levels by isotonic regression, and a document gets the level of most of its text, so that a
few sentences of another level don't shift it.

The ranker is fitted on the driver from a bounded sample of graded documents; everything else runs
over whole texts of all documents in one narrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ship
from .text import plain

_BULLET = r"^[ \t]*[-*•·–]"  # an item of a list starts a sentence
_TOKEN = regex.compile(rf"(?m:{_BULLET})|\p{{Han}}|[^\W\d_\p{{Han}}]+|\d+|[.!?;:,\n。！？；：，、]")
_TOKEN_ASCII = re.compile(r"(?m:^[ \t]*[-*])|[a-z]+|[0-9]+|[.!?;:,\n]")
_LINE, _END, _LINK, _ITEM, _NUMBER, _HAN, _WORD = range(7)
_STOP = "\0"  #: a token between texts; no text holds it, as it is no letter, number or sign


class _Kinds(dict):
    """Token to its kind, remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        c = token[0]
        if c in "\n\0":
            kind = _LINE
        elif c in ".!?;。！？；":
            kind = _END
        elif c in ",:，：、":
            kind = _LINK
        elif c.isdigit():
            kind = _NUMBER
        elif "㐀" <= c <= "鿿" or "\U00020000" <= c <= "\U0003ffff" or "豈" <= c <= "\ufaff":
            kind = _HAN
        else:
            kind = _WORD if c.isalpha() else _ITEM
        self[token] = kind
        return kind


_KINDS = _Kinds()
SYNTAX = ("word length", "long words", "sentence length", "links", "numbers")


@dataclass(frozen=True)
class Setup:
    documents: int = 2000  #: graded documents that the ranker is fitted on, at most
    vocabulary: int = 12000  #: words with a weight of their own, the most widespread of those documents
    reach: int = 15  #: words on each side that a passage's score takes in,
    mix: float = 0.5  #: besides, by this part, the words of the same sentence
    long: int = 40  #: a sentence has one vote; a longer one one for each so many words
    steps: int = 220
    pairs: int = 12  #: pairs for each document
    decay: float = 2e-4
    rate: float = 0.05
    words: int = 40  #: running prose has so many words,
    han: int = 60  #: or so many Chinese characters
    prose: float = 0.6  #: share of words among a line's tokens from which the line is prose
    script: int = 24  #: graded documents of a script from which its levels are calibrated apart; fewer share those of all
    points: int = 24  #: passages of a graded document, evenly spread, that levels are calibrated on, or up to twice as many
    texts: int = 256  #: texts that are rated at once, at most,
    tokens: int = 200_000  #: and their tokens, beyond which no further text is added
    seed: int = 5


@dataclass
class Parsed:
    """Tokens of a text's prose. Han characters count as words and, in pairs, as vocabulary."""

    words: list[str]
    syntax: np.ndarray  # tokens x len(SYNTAX)
    sentence: np.ndarray  # number of each token's sentence
    latin: int
    han: int


def tokens_of(text: str) -> list[str]:
    p = plain(text)
    return (_TOKEN_ASCII if p.isascii() else _TOKEN).findall(p)


def parse(text: str, setup: Setup) -> Parsed:
    """Lines that are no prose (logs, tables, keys) are left out; wrapped lines make one sentence.
    A sentence ends at its sign, an empty or left-out line, or the next item of a list."""
    tokens = tokens_of(text)
    kind = np.fromiter(map(_KINDS.__getitem__, tokens), dtype=np.int8, count=len(tokens))
    new_line = kind == _LINE
    line = np.cumsum(new_line) - new_line  # a line's end belongs to it
    solid = np.bincount(line, weights=kind >= _NUMBER)
    alpha = np.bincount(line, weights=kind >= _HAN)
    prose = (solid > 0) & (alpha >= setup.prose * solid)
    inside = prose[line] if len(line) else np.zeros(0, dtype=bool)
    breaks = (kind == _END) | (kind == _ITEM) | (new_line & ~inside)
    spot = np.cumsum(breaks)
    here = np.flatnonzero(inside & (kind >= _NUMBER))
    if not len(here):
        return Parsed([], np.empty((0, len(SYNTAX)), np.float32), np.empty(0, np.int64), 0, 0)
    k = kind[here]
    _, own = np.unique(spot[here], return_inverse=True)
    first = np.searchsorted(spot[here], np.arange(spot[-1] + 2))  # where a spot's words start
    size = np.bincount(own)
    link = inside & (kind == _LINK)
    links = np.zeros(len(size))
    at = first[spot[link]]
    fine = at < len(here)
    np.add.at(links, own[at[fine]], 1.0)
    words = np.array(tokens, dtype=object)[here]
    length = np.fromiter(map(len, words), dtype=np.float32, count=len(words))
    latin = k == _WORD
    words[k == _NUMBER] = "0"
    han = k == _HAN
    if han.any():  # a character and the one before it
        pair = np.flatnonzero(han[1:] & han[:-1] & (np.diff(here) == 1)) + 1
        words[pair] = words[pair - 1] + words[pair]
    mine = size[own]
    syntax = np.stack([np.where(latin, np.minimum(length, 20) / 10, 0), latin & (length > 7), np.log1p(np.minimum(mine, 80)) / 4, (links / size)[own] * 5, k == _NUMBER], axis=1)
    return Parsed(words.tolist(), syntax.astype(np.float32), own, int(latin.sum()), int(han.sum()))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing step function of y over x: its ascending steps (x from, y)."""
    order = np.argsort(x, kind="stable")
    starts, values, weights = [], [], []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        starts.append(a)
        values.append(b)
        weights.append(1.0)
        while len(values) > 1 and values[-2] >= values[-1]:
            w = weights[-2] + weights[-1]
            values[-2:] = [(values[-2] * weights[-2] + values[-1] * weights[-1]) / w]
            weights[-2:] = [w]
            starts.pop()
    return np.array(starts), np.array(values)


def _cuts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    starts, values = isotonic(x, y)
    return np.array([starts[np.searchsorted(values, t)] if values[-1] >= t else np.inf for t in (1.5, 2.5, 3.5)])


class Weights(dict):
    """Word to weight; words without one share ``unknown``."""

    unknown = 0.0

    def __missing__(self, word: str) -> float:
        return self.unknown


@dataclass
class Model:
    weights: Weights
    syntax: np.ndarray
    cuts: np.ndarray  # by script (Latin, Han): passage scores from which the level is 2, 3 and 4
    setup: Setup

    def local(self, p: Parsed) -> np.ndarray:
        """Score of the passage around each word."""
        s = np.fromiter(map(self.weights.__getitem__, p.words), dtype=np.float64, count=len(p.words)) + p.syntax @ self.syntax
        return passage(s, p.sentence, self.setup)

    def level(self, text: str) -> int | None:
        """1 to 4, or None for a text without enough running prose. Every sentence has a vote, split over
        its words by the level of the passage around each; a tie goes to the lower level."""
        p = parse(text, self.setup)
        if p.latin < self.setup.words and p.han < self.setup.han:
            return None
        levels = np.searchsorted(self.cuts[int(p.han > p.latin)], self.local(p), side="right")
        size = np.bincount(p.sentence)[p.sentence]
        votes = np.bincount(levels, weights=1.0 / np.minimum(size, self.setup.long), minlength=4)
        return int(votes.argmax()) + 1


class Lexicon(dict):
    """Token to its place in arrays of kinds, lengths and weights, so that a token is looked at once."""

    limit = 400_000

    def __init__(self, weights: Weights):
        super().__init__()
        self.weights = weights
        self.kind, self.length, self.weight = np.zeros(1024, np.int8), np.zeros(1024, np.float32), np.zeros(1024)

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.kind):
            self.kind, self.length, self.weight = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.length, self.weight))
        kind = self.kind[at] = _KINDS[token]
        self.length[at] = len(token)
        self.weight[at] = self.weights["0" if kind == _NUMBER else token]
        self[token] = at
        return at


def rated(model: Model, lexicon: Lexicon, plains: list[list[str]]) -> list[int | None]:
    """:meth:`Model.level` of several texts, given as their tokens, in one go. Every step is that of
    :func:`parse`; a stop after each text keeps lines, sentences and passages apart."""
    setup = model.setup
    if len(lexicon) > lexicon.limit:
        lexicon.clear()
    tokens = [t for p in plains for t in (*p, _STOP)]
    n = len(plains)
    at = np.fromiter(map(lexicon.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    doc = np.repeat(np.arange(n), [len(p) + 1 for p in plains])
    kind = lexicon.kind[at]
    stop = at == lexicon[_STOP]
    new_line = kind == _LINE
    line = np.cumsum(new_line) - new_line
    solid = np.bincount(line, weights=kind >= _NUMBER)
    prose = (solid > 0) & (np.bincount(line, weights=kind >= _HAN) >= setup.prose * solid)
    inside = prose[line]
    spot = np.cumsum((kind == _END) | (kind == _ITEM) | stop | (new_line & ~inside))
    here = np.flatnonzero(inside & (kind >= _NUMBER))
    if not len(here):
        return [None] * n
    k, mine = kind[here], doc[here]
    own = np.cumsum(np.diff(spot[here], prepend=spot[here[0]]) > 0)
    size = np.bincount(own)
    link = np.flatnonzero(inside & (kind == _LINK))
    to = np.searchsorted(spot[here], spot[link])
    link, to = link[to < len(here)], to[to < len(here)]
    links = np.bincount(own[to[mine[to] == doc[link]]], minlength=len(size))
    length, latin, han = lexicon.length[at[here]], k == _WORD, k == _HAN
    weight = lexicon.weight[at[here]]
    if han.any():
        pair = np.flatnonzero(han[1:] & han[:-1] & (np.diff(here) == 1)) + 1
        first, second = here[pair - 1].tolist(), here[pair].tolist()
        weight[pair] = np.fromiter((model.weights[tokens[i] + tokens[j]] for i, j in zip(first, second, strict=True)), dtype=np.float64, count=len(pair))
        length[pair] += lexicon.length[at[here[pair - 1]]]
    around = size[own]
    syntax = np.stack([np.where(latin, np.minimum(length, 20) / 10, 0), latin & (length > 7), np.log1p(np.minimum(around, 80)) / 4, (links / size)[own] * 5, k == _NUMBER], axis=1).astype(np.float32)
    s = weight + syntax @ model.syntax
    c = np.concatenate([[0.0], np.cumsum(s)])
    ends = np.cumsum(np.bincount(mine, minlength=n))
    i = np.arange(len(s))
    a, b = np.maximum(i - setup.reach, (ends - np.bincount(mine, minlength=n))[mine]), np.minimum(i + setup.reach + 1, ends[mine])
    local = (1 - setup.mix) * (c[b] - c[a]) / (b - a) + setup.mix * (np.bincount(own, weights=s) / size)[own]
    words, characters = np.bincount(mine, weights=latin, minlength=n), np.bincount(mine, weights=han, minlength=n)
    script = (characters > words).astype(np.int64)
    level = (local[:, None] >= model.cuts[script[mine]]).sum(axis=1)
    votes = np.bincount(mine * 4 + level, weights=1.0 / np.minimum(around, setup.long), minlength=4 * n).reshape(n, 4)
    enough = (words >= setup.words) | (characters >= setup.han)
    return [v + 1 if ok else None for v, ok in zip(votes.argmax(axis=1).tolist(), enough.tolist(), strict=True)]


def passage(s: np.ndarray, sentence: np.ndarray, setup: Setup) -> np.ndarray:
    """Mean of the score of the words around and of that of the word's sentence."""
    around = smooth(s, setup.reach)
    own = np.bincount(sentence, weights=s) / np.maximum(np.bincount(sentence), 1)
    return (1 - setup.mix) * around + setup.mix * own[sentence]


def smooth(s: np.ndarray, reach: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(s)])
    i = np.arange(len(s))
    a, b = np.maximum(i - reach, 0), np.minimum(i + reach + 1, len(s))
    return (c[b] - c[a]) / (b - a)


def fit(graded: list[tuple[str, float]], setup: Setup = Setup()) -> Model:
    """Learn the ranker and its levels from (text, mean rating). Without graded prose every level is 2,
    the scale's general reader."""
    rng = np.random.default_rng(setup.seed)
    docs = [(p, y) for t, y in graded if (p := parse(t, setup)).latin >= setup.words or p.han >= setup.han]
    spread: dict[str, int] = {}
    for p, _ in docs:
        for w in set(p.words):
            spread[w] = spread.get(w, 0) + 1
    kept = sorted((w for w, n in spread.items() if n >= 2), key=lambda w: (-spread[w], w))[: setup.vocabulary]
    index = {w: i for i, w in enumerate(kept)}
    y = np.array([v for _, v in docs])
    n, m = len(docs), len(kept)
    if n < 2 or len(set(y.tolist())) < 2:
        return Model(Weights(), np.zeros(len(SYNTAX)), np.array([[-np.inf, np.inf, np.inf]] * 2), setup)
    ids = [np.fromiter((index.get(w, m) for w in p.words), dtype=np.int64, count=len(p.words)) for p, _ in docs]
    #: documents of a script are compared with each other
    script = np.array([int(p.han > p.latin) for p, _ in docs])
    keep = [np.ones(len(i), dtype=bool) for i in ids]
    w, v = np.zeros(m + 1), np.zeros(len(SYNTAX))
    cuts = np.zeros((2, 3))
    for rnd in range(2):
        # rows of the sparse document-feature matrix
        rows, cols, vals, syn = [], [], [], np.zeros((n, len(SYNTAX)))
        for d, (p, _) in enumerate(docs):
            k = keep[d]
            own, count = np.unique(ids[d][k], return_counts=True)
            rows.append(np.full(len(own), d))
            cols.append(own)
            vals.append(count / max(k.sum(), 1))
            syn[d] = p.syntax[k].mean(axis=0) if k.any() else 0.0
        rows_, cols_, vals_ = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        w, v = np.zeros(m + 1), np.zeros(len(SYNTAX))
        mw, sw, mv, sv = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)
        groups = [np.flatnonzero(script == g) for g in (0, 1)]
        for step in range(1, setup.steps + 1):
            s = np.bincount(rows_, weights=vals_ * w[cols_], minlength=n) + syn @ v
            a = np.concatenate([np.repeat(g, setup.pairs) for g in groups if len(g) > 1])
            b = np.concatenate([rng.choice(g, len(g) * setup.pairs) for g in groups if len(g) > 1]) if len(a) else a
            gap = y[a] - y[b]
            ok = gap != 0
            a, b, gap = a[ok], b[ok], gap[ok]
            up, down = np.where(gap > 0, a, b), np.where(gap > 0, b, a)
            pull = np.abs(gap) / (1 + np.exp(np.clip(s[up] - s[down], -30, 30)))
            g = (np.bincount(down, weights=pull, minlength=n) - np.bincount(up, weights=pull, minlength=n)) / max(len(a), 1)
            gw = np.bincount(cols_, weights=vals_ * g[rows_], minlength=m + 1) + setup.decay * w / (m + 1) ** 0.5
            gv = syn.T @ g + setup.decay * v
            for x, gx, mx, sx in ((w, gw, mw, sw), (v, gv, mv, sv)):
                mx += 0.1 * (gx - mx)
                sx += 0.001 * (gx * gx - sx)
                x -= setup.rate * (mx / (1 - 0.9**step)) / (np.sqrt(sx / (1 - 0.999**step)) + 1e-8)
        scores = [passage(w[i] + p.syntax @ v, p.sentence, setup) for i, (p, _) in zip(ids, docs, strict=True)]
        part = [np.flatnonzero(k)[:: max(1, k.sum() // setup.points)] for k in keep]
        xs = np.concatenate([s[q] for s, q in zip(scores, part, strict=True)])
        ys = np.concatenate([np.full(len(q), t) for q, t in zip(part, y, strict=True)])
        gs = np.concatenate([np.full(len(q), g) for q, g in zip(part, script, strict=True)])
        cuts = np.stack([_cuts(xs, ys) if not enough else _cuts(xs[gs == g], ys[gs == g]) for g, enough in enumerate(np.bincount(script, minlength=2) >= setup.script)])
        # the second fit leaves out passages that are plainly of another level than their document
        keep = [(np.abs(np.searchsorted(cuts[g], s, side="right") + 1 - t) <= 0.75) for s, t, g in zip(scores, y, script, strict=True)]
        keep = [k if k.mean() > 0.3 else np.ones(len(k), dtype=bool) for k in keep]
    weights = Weights({x: float(w[i]) for x, i in index.items()})
    weights.unknown = float(w[m])
    return Model(weights, v, cuts, setup)


def grades(documents: DataFrame, levels: DataFrame, setup: Setup = Setup()) -> list[tuple[str, float]]:
    """Texts and mean ratings of ``setup.documents`` graded documents at most, those of the smallest
    hash of their id. Ratings that are null or off the scale don't count; a rater counts once."""
    r = levels.where(F.col("reading_level").between(1, 4) & F.col("doc_id").isNotNull()).groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("v"))
    r = r.groupBy("doc_id").agg(F.avg("v").alias("level"))
    few = {x[0]: x[1] for x in r.orderBy(F.xxhash64("doc_id"), "doc_id").limit(setup.documents).collect()}
    chosen = documents.where(F.col("doc_id").isin(list(few)) & F.col("text").isNotNull()) if few else documents.limit(0)
    return sorted((t, few[d]) for d, t in chosen.select("doc_id", "text").collect())


def _rate(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(model.weights)
    for batch in batches:
        levels: list[int | None] = []
        part: list[list[str]] = []
        size = 0
        for text in batch.column(0):
            part.append(tokens_of(text.as_py() or ""))
            size += len(part[-1])
            if len(part) >= model.setup.texts or size >= model.setup.tokens:
                levels += rated(model, lexicon, part)
                part, size = [], 0
        levels += rated(model, lexicon, part) if part else []
        kept = range(1, batch.num_columns)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(levels, pa.int32())], [*[batch.schema.field(i).name for i in kept], "reading_level"])


def rate(documents: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``reading_level`` of every document; the level is null without enough running prose
    (null, empty and short texts, logs, tables). Kept columns pass through, so no join follows."""
    ship(documents.sparkSession)
    m = documents.sparkSession.sparkContext.broadcast(model)
    d = documents.select(F.col("text").cast("string").alias("_text"), *[F.col(c).cast("bigint") if c == "doc_id" else F.col(c) for c in keep])
    schema = ", ".join([*[f"`{c}` {t}" for c, t in d.dtypes[1:]], "reading_level int"])
    return d.mapInArrow(lambda it: _rate(it, m.value), schema)


def reading_levels(documents: DataFrame, levels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """Fit on the graded documents and rate all with running prose."""
    return rate(documents, fit(grades(documents, levels, setup), setup)).where(F.col("reading_level").isNotNull())
