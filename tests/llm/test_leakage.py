import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import DATA

from decistrata.llm import leakage
from decistrata.llm.text import Hasher, plain, words_of

NAMES, GOODS = ["Oskvik", "Varwick", "Fenlora", "Ilddara", "Sidheim", "Kelmere", "Pelgate"], ["tin soup", "wool yarn", "candle wax", "glass beads", "lamp oil"]


def puzzle(rng):
    n, g = lambda: rng.choice(NAMES), lambda: rng.choice(GOODS)
    s = [
        f"A barge in {n()} begins the month with {rng.randint(10, 999)} drums of {g()}.", f"Sparks ruin one in {rng.randint(2, 99)} barrels of {g()} kept at {n()}, as Odric notes with regret.",
        f"The rent in {n()} is {rng.randint(10, 999)} marks per crate, half what Wista pays for {g()}.", f"Before Sunday the ramp at {n()} is shut, so at most {rng.randint(10, 999)} loads of {g()} can leave.",
        f"A rival from {n()} bids {rng.randint(10, 999)} tokens for all {g()} that is still unsold on Monday.",
    ]
    rng.shuffle(s)
    return s


def wrap(s, width=40):
    out, line = [], ""
    for w in s.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n> ".join([*out, line])


FILL = "People in the town often ask for spare parts, so the warehouse keeps some more of it. The night team counts paint cans at the end of the month. "


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    items = {k: puzzle(rng) for k in range(60)}
    docs, true = {}, set()
    for k, s in items.items():
        text = " ".join(s)
        for j, t in enumerate([text, text.upper(), FILL + wrap(text) + FILL, " ".join(rng.sample(s, len(s))), " ".join(s[1:4]), "<b>" + "</b> ".join(text.split(" ")), text.replace("a", "а").replace("o", "о"), "­".join(text), "\n\n".join(w if i % 11 else "also" for i, w in enumerate(text.split()))]):
            docs[k * 100 + j] = FILL * rng.randint(0, 3) + t + FILL
            true.add((k * 100 + j, k))
        docs[k * 100 + 50] = FILL + s[0] + FILL  # a short quotation
        docs[k * 100 + 51] = FILL + " ".join(puzzle(rng))  # another puzzle
    return {k: " ".join(s) for k, s in items.items()}, docs, true


def test_found(spark, cases):
    items, docs, true = cases
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").selectExpr("*", "1 as item_id", "0.5 as share")
    i = spark.createDataFrame(list(items.items()), "item_id bigint, passage string").selectExpr("*", "'x' as text")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.held_passages(d, i).collect()}
    assert got == true
    blocks = {(r["doc_id"], r["item_id"]) for r in leakage.held_passages(d, i, leakage.Search(block=200, words=300)).collect()}
    assert blocks == true


def scan(items, docs, search=leakage.Search()):
    """Pairs that one pass over the documents finds, without Spark."""
    table = pa.table({"doc_id": list(docs), "text": list(docs.values())})
    out = {}
    for block in leakage.indexes(sorted(items.items()), search):
        for b in leakage._scan(iter(table.to_batches()), block, search):
            out |= {(d, i): s for d, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    return out


def brute(items, docs, search=leakage.Search()):
    """Share of every passage in every stretch of every document, from the definition."""
    words = {i: words_of(plain(t)) for i, t in items.items()}
    seen = Counter(p for w in words.values() for p in set(zip(w, w[1:], strict=False)))
    out = {}
    for d, text in docs.items():
        w = words_of(plain(text))
        for i, own in words.items():
            weight = [(math.log((len(words) + 1) / seen[p]) / math.log(len(words) + 1)) ** 2 for p in zip(own, own[1:], strict=False)]
            most = [max(weight[max(k - 1, 0) : k + 1]) for k in range(len(own))]
            size = int(search.spread * len(own))
            best = 0.0
            for first in range(max(len(w) - size, 0) + 1):
                part = w[first : first + size]
                runs = set(zip(part, part[1:], part[2:], strict=False))
                pairs = {q for k in range(len(own) - 2) if tuple(own[k : k + 3]) in runs for q in (k, k + 1)}
                best = max(best, sum(max([weight[q] for q in (k - 1, k) if q in pairs], default=0.0) for k in range(len(own))) / sum(most))
            if best > search.share:
                out[d, i] = best
    return out


def test_all_that_the_definition_holds():
    """The filter loses nothing, and pieces strewn over more than the stretch don't add up."""
    rng = random.Random(3)
    items = {k: puzzle(rng) for k in range(25)}
    docs = {}
    for k, s in items.items():
        w = " ".join(s).split()
        for j in range(12):
            part = [x if rng.random() > j / 40 else rng.choice(w) for x in w]
            docs[k * 100 + j] = " ".join(part[: rng.randint(len(w) // 3, len(w))])
        docs[k * 100 + 20] = (" ".join(puzzle(rng)) + " ").join(s)
        docs[k * 100 + 21] = (FILL * 3).join(s)
    texts = {k: " ".join(s) for k, s in items.items()}
    for search in (leakage.Search(spread=2.0), leakage.Search()):
        got, want = scan(texts, docs, search), brute(texts, docs, search)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
        assert 40 < len(got) < len(docs)


@pytest.fixture(scope="module")
def passages():
    return {r["item_id"]: r["passage"] for r in pq.read_table(f"{DATA}/eval_items.parquet").to_pylist()}


@pytest.mark.parametrize("k", range(4, 13))
def test_every_kth_word_changed(k, passages):
    """Recall by the kind of change, over all test items."""
    docs = {n: " ".join(w if (j + 1) % k else "also" for j, w in enumerate(words_of(plain(t)))) for n, t in passages.items()}
    got = scan(passages, docs)
    assert sum((n, n) in got for n in passages) >= (0.97 if k == 4 else 1.0) * len(passages) and all(d == i for d, i in got)


def test_long_text_with_one_quotation(passages):
    """All other items, and two pieces of each far apart, make no case; three quarters of one do."""
    some = sorted(passages)[::6]
    rest = [t for n, t in passages.items() if n not in some]
    text = FILL * 200 + " ".join(rest)
    for t in map(passages.get, some):
        text += t[: len(t) // 4] + FILL * 60 + t[-len(t) // 3 :] + FILL * 60
    got = scan(passages, {1: text})
    assert {i for _, i in got} == set(passages) - set(some)
    last = passages[some[-1]]
    assert set(scan(passages, {1: text + last[len(last) // 4 :] + FILL * 200})) - set(got) == {(1, some[-1])}


def test_a_short_passage_changes_no_other(cases):
    items, docs, _ = cases
    alone, beside = scan(items, docs), scan({**items, 800: "lamp oil", 801: "zzz", 802: "Two short words"}, {**docs, 7777: "We sell Lamp Oil."})
    assert {k: v for k, v in beside.items() if k[1] < 800}.keys() == alone.keys()
    assert (7777, 800) in beside and not any(i in (801, 802) for _, i in beside)


def test_candidates_lose_nothing_within_radius():
    """Multi-index lookup against comparing every pair of fingerprints."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    noise = base[rng.integers(0, 200, 4000)]
    for _ in range(3):
        noise ^= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    noise = np.concatenate([noise, rng.integers(0, 2**63, 2000, dtype=np.uint64)])
    index = leakage.Index([], 3, leakage.Search(), {}, {})
    index._lookup(base, np.arange(200))
    brute = np.argwhere(np.bitwise_count(noise[:, None] ^ base[None, :]) <= 3)
    for chunk in (1 << 19, 1000):
        at, who = index.near(noise, chunk)
        assert set(zip(at.tolist(), who.tolist(), strict=True)) == set(map(tuple, brute.tolist()))


def test_larger_radius_loses_nothing():
    """Bits that differ are spread over the fingerprint, so that four blocks would all differ."""
    text = " ".join(f"word{k}" for k in range(40))
    for radius in (4, 6, 11):
        ((index,),) = leakage.indexes([(1, text)], leakage.Search(radius=radius))
        flip = sum(1 << (64 * k // radius) for k in range(radius))
        at, _ = index.near(index.prints ^ np.uint64(flip))
        assert set(at.tolist()) == set(range(len(index.prints)))
    with pytest.raises(ValueError):
        leakage.Index([], 3, leakage.Search(radius=64), {}, {})


def test_fingerprints():
    h = Hasher().array(words_of(plain("one two three four five six seven eight nine ten")))
    for window in (1, 2, 3, 4, 8):
        f = leakage.fingerprints(h, window)
        bits = (h[1 : 1 + window, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert len(f) == 11 - window
        assert int(f[1]) == sum(int(2 * s >= window) << k for k, s in enumerate(bits.sum(axis=0).tolist()))
        assert len(leakage.fingerprints(h[: window - 1], window)) == 0


def test_nothing_to_find(spark, cases):
    items, docs, _ = cases
    i = spark.createDataFrame(list(items.items()) + [(900, None), (901, ""), (902, "...")], "item_id bigint, passage string")
    d = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "short"), (None, items[0]), (6, FILL * 5000)], "doc_id bigint, text string")
    assert leakage.held_passages(d, i).count() == 0
    assert leakage.held_passages(d.limit(0), i).count() == 0
    assert leakage.held_passages(d, i.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, items[0]), (1, items[0])], "doc_id bigint, text string")
    assert [tuple(r)[:2] for r in leakage.held_passages(twice, i.unionByName(i)).collect()] == [(1, 0)]


def test_plain():
    assert words_of(plain("Ware-\nhouse <b>Ｆｕｌｌ</b> café in­vent­ory а1 a\\nb &amp; 中文")) == ["warehouse", "full", "cafe", "inventory", "a1", "a", "b", "中", "文"]
