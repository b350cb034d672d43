"""Splits that keep related records together.

Components come from parallel hooking and shortcutting over a parent table: every root hooks onto
the smallest root beside it, pointers are halved until they are flat, and the edges shrink to edges
between roots. Two rounds at least halve the roots that still have an edge (a star with a large centre
takes both), so rounds grow as the logarithm of the longest chain. Nothing but a size histogram comes to
the driver.

Which components go where is decided on that histogram (size and how many components have it):
each split first gets its proportion of the components of every size, rounded down, so that large and
small ones are in all splits; subset-sum bitsets over the size multiplicities then find the rest that
brings the totals closest to the targets. The rows follow by an exact rank within each size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import network_key, with_domain
from ..functions.ranking import rank_within
from ..sources import bounded, durable

#: Relations that bind two networks together; other notes don't. Fixed values.
BINDING = ("derived_from", "renamed_to", "merged_into", "split_from")
#: Rows of a split's total that are searched at first; of a larger total all of it where that misses.
UNITS = 1 << 22


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); the root is the component's
    smallest node. Nulls, loops and repeated edges are harmless; an empty table gives no rows."""
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = durable(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct())
    tops = []
    e = durable(e.where(F.col("a") != F.col("b")).distinct())
    while e.head(1):
        # hooking: each root takes the smallest root beside it, itself included
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        # shortcutting: halve the pointers, twice for each table written, until every one ends at a root
        while True:
            half = _shortcut(hooks.select("node", "up")).select("node", "up")
            hooks = durable(_shortcut(half))
            if not hooks.where("moved").head(1):
                break
        top = hooks.select(F.col("node").alias("root"), "up")
        tops.append(top)
        ta, tb = top.select(F.col("root").alias("a"), F.col("up").alias("ra")), top.select(F.col("root").alias("b"), F.col("up").alias("rb"))
        e = e.join(ta, "a").join(tb, "b").where(F.col("ra") != F.col("rb"))
        e = durable(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    parents = nodes.withColumn("root", F.col("node"))
    for top in tops:  # a table for each round, so their number grows as the logarithm too
        parents = parents.join(top, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return parents


def _shortcut(hooks: DataFrame) -> DataFrame:
    up = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
    return hooks.join(up, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))


def network_components(states: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    """``node, root`` of networks, written ``domain|number-LETTERS``, that binding links tie together.
    Notes on one network alone, of an unknown domain or relation, or with a string that names no
    network bind nothing."""
    node = lambda c: F.concat_ws("|", F.col("domain"), network_key(F.col(c)))
    bound = with_domain(links.where(F.lower(F.trim("relation")).isin(*BINDING)), domains).where(F.col("domain").isNotNull())
    known = network_key(F.col("network_id")).isNotNull() & network_key(F.col("related_network_id")).isNotNull()
    return components(bound.where(known).select(node("network_id").alias("a"), node("related_network_id").alias("b")))


def entities(states: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    """``domain, network_id, states, entity``: each way a domain's states write their network, how
    many rows do, and the entity (component) meant. Strings that name no network are left out."""
    written = with_domain(states.groupBy("domain_id", "network_id").agg(F.count(F.lit(1)).alias("n")), domains)
    written = written.groupBy("domain", "network_id").agg(F.sum("n").alias("states"))
    written = written.withColumn("node", F.concat_ws("|", F.col("domain"), network_key(F.col("network_id")))).where(F.col("domain").isNotNull() & network_key(F.col("network_id")).isNotNull())
    roots = network_components(states, links, domains)
    return written.join(roots, "node", "left").select("domain", "network_id", "states", F.coalesce("root", "node").alias("entity"))


def bound_pairs(states: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    """``domain_id, network_id_a, network_id_b``: two strings whose states must share a split."""
    e = durable(entities(states, links, domains))
    b = e.select(F.col("entity").alias("other"), F.col("network_id").alias("network_id_b"))
    pairs = e.join(b, F.col("entity") == F.col("other")).where(F.col("network_id") < F.col("network_id_b"))
    return pairs.select(F.col("domain").alias("domain_id"), F.col("network_id").alias("network_id_a"), "network_id_b").distinct()


def choose(histogram: dict[int, int], target: int) -> dict[int, int]:
    """How many of each size to take so that the total is as close to ``target`` as any choice is; ties go
    to the smaller total.

    At first each size gives its proportion of components, rounded down, and only the rest is searched.
    What hits the closest multiple of the sizes' common divisor can't be beaten. Otherwise most of the
    total is taken by size, largest first, and the last UNITS rows are searched; then, if that misses too, the
    whole total, up to the distance that was left.
    """
    usable = {s: m for s, m in histogram.items() if 0 < s <= 2 * target and m > 0}
    if not usable:
        return {}
    g = math.gcd(*usable)
    near = min(target // g * g, (target // g + 1) * g, key=lambda total: (abs(total - target), total))
    everything = sum(s * m for s, m in usable.items())
    even = {s: m * min(target, everything) // everything for s, m in usable.items()}
    best: tuple[int, dict[int, int]] | None = None
    for start in (even, {}):
        took = {s: k for s, k in start.items() if k}
        left = {s: m - took.get(s, 0) for s, m in usable.items()}
        rest = target - sum(s * k for s, k in took.items())
        for size in sorted(usable, reverse=True):
            k = min(left[size], max(0, rest - UNITS) // size)
            if k:
                took[size] = took.get(size, 0) + k
                left[size] -= k
                rest -= k * size
        whole = rest == target
        for size, k in _closest(left, rest, 2 * rest, g).items():
            took[size] = took.get(size, 0) + k
        total = sum(s * k for s, k in took.items())
        if best is None or (abs(total - target), total) < (abs(best[0] - target), best[0]):
            best = (total, took)
        if best[0] == near or whole:
            return best[1]
    return _closest(usable, target, target + min(target, abs(best[0] - target)), g)


def _closest(histogram: dict[int, int], target: int, cap: int, g: int) -> dict[int, int]:
    """The choice closest to ``target`` of those with a total up to ``cap``; ``g`` divides every size.

    Bit s of the bitset tells that a total of s x ``g`` can be reached. Multiplicities are taken in powers of
    two; the first step that reaches a total is kept, so the choice is read back from the sums
    alone: earlier totals were reached by earlier steps, and no step is used twice.
    """
    import numpy as np

    cap //= g
    goal = min(cap, target // g + (2 * (target % g) > g))
    steps, bits, mask = [], 1, (1 << (cap + 1)) - 1
    first = np.full(cap + 1, -1, dtype=np.int32)
    for size in sorted((s // g for s in histogram if s // g <= cap), reverse=True):
        left, k = min(histogram[size * g], cap // size), 1
        while left > 0 and not (bits >> goal) & 1:
            k = min(k, left)
            new = (bits << (size * k)) & mask & ~bits
            if new:
                raw = np.frombuffer(new.to_bytes((cap >> 3) + 1, "little"), dtype=np.uint8)
                for at in range(0, len(raw), 1 << 20):
                    some = np.flatnonzero(raw[at : at + (1 << 20)]) + at
                    spot = np.flatnonzero(np.unpackbits(raw[some], bitorder="little"))
                    first[some[spot >> 3] * 8 + (spot & 7)] = len(steps)
                bits |= new
            steps.append((size, k))
            left -= k
            k *= 2
    below, above = (bits & ((1 << (goal + 1)) - 1)).bit_length() - 1, bits >> goal
    best = [below, *([goal + (above & -above).bit_length() - 1] if above else [])]
    best = min(best, key=lambda total: (abs(total * g - target), total))
    taken: dict[int, int] = {}
    while best > 0:
        size, k = steps[first[best]]
        taken[size * g] = taken.get(size * g, 0) + k
        best -= size * k
    return taken


def plan(histogram: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """Split to {size: components}; the last split of ``shares`` takes what the others leave."""
    total = sum(s * m for s, m in histogram.items())
    left, out = dict(histogram), {}
    names = list(shares)
    for name in sorted(names[:-1], key=lambda n: (shares[n], n)):
        out[name] = choose(left, round(shares[name] * total))
        for s, k in out[name].items():
            left[s] -= k
    out[names[-1]] = {s: m for s, m in left.items() if m}
    return out


#: States of one network or entity that may come to one task.
HOT = 100_000


def _joined(states: DataFrame, small: DataFrame, key: str, how: str, hot: int) -> DataFrame:
    """Join to a table of networks or entities, a row each. States of those that have more than ``hot`` stay
    where they are: such keys, found by a count, are few and their rows are sent to all tasks."""
    many = states.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") > hot)).select(key)
    many = durable(many)
    if not many.head(1):
        return states.join(small, key, how)
    cold = states.join(bounded(many), key, "left_anti").join(small, key, how)
    return cold.unionByName(states.join(bounded(durable(many.join(small, key, how))), key))


def split(states: DataFrame, links: DataFrame, domains: DataFrame, shares: dict[str, float] | None = None, seed: int = 11, hot: int = HOT) -> DataFrame:
    """``state_id, domain_id, entity, split``: one row per state, every state in exactly one split.

    ``shares`` are proportions of states, in order; the last takes the rest. A state whose network
    or domain isn't known is an entity of its own. Deliveries of a state count once; rows without
    ``state_id`` name no state. The histogram that comes to the driver has at most sqrt(2 x states)
    rows, whatever the number of components.
    """
    shares = shares or {"test": 0.1, "validation": 0.1, "train": 0.8}
    s = with_domain(states.where(F.col("state_id").isNotNull()), domains).select("state_id", "domain", network_key(F.col("network_id")).alias("net"))
    s = s.groupBy("state_id").agg(F.max("domain").alias("domain"), F.max(F.when(F.col("domain").isNotNull() & F.col("net").isNotNull(), F.concat_ws("|", "domain", "net"))).alias("node"))
    s = _joined(durable(s), network_components(states, links, domains), "node", "left", hot)
    s = durable(s.select("state_id", "domain", F.coalesce("root", "node", F.concat(F.lit("state|"), F.col("state_id").cast("string"))).alias("entity")))
    sizes = durable(s.groupBy("entity").agg(F.count(F.lit(1)).alias("size")))
    histogram = {r[0]: r[1] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("m")).collect()}
    spark = states.sparkSession
    ranges = []
    done: dict[int, int] = {}
    for name, taken in plan(histogram, shares).items():
        for size, k in taken.items():
            ranges.append((size, done.get(size, 0), done.get(size, 0) + k, name))
            done[size] = done.get(size, 0) + k
    schema = "size bigint, above bigint, upto bigint, split string"
    r = spark.createDataFrame(ranges, schema)
    placed = rank_within(sizes, ["size"], ["entity"], seed).join(r, "size").where((F.col("rank") > F.col("above")) & (F.col("rank") <= F.col("upto"))).select("entity", "split")
    return _joined(s, placed, "entity", "inner", hot).select("state_id", F.col("domain").alias("domain_id"), "entity", "split")
