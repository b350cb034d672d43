"""Filling missing values by label propagation over group and similarity edges.

States and groups form a bipartite graph: a state is tied to its network, to its domain and week, and to
the states of its domain that are built alike (similarity edges). Observed values are clamped. A missing
number is the weighted mean of its neighbours' means, averaged again while the filled values of others
flow through the shared groups, until none changes by more than a stated part; a missing network is the
mean of the network distributions of states that look alike (pairs of structural values shared within a
domain), updated the same way. A state that no likeness reaches has the distribution of its domain's week
and of its domain.

All states of one network, week and likeness that lack a feature get the same value for it, and all
states of one likeness the same network. So what is propagated is one row for each such case with the
number of its states, whatever their number; the observed part is summed once per group. A network that
holds a third of all states is neither gathered in one task nor joined by one.

What can't be a measurement is told from the data. The typical size of a feature is the geometric mean of
its numbers other than zero. No measurement are NaN and infinities; numbers more than ``beyond`` times the
typical size; a number that is far out (``far`` times the typical size) in two features or more, as codes
are and peaks are not; and numbers below zero where the five most frequent of them make up half of all
below zero or more, as codes do and measurements do not. Any other number stays, however large.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import network_key, time_key, with_domain
from ..functions.values import let
from ..sources import bounded, durable

#: The greatest finite number.
MOST = sys.float_info.max
#: States of one case that may come to one task.
HOT = 100_000


@dataclass(frozen=True)
class Spread:
    rounds: int = 40  #: propagation rounds of numbers, at most;
    tolerance: float = 0.005  #: they end when no filled number changes by this part any more
    network_rounds: int = 2  #: propagation rounds of networks
    salts: int = 16
    network_weight: float = 3.0
    time_weight: float = 1.0
    like_weight: float = 1.0
    domain_weight: float = 0.5  #: of the domain beside its week, where no likeness tells a network
    sent: int = 250_000  #: means of groups, some 40 bytes each, that are sent to all tasks at most; more are joined by shuffle
    far: float = 1e3  #: typical sizes from which a number that recurs in two features is a code
    beyond: float = 1e9  #: typical sizes from which no number is a measurement
    structure: tuple[str, ...] = ("nodes", "arcs", "hub_share")  #: of ``network_features``; states are alike that share two


@dataclass(frozen=True)
class Possible:
    """What can be a measurement, by place of the feature."""

    size: list[float]
    codes: list[float]
    signed: set[int]
    beyond: float

    def of(self, v: Column, i: int) -> Column:
        fine = F.abs(v) <= min(self.beyond * self.size[i], MOST)  # NaN is greater
        fine = fine & ~v.isin(*self.codes) if self.codes else fine
        return F.when(fine if i in self.signed else fine & (v >= 0), v)


def catalog_features(catalog: DataFrame, groups: Sequence[str]) -> list[tuple[str, str]]:
    """Distinct (group, name) of the catalog, in order; the catalog decides the columns."""
    return sorted((r[0], r[1]) for r in catalog.where(F.col("feature_group").isin(*groups)).select("feature_group", "feature_name").distinct().collect())


def network_code(key: Column) -> Column:
    """A canonical network name as one number, which aggregates and joins as such. A name whose number
    has more than 15 digits gets a code below zero: it is known, but can't be supplied to others."""
    number, letters = F.substring_index(key, "-", 1), F.substring_index(key, "-", -1)
    code = number.try_cast("bigint") * 676 + (F.ascii(letters) - 65) * 26 + F.ascii(F.substring(letters, 2, 1)) - 65
    return F.when(F.length(number) <= 15, code).when(key.isNotNull(), -F.shiftrightunsigned(F.xxhash64(key), 1) - 1)


def network_name(code: Column) -> Column:
    letter = lambda i: F.char(F.lit(65) + i)
    return F.when(code >= 0, F.concat(F.floor(code / 676).cast("string"), F.lit("-"), letter(F.floor(F.pmod(code, F.lit(676)) / 26)), letter(F.pmod(code, F.lit(26)))))


def delivered(states: DataFrame, domains: DataFrame, features: Sequence[tuple[str, str]], spread: Spread = Spread()) -> DataFrame:
    """One row per delivery of a state: ``state_id``, ``domain, network, time`` as numbers, ``f0..``
    (features) and ``s0..`` (structural values) as they are. The maps are read here and nowhere else.
    Rows without ``state_id`` name no state and are left out."""
    s = with_domain(states.where(F.col("state_id").isNotNull()).select("state_id", "domain_id", "network_id", "time_id", *dict.fromkeys([*(g for g, _ in features), "network_features"])), domains)
    week = let(time_key(F.col("time_id")), lambda t: F.substring(t, 1, 4).cast("int") * 100 + F.substring(t, 7, 2).cast("int"))
    number = F.when(F.col("domain").isNotNull(), F.xxhash64("domain"))
    values = [F.col(g)[n].alias(f"f{i}") for i, (g, n) in enumerate(features)]
    values += [F.col("network_features")[x].alias(f"s{i}") for i, x in enumerate(spread.structure)]
    return s.select("state_id", number.alias("domain"), let(network_key(F.col("network_id")), network_code).alias("network"), week.alias("time"), *values)


def possible(rows: DataFrame, n: int, spread: Spread = Spread()) -> Possible:
    """The rule of the module's docstring for the columns ``f0..`` and ``s0..`` of delivered states. Only
    one row of sizes, the codes and a row per feature come to the driver."""
    cols = [*[f"f{i}" for i in range(n)], *[f"s{i}" for i in range(len(spread.structure))]]
    sizes = rows.agg(*[F.exp(F.avg(F.when((F.col(c) != 0) & (F.abs(c) <= MOST), F.ln(F.abs(c))))) for c in cols]).first()
    size = [math.inf if x is None else x for x in sizes]
    odd = [F.when((F.abs(c) <= MOST) & ((F.col(c) < 0) | (F.abs(c) > spread.far * size[i])), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"), (F.abs(c) > spread.far * size[i]).alias("out"), (F.abs(c) <= spread.beyond * size[i]).alias("near"))) for i, c in enumerate(cols)]
    odd = durable(rows.select(F.explode(F.array_compact(F.array(*odd))).alias("o")).select("o.*").groupBy("i", "v", "out", "near").agg(F.count(F.lit(1)).alias("n")))
    codes = sorted(r[0] for r in odd.where(F.col("out") & (F.col("i") < n)).groupBy("v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("v").collect())
    below = odd.where((F.col("v") < 0) & F.col("near") & ~F.col("v").isin(*codes)) if codes else odd.where((F.col("v") < 0) & F.col("near"))
    top = below.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))).where(F.col("r") <= 5).groupBy("i").agg(F.sum("n").alias("top"))
    signed = below.groupBy("i").agg(F.sum("n").alias("n")).join(top, "i").where(2 * F.col("top") < F.col("n"))
    return Possible(size, codes, {r[0] for r in signed.select("i").collect()}, spread.beyond)


def tidy_states(rows: DataFrame, can: Possible, n: int, spread: Spread = Spread()) -> DataFrame:
    """One row per ``state_id`` of delivered rows, with what can be measurements. A value counts as held
    if any delivery of the state has it. ``like`` is a number for the state's structure, if known. All
    that is aggregated is a number, so it is hashed and not sorted."""
    k = len(spread.structure)
    values = [can.of(F.col(f"f{i}"), i).alias(f"f{i}") for i in range(n)] + [can.of(F.col(f"s{i}"), n + i).alias(f"s{i}") for i in range(k)]
    s = rows.select("state_id", "domain", "network", "time", *values)
    s = s.groupBy("state_id").agg(*[F.max(c).alias(c) for c in s.columns if c != "state_id"])
    known = [F.col(f"s{i}").isNotNull() for i in range(k)]
    whole = F.lit(bool(k)) if not k else known[0]
    for c in known[1:]:
        whole = whole & c
    return s.withColumn("like", F.when(whole, F.xxhash64(*[f"s{i}" for i in range(k)])) if k else F.lit(None).cast("bigint"))


def listed_features(catalog: DataFrame, domains: DataFrame, features: Sequence[tuple[str, str]]) -> DataFrame:
    """``domain, l0..``: which features the catalog lists for a domain; a row per domain."""
    c = with_domain(catalog.select("domain_id", "feature_group", "feature_name"), domains).where(F.col("domain").isNotNull())
    return c.groupBy(F.xxhash64("domain").alias("domain")).agg(*[F.max((F.col("feature_group") == g) & (F.col("feature_name") == m)).alias(f"l{i}") for i, (g, m) in enumerate(features)])


def _salted(left: DataFrame, small: DataFrame, keys: list[str], salts: int, how: str = "left") -> DataFrame:
    """Join to a small table; the rows of a hot key go to ``salts`` tasks."""
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64("state_id"), F.lit(salts)).cast("int")).join(right, [*keys, "_salt"], how).drop("_salt")


def _best() -> Column:
    """Aggregate: network and weight of the likeliest; ties go to the smaller code."""
    return F.min_by(F.struct("network", "p"), F.struct((-F.round("p", 9)).alias("o"), "network"))


def _moved(old: Column, new: Column) -> Column:
    """Change as a part of the larger value; 1 for a value that is new, null where there is none."""
    gap = F.abs(new - old)
    return F.when(new.isNotNull() & old.isNull(), 1.0).when(gap == 0, 0.0).otherwise(gap / F.greatest(F.abs(old), F.abs(new)))


def fill_networks(tidied: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """``state_id, network, score`` for every state without a network whose domain has known ones: by
    likeness to others, else by its domain and time; ties go to the smaller code. Score is the label's
    weight in the state's final distribution. Votes are worked out once for each likeness."""
    k = len(spread.structure)
    shape = [f"s{i}" for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i)]
    keys = F.array_compact(F.array(*[F.when(F.col(f"s{i}").isNotNull() & F.col(f"s{j}").isNotNull(), F.xxhash64(F.lit(i), F.lit(j), f"s{i}", f"s{j}")) for i, j in pairs]))
    shapes = tidied.where((F.col("network") >= 0) | F.col("network").isNull()).groupBy("domain", *shape, "network").agg(F.count(F.lit(1)).cast("double").alias("c"))
    edges = shapes.select("domain", F.xxhash64("domain", *shape).alias("shape"), "network", "c", F.explode(keys).alias("node"))
    edges = durable(edges)
    open_ = edges.where(F.col("network").isNull()).select("domain", "node", "shape", "c")
    wanted = open_.select("domain", "node").distinct()
    clamped = durable(edges.where(F.col("network").isNotNull()).join(wanted, ["domain", "node"], "left_semi").groupBy("domain", "node", "network").agg(F.sum("c").alias("w")))
    now = clamped
    found = None
    for _ in range(spread.network_rounds):
        total = now.groupBy("domain", "node").agg(F.sum("w").alias("t"))
        dist = now.join(total, ["domain", "node"]).select("domain", "node", "network", (F.col("w") / F.col("t")).alias("p"))
        votes = open_.join(dist, ["domain", "node"]).groupBy("shape", "network").agg(F.sum("p").alias("p"))
        mass = votes.groupBy("shape").agg(F.sum("p").alias("m"))
        found = votes.join(mass, "shape").select("shape", "network", (F.col("p") / F.col("m")).alias("p"))
        back = open_.join(found, "shape").groupBy("domain", "node", "network").agg(F.sum(F.col("p") * F.col("c")).alias("w"))
        now = clamped.unionByName(back).groupBy("domain", "node", "network").agg(F.sum("w").alias("w"))
    alike = durable(found.groupBy("shape").agg(_best().alias("b")))
    lost = tidied.where(F.col("network").isNull() & F.col("domain").isNotNull()).select("state_id", "domain", "time", F.xxhash64("domain", *shape).alias("shape"))
    times, whole = _group_networks(tidied, spread)
    lost = _salted(lost, alike, ["shape"], spread.salts)
    lost = _salted(lost, times.select("domain", "time", F.struct("network", "p").alias("t")), ["domain", "time"], spread.salts).join(whole.select("domain", F.struct("network", "p").alias("d")), "domain", "left")
    lost = lost.select("state_id", F.coalesce("b", "t", "d").alias("b")).where(F.col("b").isNotNull())
    return lost.select("state_id", F.col("b.network").alias("network"), F.col("b.p").alias("score"))


def _group_networks(tidied: DataFrame, spread: Spread) -> tuple[DataFrame, DataFrame]:
    """``domain, time, network, p`` and ``domain, network, p``: the likeliest network of each domain's week,
    the domain counting too, and of each domain alone, among observed networks. A network that the week
    lacks can be its likeliest only if it is the domain's, so no other is tried."""
    seen = durable(tidied.where((F.col("network") >= 0) & F.col("domain").isNotNull()).groupBy("domain", "time", "network").agg(F.count(F.lit(1)).alias("n")))
    overall = seen.groupBy("domain", "network").agg(F.sum("n").alias("n"))
    overall = durable(overall.join(overall.groupBy("domain").agg(F.sum("n").alias("t")), "domain").select("domain", "network", (F.col("n") / F.col("t")).alias("p")))
    whole = overall.groupBy("domain").agg(_best().alias("b")).select("domain", "b.*")
    weeks = seen.where(F.col("time").isNotNull())
    total = weeks.groupBy("domain", "time").agg(F.sum("n").alias("t"))
    more = total.join(whole, "domain").select("domain", "time", "network", F.lit(0).cast("bigint").alias("n"))
    each = weeks.unionByName(more).groupBy("domain", "time", "network").agg(F.sum("n").alias("n"))
    each = each.join(total, ["domain", "time"]).join(overall.withColumnRenamed("p", "o"), ["domain", "network"])
    p = (F.col("n") / F.col("t") * spread.time_weight + F.col("o") * spread.domain_weight) / (spread.time_weight + spread.domain_weight)
    times = each.select("domain", "time", "network", p.alias("p")).groupBy("domain", "time").agg(_best().alias("b")).select("domain", "time", "b.*")
    return times, whole


def _observed(tidied: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys, field, s, n``: sum and count of each feature's observed values in a group."""
    each = F.array_compact(F.array(*[F.when(F.col(f"f{i}").isNotNull(), F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("v"))) for i in range(n)]))
    long = tidied.where(F.col(keys[-1]).isNotNull()).select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "field").agg(F.sum("v").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))


def fill_numbers(tidied: DataFrame, cases: DataFrame, n: int, spread: Spread = Spread()) -> DataFrame:
    """``domain, net, time, like, field, m, value`` for each case of missing features (``m`` is the number of
    its states). ``tidied`` has ``net``, the known or supplied network.

    Each round a case takes the weighted mean of what its network, week and likeness have on average,
    fills of the round before included; where none has the feature, the mean over the domain's weeks.
    """
    groups = {"net": (["domain", "net", "field"], spread.network_weight), "time": (["domain", "time", "field"], spread.time_weight), "like": (["domain", "like", "field"], spread.like_weight)}
    observed = {k: durable(_observed(tidied, keys[:-1], n)) for k, (keys, _) in groups.items()}
    whole = observed["time"].groupBy("domain", "field").agg(F.avg(F.col("s") / F.col("n")).alias("whole"))

    # the groups are the same in all rounds, so one count shows whether their means may be sent to all tasks
    few = {k: observed[k].count() + cases.select(*keys).distinct().count() <= spread.sent for k, (keys, _) in groups.items()}

    def added(sums: DataFrame, filled: DataFrame, keys: list[str]) -> DataFrame:
        """A group's sums with the fills of its cases."""
        more = filled.where(F.col(keys[1]).isNotNull() & F.col("value").isNotNull()).groupBy(*keys).agg(F.sum(F.col("value") * F.col("m")).alias("s"), F.sum("m").alias("n"))
        return sums.unionByName(more).groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    def averaged(at: DataFrame, sums: dict[str, DataFrame]) -> DataFrame:
        for k, (keys, _) in groups.items():
            means = sums[k].select(*keys, (F.col("s") / F.col("n")).alias(f"mean_{k}"))
            at = at.join(F.broadcast(means) if few[k] else means, keys, "left")
        mass = sum((F.when(F.col(f"mean_{k}").isNotNull(), w).otherwise(0.0) for k, (_, w) in groups.items()), F.lit(0.0))
        total = sum((F.coalesce(F.col(f"mean_{k}"), F.lit(0.0)) * w for k, (_, w) in groups.items()), F.lit(0.0))
        new = F.when(mass > 0, total / mass).otherwise(F.col("whole"))
        return durable(at.select("domain", "net", "time", "like", "field", "m", "whole", new.alias("value"), _moved(F.col("value"), new).alias("change")))

    current = averaged(cases.join(whole, ["domain", "field"], "left").withColumn("value", F.lit(None).cast("double")), observed)
    for _ in range(spread.rounds - 1):
        current = averaged(current, {k: added(observed[k], current, keys) for k, (keys, _) in groups.items()})
        if (current.agg(F.max("change")).first()[0] or 0.0) < spread.tolerance:
            break
    return current


def _with_cases(missing: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """``state_id, field, value``: each missing field with the value of its case. Only a case of more than
    ``hot`` states could be too much for a task; such cases are few and sent to all."""
    cold = missing
    many = known.where(F.col("m") > hot)
    if many.head(1):
        many = bounded(many.select("case", F.col("value").alias("own")))
        cold = missing.join(many, "case", "left_anti")
        return cold.join(known.drop("m"), "case").select("state_id", "field", "value").unionByName(missing.join(many, "case").select("state_id", "field", F.col("own").alias("value")))
    return cold.join(known.drop("m"), "case").select("state_id", "field", "value")


def fill(states: DataFrame, catalog: DataFrame, domains: DataFrame, groups: Sequence[str] = ("demand_features", "inventory_features"), spread: Spread = Spread()) -> DataFrame:
    """``state_id, field, value, label, filled, score``: one row per missing field of a state.

    ``field`` is ``network_id`` (filled by ``label``, the canonical name) or a feature's full name
    (filled by ``value``). ``filled`` is false where no state of the domain has a value; the row still
    marks the field as missing. States of no known domain have no listed features and so only ``network_id``.
    An empty table gives no rows.
    """
    features = catalog_features(catalog, groups)
    n = len(features)
    rows = durable(delivered(states, domains, features, spread))
    t = durable(tidy_states(rows, possible(rows, n, spread), n, spread))
    nets = durable(fill_networks(t, spread))
    lost = t.where(F.col("network").isNull()).select("state_id").join(nets, "state_id", "left")
    lost = lost.select("state_id", F.lit("network_id").alias("field"), F.lit(None).cast("double").alias("value"), network_name(F.col("network")).alias("label"), "score")
    if not n:
        return lost.withColumn("filled", F.col("label").isNotNull())
    t = t.withColumnRenamed("network", "net")
    guessed = t.where(F.col("net").isNull()).drop("net").join(nets.select("state_id", F.col("network").alias("net")), "state_id", "left")
    t = t.where(F.col("net").isNotNull()).unionByName(guessed)
    lacking = F.array_compact(F.array(*[F.when(F.col(f"l{i}") & F.col(f"f{i}").isNull(), F.lit(i)) for i in range(n)]))
    missing = durable(t.join(listed_features(catalog, domains, features), "domain").select("state_id", "domain", "net", "time", "like", F.explode(lacking).alias("field")))
    case = ["domain", "net", "time", "like", "field"]
    cases = durable(missing.groupBy(*case).agg(F.count(F.lit(1)).cast("double").alias("m")))
    known = fill_numbers(t, cases, n, spread)
    # a case is named by one number, as its parts may be null
    name = F.xxhash64(*[x for c in case for x in (F.coalesce(c, F.lit(0)), F.col(c).isNull())]).alias("case")
    found = _with_cases(missing.select("state_id", "field", name), known.select(name, "m", "value"))
    names = F.array(*[F.lit(f"{g}.{m}") for g, m in features])
    numbers = found.select("state_id", names[F.col("field")].alias("field"), "value", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"))
    return numbers.unionByName(lost).withColumn("filled", F.col("value").isNotNull() | F.col("label").isNotNull())
