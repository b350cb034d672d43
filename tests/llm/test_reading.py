import random

import numpy as np
import pytest
from decistrata.llm import reading

LEVEL = {
    1: ["The cat is big.", "We see a red bag.", "It is hot now.", "Look, the dog runs!", "You and I open the box."],
    2: ["People in town often ask for garden tools, so the shop keeps some more of them.", "The road was closed, which meant that coats came three days late.", "Last year the market sold about two hundred pieces before the weekend."],
    3: ["A review of locations indicates that the holding cost understates the capacity plan.", "Responsibility for the service level rests with planners, who evaluate alternatives under the approval procedure.", "Analysts compare the transfer budget with the inventory position as volumes become less predictable."],
    4: ["The ergodic perturbation analysis parametrises the conditional expectation modulo degenerate extreme points.", "Under the heteroscedastic multiplier, the lexicographic recourse function remains unidentified.", "Insofar as identifiability is preserved, the polyhedral certificate attenuates the asymptotic estimator."],
}
LOG = "2025-06-05 INFO job=5559 rc=4\n"


def text(rng, level, stray=0.2, n=14):
    return " ".join(rng.choice(LEVEL[level if rng.random() > stray else rng.randint(1, 4)]) for _ in range(n if level > 1 else 3 * n))


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random(200)
    y = x + rng.normal(0, 0.3, 200)
    starts, values = reading.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(starts) > 0).all()
    fit = values[np.searchsorted(starts, x, side="right") - 1]
    assert abs(fit.mean() - y.mean()) < 1e-9
    for k in range(len(values)):
        own = np.isclose(fit, values[k])
        assert abs(y[own].mean() - values[k]) < 1e-9


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    graded = [(text(rng, k), float(k)) for k in (1, 2, 3, 4) for _ in range(40)]
    model = reading.fit(graded)
    test = [(k, text(rng, k)) for k in (1, 2, 3, 4) for _ in range(25)]
    assert sum(model.level(t) == k for k, t in test) >= 97
    # a loud minority doesn't shift the level
    mixed = " ".join([LEVEL[2][i % 3] for i in range(16)] + LEVEL[4][:2] * 3)
    assert model.level(mixed) == 2 and model.level(mixed.upper()) == 2
    assert model.level("") is None and model.level(LOG * 50) is None and model.level("The cat is big.") is None
    assert model.level(text(rng, 4, n=3000)) == 4
    rows = [(1, mixed), (2, None), (3, LOG * 9), (4, ""), (None, mixed), (1, mixed)]
    got = reading.rate(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "9 as reading_level"), model).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2), (2, None), (3, None), (4, None), (None, 2), (1, 2)], key=str)


def test_nothing_graded(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(1, text(rng, 2)), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, "a", None), (None, "b", 2), (9, "c", 3), (1, "d", 7)], "doc_id bigint, rater string, reading_level int")
    assert [tuple(r) for r in reading.reading_levels(docs, none).collect()] == [(1, 2)]
    assert reading.reading_levels(docs.limit(0), none).count() == 0


def test_grades_are_bounded_and_averaged(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)], "doc_id bigint, text string")
    rows = [(k, r, 1 + (k + j) % 2) for k in range(30) for j, r in enumerate(["a", "b", "b"])]
    levels = spark.createDataFrame(rows, "doc_id bigint, rater string, reading_level int")
    got = reading.grades(docs, levels, reading.Setup(documents=10))
    assert len(got) == 10 and {y for _, y in got} <= {1.25, 1.5, 1.75}


def test_chinese():
    p = reading.parse("在可比站点范围内，调拨预算直接影响季度持有成本。今天很冷！", reading.Setup())
    assert p.han == 26 and p.latin == 0 and p.words[0] == "在" and p.words[1] == "在可"


def test_rated_together_as_alone(passages_of_all_kinds):
    """Texts rated in one go get the levels that each gets alone, whatever stands beside them."""
    texts, model = passages_of_all_kinds
    want = [model.level(t) for t in texts]
    assert len(set(want)) > 2
    lexicon = reading.Lexicon(model.weights)
    for size in (1, 3, len(texts)):
        got = [x for k in range(0, len(texts), size) for x in reading.rated(model, lexicon, [reading.tokens_of(t) for t in texts[k : k + size]])]
        assert got == want
    lexicon.limit = 5
    assert reading.rated(model, lexicon, [reading.tokens_of(t) for t in texts]) == want


@pytest.fixture(scope="module")
def passages_of_all_kinds():
    rng = random.Random(2)
    easy, hard = ["the", "cat", "sat", "on", "a", "mat", "we", "go", "home", "now"], ["stochastic", "optimization", "notwithstanding", "heterogeneous", "replenishment", "asymptotically", "of", "under"]
    prose = lambda words, n, step: ". ".join(" ".join(rng.choice(words) for _ in range(step)) for _ in range(n)) + "."
    graded = [(prose(easy, 12, 5), 1.0) for _ in range(30)] + [(prose(hard, 6, 14), 4.0) for _ in range(30)] + [(prose(easy, 6, 5) + " " + prose(hard, 6, 10), 2.5) for _ in range(30)]
    han = "仓库里有很多货物，司机每天早上把箱子送到商店。" * 4
    odd = ["", " ", "\n", ", , ,", "1 2 3\n4 5 6\n" * 20, "- one\n- two, three\n" * 15, han, han + prose(easy, 12, 5), prose(hard, 1, 300), "id=7;x=3\n" + prose(easy, 12, 5), "word", ":", prose(easy, 12, 5) + "\n\n,"]
    texts = [t for t, _ in graded[::7]] + odd
    rng.shuffle(texts)
    return texts, reading.fit(graded)
