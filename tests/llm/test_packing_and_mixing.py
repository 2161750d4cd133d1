import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from textquarry.llm import mixing, packing
from textquarry.llm.tokens import encoding, token_counts


def loads(plan, hist):
    used = Counter()
    for length, slots in plan.slots.items():
        slots = sorted(slots)
        for i, (start, first, per) in enumerate(slots):
            end = slots[i + 1][0] if i + 1 < len(slots) else hist[length]
            for r in range(start, end):
                used[first + (r - start) // per] += length
    return used


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_every_piece_fits(hist):
    plan = packing.Plan(hist, 64)
    used = loads(plan, hist)
    assert sum(used.values()) == sum(k * v for k, v in hist.items())
    assert max(used.values(), default=0) <= 64 and len(used) == plan.containers


@pytest.mark.parametrize("capacity", [64, 1024, 4096])
def test_near_the_bound(capacity):
    rng = np.random.default_rng(2)
    hist = Counter(int(x) for x in np.clip(rng.gamma(2, capacity / 9, 20_000), 1, capacity))
    plan = packing.Plan(dict(hist), capacity)
    assert plan.bound <= plan.containers <= plan.bound + 1 and plan.bound <= packing.Plan.tightest_fit(hist, capacity)
    assert plan.rest <= 0.05 * sum(k * v for k, v in hist.items())


def test_bound_is_below_the_optimum():
    assert packing.Plan({6: 10}, 10).bound == packing.Plan({6: 10}, 10).containers == 10  # no two of them fit together
    assert packing.Plan({5: 4, 10: 2}, 10).bound == 4
    with pytest.raises(ValueError):
        packing.Plan({}, 0)


def test_knapsack_is_optimal():
    sizes, values = np.array([3, 5, 7, 20]), np.array([3.0, 5.5, 7.1, 21.0])
    for room in range(40):
        best = max(
            a * 3.0 + b * 5.5 + c * 7.1 + d * 21.0
            for a in range(14) for b in range(9) for c in range(6) for d in range(3) if 3 * a + 5 * b + 7 * c + 20 * d <= room
        )
        assert packing.knapsack(values, sizes, room)[-1] == pytest.approx(best)


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([10, 10, 10, 7, 3, 0, 25, 100, 10, 10])]
    sizes = spark.createDataFrame([*rows, (3, 7)], "key bigint, tokens bigint")
    out, plan = packing.pack(sizes, [("small", 10), ("large", 40)])
    got = out.collect()
    by = Counter()
    for r in got:
        by[r.container_kind, r.container_id] += r.len
    assert all(v <= {"small": 10, "large": 40}[k] for (k, _), v in by.items())
    assert sum(r.len for r in got if r.container_kind == "small") == 192
    assert {(r.piece_no, r.start, r.len) for r in got if r.key == 6 and r.container_kind == "small"} == {(0, 0, 10), (1, 10, 10), (2, 20, 5)}
    assert not [r for r in got if r.key == 5]
    report = {r.container_kind: r for r in packing.report(out, plan, [("small", 10), ("large", 40)]).collect()}
    assert report["small"].containers == 20 == report["small"].bound and report["small"].over == 0
    assert packing.pack(sizes.limit(0), [("small", 10)])[0].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("a", "two words", 1), ("b", None, 2), ("c", "", 3), ("d", "<|endoftext|>", 4)], "id string, text string, key int")
    got = {r.key: r.tokens for r in token_counts(df, "id", "text").collect()}
    assert got["b"] == got["c"] == 0 and got["a"] == len(encoding().encode_ordinary("two words")) and got["d"] > 1


TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id bigint, text string, source string, key string, p string"


def test_mix(spark):
    word = {"a": "alpha beta ", "b": "gamma delta ", "x": "other thing "}
    rows = [(i, word[s] * 10, s, "k", "p") for i, s in enumerate(["a"] * 300 + ["b"] * 30 + ["x"] * 50)]
    rows += [(1000 + i, word["b"] * 10, None, "k", "p") for i in range(3)] + [(2000, None, "a", "k", "p"), (2001, "", "b", "k", "p")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("gone", 0.1, 2)], TARGETS)
    mixed = mixing.mix(docs, targets).cache()
    got = mixed.collect()
    assert max(r.repeats for r in got if r.source == "b") <= 4 and max(r.repeats for r in got if r.source == "a") <= 1
    assert all(r.repeats == 0 for r in got if r.source == "x") and len(got) == 383
    shares = {r.source: r.actual_share for r in mixing.shares(mixed, targets).collect()}
    assert shares["a"] == pytest.approx(0.65, abs=0.03) and shares["b"] == pytest.approx(0.35, abs=0.03) and shares["gone"] == 0


def test_empty_mix(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed = mixing.mix(docs, targets)
    assert mixed.count() == 0
    assert [r.actual_share for r in mixing.shares(mixed, targets).collect()] == [0.0]


def test_posteriors(spark):
    labelled = spark.createDataFrame([(str(i), "alpha beta" if i % 2 else "gamma delta", "a" if i % 2 else "b") for i in range(80)], "key string, text string, source string")
    given = spark.createDataFrame([("1", "beta alpha alpha"), ("2", "delta"), ("3", None)], "key string, text string")
    model = mixing.Classifier(labelled, ["a", "b", "none"])
    got = {r.key: r.p for r in model.posteriors(given).collect()}
    assert model.accuracy == 1.0 and got["1"][0] > 0.9 and got["2"][1] > 0.9 and got["1"][2] == 0
    assert got["3"] == pytest.approx([0.5, 0.5, 0], abs=0.03)


def test_words_that_tell_nothing_give_the_frequencies(spark):
    rows = [(str(i), f"alpha beta {i * 7919 % 13}", "a" if i % 4 else "b") for i in range(400)]
    model = mixing.Classifier(spark.createDataFrame(rows, "key string, text string, source string"), ["a", "b"])
    p = model.posteriors(spark.createDataFrame([("x", "alpha beta 3")], "key string, text string")).first().p
    assert p == pytest.approx([0.75, 0.25], abs=0.1)


def test_membership(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], 0), ([1.0, 1.0, 0.0], None), ([0.1, 0.2, 1.0], 0)], "e array<double>, own int")
    one, none, far = (r.m for r in df.select(mixing.membership(F.col("e"), F.col("own"), [0.5, 0.5, 0.0], 0.9).alias("m")).collect())
    assert none == [0.5, 0.5, 0.0] and one == pytest.approx([0.9 / 0.95, 0.05 / 0.95, 0]) and far[0] < 0.65 and sum(far) == pytest.approx(1)


def test_larger_total_is_met_as_caps_allow(spark):
    rows = [(i, "alpha beta " * 10, "a", "k", "p") for i in range(200)] + [(500 + i, "gamma delta " * 10, "b", "k", "p") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS)
    got = {r.source: r for r in mixing.shares(mixing.mix(docs, targets, total=6000.0), targets).collect()}
    assert got["b"].selected_tokens == 2 * got["b"].tokens and got["a"].selected_tokens > 2 * got["b"].selected_tokens
    assert got["b"].most_total == pytest.approx(4 * got["b"].tokens)


def test_memberships_look_at_each_domain_once(spark):
    """The source of a record and the sum of its weights don't stand in the expression once for each domain."""
    rng = np.random.default_rng(6)
    m = 40
    prior = [float(x) for x in rng.dirichlet(np.ones(m))]
    rows = [([float(x) for x in rng.random(m)], None if k % 5 == 0 else int(rng.integers(m + 1))) for k in range(200)] + [([0.0] * m, 3)]
    df = spark.createDataFrame(rows, "e array<double>, own int")
    out = df.select("e", "own", mixing.membership(F.col("e"), F.col("own"), prior, 0.9).alias("p"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"own#\d+", plan.split("AS p#")[0])) <= 2
    for r in out.collect():
        before = prior if r.own is None else [0.9 if i == r.own else (1 - 0.9) / (m - 1) for i in range(m)]
        weights = [e * x for e, x in zip(r.e, before, strict=True)]
        total = 0.0
        for x in weights:
            total += x
        assert r.p == ([x / total for x in weights] if total > 0 else weights)


def test_a_value_is_computed_once(spark):
    values = spark.range(3).select(mixing._once(F.rand(), lambda x: F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: x))).alias("v")).collect()
    assert [len(r.v) for r in values] == [1, 1, 1]
