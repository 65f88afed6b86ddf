import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By hand: whoever is above gives back, and the rest is shared out again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return target
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            full.add(s)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "é", "￿", "\U0001f600", ""])), st.integers(0, 500), min_size=1))
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_copies(spark, docs):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), "en", rng.choice(["big"] * 12 + ["mid"] * 4 + ["tiny"])) for i in range(4000)]
    d = docs(*rows)
    plan = mixing.mixing_plan(d).collect()
    taken, target = Counter(), {}
    for r in plan:
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.1)
    mixed = Counter(r.doc_id for r in mixing.mix_sources(d.repartition(7)).collect())
    assert mixed == {r.doc_id: r.copies for r in plan if r.copies}


def test_clashing_names(spark, docs):
    d = docs((1, "a b", "en", "x"), (2, None, None, None)).withColumn("mix_source", F.lit(1)).withColumn("target", F.lit("t")).withColumn("mix_rate", F.lit(2))
    assert mixing.mix_sources(d).columns == d.columns
    plan = mixing.mixing_plan(d)
    assert {"mix_source", "mix_rate"} <= set(plan.columns) and plan.count() == 2
    assert mixing.mix_sources(d.limit(0)).count() == 0
