import random

import pytest

from logstrata.llm import mixing

DOCS, TARGETS = "doc_id bigint, source string, text string, tokens int, rate double, n int", "source string, target_share double, max_repeats int"


def documents(spark, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["big"] * 12 + ["mid"] * 5 + ["small", "other", "big "]), " ".join("w" for _ in range(r.randint(1, 60)))) for i in range(800)]
    rows += [(900, None, "x y"), (901, "big", None), (902, "big", "")]
    return rows, spark.createDataFrame([(*x, 1, 1.0, 1) for x in rows], DOCS)


def tokens(text):
    return len(text.split())  # "w w w" has one token for each word


def test_shares_are_met_or_capped(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 3), ("small", 0.2, 2), ("empty", 0.05, 4)], TARGETS)
    sizes = {s: sum(tokens(t) for _, x, t in rows if x == s and t) for s in ("big", "mid", "small")}
    total = sum(sizes.values())
    got = {r.source: r for r in mixing.mix_shares(df, targets).collect()}
    assert set(got) == {"big", "mid", "small", "empty"} and got["empty"].mixed_tokens == 0 and got["empty"].documents == 0
    for s, share, cap in (("big", 0.4, 1), ("mid", 0.35, 3), ("small", 0.2, 2)):
        goal = min(share * total, cap * sizes[s])
        assert got[s].tokens == sizes[s] and abs(got[s].mixed_tokens - goal) <= 60 and got[s].most_copies <= cap
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    assert got["small"].filled < 1 and got["small"].mixed_tokens == 2 * sizes["small"]


def test_rates_are_the_tilt_that_balances(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], TARGETS)
    copies, plan = mixing.plan_mix(df, targets, total_tokens=9000.0)
    by = {p.source: p for p in plan}
    got = copies.collect()
    for s, cap in (("big", 1), ("mid", 2)):
        mine = [r for r in got if r.source == s]
        assert sum(r.rate * r.tokens for r in mine) == pytest.approx(4500, rel=1e-6)
        mean = by[s].tokens / by[s].docs
        import math

        for r in mine:
            assert r.rate == pytest.approx(min(cap, math.exp(by[s].lam * r.tokens / mean)), rel=1e-9)
            assert math.floor(r.rate) <= r.copies <= min(cap, math.floor(r.rate) + 1)
    assert {r.source for r in got} == {"big", "mid"} and len(got) == sum(1 for _, s, t in rows if s in ("big", "mid") and t)


def test_odd_tables(spark):
    _, df = documents(spark)
    none = spark.createDataFrame([], TARGETS)
    assert mixing.mix_copies(df, none).count() == 0 and mixing.mix_shares(df, none).count() == 0
    odd = spark.createDataFrame([("big", None, 1), ("mid", 0.5, None), ("small", 0.5, 1), ("small", 0.2, 1), (None, 0.3, 1), ("nan", float("nan"), 2)], TARGETS)
    got = {r.source: r.mixed_tokens for r in mixing.mix_shares(df, odd).collect()}
    assert set(got) == {"big", "mid", "small", "nan"} and got["big"] == got["mid"] == 0 and got["small"] > 0
    empty = mixing.mix_shares(df.limit(0), spark.createDataFrame([("big", 1.0, 1)], TARGETS)).collect()
    assert [tuple(r)[:2] for r in empty] == [("big", 1.0)] and empty[0].actual_share == 0


def test_steps_that_run_out_are_an_error(spark, monkeypatch):
    _, df = documents(spark)
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(mixing.NotConverged):
        mixing.mix_copies(df, spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], TARGETS), total_tokens=9000.0)
