"""Ordered folds against step-by-step models, on literal tapes and random ones."""

import random

import pytest

from loomery.errors import BadRequest
from loomery.operators import machines as m

SCHEMA = "k long, seq long, t long, v long, kind string, ok boolean"
KINDS = ["click", "view", "purchase", "signup", "error"]


def tape(seed, n=120, users=4):
    rng, t, rows = random.Random(seed), 0, []
    for s in range(n):
        t += rng.randrange(0, 6)
        kind = rng.choice(KINDS)
        rows.append((s % users, s, t, rng.randrange(0, 100), kind, kind != "error"))
    return rows


def folded(spark, fold, rows):
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    return {r["k"]: r for r in fold.apply(df, ["k"], ["seq"], ["t", "v", "kind", "ok"]).collect()}


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_token_bucket(spark):
    fixed = [(0, i, t, 0, "view", True) for i, t in enumerate([0, 0, 0, 1, 5])]
    assert folded(spark, m.token_bucket(2, 1), fixed)[0]["admitted"] == 4
    rows = tape(1)
    for k, r in folded(spark, m.token_bucket(3, 1), rows).items():
        tokens, last, yes = 3, None, 0
        for _, _, t, *_ in by_user(rows)[k]:
            tokens = min(3, tokens + (t - (t if last is None else last)))
            last = t
            if tokens >= 1:
                tokens, yes = tokens - 1, yes + 1
        assert (r["admitted"], r["tokens_left"]) == (yes, tokens)


def test_circuit_breaker(spark):
    rows = tape(2)
    for k, r in folded(spark, m.circuit_breaker(1, 20), rows).items():
        opened, trips, cut = None, 0, 0
        for _, _, t, _, _, ok in by_user(rows)[k]:
            if opened is not None and t - opened < 20:
                cut += 1
            elif ok:
                opened = None
            else:
                opened, trips = t, trips + 1
        assert (r["is_open"], r["trips"], r["short_circuited"]) == (opened is not None, trips, cut)


def test_lru_and_sliding_log(spark):
    rows = tape(3)
    for k, r in folded(spark, m.lru(3, 7), rows).items():
        cache, hits = [], 0
        for _, _, _, v, *_ in by_user(rows)[k]:
            if v % 7 in cache:
                hits += 1
                cache.remove(v % 7)
            elif len(cache) == 3:
                cache.pop(0)
            cache.append(v % 7)
        assert r["hits"] == hits
    for k, r in folded(spark, m.sliding_log(2, 30), rows).items():
        log = []
        for _, _, t, *_ in by_user(rows)[k]:
            if sum(x > t - 30 for x in log) < 2:
                log.append(t)
        assert r["admitted"] == len(log)


def test_pattern_needs_order_and_window(spark):
    fixed = [(0, 0, 0, 0, "view", True), (0, 1, 10, 0, "click", True), (0, 2, 20, 0, "purchase", True), (0, 3, 30, 0, "view", True), (0, 4, 200, 0, "click", True)]
    r = folded(spark, m.sequence_pattern(window=60), fixed)[0]
    assert (r["matches"], r["abandoned"]) == (1, 1)


def test_dedupe_forgets_from_the_last_admission(spark):
    rows = tape(4)
    for k, r in folded(spark, m.dedupe(15, 10), rows).items():
        seen, yes = {}, 0
        for _, _, t, v, *_ in by_user(rows)[k]:
            if v % 10 not in seen or t - seen[v % 10] > 15:
                seen[v % 10], yes = t, yes + 1
        assert r["admitted"] == yes


def test_bins_and_machines(spark):
    rows = tape(5)
    packed, spread = folded(spark, m.first_fit(150), rows), folded(spark, m.longest_processing(3), rows)
    for k, own in by_user(rows).items():
        bins, loads = [], [0, 0, 0]
        for _, _, _, v, *_ in own:
            place = next((i for i, b in enumerate(bins) if b + v <= 150), None)
            if place is None:
                bins.append(v)
            else:
                bins[place] += v
            loads[loads.index(min(loads))] += v
        assert packed[k]["bins"] == len(bins) and spread[k]["makespan"] == max(loads)


@pytest.mark.parametrize("make", [lambda: m.token_bucket(1, 2), lambda: m.gcra(0), lambda: m.aimd(5, 6), lambda: m.hysteresis(5, 5), lambda: m.sequence_pattern(("a",))])
def test_bad_parameters_are_refused(make):
    with pytest.raises(BadRequest):
        make()
