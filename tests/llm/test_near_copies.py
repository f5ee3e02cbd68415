"""Near copies against brute-force Jaccard."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quiver.llm import components, near_copies, simhash

WORDS = [f"w{i}" for i in range(300)]


def brute(rows):
    """(id, least id of the component of similarity 0.8 and more) of rows (id, text)."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) > 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return Counter((doc, min(least[find(i)], default=None)) for i, (doc, _) in enumerate(rows))


def texts():
    rng = random.Random(5)
    line = lambda k: [rng.choice(WORDS) for _ in range(k)]
    common = line(40)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One "), (5, "one two three"), (None, "one two three"), (None, " ".join(line(30))), (6, "a b c d e"), (6, "a b c d e f")]
    for base in [line(rng.choice([12, 30, 60, 200])) + common * rng.randint(0, 1) for _ in range(12)]:
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows) + 100, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("sample", "rounds"), [(16_000, 2), (20, 1), (16_000, 0)])
def test_near_copies(spark, monkeypatch, sample, rounds):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rows = texts()
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_nothing(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_stage_drops_copies_of_similarity_0_8(spark):
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 8):
        w = list(base)
        for k in range(3):
            w[10 + 60 * k + i] = f"new{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [0]


def test_fine_parities_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    for n, m, both in ((513, 513, 513), (2000, 1800, 1500), (1030, 1020, 0), (5000, 600, 300)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        true = n + m - 2 * both
        found = near_copies.least_difference(near_copies.fine_parities(a), near_copies.fine_parities(b))
        assert found == near_copies.least_difference(near_copies.fine_parities(b), near_copies.fine_parities(a))
        assert found <= true and (n > 2 * m or 5 * found >= true)
    assert near_copies.fine_parities(np.arange(512, dtype=np.uint64)) is None


def test_long_near_copies_are_found_and_long_texts_with_a_shared_part_are_not(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(3_000)]
    near = base[:1_500] + ["changed"] + base[1_501:]
    longer = base + [f"x{i}" for i in range(600)]
    part = base[:2_000] + [f"y{i}" for i in range(1_000)]
    rows = [(i, " ".join(t)) for i, t in enumerate([base, near, longer, part])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, near_copies.near_copies(docs).collect())) == brute(rows) == Counter([(0, 0), (1, 0), (2, 0), (3, 3)])


def test_simhash_links_first_and_a_large_group_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for k in rng.sample(range(140), rng.choice([1, 2, 2, 3])):
            w[k] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, f"{t} end" if i % 2 else t.upper()) for i, (_, t) in enumerate(rows[:20])]
    steps, links, verified = [], simhash.links, near_copies.verified

    def counted(pairs, *more):
        steps.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "links", lambda *a: steps.append("simhash") or links(*a))
    monkeypatch.setattr(near_copies, "verified", counted)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert Counter(map(tuple, found.collect())) == brute(rows)
    assert steps[0] == "simhash" and steps[1] > 0 and sum(steps[1:]) <= 5 * len(rows)


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_components_are_the_same_in_the_driver_and_in_steps(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST_BYTES", limit)
    rng = random.Random(2)
    edges = [(i + 1, i) for i in range(100, 140)] + [(-(1 << 63), (1 << 63) - 1), (7, 7), (5, -5), (5, -5), (-5, 5)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    reached = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and reached[a] is not reached[b]:
            reached[a] |= reached[b]
            for x in reached[b]:
                reached[x] = reached[a]
    rng.shuffle(edges)
    found = components.components_by_size(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted((x, min(of)) for x, of in reached.items())
    assert components.components_by_size(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_few_links_take_few_tasks(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    context, group = spark.sparkContext, "few-links"
    context.setJobGroup(group, group)
    try:
        assert Counter(map(tuple, near_copies.near_copies(docs).collect())) == brute(rows)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks < 384
