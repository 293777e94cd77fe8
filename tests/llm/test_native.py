"""Exact deduplication, mixing and sharding against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowguard.llm.exact_dedup import exact_dedup
from flowguard.llm.mixing import mix, mixed_documents
from flowguard.llm.sharding import minimax_cuts, shard, whole_cuts
from tests.llm.helpers import SENTENCE, awkward, awkward_rows, empty


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_on_awkward_rows(spark):
    groups = defaultdict(list)
    for r in awkward_rows():
        groups[hashlib.sha256(lowered(r[1]).encode()).hexdigest()].append(r[0])
    got = exact_dedup(awkward(spark)).collect()
    expected = [(d, max((x for x in ids if x is not None), default=None), len(ids), sha) for sha, ids in groups.items() for d in ids]
    order = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=order) == sorted(expected, key=order)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))


def test_exact_dedup_with_a_crowded_filter(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bits_per_row=1).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(300, 1000)) and len(got) == 1000


def test_empty_tables(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert mix(empty(spark)).count() == 0
    assert mixed_documents(empty(spark)).count() == 0
    assert shard(empty(spark)).count() == 0


def test_mix_takes_exact_budgets(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "hot" if i % 3 else f"s{i % 10}") for i in range(3000)] + [(9000, "lone word", None), (9001, None, "void")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    taken, sizes, targets = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        targets[source[r.doc_id]] = r.target
    assert len(got) == len(rows)
    assert all(taken[s] == int(targets[s]) for s in targets)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    # water-filling by rounds
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(targets, key=lambda s: (s is None, s)))}
    expected, open_, left = {}, set(targets), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if unit * weights[s] >= 3 * sizes[s]}
        if not over:
            expected |= {s: unit * weights[s] for s in open_}
            break
        for s in over:
            expected[s] = 3.0 * sizes[s]
            left -= expected[s]
        open_ -= over
    assert targets == pytest.approx(expected)


def test_mix_on_awkward_rows_and_its_documents(spark):
    docs = awkward(spark)
    assert mix(docs).count() == len(awkward_rows())
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert max(Counter(r.text for r in out.collect()).values()) <= 6
    again = mixed_documents(docs)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, again.collect()))


def test_documents_without_words_come_once_per_epoch(spark):
    rows = [(i, " ".join(["w"] * 10), "a" if i < 10 else "b") for i in range(50)] + [(100 + k, t, s) for s in "ab" for k, t in enumerate((None, "", " \t"), 3 * (s == "b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    epochs = {r.doc_id: r.epochs for r in mix(docs).collect()}
    copies = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert epochs[100] == epochs[0] > 0
    assert all(copies[i] == epochs[i] for i in range(100, 106))


def greedy_least(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=300), st.integers(1, 16), st.integers(1, 10**15))
def test_capacity_is_minimal(spark, sizes, shards, spread):
    rows = [(k * spread - 10**17, s) for k, s in enumerate(sizes)]
    capacity, cuts = minimax_cuts(spark.createDataFrame(rows, "place long, bytes long"), shards)
    assert capacity == greedy_least(sizes, shards)
    loads = Counter()
    for place, size in rows:
        loads[sum(place > c for c in cuts)] += size
    assert max(loads.values()) <= capacity and len(cuts) == shards - 1


def test_capacity_over_many_groups(spark):
    random = np.random.default_rng(5)
    sizes = random.integers(1, 400, 60_000)
    sizes[random.integers(0, 60_000, 30)] = 200_000
    rows = spark.range(60_000).selectExpr("id AS place").toPandas().assign(bytes=sizes)
    capacity, _ = minimax_cuts(spark.createDataFrame(rows), 16)
    assert capacity == greedy_least(sizes.tolist(), 16)
    assert whole_cuts(np.cumsum(sizes), capacity, 16) and not whole_cuts(np.cumsum(sizes), capacity - 1, 16)


@pytest.mark.parametrize("place", [0, 1500, 2999])
def test_a_large_group_leaves_no_shard_empty(spark, place):
    random = np.random.default_rng(6)
    sizes = random.integers(200, 400, 3000)
    sizes[place] = sizes.sum() // 2
    for spread in (lambda k: k, lambda k: k if k < 2990 else 10**15 + k):
        rows = [(spread(k), int(s)) for k, s in enumerate(sizes)]
        capacity, cuts = minimax_cuts(spark.createDataFrame(rows, "place long, bytes long"), 16)
        assert capacity == sizes[place]
        loads = Counter()
        for k, size in rows:
            loads[sum(k > c for c in cuts)] += size
        hot = sum(spread(place) > c for c in cuts)
        rest = [loads[n] for n in range(16) if n != hot]
        assert loads[hot] == capacity and max(rest) < 1.2 * (sum(sizes) - capacity) / 15 and min(rest) > 0.8 * (sum(sizes) - capacity) / 15


def test_shards(spark):
    rows = [(i, f"{SENTENCE} {i if i % 3 else 0} " * (1 + i % 4)) for i in range(2000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    of_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        of_text[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(lambda: [10**9, 0])
    for i, t in rows:
        groups[t] = [min(groups[t][0], i), groups[t][1] + len(t.encode()) + 1]
    assert max(load.values()) == greedy_least([s for _, s in sorted(groups.values())], 16)
    assert shard(awkward(spark)).count() == len(awkward_rows())
