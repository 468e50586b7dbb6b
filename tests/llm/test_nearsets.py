"""Near-duplicate texts against all pairs, on made-up articles with edits."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from rinkline.llm.nearsets import near_classes, near_pairs

WORD = re.compile(r"[^\W_]+")


def brute(items, t=0.6):
    sets = [(i, set(WORD.findall(x.lower()))) for i, x in items if x is not None]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and x and y and len(x & y) >= t * len(x | y) - 1e-9}


def articles(seed, n, versions, words=70):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for v in range(versions):
            t = list(base)
            for _ in range(v * 3):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if v % 2:
                t = t[20:] + t[:20]
            out.append((len(out), " ".join(t)))
    return out


def check(spark, items, **limits):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item long, body string, node string, n long")
    got = [(r.item_a, r.item_b) for r in near_pairs(df, "item", F.col("body"), **limits).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_long_texts(spark):
    items = articles(1, 40, 4)
    assert check(spark, items) == brute(items)


def test_more_versions_than_a_branch_is_wide(spark):
    items = articles(2, 1, 1)
    rng = random.Random(3)
    base = items[0][1].split()
    for k in range(1, 200):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = f"v{rng.randrange(5000)}"
        items.append((k, " ".join(t)))
    assert check(spark, items) == brute(items)


def edited(seed, n=30, words=60, vocabulary=300):
    """Texts of few words, each with every fifth word changed, shuffled with one edit, in moved blocks, and cut."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(words)]
        fifth = [f"x{k}y{i}" if i % 5 == 0 else w for i, w in enumerate(base)]
        mixed = rng.sample(base, len(base))
        mixed[0] = f"z{k}"
        moved = base[40:] + base[20:40] + base[:20]
        out += [base, fifth, mixed, moved, base[: int(words * 0.65)]]
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_edits_of_every_kind(spark):
    items = edited(11)
    assert len(brute(items)) > 200
    assert check(spark, items) == brute(items)


def test_hot_first_words_are_shared_out(spark):
    items = edited(12, n=20, vocabulary=60)
    assert check(spark, items, hot_texts=3, part_entries=500) == brute(items)


def test_wide_nodes_are_parted(spark, monkeypatch):
    from rinkline.llm import prefixtree
    from rinkline.llm.nearsets import probe_length

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(3, 30))) for _ in range(300)]
    n = np.array([len(s) for s in sets])
    bits = np.zeros((300, 256), dtype=bool)
    for i, s in enumerate(sets):
        bits[i, s % 32] = True
    kept = np.minimum(n, probe_length(n, 0.6) + prefixtree.DEPTH - 1)
    labels = np.concatenate([s[:k] for s, k in zip(sets, kept, strict=True)]).astype(np.int32)
    want = {(i, j) for i in range(300) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}
    for wide, small in ((400, 2000), (3, 4), (1, 0)):
        monkeypatch.setattr(prefixtree, "WIDE", wide)
        monkeypatch.setattr(prefixtree, "_SMALL", small)
        part = prefixtree.Part(np.arange(300), n, np.packbits(bits, axis=1).view(np.int64), labels, kept, 0.6)
        a, b = part.pairs(0, 1, 1 << 30)
        assert want <= {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}


def test_short_texts_copies_nulls(spark):
    items = [(1, "a b c"), (2, "a b c d"), (3, "c b a"), (4, None), (5, ""), (6, "!!"), (7, "x"), (8, "X."), (9, "a b c d e f g h"), (10, "word " * 50_000), (11, "Word")]
    assert check(spark, items) == brute(items)
    assert check(spark, []) == set()


def test_short_against_longer(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.sample([f"w{j}" for j in range(60)], rng.randrange(20, 50)))) for k in range(80)]
    items = [x for x in items if len(set(x[1].split())) < 32]
    assert check(spark, items) == brute(items)


def test_classes(spark):
    items = articles(7, 10, 3)
    df = spark.createDataFrame(items, "item long, body string")
    got = {r.item_id: (r.class_id, r.n_links) for r in near_classes(df, "item", F.col("body")).collect()}
    assert len(got) == len(items)
    for a, b in brute(items):
        assert got[a][0] == got[b][0]


def test_a_long_chain_is_one_group(spark):
    from rinkline.llm.components import closed_groups

    rng = random.Random(9)
    names = rng.sample(range(1000), 200)
    nodes = spark.createDataFrame([(k,) for k in range(1000)], "node long")
    edges = spark.createDataFrame([*zip(names, names[1:]), (5000, 5000)], "a long, b long")
    got = {r.node: r.label for r in closed_groups(nodes, edges).collect()}
    assert all(got[k] == (min(names) if k in names else k) for k in range(1000))


def test_groups_of_sets_meet_in_pairs(spark):
    items = edited(13)
    want = brute(items)
    for limits in ({"parts": 1, "groups": 4}, {"parts": 3, "groups": 3}, {"parts": 5, "groups": 2, "hot_texts": 3}):
        assert check(spark, items, **limits) == want


def test_a_task_holds_a_bounded_number_of_sets():
    from rinkline.llm.nearsets import _groups_of, _pair_number, shape

    counts = np.full(20_000, 4_000)  # of 1,000,000 sets of 80 words
    parts, groups = shape(1_000_000, counts, 0.6, 6, 3_700_000, 500_000)
    entries = 0.4 * 80 + 1
    assert 1_000_000 * min(1, 2 / groups) * min(1, entries / parts) <= 100_001
    assert shape(90_000, counts * 0.09, 0.6, 6, 3_700_000, 500_000) == (6, 1)
    assert [_pair_number(*_groups_of(k)) for k in range(50)] == list(range(50))


def test_memory_of_a_part_for_each_set():
    import tracemalloc

    from rinkline.llm import prefixtree

    rng = np.random.default_rng(6)
    sets, kept = 100_000, 40
    labels = np.sort(rng.integers(0, 200_000, (sets, kept)), axis=1).astype(np.int32).ravel()
    n = np.full(sets, 90)
    bits = rng.integers(-(2**62), 2**62, (sets, 4))
    tracemalloc.start()
    prefixtree.Part(np.arange(sets), n, bits, labels, np.full(sets, kept), 0.6).pairs(3, 50, 1 << 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800 * sets  # 1,440 bytes a set when the labels of all parts were laid out at once
