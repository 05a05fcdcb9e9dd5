import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import words

from logmill.llm import near_dup
from logmill.llm.components import components
from logmill.llm.storage import shared_root


def sets(text):
    w = words(text, lower=True)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected(doc_rows, threshold=85):
    s = [sets(t) for _, t in doc_rows]
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= threshold * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(doc_rows):
        names.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return Counter((d, len(s[i]), least[find(i)] if s[i] else d) for i, (d, _) in enumerate(doc_rows))


def many_near_copies():
    """Copies that link through a base only, a chain, and texts that share a passage without linking."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(50, " ".join(base))]
    for i in range(40):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(8):
        rows.append((100 + i, " ".join(chain)))
        k = 10 * i
        chain[k : k + 8] = [f"d{i}{j}" for j in range(8)]
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(200 + i, shared + " " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(30)]
    return rows


@pytest.mark.parametrize(("local", "threshold"), [(near_dup.LOCAL, 85), (near_dup.LOCAL, 80), (100, 85)])
def test_brute_force(spark, docs, doc_rows, local, threshold):
    got = near_dup.near_duplicates(docs, threshold, local).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(doc_rows, threshold)


def test_banding():
    assert near_dup.banding(85) == (20, 5) and near_dup.banding(80) == (25, 4)


@pytest.mark.parametrize("local", [near_dup.LOCAL, 1000])
def test_links_through_others(spark, local):
    rows = many_near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(docs, local=local).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)


def test_large_groups(spark):
    """Groups grown by joins: copies that all link, texts that share half of their words and do not, and a hub."""
    rng = random.Random(3)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    for i in range(120):
        rows.append((1000 + i, " ".join(base[:60] + [f"own{i}x{j}" for j in range(45)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(docs, local=500).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)


def test_large_groups_move_few_bytes(spark, tmp_path):
    """A group of texts that are alike but not linked: what is shuffled stays in proportion to its sets, and what is written goes."""
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(400)]
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(400), 14):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = shuffled(spark)
    got = near_dup.near_duplicates(docs, local=80_000).collect()
    moved = shuffled(spark) - before
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)
    assert moved < 12 * 8 * sum(r.n_shingles for r in got)


def shuffled(spark):
    """Bytes that all stages of the session so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_keep_one_leaves_little(spark, docs):
    """Scratch tables go before the result is read, and no text is shuffled for rows that stay."""
    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.glob("*"))
    kept = near_dup.keep_one(docs)
    assert {p.name.rpartition("-")[0] for p in set(root.glob("*")) - before} == {"near-copies"}
    assert kept.count()


def test_keep_one(docs, doc_rows):
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("_KEY <> 'z'").count() == 0
    names = Counter()
    for (d, _, c), n in expected(doc_rows).items():
        if c is None or d == c:
            names[d] += n
    assert Counter(r.doc_id for r in kept.collect()) == names


def test_empty(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_components_with_hubs(spark):
    """Stars, of which one has most edges, a long chain, and a bridge between them."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(5001, 5400)] + [(7000 + i, 7001 + i) for i in range(60)] + [(7060, 5399), (9000, 9001)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in [*range(5000, 5400), *range(7000, 7061)]} | {9000: 9000, 9001: 9000}


def test_components(spark):
    edges = [(9, 3), (3, 7), (7, 20), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (35, 29)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.v: r.root for r in got} == {9: 3, 3: 3, 7: 3, 20: 3, 5: 5} | {i: 29 for i in range(29, 36)}


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (850, 75, 75))
    value = np.concatenate((np.sort(np.concatenate((shared, a))), np.sort(np.concatenate((shared, b)))))
    bands = near_dup.signatures(value, np.array([0, 925, 1850]), bands=400, rows=1)
    assert abs((bands[0] == bands[1]).mean() - 0.85) < 0.06
