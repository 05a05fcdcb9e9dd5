import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest import words  # noqa: F401  (tests/llm)

from logmill.llm import substrings
from logmill.llm.arrays import hash_strings, hash_words


def expected(doc_rows, width):
    places = defaultdict(list)
    split = [words(t) for _, t in doc_rows]
    for d, w in enumerate(split):
        for k in range(len(w) - width + 1):
            places[tuple(w[k : k + width])].append((d, k))
    gone = defaultdict(set)
    for p in places.values():
        if len(p) > 1:
            for d, k in p:
                gone[d].update(range(k, k + width))
    out = []
    for d, w in enumerate(split):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        out.append((doc_rows[d][0], len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def test_brute_force(docs, doc_rows):
    for width, anchor in ((35, 17), (6, 3)):
        got = substrings.remove_repeats(docs, width, anchor, log2_bits=20).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == expected(doc_rows, width)


def test_many_slices_per_task(spark, docs, doc_rows):
    """Batches of two rows: a task meets windows again and again, with room to remember them and without."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for slots in (substrings.SLOTS, 4):
            got = substrings.remove_repeats(docs.coalesce(2), 6, 3, log2_bits=20, slots=slots).collect()
            assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == expected(doc_rows, 6)
        same = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40))) for i in range(300)], "doc_id long, text string").coalesce(3)
        rows = substrings.repeated_windows(same).groupBy("n").count().collect()
        assert sum(r["count"] for r in rows) <= 300 + 2 * 3 * 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_memory_tells_once():
    memory, rng = substrings.Memory(8), np.random.default_rng(1)
    seen, told = Counter(), Counter()
    for _ in range(200):
        window = np.unique(rng.integers(0, 40, 6, np.uint64))
        twice = rng.random(len(window)) < 0.2
        known, tell = memory.meet(window, twice)
        assert (known | ~twice).all() and (known | ~tell).all()
        for w, t, k, say in zip(window.tolist(), twice, known, tell):
            assert not k or t or seen[w]
            seen[w] += 1
            told[w] += say or not k
            assert not k or told[w]  # whoever is known has been reported before or is now


def test_overlapping_self_repeats(spark):
    rows = [(1, "a " * 60), (2, "b c " * 40 + "d"), (3, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs, log2_bits=16).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == expected(rows, 35)


def test_empty(no_docs):
    assert substrings.remove_repeats(no_docs, log2_bits=16).count() == 0


def test_intervals():
    assert substrings.intervals([(0 << 31) | 2, (10 << 31) | 1, (3 << 31) | 1], 5) == [(0, 8), (10, 15)]
    assert substrings.intervals(np.array([], dtype=np.int64), 5) == []


def test_hashes_of_strings():
    """Equal strings have equal hashes wherever they stand; others differ, also those of zeros and swapped letters."""
    rng = np.random.default_rng(2)
    names = sorted({"".join(rng.choice(list("ab\0é"), rng.integers(0, 9))) for _ in range(4000)})
    h = hash_words(names)
    assert len(set(h.tolist())) == len(names)
    order = rng.permutation(len(names))
    assert (hash_words([names[i] for i in order]) == h[order]).all()
    assert (hash_strings(pa.array(["x", *names]).slice(1)) == h).all() and len(hash_words([])) == 0
