import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from logmill.llm import pitman_yor as py
from logmill.llm import restaurants
from logmill.llm.arrays import hash_words, pack_arrays, uniform, unpack_arrays

TOP = restaurants.TOP


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def pairs(text):
    """(word, word before) of every token; the end is True, the start False."""
    w = [*words(text, lower=True), True]
    return list(zip(w, [False, *w[:-1]]))


def plain(doc_rows, rounds, samples, seed):
    """The whole model with dictionaries, one cell after the other."""
    ids = {True: restaurants.END_HASH | TOP, False: restaurants.START_HASH | TOP}
    number = lambda w: ids[w] if isinstance(w, bool) else hash_words([w])[0] | TOP
    tokens = [pairs(t) for _, t in doc_rows]
    c = Counter(p for (d, _), x in zip(doc_rows, tokens) if not held_out(d) for p in x)
    cw, cu = Counter(), Counter()
    for (h, u), n in c.items():
        cw[h] += n
        cu[u] += n
    ones = lambda x, k: sum(v == k for v in x.values())
    kinds = Counter(h for h, _ in c)
    d, d0 = py.discount_of(ones(c, 1), ones(c, 2)), py.discount_of(ones(kinds, 1), ones(kinds, 2))
    key = {p: restaurants.pair_key(np.array([number(p[0])]), np.array([number(p[1])])) for p in c}
    t, kept = dict.fromkeys(c, 1), []

    def totals(t):
        tw, tu = Counter(), Counter()
        for (h, u), n in t.items():
            tw[h] += n
            tu[u] += n
        return tw, tu, sum(t.values())

    for k in range(rounds + samples):
        tw, tu, root = totals(t)
        new = dict(t)
        for (h, u), n in c.items():
            if n > 1 and (k == 0 or uniform(seed, k, 3, key[h, u])[0] < 0.5):
                one = lambda v: np.array([v])
                new[h, u] = int(py.draw_tables(one(n), one(t[h, u]), one(tw[h]), one(tu[u]), float(root), d, d0, uniform(seed, k, 1, key[h, u]), uniform(seed, k, 2, key[h, u]), 12 if k == 0 else 3)[0])
        t = new
        if k >= rounds:
            kept.append((t, *totals(t)))
    n_all, v = sum(c.values()), len(cw)

    def p(h, u):
        out = 0.0
        for t, tw, tu, root in kept:
            parent = (tw[h] - d0 if tw[h] else 1 + d0 * v) / (1 + root)
            out += (c[h, u] - d * t.get((h, u), 0) + (1 + d * tu[u]) * parent) / (1 + cu[u])
        return out / samples

    rows = [
        (i, held_out(i), len(x), sum(h in cw for h, _ in x), n_all, sum(math.log10((cw[h] + 0.5) / (n_all + 0.5 * (v + 1))) for h, _ in x), sum(math.log10(p(h, u)) for h, u in x))
        for (i, _), x in zip(doc_rows, tokens)
    ]
    return rows, p, cw, cu, (lambda u: sum((1 + d * tu[u]) * (1 + d0 * v) / (1 + root) for _, _, tu, root in kept) / samples / (1 + cu[u]))


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 4)))


@pytest.fixture(scope="module")
def small(doc_rows):
    return [(d, t if t is None or len(t) < 3000 else t[:3000]) for d, t in doc_rows]


@pytest.fixture(scope="module")
def wanted(small):
    return plain(small, 2, 2, 5)


@pytest.mark.parametrize(("hot", "bucket", "hot_pairs", "parts"), [(restaurants.HOT, restaurants.BUCKET, restaurants.HOT_PAIRS, 1), (0, 700, 0, 7), (12, 900, 20, 3), (60, 400, 8, 64)])
def test_equals_a_plain_model(spark, small, wanted, monkeypatch, hot, bucket, hot_pairs, parts):
    """However words are routed and texts are dealt out: scores are equal to the last digit."""
    monkeypatch.setattr(restaurants, "OFTEN", 2)
    docs = spark.createDataFrame([(d, t, 1) for d, t in small], "doc_id long, text string, h int").repartition(parts)
    marked = docs.withColumn("train", py.in_training(F.col("doc_id")))
    fitted = restaurants.fit(marked, 2, 2, 5, hot=hot, bucket=bucket, hot_pairs=hot_pairs)
    got = restaurants.score(marked, fitted).select("doc_id", (~py.in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.customers), "base_score", "score").collect()
    got, want = in_order(got), in_order(wanted[0])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-5)


def test_normalised(wanted):
    """In every context the probabilities of all known words and the unseen event add up to 1."""
    _, p, cw, cu, unseen = wanted
    for u in [*itertools.islice(cu, 12), "no such context"]:
        assert sum(p(h, u) for h in cw) + unseen(u) == pytest.approx(1)


def test_registered_query_on_odd_rows(docs, doc_rows):
    got = py.score_corpus(docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(pairs(t))) for d, t in doc_rows)
    assert all(r.score < 0 for r in got) and got[0].asDict().keys() == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    again = py.score_corpus(docs.repartition(9)).collect()
    assert sorted((r.n_tokens, r.score) for r in got) == sorted((r.n_tokens, r.score) for r in again)


def test_rare_contexts_are_learned(spark):
    """Each b follows only its a: a rare context must predict it."""
    rows = [(i, " ".join(f"a{j} b{j} z" for j in range(i % 7, 200, 3))) for i in range(60)]
    out = py.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg({"score": "sum", "n_tokens": "sum"}).collect()[0]
    assert out["sum(score)"] / out["sum(n_tokens)"] > -1.0


def test_held_out_beats_add_half_and_perplexity_falls_with_samples(spark):
    """Averaged probabilities do better than their samples do on average, and much better than the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def held(rounds, samples):
        return py.score_corpus(docs, rounds, samples).where("held_out").cache()

    # The chain is the same: its third, fourth and fifth rounds alone, and together.
    alone = [math.log(py.perplexity(held(rounds, 1))) for rounds in (2, 3, 4)]
    together = held(2, 3)
    base = together.select("n_tokens", F.col("base_score").alias("score"))
    assert math.log(py.perplexity(together)) < sum(alone) / 3 and py.perplexity(together) < py.perplexity(base) / 10


def exact_tables(n, theta, d, root_d, tables, others=0.0):
    """Posterior of the number of tables of one dish with n customers, everything else given."""
    stirling = np.zeros(n + 1)
    log = np.full((n + 1, n + 1), -np.inf)
    log[0, 0] = 0.0
    t = np.arange(n + 1)
    for m in range(n):
        with np.errstate(divide="ignore"):
            join = log[m] + np.log(np.maximum(m - d * t, 0.0))
        log[m + 1] = np.logaddexp(np.concatenate(([-np.inf], log[m, :-1])), join)
    w = log[n].copy()
    for k in range(2, n + 1):  # each further table needs one more draw of the word from the parent
        w[k:] += np.log((theta + d * (tables / 64)) * (others + k - 1 - root_d) / (theta + tables))
    stirling[1:] = np.exp(w[1:] - w[1:].max())
    return stirling / stirling.sum()



@pytest.mark.parametrize(("n", "tables", "d"), [(4, 30.0, 0.5), (12, 3000.0, 0.7), (30, 500.0, 0.3)])
def test_a_draw_matches_the_exact_posterior(n, tables, d):
    """One word in one context: the number of tables has a closed-form posterior."""
    m = 40_000
    one, u = np.ones(m, np.int64), uniform(5, np.arange(m))
    t = py.draw_tables(np.full(m, n), one, one, np.full(m, tables / 64), tables, d, 0.4, u, u, 12)
    counts = np.bincount(t, minlength=n + 1)
    assert np.allclose(counts / m, exact_tables(n, 1.0, d, 0.4, tables), atol=0.01)


def test_rounds_settle_in_the_joint_posterior():
    """Three words in two contexts, replicated: mean tables and probabilities against all seatings enumerated."""
    c = np.array([[3, 1, 2], [2, 4, 0]])  # contexts x words
    d, d0 = 0.6, 0.3
    cells = [(u, h) for u in range(2) for h in range(3) if c[u, h]]
    rising = lambda x, n, step: math.prod(x + k * step for k in range(n))
    weights = {}
    for ts in itertools.product(*(range(1, c[x] + 1) for x in cells)):
        t = np.zeros((2, 3), int)
        for x, n in zip(cells, ts):
            t[x] = n
        w = math.prod(math.exp(py.log_seatings(d)[c[x], t[x]]) for x in cells)
        w *= math.prod(rising(1 + d, t[u].sum() - 1, d) for u in range(2))
        tw = t.sum(axis=0)
        # The parent: a first customer of a word opens a table, further ones join it or stand for themselves.
        w *= math.prod(rising(1 - d0, int(x) - 1, 1) for x in tw if x) / rising(1, int(tw.sum()), 1)
        weights[ts] = w
    total = sum(weights.values())
    exact = np.array([sum(w * ts[k] for ts, w in weights.items()) / total for k in range(len(cells))])
    m = 6000
    customers, t = np.array([c[x] for x in cells]), np.ones((m, len(cells)), np.int64)
    mean = np.zeros(len(cells))
    for k in range(40):
        of_word = np.stack([sum(t[:, j] for j, y in enumerate(cells) if y[1] == x[1]) for x in cells], 1)
        of_context = np.stack([sum(t[:, j] for j, y in enumerate(cells) if y[0] == x[0]) for x in cells], 1)
        new = t.copy()
        moves = uniform(1, k, 3, np.arange(t.size)).reshape(t.shape) < 0.5
        roots = t.sum(axis=1)
        for root in np.unique(roots):
            at = np.flatnonzero(np.repeat(roots == root, len(cells)) & moves.ravel())
            flat = [np.broadcast_to(customers, t.shape).ravel()[at], t.ravel()[at], of_word.ravel()[at], of_context.ravel()[at]]
            u = uniform(1, k, 1, at)
            new.ravel()[at] = py.draw_tables(*flat, float(root), d, d0, u, u, 3)
        t = new
        if k >= 20:
            mean += t.mean(axis=0) / 20
    assert np.allclose(mean, exact, rtol=0.15), (mean, exact)


@pytest.mark.parametrize(("n", "a", "d"), [(60, 20.0, 0.5), (400, 3.0, 0.7), (400, 900.0, 0.3), (1000, 150.0, 0.6)])
def test_saddle_point_of_many_customers(n, a, d):
    log = np.full(n + 1, -np.inf)
    log[0] = 0.0
    t = np.arange(n + 1)
    for m in range(n):
        with np.errstate(divide="ignore"):
            log = np.logaddexp(np.concatenate(([-np.inf], log[:-1])), log + np.log(np.maximum(m - d * t, 0.0)))
    p = np.exp(log + t * np.log(a) - (log + t * np.log(a)).max())
    p /= p.sum()
    mean = (p * t).sum()
    var = (p * (t - mean) ** 2).sum()
    got_mean, got_var = (float(x[0]) for x in py.large_moments(np.array([float(n)]), np.array([a]), d))
    assert abs(got_mean - mean) < 0.03 * mean + 0.6 and abs(got_var - var) < 0.15 * var + 0.5


def test_no_training_rows(spark, no_docs):
    assert py.score_corpus(no_docs).count() == 0
    only = next(i for i in range(99) if held_out(i))
    r = py.score_corpus(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and abs(r.score) < 1e-9



def test_packed_arrays_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 3, 5000):
        arrays = [rng.integers(0, 1 << 62, n, np.uint64), rng.integers(-5, 5, n), rng.integers(0, 255, n).astype(np.uint8), np.zeros(0, np.int32)]
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack_arrays(pack_arrays(*arrays))))
