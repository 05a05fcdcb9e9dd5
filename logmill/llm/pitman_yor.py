"""A hierarchical Pitman-Yor language model over words, and its scores of texts.

Every token is drawn in the restaurant of its context: the previous word, whichever
it is, or the start of the text.  All context restaurants share one parent, the
unigram restaurant, whose own base is diffuse: a draw from it is always a word never
seen, and all unseen words are one event.  So the model is normalised over the
distinct training tokens and that event.

Seating is sampled by Gibbs.  The state is the number of tables that each dish (word)
has in each restaurant; the sizes of tables are summed out, so one draw seats all
customers of a dish in a restaurant anew given all other seatings, and every table
sends one customer to the parent.  A draw is exact up to ``SMALL`` customers (against
closed-form posteriors, in the tests) and normal around a saddle point beyond (against
exact moments).  Within a round a random half of the cells is drawn at once (all in
the first) given the totals of the round before, the usual approximation of
distributed samplers.  The chain goes on from round to round; predictive
probabilities are averaged over the last ones (held-out scores change in the fourth
digit after the first round, see the README).  Random numbers come from a hash of
word, context and round: results depend neither on partitions nor on retries.

Discounts come from counts of counts; both strengths are fixed.  Texts are
lower-cased (A-Z) and cut into runs without ASCII white space; an end token follows.
Words are told apart by 63-bit hashes.  Log probabilities are added up as whole
multiples of 2**-26, so sums are the same in any order.

Null text counts as empty, a null ``doc_id`` as empty text.  Repeated ``doc_id``s give
one row each.  Without training rows every token has probability 1.  An empty table
gives no rows.  Columns but doc_id and text are not looked at.  A very long text is
read whole by its task; what is shuffled of it are its distinct pairs of words.

``restaurants`` has the passes over the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRENGTH = 1.0
#: Customers of a dish in a restaurant up to which its tables are drawn exactly.
SMALL = 40
#: Log probabilities are multiples of one over this.
SCALE = float(1 << 26)


def in_training(doc_id: Column) -> Column:
    """The rows learned from: CRC-32 of the id as text, modulo 5, is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from how many cells have one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


_stirling: dict[float, np.ndarray] = {}


def log_seatings(discount: float) -> np.ndarray:
    """Logarithm of the weight of all ways to seat ``c`` customers at ``t`` tables, by [c, t] up to ``SMALL``.

    Generalised Stirling numbers: customer ``c + 1`` opens a table or joins one of
    ``t`` with a total weight of ``c - discount * t``.
    """
    if discount not in _stirling:
        w = np.zeros((SMALL + 1, SMALL + 1))
        w[0, 0] = 1.0
        t = np.arange(SMALL + 1)
        for c in range(SMALL):
            w[c + 1, 1:] += w[c, :-1]
            w[c + 1] += np.maximum(c - discount * t, 0.0) * w[c]
        with np.errstate(divide="ignore"):
            _stirling[discount] = np.log(w)
    return _stirling[discount]


def draw_small(c: np.ndarray, others: np.ndarray, log_new: np.ndarray, discount: float, root_discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of cells with few customers from their exact distribution given everything else."""
    out = np.ones(len(c), np.int64)
    weights = log_seatings(discount)
    low = 2
    for high in (3, 6, 12, 24, SMALL):
        at = np.flatnonzero((c >= low) & (c <= high))
        low = high + 1
        if not len(at):
            continue
        t = np.arange(1, high + 1)
        # Each table beyond the first is one more draw of the word from the parent, which has seen the earlier ones.
        more = np.log(others[at][:, None] + t[:-1] - root_discount) + log_new[at][:, None]
        w = weights[c[at]][:, 1 : high + 1] + np.concatenate((np.zeros((len(at), 1)), np.cumsum(more, axis=1)), axis=1)
        p = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        out[at] = 1 + (p < (u[at] * p[:, -1])[:, None]).sum(axis=1)
    return np.minimum(out, np.maximum(c, 1))


def large_moments(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of ``c`` customers if each table has weight ``a``, for large ``c``.

    Tables are a Poisson process whose sizes add up to ``c``: the saddle point of
    ``exp(a * (1 - y**d) / d)`` with ``y = 1 - x`` solves ``a * (1 - y) * y**(d - 1) = c``.
    """
    mean, var, log_width = _saddle(c, a, d)
    # Second order: half the change of the saddle's width; where one table has almost all customers it is that table.
    _, _, wider = _saddle(c, a * 1.02, d)
    return mean + np.clip(-0.5 * (wider - log_width) / np.log(1.02), 0.0, 1.0), var


def _saddle(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and the logarithm of the saddle's width."""
    goal = np.log(c / a)
    y = np.clip(np.where(goal > 0, np.exp(-goal / (1 - d)) / 2, 0.5), 1e-300, 1 - 1e-12)
    for _ in range(16):
        f = np.log1p(-y) + (d - 1) * np.log(y) - goal
        slope = -y / (1 - y) + (d - 1)  # by log y
        y = np.clip(y * np.exp(np.clip(-f / slope, -3, 3)), 1e-300, 1 - 1e-12)
    x = 1 - y
    g, g1, g2 = (1 - y**d) / d, y ** (d - 1), (1 - d) * y ** (d - 2)
    spread = x * g1 + x * x * g2
    return a * g, a * np.maximum(g - (x * g1) ** 2 / spread, 0.0), np.log(a * spread)


def draw_large(c: np.ndarray, others: np.ndarray, log_new: np.ndarray, now: np.ndarray, discount: float, root_discount: float, u: np.ndarray, v: np.ndarray, turns: int) -> np.ndarray:
    """Tables of cells with many customers: a rounded normal draw around the saddle point."""
    mean = now.astype(np.float64)
    var = mean
    for _ in range(turns):  # the weight of a table grows with the tables that the parent has seen
        a = np.exp(log_new) * np.maximum(others + mean - root_discount, 1e-9)
        mean, var = large_moments(c.astype(np.float64), a, discount)
        mean = np.clip(mean, 1.0, c)
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    return np.clip(np.rint(mean + np.sqrt(var) * normal), 1, c).astype(np.int64)


def draw_tables(c: np.ndarray, t: np.ndarray, of_word: np.ndarray, of_context: np.ndarray, root: float, discount: float, root_discount: float, u: np.ndarray, v: np.ndarray, turns: int) -> np.ndarray:
    """New numbers of tables of cells with ``c`` customers and ``t`` tables, given the tables of their words, contexts and of all; ``u`` and ``v`` are uniform."""
    log_new = np.log((STRENGTH + discount * of_context) / (STRENGTH + root))
    others, out = of_word - t, t.copy()
    at = np.flatnonzero((c > 1) & (c <= SMALL))
    out[at] = draw_small(c[at], others[at], log_new[at], discount, root_discount, u[at])
    at = np.flatnonzero(c > SMALL)
    if len(at):
        out[at] = draw_large(c[at], others[at], log_new[at], t[at], discount, root_discount, u[at], v[at], turns)
    return out


def log_probability(c, t, cu, tu, tw, roots, words: int, discount: float, root_discount: float) -> np.ndarray:
    """Log10 of the averaged probability of cells, in multiples of 1 / ``SCALE``.

    ``c`` and ``cu`` are customers of the cell and the context; ``t``, ``tu`` and ``tw``
    tables of cell, context and word, by sample in rows; ``roots`` all tables by sample.
    """
    p = np.zeros(len(c))
    for s, root in enumerate(roots):
        parent = np.where(tw[s] > 0, tw[s] - root_discount, STRENGTH + root_discount * words) / (STRENGTH + root)
        p += (c - discount * t[s] + (STRENGTH + discount * tu[s]) * parent) / (STRENGTH + cu)
    return np.rint(np.log10(p / len(roots)) * SCALE).astype(np.int64)


def perplexity(scores: DataFrame) -> float:
    """Per token, over rows with ``score`` and ``n_tokens``."""
    r = scores.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).collect()[0]
    return 10.0 ** (-r["s"] / r["n"])


def score_corpus(docs: DataFrame, rounds: int = 2, samples: int = 3, seed: int = 17) -> DataFrame:
    """Learn from the training rows of ``docs`` (doc_id, text) and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from logmill.llm import restaurants

    marked = docs.select("doc_id", "text", in_training(F.col("doc_id")).alias("train"))
    fitted = restaurants.fit(marked, rounds, samples, seed)
    out = restaurants.score(marked, fitted)
    return out.select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(fitted.customers).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
