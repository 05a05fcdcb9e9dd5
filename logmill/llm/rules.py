"""Learned decision lists over text statistics, with DataFrame operations only.

Statistics of whole texts are built-in expressions.  A decision list is learned
from labelled rows by sequential covering: a rule grows literal by literal
(``feature >= t`` or ``feature < t``), taking the one with the greatest FOIL gain
on two thirds of the rows not yet covered; then trailing literals are pruned as
long as the rest does no worse on the other third; a rule that is right too
seldom there ends the list.  Each step reads one small histogram per feature.
The list is emitted as an ordered conditional expression.

At most about ``MAX_LABELLED`` labelled rows are learned from (chosen by a hash of
``doc_id``); everything else covers all rows.  Null text: no words.  Without both
kinds of labels the list is empty and rejects nothing.  Null labels and label
rows without a document are ignored; a document labelled twice counts as bad if
any label says so.  Repeated ``doc_id``s are separate documents.  Of literals with equal
gain the first feature's with the lowest threshold is taken.  An empty table gives no
rows and an empty list.  Names of other columns do not matter.  A text is one row of
arrays, so a very long one needs some fifty times its size in its task's heap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.llm.storage import fresh, materialize

#: The white space and the marks that the statistics are about.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_LABELLED = 200_000
#: Repeated windows up to which each place is compared with all of them.
FEW = 12
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_stats(docs: DataFrame, name: str = "_stats") -> DataFrame:
    """Add a struct column with the five statistics of ``text``.

    n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines with a
    word, equal to an earlier line); n_repeat_words (words inside three-word
    windows that the text has twice or more).
    """
    own = list(docs.columns)
    text, words, hashes, ordered, twice, pairs, at = (fresh(docs, f"{name}_{k}") for k in ("text", "words", "hashes", "ordered", "twice", "pairs", "at"))
    out = docs.withColumn(text, F.coalesce("text", F.lit("")))
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    out = out.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")))

    def window(i: Column) -> Column:
        w = F.col(words)
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    none = F.array().cast("array<int>")
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(none)
    out = out.withColumn(hashes, F.transform(starts, window))
    # Most texts repeat few windows or none: plain numbers are sorted for all texts, places only for the others.
    out = out.withColumn(ordered, F.sort_array(hashes))
    out = out.withColumn(twice, F.array_distinct(F.filter(ordered, lambda h, k: h == F.get(F.col(ordered), k + 1))))
    few = F.size(twice) <= FEW
    placed = F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn(pairs, F.when(few, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(placed)))

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(F.col(pairs), k - 1)["h"], F.get(F.col(pairs), k + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    by_place = F.filter(starts, lambda i: F.array_contains(twice, F.get(hashes, i)))
    by_order = F.sort_array(F.transform(F.filter(pairs, repeated), lambda x: x["i"]))
    out = out.withColumn(at, F.when(F.size(twice) == 0, none).when(few, by_place).otherwise(by_order))
    # Sorted windows cover three words each, less what the next one begins with.
    covered = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(at), k + 1) - p, F.lit(3))))
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )
    return out.withColumn(name, stats).select(*own, name)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def features(stats: Column) -> dict[str, Column]:
    """Numbers that rules speak about: the statistics and their shares of the words."""
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    plain = {s: stats[s].cast("double") for s in STATS}
    return plain | {
        "chars_per_word": plain["word_chars"] / words,
        "symbols_per_word": plain["n_symbols"] / words,
        "dup_lines_per_word": plain["n_dup_lines"] / words,
        "repeat_share": plain["n_repeat_words"] / words,
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        v = values[self.feature]
        return v >= self.threshold if self.at_least else v < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects a text, none keeps it."""

    rules: list[list[Literal]] = field(default_factory=list)

    def keeps(self, values: dict[str, Column]) -> Column:
        """``CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true END``."""
        out = None
        for rule in self.rules:
            holds = conjunction(rule, values)
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def conjunction(rule: list[Literal], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column(values)
    return out


def _bucket(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts are ``value`` at most."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value))


def learn(labelled: DataFrame, max_literals: int = 3, quantiles: int = 24, least_precision: float = 0.9, least_rows: int = 5) -> DecisionList:
    """Learn from rows with a double column per feature, ``bad`` (boolean) and ``grow`` (boolean).

    Rules have ``max_literals`` at most, their thresholds come from ``quantiles`` of
    each feature and class.  Their number has no limit: the list ends when no literal
    gains anything, or when a rule is too imprecise on the pruning rows or rejects
    fewer than ``least_rows`` bad ones of them, so each rule uses some up.
    """
    names = [c for c in labelled.columns if c not in ("bad", "grow")]
    values = {n: F.col(f"`{n}`") for n in names}
    steps = [k / (quantiles + 1) for k in range(1, quantiles + 1)]
    cuts_of = {}
    asked = [F.percentile_approx(F.when(F.col("bad") == kind, values[n]), steps, 2000).alias(f"{n}:{kind}") for n in names for kind in (True, False)]
    row = labelled.where("grow").agg(*asked).collect()[0]
    for n in names:
        seen = sorted({float(x) for kind in (True, False) for x in (row[f"{n}:{kind}"] or [])})
        cuts_of[n] = sorted({*seen, *((a + b) / 2 for a, b in zip(seen, seen[1:]))})
    names = [n for n in names if cuts_of[n]]
    result = DecisionList()
    if not names:
        return result

    def histogram(rule: list[Literal]) -> dict[str, dict[int, tuple[int, int]]]:
        """Per feature and bucket between thresholds: bad and good rows that the rule holds for and no earlier rule does."""
        rest = labelled.where(F.col("grow") & result.keeps(values) & conjunction(rule, values))
        slots = [F.struct(F.lit(n).alias("feature"), _bucket(values[n], cuts_of[n]).alias("bucket")) for n in names]
        counted = rest.select("bad", F.explode(F.array(*slots)).alias("s")).groupBy("s.feature", "s.bucket").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in counted.collect():  # features x thresholds rows
            out[r["feature"]][r["bucket"]] = (r["p"], r["n"])
        return out

    def best_literal(found: dict[str, dict[int, tuple[int, int]]]) -> tuple[float, Literal | None, int, int]:
        top: tuple[float, Literal | None, int, int] = (1e-9, None, 0, 0)
        for name, buckets in found.items():
            all_p, all_n = (sum(b[k] for b in buckets.values()) for k in (0, 1))
            if not all_p:
                continue
            prior = math.log2(all_p / (all_p + all_n))
            for k, cut in enumerate(cuts_of[name]):
                high_p, high_n = (sum(b[j] for i, b in buckets.items() if i > k) for j in (0, 1))
                for at_least, p, n in ((True, high_p, high_n), (False, all_p - high_p, all_n - high_n)):
                    if p >= least_rows and (gain := p * (math.log2(p / (p + n)) - prior)) > top[0]:
                        top = (gain, Literal(name, at_least, cut), p, n)
        return top

    while True:
        rule: list[Literal] = []
        while len(rule) < max_literals:
            _, literal, p, n = best_literal(histogram(rule))
            if literal is None:
                break
            rule.append(literal)
            if n == 0:
                break
        if not rule:
            break
        rest = labelled.where(~F.col("grow") & result.keeps(values))
        counts = []
        for k in range(1, len(rule) + 1):
            holds = conjunction(rule[:k], values)
            counts += [F.count_if(holds & F.col("bad")).alias(f"p{k}"), F.count_if(holds & ~F.col("bad")).alias(f"n{k}")]
        seen = rest.agg(*counts).collect()[0]
        worth = [(seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"]) for k in range(1, len(rule) + 1)]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i)) + 1
        p, n = seen[f"p{k}"], seen[f"n{k}"]
        if p < least_rows or p / (p + n) < least_precision:
            break
        result.rules.append(rule[:k])
    return result


def labelled_features(stats: DataFrame, labels: DataFrame, name: str = "_stats", most: int = MAX_LABELLED) -> DataFrame:
    """Join statistics (doc_id and the struct) to labels (doc_id, quality): features, ``bad``, ``grow``."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    total = max(1, marks.count())
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < 1_000_003 * min(1.0, most / total)
    joined = stats.select("doc_id", name).join(marks.where(share), "doc_id")
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    return joined.select(*(c.alias(n) for n, c in features(F.col(name)).items()), "bad", grow.alias("grow"))


def fit(stats: DataFrame, labels: DataFrame, name: str = "_stats") -> DecisionList:
    return learn(materialize(labelled_features(stats, labels, name), "rule-labels"))


def judge(docs: DataFrame, labels: DataFrame, stats: str = "_stats", kept: str = "_kept") -> tuple[DataFrame, DecisionList]:
    """``docs`` (all columns) with the statistics and whether they are kept, and the list learned; statistics are computed once."""
    found = materialize(with_stats(docs, stats), "rule-stats")
    rules = fit(found, labels, stats)
    s = F.col(stats)
    return found.withColumn(kept, ~base_failed(s) & rules.keeps(features(s))), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that neither the base rules nor the learned list reject."""
    stats, kept = fresh(docs, "_stats"), fresh(docs, "_kept")
    judged, _ = judge(docs, labels, stats, kept)
    return judged.where(F.col(kept)).select(*docs.columns)
