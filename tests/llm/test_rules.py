import math
import random
from collections import Counter

from conftest import words
from pyspark.sql import functions as F

from logmill.llm import rules


def expected(text):
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, doc_rows):
    assert rules.with_stats(docs, "more").columns == [*docs.columns, "more"]
    got = rules.with_stats(docs.drop("_stats"))
    extra = [(1, "a b c a b c a b c d"), (2, "x x x x"), (3, "# a\n# a\n\n \n# a\nb | c"), (4, "\x0b a\x0cb\r"), (5, "é 日本 a b")]
    rows = doc_rows + extra
    more = docs.sparkSession.createDataFrame(extra, "doc_id long, text string")
    both = got.select("doc_id", "_stats").unionByName(rules.with_stats(more).select("doc_id", "_stats")).collect()
    assert Counter((r.doc_id, *r._stats) for r in both) == Counter((d, *expected(t)) for d, t in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def labelled(spark, n=1500):
    """Bad: many symbols in short words, or almost all words repeated; some labels are wrong."""
    rng, rows = random.Random(5), []
    for i in range(n):
        kind = rng.randrange(4)
        words_, chars = rng.randint(60, 400), rng.uniform(4, 6)
        symbols = rng.randint(words_, 3 * words_) if kind == 0 else rng.randint(0, 3)
        repeat = int(words_ * rng.uniform(0.3, 0.5)) if kind == 1 else rng.randint(0, 5)
        bad = kind < 2 if rng.random() > 0.01 else kind >= 2
        rows.append((i, (words_, int(words_ * chars), symbols, rng.randint(0, 2), repeat), int(not bad), kind < 2))
    schema = "doc_id long, _stats struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>, quality int, truth boolean"
    return spark.createDataFrame(rows, schema)


def test_learns_held_out_rules(spark):
    rows = labelled(spark)
    learned = rules.fit(rows, rows.select("doc_id", "quality").where("doc_id < 1000"))
    assert 1 <= len(learned.rules) <= 8 and all(len(r) <= 3 for r in learned.rules)
    test = rows.where("doc_id >= 1000").withColumn("keep", learned.keeps(rules.features(rows["_stats"])))
    wrong = test.where("keep = truth").count()
    assert wrong <= 10, str(learned)
    assert str(learned).startswith("reject if ")


def test_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 0), (10**9, 1)], "doc_id long, quality int")
    out, learned = rules.judge(docs, labels, "_s", "_k")
    assert not learned.rules and out.count() == docs.count()
    assert out.where("_k is null").count() == 0
    assert rules.judge(no_docs, labels, "_s", "_k")[0].count() == 0
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("_k").count() and kept.where("_stats = 'z' and _kept = 'z'").count() == kept.count()


def test_as_many_rules_as_kinds_of_junk(spark):
    kinds = 11
    rows = [(*(20.0 + i % 5 if j == i % (2 * kinds) else float((i * 7 + j) % 5) for j in range(kinds)), i % (2 * kinds) < kinds, i // (2 * kinds) % 3 < 2) for i in range(60 * kinds)]
    table = spark.createDataFrame(rows, ", ".join(f"f{j} double" for j in range(kinds)) + ", bad boolean, grow boolean")
    learned = rules.learn(table)
    keeps = learned.keeps({f"f{j}": table[f"f{j}"] for j in range(kinds)})
    assert len(learned.rules) > 8
    assert table.where(keeps == table["bad"]).count() == 0


def plain_list(rows, max_literals=3, quantiles=24, least_precision=0.9, least_rows=5):
    """Sequential covering by trying every literal on every row: [(feature, at least, threshold), ...] per rule."""
    names = [c for c in rows[0] if c not in ("bad", "grow")]
    grow, prune = ([r for r in rows if r["grow"] == g] for g in (True, False))
    cuts = {}
    for name in names:
        seen = set()
        for kind in (True, False):
            values = sorted(r[name] for r in grow if r["bad"] == kind)
            seen |= {values[max(1, math.ceil(len(values) * k / (quantiles + 1))) - 1] for k in range(1, quantiles + 1)} if values else set()
        seen = sorted(seen)
        cuts[name] = sorted({*seen, *((a + b) / 2 for a, b in zip(seen, seen[1:]))})
    holds = lambda rule, r: all((r[f] >= t) == at_least for f, at_least, t in rule)
    count = lambda rows: (sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows))
    result = []
    while True:
        rule = []
        while len(rule) < max_literals:
            rest = [r for r in grow if not any(holds(x, r) for x in result) and holds(rule, r)]
            all_p, all_n = count(rest)
            best, top = None, 1e-9
            for name in names:
                for t in cuts[name]:
                    for at_least in (True, False):
                        p, n = count([r for r in rest if (r[name] >= t) == at_least])
                        if p >= least_rows:
                            gain = p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n)))
                            if gain > top:
                                best, top, left = (name, at_least, t), gain, n
            if best is None:
                break
            rule.append(best)
            if left == 0:
                break
        if not rule:
            return result
        rest = [r for r in prune if not any(holds(x, r) for x in result)]
        seen = [count([r for r in rest if holds(rule[:k], r)]) for k in range(1, len(rule) + 1)]
        worth = [(p - n) / max(1, p + n) for p, n in seen]
        k = worth.index(max(worth)) + 1
        p, n = seen[k - 1]
        if p < least_rows or p / (p + n) < least_precision:
            return result
        result.append(rule[:k])


def test_rules_equal_a_plain_learner(spark):
    """The list learned from histograms is that of trying every literal on every row."""
    rng, rows = random.Random(9), []
    for _ in range(700):
        kind = rng.randrange(5)
        a, b, c = rng.randint(0, 40), round(rng.gauss(0, 3), 2), rng.choice([0.0, 1.0, 2.0])
        bad = (kind == 0 and a > 25) or (kind == 1 and b < -1 and c > 0) or (a < 4 and c == 2) or rng.random() < 0.02
        rows.append({"a": float(a), "b": b, "c": c, "bad": bad, "grow": rng.random() < 0.67})
    for _ in range(250):
        rows.append({"a": 33.0, "b": round(rng.uniform(-9, 9), 2), "c": 1.0, "bad": rng.random() < 0.97, "grow": rng.random() < 0.67})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a double, b double, c double, bad boolean, grow boolean")
    learned = rules.learn(df)
    assert [[(x.feature, x.at_least, x.threshold) for x in r] for r in learned.rules] == plain_list(rows) and learned.rules
    # Ties: equal columns and equal rows; the first feature and the lowest threshold win.
    twin = df.withColumn("b", F.col("a"))
    again = rules.learn(twin)
    assert [[(x.feature, x.at_least, x.threshold) for x in r] for r in again.rules] == plain_list([{**r, "b": r["a"]} for r in rows])
    assert rules.learn(df.where("false")).rules == []
