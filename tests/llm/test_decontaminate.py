import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from logmill.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(doc_rows, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in doc_rows:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[x]
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def items_from(doc_rows):
    rng, out = random.Random(3), []
    for k in range(25):
        w = (rng.choice(doc_rows)[1] or "").split()
        a = rng.randrange(max(1, len(w) - 20))
        out.append((k, " ".join(w[a : a + rng.choice([1, 3, 12, 13, 14, 30])]).upper()))
    return out + [(3, out[5][1]), (100, None), (101, ""), (None, out[6][1]), (102, "zzz qqq nothing")]


def test_brute_force(spark, docs, doc_rows):
    items = items_from(doc_rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected(doc_rows, items)
    for block in (decontaminate.BLOCK, 300):
        got = decontaminate.scan(docs, bench, block=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for (_, _, h, _), n in want.items() if not h)


def longest(text, items):
    """Maximal verbatim matches of 13 words or more, or of a whole shorter item, by trying every pair of places."""
    w, out = split(text), set()
    for i, t in items:
        b = split(t)
        least = min(13, len(b))
        for p in range(len(w)):
            for q in range(len(b)):
                if p and q and w[p - 1] == b[q - 1]:
                    continue
                n = 0
                while p + n < len(w) and q + n < len(b) and w[p + n] == b[q + n]:
                    n += 1
                if least and n >= least:
                    out.add(("" if i is None else str(i), p, q, n))
    return out


def test_all_longest_matches(spark):
    """Repeats inside items and documents, shared prefixes, matches at edges; small blocks and shards."""
    rng = random.Random(8)
    word = lambda: rng.choice("abc")
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 5, 13, 14, 20, 33])))) for k in range(12)] + [(50, "a " * 30), (50, "b " * 15), (None, "c " * 13)]
    rows = [(d, " ".join(word() for _ in range(rng.randint(0, 60)))) for d in range(40)]
    rows += [(100 + k, f"{items[k][1]} z {items[k + 1][1]}") for k in range(13)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 100):
        got = {r.doc_id: {tuple(m) for m in r.matches} for r in decontaminate.scan(docs, bench, block=block).collect()}
        assert got == {d: longest(t, items) for d, t in rows}


def test_blocks_are_read_once_per_shard_at_most(tmp_path, monkeypatch):
    rng, paths = random.Random(1), []
    for k in range(3):
        block = decontaminate.Block.of([k], [" ".join(f"w{rng.randrange(50)}" for _ in range(400))])
        paths.append(f"file://{tmp_path}/{k}")
        (tmp_path / str(k)).write_bytes(block.dump())
    everything = type("All", (), {"has": lambda self, x: np.ones(len(x), bool)})()
    bench = decontaminate.Benchmark(paths, 13, everything)
    for room, most in ((1 << 20, 3), (0, 12)):
        monkeypatch.setattr(decontaminate, "REMEMBER", room)
        monkeypatch.setattr(decontaminate, "reads", 0)
        monkeypatch.setattr(decontaminate, "_size", 0)
        decontaminate._remembered.clear()
        for _ in range(4):
            decontaminate.scan_shard(pa.array(["w1 w2 " * 30, None, ""]), bench)
        assert decontaminate.reads == most


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(5, "q " + " ".join(f"w{i}" for i in range(10, 30)) + " r")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = decontaminate.scan(docs, bench).collect()[0]
    assert [tuple(m) for m in r.matches] == [("5", 10, 1, 20)] and r.n_hit == 20


def test_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(no_docs, none).count() == 0
    assert decontaminate.scan(docs, none).agg({"n_hit": "sum"}).collect()[0][0] == 0
    assert decontaminate.digest([]) == hashlib.sha256(b"").hexdigest()
