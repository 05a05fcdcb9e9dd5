import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def make_docs(seed=7, n=60):
    """Rows (doc_id, text): copies, near copies, shared passages and lines, nulls, empty, a long one, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "in", "er", "on", "é", "Ag", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(150)]

    def text(k):
        out = []
        for i in range(k):
            out.append(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", "!", "'s"]))
            out.append(rng.choice([" ", " ", " ", " ", "  ", "\n", "\t"]) if i < k - 1 else "")
        return "".join(out)

    passage, lines = text(50), "\n".join(text(6) for _ in range(4))
    rows = [(i, text(rng.randint(1, 120))) for i in range(n)]
    rows += [(n + i, text(20) + " " + passage + " " + text(15)) for i in range(4)]
    rows += [(n + 10 + i, text(10) + "\n" + lines + "\n" + text(8)) for i in range(4)]
    base = text(150).split(" ")
    for i in range(6):
        w = list(base)
        for _ in range(i // 2):
            w[rng.randrange(len(w))] = "zz%d" % rng.randrange(99)
        rows.append((n + 20 + i, " ".join(w)))
    rows += [(n + 30, rows[3][1]), (n + 31, rows[3][1]), (n + 32, None), (n + 33, ""), (n + 34, " \n\n "), (None, rows[5][1]), (None, None)]
    rows += [(7, rows[7][1]), (7, text(40)), (n + 35, text(6000)), (n + 36, "x <|endoftext|> y<|startoftext|>")]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """The rows with columns that clash with names the operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, *"zzzzzz") for i, t in doc_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, _row string, _KEY string, _gone string, _stats string, _kept string, spread string"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
