import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logmill.llm import frames, packing, token_counts
from logmill.llm.tokenize import WordEncoder, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids_of(text, path=WORD):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoded(doc_rows):
    return [(d, np.array([*ids_of(t), 1], "<u4").tobytes()) for d, t in doc_rows]


ODD = st.lists(st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85  aZé's.,!|<>#1٣ßİ́日\x00") + ["<|endoftext|>", "'ll", "the "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_encoders_equal_the_library(texts):
    ids, bounds = _ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [[*ids_of(t), 1] for t in texts]
    pre = token_counts.PreTokenizer.of(BYTE)
    row, code, names = pre.tokens(pa.array(texts, pa.string()))
    pieces = {n: len(ids_of(n, BYTE)) for n in names.to_pylist()}
    got = [sum(pieces[names[int(c)].as_py()] for r, c in zip(row, code) if r == i) for i in range(len(texts))]
    assert got == [len(ids_of(t, BYTE)) for t in texts]


_ENCODER = WordEncoder(WORD)


def test_frames_round_trip(spark, docs, encoded):
    shards = frames.write_shards(docs, WORD)
    got = frames.read_shards(spark, shards).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == Counter((d, len(b) // 4, zlib.crc32(b), b) for d, b in encoded)
    got.sort(key=lambda r: r.start)
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert frames.read_shards(spark, frames.write_shards(docs.where("false"), WORD)).count() == 0


def test_shards_end_by_size(spark, docs, encoded):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        shards = frames.write_shards(docs, WORD, shard_bytes=300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(shards) > 8 and sum(s.docs for s in shards) == len(encoded)
    got = sorted(frames.read_shards(spark, shards).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(encoded)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


def test_random_access_and_damage(tmp_path):
    path = tmp_path / "x.zst"
    writer = frames.FrameWriter(path.open("wb"))
    arrays = [np.arange(n, dtype=np.uint32) for n in (5, 0, 70_000)]
    for i, a in enumerate(arrays):
        writer.add(10 * i, a)
    writer.close()
    reader = frames.FrameReader(str(path))
    assert len(reader) == 3 and reader.lengths.tolist() == [5, 0, 70_000] and reader.doc_ids == [0, 10, 20]
    assert (reader.find(20)[0] == arrays[2]).all() and reader.find(11) == []
    import zstandard

    # an ordinary decompressor reads the file as well: tables are skippable frames
    with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as r:
        assert r.read() == b"".join(a.astype("<u4").tobytes() for a in arrays)
    raw = bytearray(path.read_bytes())
    raw[int(reader.offsets[2]) + 20] ^= 1
    path.write_bytes(raw)
    again = frames.FrameReader(str(path))
    assert (again.read(0) == arrays[0]).all()
    with pytest.raises(Exception):
        again.read(2)


def test_packing(docs, encoded):
    capacity = 64
    packed = packing.pack(packing.token_pieces(docs, WORD, capacity, with_ids=True), capacity, group=40)
    whole = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    pieces = packed.collect()
    want = Counter()
    for d, b in encoded:
        for k, a in enumerate(range(0, len(b), 4 * capacity)):
            part = b[a : a + 4 * capacity]
            want[(d, k, a // 4, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
        assert whole[r.sequence_id][1][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert {k: sum(n for _, n in b) for k, b in bins.items()} == {k: len(i) // 4 for k, (n, i) in whole.items()} == {k: n for k, (n, _) in whole.items()}
    # As many sequences as packing all lengths at once, however pieces are dealt into groups.
    assert len(bins) == packing.best_fit_decreasing(np.array([r.length for r in pieces]), capacity)[0].max() + 1
    assert packing.pack(packing.token_pieces(docs.where("false"), WORD)).count() == 0


def test_packing_is_global(spark):
    """Several groups of the usual size; a third of the pieces have one length."""
    rng = np.random.default_rng(5)
    n = 3 * packing.GROUP
    lengths = np.where(rng.random(n) < 1 / 3, 1500, rng.integers(1, 2700, n)).astype(np.int64)
    rows = pd.DataFrame({"doc_id": np.arange(n), "piece": np.zeros(n, np.int32), "length": lengths, "spread": rng.integers(0, 1 << 62, n)})
    got = packing.pack(spark.createDataFrame(rows)).toPandas()
    where, _ = packing.best_fit_decreasing(lengths, 4096)
    assert sorted(got["length"]) == sorted(lengths) and got["sequence_id"].nunique() == where.max() + 1
    got = got.sort_values(["sequence_id", "offset"])
    end = got["offset"] + got["length"]
    assert end.max() <= 4096
    same = got["sequence_id"].to_numpy()[1:] == got["sequence_id"].to_numpy()[:-1]
    assert (got["offset"].to_numpy()[1:] == np.where(same, end.to_numpy()[:-1], 0)).all() and got["offset"].iloc[0] == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing_is_what_it_says(lengths):
    """The same bins as trying every open one."""
    where, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 50)
    rooms: list[int] = []
    plain = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits, default=50)
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[i])
        plain[i] = 50 - room
    assert [plain[i] for i in range(len(lengths))] == offset.tolist()
    assert len(rooms) == (where.max() + 1 if len(lengths) else 0)
    # Pieces of a bin lie one after the other.
    for b in set(where.tolist()):
        inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(where == b))
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]


@pytest.mark.parametrize("hot", [0, 50, token_counts.HOT])
def test_token_counts(docs, doc_rows, hot):
    got = token_counts.token_counts(docs, BYTE, hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((d, len((t or "").encode()), len(ids_of(t, BYTE))) for d, t in doc_rows)
    assert token_counts.token_counts(docs.where("false"), BYTE, hot).count() == 0
