import numpy as np
import pyarrow as pa
import pytest

from logmill.llm import cotraining
from logmill.llm.arrays import uniform


def held_out(spark, sf, **more):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model, features = cotraining.fit(docs, labels.where("doc_id % 3 <> 0"), **more)
    test = cotraining.score(features, model).join(labels.where("doc_id % 3 = 0"), "doc_id")
    good = "quality = 1 and toxic = 0"
    r = test.selectExpr(
        f"avg(case when {good} then cast(kept as int) end) as kept_good",
        f"avg(case when not ({good}) then 1 - cast(kept as int) end) as caught",
        f"avg(score) - avg(case when {good} then 1 else 0 end) as bias",
    ).collect()[0]
    return model, r


def test_held_out_accuracy(spark):
    model, r = held_out(spark, "sf0.1")
    assert model.exchanged > 0 and r.kept_good > 0.96 and r.caught > 0.8 and abs(r.bias) < 0.05


def test_bounds_on_training_rows_hold_and_still_work(spark):
    """All rows are searched for certain ones; few of them are learned from."""
    model, r = held_out(spark, "sf0.1", labelled=1500, most=200)
    assert 0 < model.exchanged <= 2 * 3 * 220 and r.kept_good > 0.95 and r.caught > 0.75


def sparse(rows):
    return cotraining.Sparse(np.concatenate(rows).astype(np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows]))))


def two_views(n, seed=3):
    rng, y = np.random.default_rng(seed), np.random.default_rng(seed).integers(0, 2, n)

    def view(strong):
        return sparse([np.unique(np.append(rng.integers(100, 140, 3), [10 + y[i]] if rng.random() < strong else [])) for i in range(n)])

    return cotraining.Views(view(0.8), np.full((n, len(cotraining.SHAPE)), np.nan, np.float32), view(0.9)), y


def test_views_teach_each_other():
    """Labels show one sign of either view only; the pool links it to the others."""
    views, y = two_views(4000)
    first, rest = np.arange(300), np.arange(300, 4000)
    pool = cotraining.Pool(views.take(rest), rest, uniform(11, rest))
    model = cotraining.cotrain(views.take(first), y[first], first % 4, pool)
    right = [((z > 0) == y)[300:].mean() for z in model.log_odds(views)]
    assert model.exchanged > 100 and right[2] > 0.95 and right[2] >= max(right[:2]) - 0.01


def plain_loop(labelled, label, fold, pool_views, row, dice, rounds, share, sure, most):
    """Co-training with lists: one row after the other, all of the pool in every round."""
    cuts = cotraining.shape_cuts(labelled.shape)
    size = {"text": (1 << cotraining.TEXT_BITS) + sum(map(len, cuts)), "meta": 1 << cotraining.META_BITS}
    fixed = [i for i in range(len(labelled)) if fold[i]]
    good = np.mean([label[i] for i in fixed])
    own = {name: [(labelled.take(np.array([i])), label[i]) for i in fixed] for name in size}
    given = {name: set() for name in size}
    for number in range(rounds + 1):
        w = {}
        for name in size:
            together = cotraining.Views.joined([v for v, _ in own[name]])
            w[name] = cotraining.fit_logistic(together.view(name, cuts), np.array([float(k) for _, k in own[name]]), size[name])
        if number == rounds:
            return w
        room = min(int(share * len(pool_views)), most)
        for name, other in (("text", "meta"), ("meta", "text")):
            odds = cotraining.raw_odds(pool_views, name, w[name], cuts)
            for kind, limit in ((1, int(room * good)), (0, int(room * (1 - good)))):
                sure_of = [(min(int(abs(o) * 8), 400), k) for k, o in enumerate(odds) if (1 / (1 + np.exp(-o)) if kind else 1 / (1 + np.exp(o))) >= sure]
                left = limit
                for step in sorted({s for s, _ in sure_of}, reverse=True):
                    these = [k for s, k in sure_of if s == step]
                    portion = min(1.0, left / len(these))
                    for k in these:
                        if dice[k] < portion and row[k] not in given[other]:
                            given[other].add(row[k])
                            own[other].append((pool_views.take(np.array([k])), kind))
                    if len(these) >= left:
                        break
                    left -= len(these)


def test_equals_a_plain_loop(spark):
    """What the executors count and choose gives the weights of a loop over all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, features = cotraining.fit(docs, labels, most=60)
    rows = [cotraining._load(r.blob) for r in features.collect()]
    ids = [i for r in rows for i in r[0].to_pylist()]
    label, row = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
    views = cotraining.Views.joined([r[3] for r in rows])
    at = np.array(sorted(np.flatnonzero(label >= 0), key=lambda k: ids[k]))
    fold = np.array([cotraining.hash_words([str(ids[k])])[0] % np.uint64(4) for k in at], np.int64)
    pool = np.flatnonzero(label < 0)
    w = plain_loop(views.take(at), label[at].astype(np.int64), fold, views.take(pool), row[pool].tolist(), uniform(11, row[pool]), 3, 0.1, 0.95, 60)
    assert model.exchanged > 0
    assert np.allclose(w["text"], model.text, atol=1e-6) and np.allclose(w["meta"], model.meta, atol=1e-6)


def test_repeated_ids_and_copies(spark):
    """One id and one text hold most rows: what reaches the driver stays bounded."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one = labels.where("quality = 1").orderBy("doc_id").limit(1).select("doc_id")
    many = docs.join(one, "doc_id").crossJoin(spark.range(3000)).drop("id")
    unlabelled = docs.join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(1).crossJoin(spark.range(3000)).drop("id")
    everything = docs.unionByName(many).unionByName(unlabelled)
    model, features = cotraining.fit(everything, labels, most=100)
    assert cotraining.score(features, model).count() == everything.count() and model.exchanged <= 2 * 3 * 150


def test_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    out = cotraining.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or kept is null").count() == 0
    none, features = cotraining.fit(no_docs, labels.where("false"))
    assert cotraining.score(features, none).count() == 0
    r = cotraining.classify(docs.drop("lang", "source", "n_chars"), labels.where("false")).select("score").distinct().collect()
    assert [round(x.score, 6) for x in r] == [0.5]
    text, shape = cotraining.text_features(pa.array([None, "", "a " * 20], pa.string()))
    assert len(text) == 3 and np.isnan(shape[:2]).all() and shape[2, 3] == pytest.approx(0.95)


def test_features_round_trip():
    views, y = two_views(50)
    ids, label, row, got = cotraining._load(cotraining._dump(pa.array([None, *range(49)], pa.int64()), y, np.arange(50), views))
    assert ids.to_pylist() == [None, *range(49)] and (label == y).all() and (row == np.arange(50)).all()
    assert (got.text.index == views.text.index).all() and (got.meta.bounds == views.meta.bounds).all() and np.isnan(got.shape).all()
