"""The n-gram join against all pairs; the classifier's likelihood and held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest

from prosemill.llm import jaccard, ordinal
from prosemill.llm import queries as Q
from prosemill.llm.jaccard import Banding, near_duplicates


def grams(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, threshold=0.8):
    sets, links, group = [grams(t) for _, t in rows], Counter(), list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 1_000_000 >= round(threshold * 1_000_000) * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                group[root(a)] = root(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (key is not None, key or 0)) if root(i) in least else (key is not None, key or 0)
    return [(rows[i][0], least[root(i)][1] if least[root(i)][0] else None, links[i]) for i in range(len(rows))]


def copies(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(3, 200))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK_CLASSES, 16])
def test_links_and_groups(spark, monkeypatch, block):
    """A recall of nearly one, so that the result is that of all pairs; small blocks go through pairs of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = copies(block)
    done = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999999)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in done.collect()) == sorted(brute(rows))
    kept = [r["doc_id"] for r in done.where("kept").collect()]
    assert sorted(kept) == sorted({c for _, c, _ in brute(rows)})


def test_recall_at_the_shipped_setting(spark):
    """Pairs at a similarity of just 0.8, which no other text is like: nine in ten at least must be linked."""
    rng, rows = random.Random(4), []
    for i in range(600):
        words = [f"v{rng.getrandbits(30)}" for _ in range(94)]  # 90 grams; one word changed at the end leaves 80 of 100
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:84], *(f"u{rng.getrandbits(30)}" for _ in range(10))]))]
    similar = [len(grams(a[1]) & grams(b[1])) / len(grams(a[1]) | grams(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert all(0.8 <= s < 0.81 for s in similar), similar[:3]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert found >= 0.9 * len(rows)


def test_a_chain_of_neighbours_moves_few_sets(spark, monkeypatch):
    """Each text is like the next only. With blocks of eight a set goes to its own block and those of its neighbours, not to all."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)
    rng, words, rows = random.Random(6), [f"v{i}" for i in range(60)], []
    for i in range(300):
        words = [*words[3:], *(f"u{rng.getrandbits(40)}" for _ in range(3))]
        rows.append((i, " ".join(words)))
    moved = []
    write = jaccard.Scratch.write

    def counted(self, df, name):
        table = write(self, df, name)
        if name == "pairs":
            moved.append(table.count())
        return table

    monkeypatch.setattr(jaccard.Scratch, "write", counted)
    done = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999999)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in done.collect()) == sorted(brute(rows))
    assert moved[0] < 300 * 16  # 38 blocks: moving to all would be 300 * 38


def test_edges_of_the_join(edges, empty):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    done = near_duplicates(edges, recall=0.999999)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in done.collect()), key=str) == sorted(brute(rows), key=str)
    assert near_duplicates(empty).count() == 0


def test_banding_reaches_its_recall():
    b = Banding.for_recall(0.8, 0.99)
    assert 1 - (1 - 0.8**b.rows) ** b.bands >= 0.99 > 1 - (1 - 0.8**b.rows) ** (b.bands - 1)


def test_grams_in_the_same_sets_are_one_weighted_column():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 9])]
    rows = np.arange(3)
    assert jaccard.common(sets, rows, rows).tolist() == [[4, 3, 1], [3, 4, 1], [1, 1, 2]] or np.array_equal(jaccard.common(sets, rows, rows) * (1 - np.eye(3)), [[0, 3, 1], [3, 0, 1], [1, 1, 0]])


def test_likelihood_falls_and_thresholds_ascend():
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 3, 400)
    text, place, value = np.arange(400), grade * 7 + 5, np.ones(400)
    model = ordinal.fit(text, place, value, grade, 3)
    assert (np.diff(model.thresholds) > 0).all()
    p = model.probabilities(model.score(text, place, value, 400))
    assert ((p > 0.5).sum(1) == grade).mean() > 0.99 and (np.diff(p, axis=1) <= 0).all()


def test_rating_and_its_edges(spark, edges, empty):
    good = [(i, f"fine words number {i} stand here in good order", 2) for i in range(60)]
    bad = [(100 + i, f"awful{'!' * 3} words{'!' * 3} {i}!!!", i % 2) for i in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in good + bad] + [(1, None), (None, 0)], "doc_id long, grade int")
    model = ordinal.train(rows, ratings, 3)
    rated = {r["doc_id"]: r for r in ordinal.rate(rows, model).collect()}
    assert all(rated[i]["selected"] for i, _, _ in good) and not any(rated[i]["selected"] for i, _, _ in bad)
    assert all(0 <= r["expected_grade"] <= 2 for r in rated.values())
    assert ordinal.rate(edges, model).count() == edges.count() and ordinal.rate(empty, model).count() == 0
    nothing = ordinal.train(rows, ratings.limit(0), 3)
    assert all(r["selected"] for r in ordinal.rate(rows, nothing).collect())


def test_held_out_accuracy(spark):
    """Fitted on three quarters of the labelled documents, judged on the rest."""
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0").dropDuplicates(["doc_id"])
    from pyspark.sql import functions as F

    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    model = ordinal.train(docs, train.select("doc_id", grade.alias("grade")), 3)
    rated = ordinal.rate(docs, model).join(test, "doc_id").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    kept, wrong = (rated.where(c).count() for c in ("good", "good and not selected"))
    bad, missed = (rated.where(c).count() for c in ("not good", "not good and selected"))
    assert wrong <= 0.02 * kept and missed <= 0.1 * bad, (kept, wrong, bad, missed)


def test_queries_return_every_row(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert Q.op1_quality_classifier(spark, small).count() == n


def plain_features(text):
    """Occurrences of each feature of one text, and its words: what features() hashes to places."""
    found, words = Counter(), (text or "").split()
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w).encode()
    for i, word in enumerate(words):
        raw, low = word.encode(), lower(word)
        inner = len(raw) - 1 - (len(raw) > 2)
        found["word", low] += 1
        found["tail", tuple(low[max(len(low) - k, 0)] for k in (1, 2, 3))] += 1
        found["shape", i > 0 and lower(words[i - 1]) == low, len(raw) > 1 and raw[0] != low[0] and raw[inner] != low[inner]] += 1
        for n in ordinal.BEGINNINGS:
            if len(low) > n:
                found["beginning", low[:n]] += 1
    return found, len(words)


def text_features(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return ordinal.features(raw, np.array([0, len(raw)]))


def test_features_are_those_of_a_plain_count():
    """Places may collide, which adds occurrences up: their sum is exact, their number nearly."""
    for text in ("The the QUICK brown Foxes", "straße Straße ab a I NASA NASA", " ".join(f"word{i} Name{i % 3}" for i in range(40)), "x"):
        found, n = plain_features(text)
        _, place, value = text_features(text)
        times = (value * (3 + np.log(n))) ** 2
        assert times.sum() == pytest.approx(sum(found.values())) and len(found) - 3 <= len(place) <= len(found)
        assert np.sort(np.rint(times))[-1] >= max(found.values())


def test_rating_is_the_plain_formula(spark):
    rng = np.random.default_rng(3)
    model = ordinal.OrdinalModel(rng.normal(size=ordinal.SPACE).astype(np.float32), np.array([-0.4, 0.7]))
    texts = ["the quick brown fox", "", None, "Over the lazy dog, twice over", "x"]
    done = {r["doc_id"]: r for r in ordinal.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        _, place, value = text_features(text or "")
        score = sum(float(model.weights[p]) * v for p, v in zip(place.tolist(), value.tolist(), strict=True))
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds.tolist()]
        assert (done[i]["expected_grade"], done[i]["tail_probability"]) == (pytest.approx(sum(above)), pytest.approx(above[-1]))
        assert done[i]["selected"] == (above[-1] >= 0.5)


def test_the_first_step_goes_down_the_plain_gradient():
    """Adam's first step has the sign of minus the gradient, which differences of the plain likelihood give."""
    rng = np.random.default_rng(9)
    text, place, grade = np.repeat(np.arange(30), 4), rng.integers(0, 12, 120), rng.integers(0, 3, 30)
    value = rng.uniform(0.2, 1, 120)

    def loss(weights, steps):
        thresholds, total = [steps[0], steps[0] + np.exp(steps[1])], 0.0
        for i in range(30):
            score = sum(weights[p] * v for t, p, v in zip(text, place, value, strict=True) if t == i)
            above = [1.0, *(1 / (1 + np.exp(t - score)) for t in thresholds), 0.0]
            total -= np.log(above[grade[i]] - above[grade[i] + 1])
        return total / 30

    model, start, h = ordinal.fit(text, place, value, grade, 3, rounds=1), [-1.0, 0.0], 1e-5
    for p in range(12):
        up, down = np.zeros(12), np.zeros(12)
        up[p], down[p] = h, -h
        slope = (loss(up, start) - loss(down, start)) / (2 * h)
        assert np.sign(model.weights[p]) == -np.sign(slope) and abs(model.weights[p]) == pytest.approx(0.3, rel=1e-3)
    slopes = [(loss(np.zeros(12), [a + h * (k == 0) for k, a in enumerate(start)]) - loss(np.zeros(12), [a - h * (k == 0) for k, a in enumerate(start)])) / (2 * h)]
    assert np.sign(model.thresholds[0] + 1) == -np.sign(slopes[0])
