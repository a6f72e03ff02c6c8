"""Toxicity, periodic runs and centroid clusters against brute force and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests_support import compare, connect

from tallyspark.llm import centroids, periodic_runs, queries, toxicity
from tallyspark.llm.words import mix

SMALL = "/root/testdata/sf0.001"


def runs_by_hand(words):
    """Every lag compared with every place; the smallest period of each stretch."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        start = None
        for i in range(len(words) - period + 1):
            same = i < len(words) - period and words[i] == words[i + period]
            if same and start is None:
                start = i
            elif not same and start is not None:
                if i - start + period >= max(12, 2 * period):
                    found.setdefault((start, i + period), period)
                start = None
    return sorted((start, end, period) for (start, end), period in found.items())


def odd_sequence(rng):
    kind, size = rng.randrange(6), rng.randrange(1, 500)
    if kind == 0:
        return [rng.randrange(2) for _ in range(size)]
    if kind == 1:  # Fibonacci word
        a, b = [0], [0, 1]
        while len(b) < size:
            a, b = b, b + a
        return b[:size]
    if kind == 2:  # powers of random blocks
        out = []
        while len(out) < size:
            out += [rng.randrange(3) for _ in range(rng.randrange(1, 60))] * rng.randrange(1, 5)
        return out
    if kind == 3:  # long short-period stretches that touch
        out = []
        while len(out) < size:
            out += [0, 0, 1] * rng.choice([10, 20, 20, 21]) + [0, 0, 1][: rng.randrange(3)]
        return out
    if kind == 4:  # powers of powers
        block = [rng.randrange(2) for _ in range(5)]
        for _ in range(3):
            block = block * rng.randrange(1, 4) + [rng.randrange(3)] * rng.randrange(3)
        return (block * 3)[:900]
    return [0] * size


@pytest.mark.parametrize("seed", range(3))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = sorted((odd_sequence(rng) for _ in range(rng.randrange(1, 4))), key=len, reverse=True)
        sizes = np.array([len(t) for t in texts])
        runs = periodic_runs.find_runs(mix(np.concatenate(texts).astype(np.uint64) + np.uint64(9)), sizes)
        want, at = [], 0
        for text in texts:
            want += [(s + at, e + at, p) for s, e, p in runs_by_hand(text)]
            at += len(text)
        assert sorted(zip(runs.start.tolist(), runs.end.tolist(), runs.period.tolist())) == sorted(want)


def described(doc_id, text, plant=True):
    """The contract of the query, word by word."""
    words = text.split() if text else []
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and n and h % 10 == 0:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    runs = runs_by_hand(words)
    dropped = {i for s, e, p in runs for i in range(s + p, e)}
    listed = sorted((s, e - s, p) for s, e, p in runs)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    return (
        doc_id, n, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else [None] * 4),
        hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in listed).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(), len(dropped),
    )


def test_runs_of_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}é" for x in odd_sequence(rng))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "a b " * 30), (104, "a b " * 30), (None, "x " * 40)]
    frame = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, id int, period string")
    for plant in (False, True):
        got = [tuple(r) for r in periodic_runs.describe_runs(frame, plant=plant).collect()]
        assert collections.Counter(got) == collections.Counter(described(i, t, plant) for i, t in rows)
    listed = periodic_runs.list_runs(frame).filter("doc_id = 104").collect()
    assert [tuple(r) for r in listed] == [(104, 0, 60, 2)] * 2
    assert periodic_runs.describe_runs(frame.limit(0)).collect() == []


def test_runs_of_a_long_text(spark):
    rng = random.Random(6)
    block = [rng.randrange(1000) for _ in range(7_000)]
    words = [rng.randrange(1000) for _ in range(5_000)] + block * 3 + [0] * 30_000 + ["end"]
    frame = spark.createDataFrame([(1, " ".join(map(str, words)))], "doc_id long, text string")
    found = {(r.start, r.length, r.period) for r in periodic_runs.list_runs(frame).collect()}
    assert any(p == 7_000 and n >= 21_000 for _, n, p in found) and any(p == 1 and n >= 30_000 for _, n, p in found)


def test_noisy_or_gradient():
    """Loss by the definition, gradient by differences."""
    texts = pa.array(["Bad idiot. Fine day!\nidiots", "fine day. Nothing here", "", "bad. bad bad\n\nbad"])
    labels = np.array([1, 0, 0, 1])
    words = toxicity.words_of(toxicity._lowered(pa.array(["bad idiot fine day"])), toxicity._LETTER)
    features = np.sort(words.hashes)
    bags = toxicity.make_bags(texts, features)
    assert bags.sentence_text.tolist() == [0, 0, 0, 1, 1, 3, 3, 3] and bags.sentence_number.tolist() == [0, 1, 3, 0, 1, 0, 1, 3]
    theta = np.array([0.3, -0.2, 0.9, 0.4, -1.0, -2.0])

    def loss(theta):
        total = 0.0
        for text in range(4):
            missed = 1 - 1 / (1 + math.exp(-theta[-1]))
            for sentence in np.flatnonzero(bags.sentence_text == text):
                z = theta[-2] + sum(theta[f] for s, f in zip(bags.entry_sentence, bags.entry_feature) if s == sentence)
                missed *= 1 - 1 / (1 + math.exp(-z))
            total -= math.log(1 - missed if labels[text] else missed)
        return total

    got, gradient = toxicity.loss_and_gradient(bags, labels, theta)
    assert got == pytest.approx(loss(theta))
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, rel=1e-4, abs=1e-6)


def toxic_corpus(rng, n):
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.15
        lines = [[rng.choice(plain) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 20))]
        if toxic:
            rng.choice(lines).append(rng.choice(["nasty", "vile"]) + rng.choice(["", "ness", "ling", "!"]))
        rows.append((i, ". ".join(" ".join(x) for x in lines), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus(random.Random(8), 900)
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t, _ in rows], "doc_id long, text string, label int, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = [(2000, None), (2001, ""), (2002, "..!\n?"), (2003, "Vile-Sorts are NASTY. abc"), (2003, "Vile-Sorts are NASTY. abc"), (None, "abc " * 50_000)]
    found = toxicity.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")), model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    held = [(y, by_id[i].score >= 0.5) for i, _, y in rows if i % 3 == 0]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.02 * len(held)
    leak = 1 / (1 + math.exp(-model.leak))
    assert all(by_id[i].score == pytest.approx(leak) for i in (2000, 2001, 2002))
    for i, text, toxic in rows:
        for s in by_id[i].sentences if toxic and by_id[i].score >= 0.5 else []:
            if s.score >= 0.5:
                assert any(w in text[s.start : s.end] for w in ("nasty", "vile"))
    assert [(s.number, "Vile-Sorts are NASTY. abc"[s.start : s.end]) for s in by_id[2003].sentences] == [(0, "Vile-Sorts are NASTY.")]
    again = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {r.doc_id: r.score for r in again} == {i: by_id[i].score for i, _, _ in rows}


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for given, score in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (1, 0)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [score, score]
    assert toxicity.score(docs.limit(0), model).collect() == []


def clusters_by_hand(vectors, size=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [q for _, q in first[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, q in kept:
            members[nearest(q)[1]].append(q)
        at = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(at)]
    return collections.Counter((i, *reversed(nearest(q)), hashlib.sha256(",".join(map(str, at[nearest(q)[1]])).encode()).hexdigest()) for i, q in kept)


def test_centroids(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in np.float32(rng.normal(size=64) + rng.integers(0, 4))]) for i in range(120)]
    vectors += [(5, vectors[5][1]), (None, vectors[6][1]), (200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63)]
    vectors += [(204, [float("nan")] + [1.0] * 63), (205, [float("inf")] * 64), (206, vectors[7][1]), (207, vectors[7][1])]
    for rows in (vectors, vectors[:7], [v for v in vectors if v[0] == 200], []):
        frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, q string")
        got = centroids.with_inertia(centroids.cluster(frame)).collect()
        want = clusters_by_hand(rows)
        assert collections.Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == want
        for r in got:
            assert r.inertia == sum(x.distance for x in got)
            assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster)


def test_centroids_by_sql(spark):
    assert compare(queries.QUERIES["op13_centroids"](spark, SMALL), connect(SMALL), queries.ORACLES["op13_centroids"]) == ""
