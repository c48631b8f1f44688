"""The quality classifier's parts and its scores, against brute force over plain dictionaries and a dense solver."""

import math
import random
import zlib

import numpy as np
import pytest

from strandline.llm import quality
from strandline.llm.common import mixed


def grams(text):
    """Each hashed n-gram of a text, one at a time."""
    data, out = text.encode(), set()
    for n in quality.GRAMS:
        for i in range(len(data) - n + 1):
            code = int.from_bytes(bytes([n]) + data[i : i + n], "big") % 2**64
            out.add(int(mixed(np.array([code], dtype=np.uint64))[0]) >> (64 - quality.BITS))
    return out


def ratios(pairs, smooth=1.0):
    """{feature: log-count ratio} and that of a feature that no text has."""
    n = [sum(y == k for _, y in pairs) for k in (0, 1)]
    counts = {}
    for text, y in pairs:
        for f in grams(text):
            counts.setdefault(f, [0, 0])[y] += 1
    def value(bad, good):
        return math.log((good + smooth) / (n[1] + 2 * smooth)) - math.log((bad + smooth) / (n[0] + 2 * smooth))
    return {f: value(*c) for f, c in counts.items()}, value(0, 0)


def solved(x, y, limit):
    """The dual of the hinge loss with a bias as one more feature, by projected gradients over all documents at once."""
    one = np.hstack([x, np.ones((len(x), 1))]) * y[:, None]
    gram = one @ one.T
    step, alpha = 1 / np.linalg.eigvalsh(gram)[-1], np.zeros(len(y))
    for _ in range(100_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, limit)
    return one.T @ alpha


def primal(w, x, y, limit):
    return 0.5 * w @ w + (limit * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()


@pytest.fixture(scope="module")
def labelled_texts():
    rng = random.Random(3)
    good, bad, both = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(25)] for letters in ("aeiounrst", "xqzjkwvby", "lmdhgcfpe"))
    rows = []
    for i in range(60):
        y = int(i % 3 != 0)
        words = rng.choices(good if y else bad, k=rng.randint(1, 12)) + rng.choices(both, k=12) + rng.choices(bad if y else good, k=3)
        rng.shuffle(words)
        rows.append((i, " ".join(words), y))
    return rows + [(60, "", 0), (61, "é😀 " * 30, 1), (62, "ab", 1)]


def trained_on(rows):
    return [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]


@pytest.mark.parametrize("text", ["", "ab", "abc", "abcde", "naïve 😀 words", "word " * 40])
def test_features_are_all_ngrams(text):
    assert quality.features(text).tolist() == sorted(grams(text))


def test_features_across_stretches():
    text = "".join(random.Random(1).choices("abcdefgh ", k=(1 << 18) + 300))
    whole = set(quality.features(text).tolist())
    edge = (1 << 18) - 20
    assert grams(text[edge : edge + 60]) <= whole and grams(text[-50:]) <= whole


def test_log_count_ratios(spark, labelled_texts):
    pairs = trained_on(labelled_texts)
    got = quality.log_count_ratios(spark.createDataFrame([*pairs, (None, 0)], "text string, y int").repartition(3), 1.0)
    want, other = ratios([*pairs, ("", 0)])
    assert np.allclose([got[f] for f in want], list(want.values()), atol=1e-12)
    unseen = np.setdiff1d(np.arange(len(got)), list(want))
    assert np.allclose(got[unseen], other, atol=1e-12)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(40)]
    rows[7] = np.array([], dtype=np.int64)
    y = np.where(rng.random(40) < 0.3, -1.0, 1.0)
    r = rng.normal(size=30)
    x = np.zeros((40, 30))
    for i, f in enumerate(rows):
        x[i, f] = r[f] / max(1e-9, np.sqrt((r[f] ** 2).sum()))
    good = (y > 0).sum()
    for c in (0.1, 1.0):
        limit = np.where(y > 0, c * 40 / (2 * good), c * 40 / (2 * (40 - good)))
        best = primal(solved(x, y, limit), x, y, limit)
        w, bias = quality.descend(rows, y, r, c, 3000, 1)
        assert best - 1e-6 <= primal(np.append(w, bias), x, y, limit) <= best * 1.01 + 1e-3


def test_calibration_is_the_least_loss():
    rng = np.random.default_rng(2)
    y = np.where(rng.random(300) < 0.6, 1.0, -1.0)
    margin = y * 0.4 + rng.normal(size=300)
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(a, b):
        z = a * margin + b
        return (np.logaddexp(0, z) - target * z).sum() + 5e-4 * ((a - 1) ** 2 + b * b)

    a, b = quality.calibrated(margin, y)
    near = [loss(a + p, b + q) for p in np.linspace(-0.5, 0.5, 41) for q in np.linspace(-0.5, 0.5, 41)]
    assert a > 0.1 and loss(a, b) <= min(near) + 1e-9


def test_scores_against_a_dense_model(spark, labelled_texts):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled_texts], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled_texts], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels, epochs=3000).collect()}
    pairs = trained_on(labelled_texts)
    r, _ = ratios(pairs)
    names = {f: k for k, f in enumerate(sorted(r))}

    def row(text):
        v = np.zeros(len(names))
        for f in grams(text) & names.keys():
            v[names[f]] = r[f]
        return v / max(1e-9, np.sqrt((v**2).sum()))

    x, y = np.array([row(t) for t, _ in pairs]), np.array([1.0 if y else -1.0 for _, y in pairs])
    good = (y > 0).sum()
    w = solved(x, y, np.where(y > 0, len(y) / (2 * good), len(y) / (2 * (len(y) - good))))
    a, b = quality.calibrated(x @ w[:-1] + w[-1], y)
    seen = [i for i, t, _ in labelled_texts if zlib.crc32(str(i).encode()) % 4 != 2]
    assert [i for i in got if not got[i].held_out] and {i for i in got if not got[i].held_out} == set(seen)
    # Texts that training saw have no other features; their scores are those of the dense model up to the descent's end.
    for i, t, _ in labelled_texts:
        if i in seen:
            assert abs(got[i].score - 1 / (1 + math.exp(-(a * (row(t) @ w[:-1] + w[-1]) + b)))) < 0.03
        assert got[i].predicted == int(got[i].score >= 0.7)
