"""Near-duplicates of dense groups: no link is lost, and groups make few pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import simhash

WORDS = [f"w{i}" for i in range(400)]


def kept(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, **more).collect())


def test_texts_of_one_fingerprint_are_all_compared(spark):
    """Two alike texts beside one of the same words in another order, whichever comes first."""
    rng = random.Random(1)
    words = WORDS[:380]
    near = words[:-1] + ["other"]
    for order in range(3):
        mixed = rng.sample(words, len(words))
        texts = [" ".join(words), " ".join(near)]
        texts.insert(order, " ".join(mixed))
        assert len(kept(spark, texts)) == 2
        assert len(kept(spark, texts[:order] + texts[order + 1 :])) == 1


def union(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


@pytest.mark.parametrize("changed", [0.004, 0.012, 0.03])
def test_components_of_a_dense_group(spark, changed):
    """Copies of one text with words changed, most pairs near the threshold, against all pairs."""
    rng = random.Random(7)
    base = [rng.choice(WORDS) for _ in range(160)]
    texts = sorted({" ".join(rng.choice(WORDS) if rng.random() < changed else w for w in base) for _ in range(90)} | {" ".join(rng.sample(base, len(base))) for _ in range(5)})
    prints = [simhash.word_prints(t, 4) for t in texts]
    sets = [set(simhash.sketch(t, 5, 192).tolist()) for t in texts]

    def alike(i, j):
        near = any((x ^ y) & (2**64 - 1) == 0 or bin((x ^ y) & (2**64 - 1)).count("1") <= 4 for x, y in zip(prints[i], prints[j]))
        return near and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j)])
    assert kept(spark, texts) == sorted({1 + i for i in want})


def test_a_joined_ball_makes_no_pairs(spark):
    """A ball of fingerprints around one: components as by all pairs, links far fewer."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    ball = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [simhash.signed(x) for x in ball]
    prints = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "id long, fp long")
    got = {r.id: r.component_id for r in simhash.components(prints).collect()}
    links = [(i, j) for i in range(len(ball)) for j in range(i) if bin(ball[i] ^ ball[j]).count("1") <= 4]
    assert [got[i] for i in range(len(ball))] == union(len(ball), links)
    stars = simhash.star_pairs(simhash.coarse_cells(prints.select(F.col("fp").alias("node"), F.array("fp").alias("fps")))).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 4)
    assert stars.count() < len(links) / 20


def test_bounds_say_yes_to_what_is_not_known(spark):
    row = spark.sql("select cast(100 as short) as n_u, cast(30 as short) as lone_u, cast(null as short) as n_v, cast(null as short) as lone_v")
    ok = simhash.could_be_alike(192, 0.8)
    assert row.select(ok.alias("x")).first().x is True
    rows = [(100, 30, 100, 0, False), (100, 10, 100, 10, True), (100, 12, 100, 0, False), (100, 12, 88, 0, True), (192, 39, 192, 0, False), (192, 38, 192, 0, True)]
    got = spark.createDataFrame(rows, "n_u int, lone_u int, n_v int, lone_v int, want boolean").select(ok.alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_marks_leave_alike_texts_alone_and_few_others(spark):
    """A ball of sketches around one: every pair that is alike may be so by its marks, and few of those that are not."""
    rng = random.Random(5)
    centre = rng.sample(range(1 << 31), 90)
    sets = [sorted(set(rng.sample(centre, rng.randint(70, 90)) + rng.sample(range(1 << 31), rng.randint(0, 8)))) for _ in range(60)] + [[], [], centre[:1]]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "th long, sk array<int>")
    one, two = (simhash.marks(texts).join(texts, "th").select(*(F.col(x).alias(f"{x}_{c}") for x in ("th", "size", "marks", "sk"))) for c in "uv")
    pairs = one.join(two, F.col("th_u") < F.col("th_v"))
    got = pairs.select((simhash.likeness(F.col("sk_u"), F.col("sk_v"), 192) >= 0.8).alias("alike"), simhash.alike_by_marks(192, 0.8).alias("maybe")).collect()
    unlike = [r.maybe for r in got if not r.alike]
    assert any(r.alike for r in got) and all(r.maybe for r in got if r.alike) and sum(unlike) < len(unlike) / 4


def test_a_dense_group_of_unlike_texts_makes_few_links(spark, monkeypatch):
    """Texts of nearly the same words, each with two words changed and two in another order: fingerprints are near, texts mostly are not. Components as by all pairs, few links of fingerprints."""
    rng = random.Random(11)
    base = rng.sample(WORDS, 160)

    def moved(words):
        i = rng.randrange(len(words) - 1)
        return words[:i] + [words[i + 1], words[i]] + words[i + 2 :]

    def other(words):
        i = rng.randrange(len(words))
        return words[:i] + [rng.choice(WORDS)] + words[i + 1 :]

    texts = [moved(other(other(base))) for _ in range(110)]
    texts += [moved(t) for t in texts[:15]] + [rng.sample(base, len(base)) for _ in range(5)]
    texts = sorted({" ".join(t) for t in texts})
    prints = [simhash.word_prints(t, 4) for t in texts]
    sets = [set(simhash.sketch(t, 5, 192).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if any(bin((x ^ y) & (2**64 - 1)).count("1") <= 4 for x, y in zip(prints[i], prints[j]))]
    alike = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    made, settle = {}, simhash.settle

    def counted(df, name):
        out = settle(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "settle", counted)
    assert kept(spark, texts) == sorted({1 + i for i in union(len(texts), alike)})
    assert 0 < len(alike) < len(near) / 10
    # Links of fingerprints come once for each of the four that are near.
    assert made["fingerprint-links"] < len(near) / 4
