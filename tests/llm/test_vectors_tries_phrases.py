"""Embedding links, the conversation trie and collocations against brute force, on the small tables and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import collocations, tries, vectors

VECTORS, TURNS, TEXTS = "vec_id long, embedding array<double>, label int", "conv_id long, turn long, role string, text string", "doc_id long, text string, lang string"


def linked_by_all_pairs(rows, threshold=0.98):
    def cosine(x, y):
        return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x)) / math.sqrt(sum(b * b for b in y))

    fine = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    near = [[i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold for j in range(len(rows))] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(len(rows)) if near[k][j] and j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], sum(near[i]), least, rows[i][0] == least))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_links_of_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert in_order(vectors.near_vectors(table, 0.5).collect()) == in_order(linked_by_all_pairs([tuple(r) for r in table.collect()], 0.5))


def test_links_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    centre = [rng.gauss(0, 1) for _ in range(12)]
    dense = [[c + rng.gauss(0, 0.12) for c in centre] for _ in range(60)]
    rows = [(100 + i, v, 7) for i, v in enumerate(dense)] + [(300 + i, dense[0], 7) for i in range(20)]
    rows += [(1, None, 7), (2, [], 7), (3, [0.0, -0.0], 7), (4, [nan, 1.0], 7), (5, [inf, 1.0], 7), (6, [None, 1.0], 7), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 7), (9, [1.0, 2.0], 8), (10, [2e200, 4e200], 7), (11, [1e-200, 2e-200], 7)]
    rows += [(None, [1.0, 2.0], 7), (None, [5.0, -1.0], 9), (12, [3.0], 7), (12, [4.0], 7), (12, [4.0], 7)]
    want = [r if r[0] not in (8, 10, 11) and r != (None, 3, 8, False) else r for r in linked_by_all_pairs([(i, v if v is None or not v or i not in (10, 11) else [1.0, 2.0], label) for i, v, label in rows])]
    got = vectors.near_vectors(spark.createDataFrame(rows, VECTORS), tile_rows=16)
    fixed = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in want]
    assert in_order(got.collect()) == in_order(fixed)


def test_links_of_no_vectors_and_more_columns(spark):
    rows = [(1, [1.0, 0.0], 1, 5, 5), (2, [1.0, 0.01], 1, 5, 5)]
    more = spark.createDataFrame(rows, VECTORS + ", node long, root long")
    assert in_order(vectors.near_vectors(more).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert vectors.near_vectors(more.where("false")).count() == 0
    with pytest.raises(ValueError):
        vectors.near_vectors(more, 1.5)


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(3)
    x = vectors.unit(rng.normal(size=(200, 70)) + 3 * rng.normal(size=70))
    directions = np.linalg.qr(rng.normal(size=(70, 70)))[0][:64]
    for threshold in (0.6, 0.9, 0.98):
        i, j = vectors.linked(x, x, ~np.eye(200, dtype=bool), directions, threshold, block=97)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in itertools.permutations(range(200), 2) if x[a] @ x[b] >= threshold}


def trie_by_sets(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v, key=lambda r: r[:2])] for c, v in convs.items()}
    path = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in ids if len(path[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        up = min(members[p[:-1]]) if p else None
        out.append((min(ids), len(p), up, len(ids), len(children[p]), sum(not children[q] for q in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def test_trie_of_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert in_order(tries.conversation_trie(table).collect()) == in_order(trie_by_sets([tuple(r) for r in table.collect()]))


def test_trie_of_copies_and_odd_rows(spark):
    rng = random.Random(9)
    rows = [(c, t, "user", f"{'é' * rng.randint(0, 3)}{rng.randint(0, 1)}") for c in range(700) for t in range(rng.randint(1, 14))]
    rows += [(5000 + c, t, "user", "the same") for c in range(300) for t in range(3)]
    rows += [(9000, None, None, None), (9000, 1, "", ""), (9001, 0, "user", None), (None, 1, "user", "nobody"), (9002, 3, "a", "bc"), (9004, 3, "ab", "c"), (9006, 0, "user", "x" * 5000)]
    rows += [(9015, t, "user", f"long {t}") for t in range(150)] + [(9020, t, "user", f"long {t}") for t in range(149)]
    got = tries.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert in_order(got.collect()) == in_order(trie_by_sets(rows))


def test_trie_of_no_rows_and_more_columns(spark):
    more = spark.createDataFrame([(5, 0, "user", "a", 1, "k")], TURNS + ", key long, node string")
    assert tries.conversation_trie(more.where("false")).count() == 0
    assert [r["depth"] for r in tries.conversation_trie(more).orderBy("depth").collect()] == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=4), min_size=1, max_size=120), st.integers(1, 7))
def test_chunks_of_a_trie_add_up(seqs, n_chunks):
    names = [hashlib.sha256(str(x).encode()).digest()[: tries.WIDTH] for x in range(301)]
    keys = sorted({b"".join(names[x] for x in s) for s in seqs})
    size = {names[x]: x for x in range(301)}
    sizes = [[size[k[i : i + tries.WIDTH]] for i in range(0, len(k), tries.WIDTH)] for k in keys]
    counts = [i % 3 + 1 for i in range(len(keys))]

    def total(cuts):
        sums = {}
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                got = tries.chunk_nodes(keys[a:b], counts[a:b], list(range(a, b)), sizes[a:b], keys[a - 1] if a else None, keys[b] if b < len(keys) else None)
                for node, parent, depth, *adds, least in zip(*got.values()):
                    old = sums.get(node, (parent, depth, [0] * 4, least))
                    sums[node] = (parent, depth, [x + y for x, y in zip(old[2], adds)], min(old[3], least))
        return sums

    assert total([0, *sorted(i * len(keys) // n_chunks for i in range(1, n_chunks)), len(keys)]) == total([0, len(keys)])


def test_layouts_of_nodes_grow():
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        root = tries.Node(b"")
        order = list(range(n))
        random.Random(n).shuffle(order)
        for x in order:
            tries.insert(root, bytes((x,)) + b"tail", x)
        assert [b for b, _ in root.children()] == sorted(order)
        assert [root.child(x).end for x in range(n)] == list(range(n)) and root.child(255) is (None if n < 256 else root.child(255))
        assert root.layout() == next(k for k in (4, 16, 48, 256) if n <= k)


def phrases_by_counting(rows, least, top):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in counts.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in some.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * some[p[i : i + m]]}
        best = []
        for p in some.keys() - gone:
            score, k = min((2000000 * some[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -some[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return out


def test_phrases_of_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in table.collect()]
    for least, top in ((30, 2000), (8, 50)):
        assert in_order(collocations.collocations(table, least, top).collect()) == in_order(phrases_by_counting(rows, least, top))


def test_phrases_of_odd_rows(spark):
    rng = random.Random(2)
    words = ["a", "b", "a", "Ä", "ß", "c\x00", "\x01", "日本", "-", "A"]
    ends = [" ", "  ", "\t", " ", " ", ". ", "\n", ";x", "\r"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40))), rng.choice(["en", None, "und", ""])) for i in range(300)]
    rows += [(1, None, "en"), (1, "", None), (2, " . ", "en"), (3, "b" * 100000 + " a", "en"), (3, "a b c d e " * 3000, "zz")] + [(4, "hot phrase here now", "hot")] * 500
    table = spark.createDataFrame(rows, TEXTS)
    for least, top in ((5, 2000), (1, 40)):
        assert in_order(collocations.collocations(table, least, top).collect()) == in_order(phrases_by_counting(rows, least, top))


def test_phrases_of_no_rows_and_more_columns(spark):
    more = spark.createDataFrame([(1, "x y " * 40, "en", "z", 3)], TEXTS + ", phrase string, f long")
    assert collocations.collocations(more.where("false")).count() == 0
    assert collocations.collocations(more).first()["phrase"]
