import random
import re

import numpy as np
import pytest
import xxhash

from tallygrid.llm import simhash


def plain_print(text, width):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(docs, width=3, radius=3):
    prints = [(d, plain_print(t, width)) for d, t in docs]
    heads = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a[1] ^ prints[j][1]).bit_count() <= radius and heads[i] != heads[j]:
                heads = [heads[i] if h == heads[j] else h for h in heads]
    smallest = {}
    for (d, _), h in zip(prints, heads):
        if d is not None:
            smallest[h] = min(smallest.get(h, d), d)
    return sorted(((d, f"{p:016x}", smallest.get(h)) for (d, p), h in zip(prints, heads)), key=str)


def run(spark, frame, **more):
    return sorted((tuple(r) for r in simhash.near_duplicates(spark, frame, **more).collect()), key=str)


@pytest.fixture
def docs():
    dice = random.Random(5)
    words = [f"W{i}" for i in range(300)]
    docs = []
    for _ in range(10):
        base = [dice.choice(words) for _ in range(dice.choice([1, 2, 5, 300, 800]))]
        for _ in range(dice.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(dice.randint(0, 4)):
                copy[dice.randrange(len(copy))] = dice.choice(words)
            docs.append((dice.randrange(10**9), dice.choice([" ", "\n", " \t"]).join(copy)))
    return docs


@pytest.mark.parametrize("radius", [3, 6])
@pytest.mark.parametrize("rows", [1024, 2])
def test_agrees_with_brute_force(spark, docs_of, docs, radius, rows, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    got = run(spark, docs_of(docs), radius=radius)
    assert got == plain(docs, radius=radius)
    assert 1 < len({r[2] for r in got}) < len(got)


def test_edges(spark, docs_of, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert run(spark, edge_docs) == plain(rows)
    by = {r[0]: r for r in run(spark, edge_docs)}
    assert by[3] == (3, "0" * 16, 1) and by[None][2] in (1, None)
    assert by[5][2] == 4 and simhash.near_duplicates(spark, docs_of([])).count() == 0
    twice = [(1, "a b c d"), (1, "quite another text here"), (1, "a b c d")]  # one id, unlike texts
    assert run(spark, docs_of(twice)) == plain(twice)


def test_texts_are_cut_without_losing_shingles(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(500))
    whole = simhash.fingerprint(text.encode(), 3)
    for step in (1, 7, 100):
        monkeypatch.setattr(simhash, "TEXT_STEP", step)
        assert simhash.fingerprint(text.encode(), 3) == whole == plain_print(text, 3)


def test_close_pairs_match_distances():
    dice = np.random.default_rng(3)
    prints = dice.integers(0, 2**64, 130, dtype=np.uint64)
    prints[65:] = prints[:65] ^ (np.uint64(1) << dice.integers(0, 64, 65, dtype=np.uint64))
    prints = np.unique(prints)
    distance = np.bitwise_count(prints[:, None] ^ prints[None, :])
    for radius in (0, 1, 2, 3, 4, 7, 25):
        for order in (range(64), range(63, -1, -1)):
            i, j = simhash.close_pairs(prints, radius, list(order))
            assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in np.argwhere(np.triu(distance <= radius, 1)).tolist()]


def test_every_near_pair_shares_a_bucket(spark):
    dice = random.Random(1)
    rows = []
    for n in range(200):
        a = dice.getrandbits(64)
        b = a
        for bit in dice.sample(range(64), 3):
            b ^= 1 << bit
        rows += [(n, x - (1 << 64) if x >> 63 else x) for x in (a, b)]
    keys = spark.createDataFrame(rows, "n int, fp long").select("n", "fp", simhash.bucket_keys(3).alias("k"))
    assert keys.count() == 4000
    shared = keys.groupBy("n", "k").count().where("count > 1").select("n").distinct().count()
    assert shared == 200
