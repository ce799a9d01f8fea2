import random
import re

import numpy as np
import pytest

from tallygrid.llm import minhash


def shingles(text, width):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def plain(docs, width, percent=80):
    sets = {d: shingles(t, width) for d, t in docs}
    name = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                one, two = sorted((name[a], name[b]))
                name = {d: one if n == two else n for d, n in name.items()}
    return {(d, len(sets[d]), name[d], name[d] == d) for d in ids}


def run(spark, frame, width):
    return {tuple(r) for r in minhash.near_duplicates(spark, frame, width=width).collect()}


@pytest.fixture
def docs():
    dice = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(12):
        words = [dice.choice(vocabulary) for _ in range(dice.choice([3, 12, 60, 200]))]
        for _ in range(dice.choice([1, 4, 25])):
            copy = list(words)
            for _ in range(dice.randint(0, max(1, len(copy) // 12))):
                copy[dice.randrange(len(copy))] = dice.choice(vocabulary)
            docs.append((dice.randrange(10**9), " ".join(copy)))
    # a chain whose ends are not alike, and edited copies in a ring
    words = [f"c{i}" for i in range(100)]
    for i in range(30):
        docs.append((5 + i, " ".join(words[i * 5 % 60:] + words[:i * 5 % 60] if i % 2 else words[:70 + i])))
    return list({d: (d, t) for d, t in docs}.values())


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("block", [1024, 3])
def test_agrees_with_brute_force(spark, docs_of, docs, width, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    assert run(spark, docs_of(docs), width) == plain(docs, width)


def test_edges(spark, docs_of, edge_docs):
    got = [tuple(r) for r in minhash.near_duplicates(spark, edge_docs, width=2).collect()]
    assert len(got) == 12
    by = {r[0]: r for r in got}
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True)
    assert by[4] == (4, 1, 4, True) and by[5] == (5, 1, 4, False)
    assert by[7][2] == 6 and not by[7][3]
    assert sum(r[0] is None and r[2] is None and r[3] for r in got) == 2
    assert minhash.near_duplicates(spark, docs_of([])).count() == 0
    mixed = [(1, "Éa ÉB c"), (2, "Éa Éb c"), (3, "éa Éb c"), (4, "Éa Éb c")]  # only A-Z fold; a no-break space is no blank
    assert run(spark, docs_of(mixed), 2) == plain(mixed, 2)


def test_coordinates_estimate_similarity():
    dice = np.random.default_rng(2)
    a = dice.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], dice.integers(0, 2**63, 200, dtype=np.uint64)])
    equal = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(equal - 800 / 1200) < 0.12
    table = minhash.second_permutation()
    slot = int((minhash.mix(a[:1] ^ np.uint64(minhash.SEED)) & np.uint64(minhash.RING - 1))[0])
    assert list(minhash.signature(a[:1])) == [table[slot + k] for k in range(minhash.BANDS * minhash.ROWS)]
