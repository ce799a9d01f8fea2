import random
import re
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import decontaminate as d


def grams(text, width=5):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    width = min(width, len(words))
    return len(words), [tuple(words[i:i + width]) for i in range(len(words) - width + 1)] if words else []


def plain(docs, items):
    out = {}
    for doc, text in docs:
        n, own = grams(text)
        for item, wanted in items:
            size, want = grams(wanted)
            best = 0.0
            for start in range(max(1, len(own) - len(want) + 1)) if own and want and min(n, 5) == min(size, 5) else ():
                window = own[start:start + len(want)]
                common = sum((Counter(window) & Counter(want)).values())
                best = max(best, common / (len(window) + len(want) - common))
            if own and want and n >= size and min(size, 5) < 5:  # a short item is one shingle of its own width
                best = max([best, *(1.0 for i in range(n - size + 1) if grams(" ".join(text.split()[i:i + size]))[1] == want)])
            if best >= 0.8:
                out[doc, item] = best
    return out


@pytest.fixture
def case():
    dice = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["the"] * 60
    text = lambda n: [dice.choice(vocabulary) for _ in range(n)]
    items = [(i, text(dice.choice([3, 5, 20, 40, 60]))) for i in range(30)]
    items += [(30, ["same"] * 20), (31, items[5][1])]
    docs = []
    for i in range(150):
        words = text(dice.randint(0, 120))
        for _ in range(dice.randint(0, 2)):
            leak = list(dice.choice(items)[1])
            for _ in range(dice.choice([0, 0, 1, 3])):
                leak[dice.randrange(len(leak))] = "EDIT"
            at = dice.randint(0, len(words))
            words[at:at] = leak if dice.random() < 0.8 else leak[: len(leak) // 2]
        docs.append((i, " ".join(words).replace("w1", "W1")))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_agrees_with_brute_force(spark, docs_of, case, monkeypatch):
    docs, items = case
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    want = plain(docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(spark, docs_of(docs), bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)  # edits may carry a fingerprint out of the radius
    assert all(abs(got[k]["similarity"] - want[k]) < 1e-9 for k in got)
    assert {k for k, v in want.items() if v == 1.0} <= set(got)
    monkeypatch.setattr(d, "ITEMS_AT_ONCE", 7)
    again = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(spark, docs_of(docs), bench).collect()}
    assert again == set(got)
    clean = {r["doc_id"] for r in d.drop_leaks(spark, docs_of(docs), bench).collect()}
    assert clean == {i for i, _ in docs} - {doc for doc, _ in got}


def test_index_finds_all_within_the_radius():
    dice = np.random.default_rng(1)
    prints = dice.integers(0, 2**63, 40, dtype=np.uint64)
    queries = []
    for p in prints:
        for flips in range(0, 20):
            bits = dice.choice(64, flips, replace=False)
            queries.append(p ^ np.uint64(sum(1 << int(b) for b in bits)))
    queries = np.array(queries, np.uint64)
    q, i, n = d.HammingIndex(prints).within(queries)
    distance = np.bitwise_count(queries[:, None] ^ prints[None, :])
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= d.RADIUS))))
    assert (distance[q, i] == n).all()


def test_edges(spark, docs_of, edge_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "no id at all"), (4, "tail")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in d.find_leaks(spark, edge_docs.where("doc_id is not null"), bench).collect())
    assert got == [(4, 3), (5, 3), (7, 4), (7, 4)]
    assert d.drop_leaks(spark, edge_docs, bench).count() == 7
    assert d.drop_leaks(spark, edge_docs, bench.limit(0)).count() == 12
    assert d.find_leaks(spark, edge_docs, bench.limit(0)).count() == 0
    assert d.find_leaks(spark, edge_docs.limit(0), bench).count() == 0
