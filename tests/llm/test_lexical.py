import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import lexical


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, []).extend(terms(text))
    for item, words in asked.items():
        scores = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, score string, term int")


@pytest.fixture
def docs():
    dice = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "日本", "x9"]
    docs = [(dice.randrange(10**6), dice.choice([" ", ", ", "-\n"]).join(dice.choices(words, [1 / (i + 1) for i in range(len(words))], k=dice.choice([1, 5, 40, 300]))))
            for _ in range(400)]
    return docs + docs[:3] + [(None, docs[0][1]), (5, None), (6, "..."), (7, "")]


@pytest.fixture
def items(docs):
    dice = random.Random(8)
    items = [(k, " ".join(terms(dice.choice(docs)[1])[:dice.choice([1, 5, 30])])) for k in range(30)]
    return items + [(40, None), (41, "?!"), (42, "unheard"), (43, "w0 w0 W0"), items[0], (0, "w17 w18"), (None, "x9 w3")]


@pytest.mark.parametrize("sketch,at_once,step", [(2048, 256, 8), (64, 7, 1), (4, 50, 3)])
def test_agrees_with_brute_force(spark, docs_of, docs, items, sketch, at_once, step, monkeypatch):
    for name, value in (("SKETCH", sketch), ("DOCS_AT_ONCE", at_once), ("STEP", step), ("ITEMS_AT_ONCE", 12), ("LOOKUPS_AT_ONCE", 9)):
        monkeypatch.setattr(lexical, name, value)
    got = sorted((tuple(r) for r in lexical.search(spark, docs_of(docs), items_of(spark, items), top=4).collect()), key=str)
    assert got == plain(docs, items, 4)


def test_edges(spark, docs_of, edge_docs):
    none = "item_id long, text string"
    assert lexical.search(spark, docs_of([]), items_of(spark, [(1, "a")])).count() == 0
    assert lexical.search(spark, edge_docs, spark.createDataFrame([], none)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    items = [(1, "one tail"), (2, "no id 日本語"), (3, "word5 " * 3)]
    got = sorted((tuple(r) for r in lexical.search(spark, edge_docs, items_of(spark, items)).collect()), key=str)
    assert got == plain(rows, items, 10)


def test_bounds_hold_and_spare_work(docs, items):
    """No score is above its bound, and most pairs are never rescored."""
    held = [Counter(terms(t)) for _, t in docs if terms(t)]
    names = {t: i for i, t in enumerate(sorted({t for c in held for t in c} | {t for _, x in items for t in terms(x)}))}
    keys = np.random.default_rng(1).integers(0, 2**64, len(names), dtype=np.uint64)
    packed = []
    for c in held:
        order = np.argsort([keys[names[t]] for t in c])
        packed.append((np.array([keys[names[t]] for t in c], np.uint64)[order], np.array(list(c.values()))[order]))
    asked = [sorted(int(keys[names[t]]) for t in set(terms(x))) for _, x in items if terms(x)]
    queries = lexical.Queries(list(range(len(asked))), np.cumsum([0] + [len(a) for a in asked]), np.array(sum(asked, []), np.uint64),
                              np.arange(1, sum(map(len, asked)) + 1) * 37)
    lengths = np.array([sum(c.values()) for c in held])
    block = lexical.Block(lengths, [t for t, _ in packed], [c for _, c in packed], len(held), int(lengths.sum()))
    spots = [lexical.places(queries.terms, turn) for turn in lexical.TURNS]
    bounds = block.bounds(queries, spots)
    q, d = (x.reshape(-1) for x in np.indices(bounds.shape))
    exact = block.scores(queries, q, d).reshape(bounds.shape)
    assert (bounds >= exact).all() and (bounds[exact == 0] == 0).mean() > 0.5
    best = lexical.Best(len(asked), 4)
    done = block.search(queries, spots, np.arange(len(held)), np.zeros(len(held), bool), best)
    assert done < bounds.size / 2
