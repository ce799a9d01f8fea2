import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import suffixes


def plain(docs):
    """Brute force over (doc_id, text), in id order."""
    first, out = {}, {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - suffixes.LENGTH + 1):
            window = data[i:i + suffixes.LENGTH]
            first[window] = min(first.get(window, (doc, i)), (doc, i))
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - suffixes.LENGTH + 1):
            if first[data[i:i + suffixes.LENGTH]] < (doc, i):
                gone[i:i + suffixes.LENGTH] = b"\1" * suffixes.LENGTH
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.setdefault(doc, []).append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return {doc: sorted(rows) for doc, rows in out.items()}


def run(spark, frame):
    rows = suffixes.remove_repeats(spark, frame).withColumn("sha", F.sha2("kept", 256)).collect()
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]))
    return {doc: sorted(rows) for doc, rows in out.items()}


@pytest.mark.parametrize("batch", [40_000, 7])
def test_agrees_with_brute_force(spark, docs_of, batch, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", batch)
    dice = random.Random(3)
    passages = ["".join(dice.choice("abcdé ") for _ in range(dice.randint(60, 400))) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [dice.choice(passages) if dice.random() < 0.6 else "".join(dice.choice("ab") for _ in range(dice.randint(0, 150)))
                 for _ in range(dice.randint(0, 4))]
        docs.append((dice.randint(0, 10**6), "".join(parts)))
    docs += [(2_000_000, "a" * 1000), (2_000_001, "a" * 99), (2_000_002, "ab" * 300), (2_000_003, docs[0][1]), (2_000_004, None), (2_000_005, ""),
             (2_000_006, "x" * 50 + "\x00" * 150 + "y" * 50), (2_000_007, "z" * 60 + "\x00" * 150), (2_000_008, "😀" * 120)]
    docs = list({d: (d, t) for d, t in docs}.values())
    assert run(spark, docs_of(docs)) == plain(docs)


def test_edges(spark, edge_docs):
    rows = suffixes.remove_repeats(spark, edge_docs).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert by[1] == [0] and by[2] == [0] and by[None] == [0, 0]
    size = len(" ".join(f"word{i % 977}" for i in range(60_000)))
    whole = {r["doc_id"]: r["n_bytes"] for r in rows}
    # both rows of id 7 lose the text of id 6 and the blank behind it, not the tail; inside id 6 only the first turn of the words stays
    turn = len(" ".join(f"word{i}" for i in range(977))) + 1
    assert whole[6] == size and by[6] == [size - turn] and by[7] == [size + 1, size + 1]
    assert suffixes.remove_repeats(spark, edge_docs.limit(0)).count() == 0


def test_places_in_pieces_are_those_of_the_whole(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(20_000), np.uint8) % 4
    whole = suffixes.anchors(data, np.array([0, 9000, 9050, len(data)]))
    monkeypatch.setattr(suffixes, "PIECE", 777)
    parts = suffixes.anchors(data, np.array([0, 9000, 9050, len(data)]))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_repeats_at_the_ends_of_texts(spark, docs_of):
    """Windows whose anchor has less than half a window beside it, down to texts of one window."""
    dice = random.Random(11)
    base = "".join(dice.choice("abcdefgh ") for _ in range(700))
    docs = [(0, base)]
    for i in range(1, 400):
        at = dice.randint(0, 560)
        piece = base[at:at + dice.randint(99, 140)]
        docs.append((i, dice.choice(["", "#", "?" * 40]) + piece + dice.choice(["", "%" * 3, "!" * 70]) + (str(i) if i % 3 else "")))
    assert run(spark, docs_of(docs)) == plain(docs)


def test_repeated_rows_lose_nothing(spark, docs_of):
    """Rows of one id and text are no repeats of each other."""
    text = random.Random(4).randbytes(400).hex()[:400]
    rows = suffixes.remove_repeats(spark, docs_of([(1, text), (1, text)])).collect()
    assert [(r["n_bytes"], r["n_removed"], bytes(r["kept"]).decode()) for r in rows] == [(400, 0, text)] * 2
    rows = suffixes.remove_repeats(spark, docs_of([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (2, 400)]


def test_one_id_over_unlike_texts(spark, docs_of):
    """Each row is judged by its own text, however long the others of its id are."""
    dice = random.Random(6)
    a, b, c = ("".join(dice.choice("abcdefgh") for _ in range(n)) for n in (400, 350, 150))
    rows = suffixes.remove_repeats(spark, docs_of([(1, a), (2, a), (2, b), (2, "short"), (3, c + b[100:250])])).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rows) == [
        (1, 400, 0), (2, 5, 0), (2, 350, 0), (2, 400, 400), (3, 300, 150)]
    docs = [(dice.randrange(6), "".join(dice.choice([a, b, c, "xy" * 30]) for _ in range(dice.randrange(4)))) for _ in range(40)]
    docs += [(9, "p" * 20 + a), (9, "q" * 20 + a), (9, a[:200] + "p"), (9, a[:200] + "q")]
    assert run(spark, docs_of(docs)) == plain(docs)
