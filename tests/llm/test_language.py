import math

import numpy as np
import pytest

from tallygrid.llm import language

PATH = language.vocabulary_path()


def test_forward_sums_all_segmentations():
    own = language.lattice(PATH)
    dice = np.random.default_rng(1)
    table = dice.random((own.size, 3))
    table /= table.sum(axis=0)
    number = {int(h): int(i) for h, i in zip(own.hashes, own.order)}

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, min(len(word), own.longest) + 1):
            piece = number.get(own._hash(word[:n]), own.unknown if n == 1 else None)
            if piece is not None:
                out += table[piece, lang] * total(word[n:], lang)
        return out

    words = ["▁the", "▁entre", "▁日本語", "▁a", "▁schön", "x"]
    got = own.log_scores(words, table)
    for i, w in enumerate(words):
        for k in range(3):
            assert math.isclose(got[i, k], math.log(total(w, k)), rel_tol=1e-9)


def test_expected_counts_are_derivatives():
    own = language.lattice(PATH)
    p = np.full(own.size, 1 / own.size)
    word = "▁entre"
    expected = own.expected([word], np.array([2]), p)
    for piece in np.flatnonzero(expected):
        step = p.copy()
        step[piece] *= 1 + 1e-6
        slope = (own.log_scores([word], step[:, None]) - own.log_scores([word], p[:, None]))[0, 0] / 1e-6
        assert math.isclose(expected[piece], 2 * slope, rel_tol=1e-3, abs_tol=1e-6)


def test_long_runs_go_in_stretches():
    words = language.words_of("A" * 100 + " b1c")
    assert "".join(words) == "▁" + "a" * 100 + "▁b▁c" and max(map(len, words)) <= language.STRETCH + 1


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    rows = language.op10_language_id(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = rows.join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark, docs_of, edge_docs):
    texts = {"aa": "mana tolo mana", "bb": "zischt krumpf zischt"}
    labelled = docs_of([(i, texts[lang], lang) for i in range(20) for lang in texts])
    model = language.fit(spark, labelled.select("doc_id", "text", "lang"), PATH)
    assert model[0] == ["aa", "bb"]
    renamed = edge_docs.withColumnRenamed("score", "score_")
    out = language.predict(renamed, model, PATH)
    assert out.columns == [*renamed.columns, "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == 12
    for r in rows:
        empty = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und" and r["score"] == 0) == empty
    with pytest.raises(ValueError):
        language.predict(edge_docs, model, PATH)
    assert language.predict(docs_of([(1, "mana"), (2, "zischt")]).select("doc_id", "text"), model, PATH).collect()[0]["lang_pred"] == "aa"
    none = language.fit(spark, labelled.limit(0).select("doc_id", "text", "lang"), PATH)
    assert [r["lang_pred"] for r in language.predict(docs_of([(1, "mana")]).select("text"), none, PATH).collect()] == ["und"]
    assert language.predict(docs_of([]).select("text"), model, PATH).count() == 0
