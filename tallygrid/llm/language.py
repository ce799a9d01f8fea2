"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text is the product of its words;
a word's probability is the sum over all its segmentations into pieces, by the forward algorithm. Probabilities are
fitted by expectation-maximisation on word counts: expected piece counts come from forward and backward sums, added
up by Spark, so only one row per (language, piece) reaches the driver. Words are scored once per task and looked up
after that; the forward algorithm runs on all new words of a batch together.

A word is a run of letters, lower-cased; digits and signs say nothing about a language. Runs of more than
``STRETCH`` letters are scored in stretches. A letter that the vocabulary lacks is an unknown piece.

Training reads labelled texts only, at most about ``docs_per_language`` of each language, chosen by a hash of the
document id, whole texts.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0; so is every text if there is
nothing to learn from. Ties go to the smaller language name. Repeated rows are each predicted. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Scratch

VOCABULARY = "piece_bpe_32k.model"
DOCS_PER_LANGUAGE, ROUNDS, SMOOTHING = 3000, 3, 0.1
STRETCH, MEMO_WORDS, BATCH_CHARS = 30, 300_000, 4 << 20
UNDETERMINED = "und"
START = "▁"  # begins a word in the vocabulary
_step = np.uint64(0x9E3779B97F4A7C15)
_letters = re.compile(r"[^\W\d_]+").findall


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Lattice:
    """Segmentations of words into vocabulary pieces, for many words at a time."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        pieces = sorted({p.lower() for p in pieces if p.lstrip(START).isalpha() or p == START})
        self.unknown, self.size = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_step) + ord(c) + 1) & (2**64 - 1)
        return h

    def arcs(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
        """For the words of each length: their places, the length, and (start, end, rows, piece) of all arcs, by start."""
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, places in by_length.items():
            codes = np.frombuffer("".join(words[i] for i in places).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = codes.reshape(len(places), length).astype(np.uint64) + np.uint64(1)
            found = []
            for start in range(length):
                h = np.zeros(len(places), np.uint64)
                for end in range(start + 1, min(length, start + self.longest) + 1):
                    h = h * _step + codes[:, end - 1]
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    hit = self.hashes[at] == h
                    if end == start + 1:
                        found.append((start, end, np.arange(len(places)), np.where(hit, self.order[at], self.unknown)))
                    elif hit.any():
                        rows = np.flatnonzero(hit)
                        found.append((start, end, rows, self.order[at[rows]]))
            yield np.array(places), length, found

    def log_scores(self, words: list[str], probabilities: np.ndarray) -> np.ndarray:
        """Log of each word's probability under every language (columns)."""
        out = np.zeros((len(words), probabilities.shape[1]))
        for places, length, arcs in self.arcs(words):
            alpha = np.zeros((length + 1, len(places), probabilities.shape[1]))
            alpha[0] = 1
            for start, end, rows, piece in arcs:
                alpha[end][rows] += alpha[start][rows] * probabilities[piece]
            out[places] = np.log(alpha[length])
        return out

    def expected(self, words: list[str], counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        """Expected count of every piece, for words of one language that occur ``counts`` times."""
        out = np.zeros(self.size)
        for places, length, arcs in self.arcs(words):
            alpha = np.zeros((length + 1, len(places)))
            beta = np.zeros((length + 1, len(places)))
            alpha[0] = beta[length] = 1
            for start, end, rows, piece in arcs:
                alpha[end][rows] += alpha[start][rows] * probabilities[piece]
            for start, end, rows, piece in reversed(arcs):
                beta[start][rows] += beta[end][rows] * probabilities[piece]
            share = counts[places] / alpha[length]
            for start, end, rows, piece in arcs:
                weight = alpha[start][rows] * probabilities[piece] * beta[end][rows] * share[rows]
                out += np.bincount(piece, weight, self.size)
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs, each with its start mark; long runs in stretches."""
    words = []
    for run in _letters((text or "").lower()):
        if len(run) <= STRETCH:
            words.append(START + run)
        else:
            run = START + run
            words.extend(run[i:i + STRETCH] for i in range(0, len(run), STRETCH))
    return words


def fit(spark: SparkSession, labelled: DataFrame, path: str, docs_per_language: int = DOCS_PER_LANGUAGE,
        rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log shares and the piece probabilities (pieces by languages), from (doc_id, text, lang)."""
    scratch = Scratch(spark, "language")
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    held = lattice(path)
    if not languages:
        return [], np.zeros(0), np.zeros((held.size, 0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(1e6 * min(1.0, docs_per_language / sizes[lang])))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tally.update((lang, w) for w in words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()),
                 pa.array(list(tally.values()), pa.int64())], names=["lang", "word", "n"])

    counts = scratch.keep(chosen.mapInArrow(count, "lang string, word string, n long")
                          .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    place = {lang: i for i, lang in enumerate(languages)}
    probabilities = np.full((held.size, len(languages)), 1.0 / held.size)
    for _ in range(rounds):
        now = probabilities

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = lattice(path)
            total = np.zeros(now.shape)
            for batch in batches:
                langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k in np.unique(langs):
                    mine = np.flatnonzero(langs == k)
                    total[:, k] += own.expected([words[i] for i in mine], n[mine], now[:, k])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[piece, lang])],
                                             names=["lang", "piece", "expected"])

        rows = counts.mapInArrow(expect, "lang long, piece long, expected double").groupBy("lang", "piece").agg(
            F.sum("expected")).collect()  # languages times pieces at most
        weight = np.full((held.size, len(languages)), smoothing)
        for lang, piece, expected in rows:
            weight[piece, lang] += expected
        probabilities = weight / weight.sum(axis=0)
    n = np.array([sizes[x] for x in languages], float)
    return languages, np.log(n / n.sum()), probabilities


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str, text_column: str = "text",
            prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its posterior to every row, under names that ``docs`` doesn't have."""
    languages, prior, probabilities = model
    names = docs.columns
    if {prediction, score} & set(names):
        raise ValueError(f"docs has a column {prediction} or {score}; name the added columns otherwise")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        memo: dict[str, int] = {}
        table = np.zeros((0, len(languages)))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            lang, odds_of = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            held: list[tuple[int, list[str]]] = []
            size = 0

            def settle() -> None:
                nonlocal table
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                    table = table[:0]
                new = set()
                for _, words in held:
                    new.update(words)
                fresh = [w for w in new if w not in memo]
                memo.update(zip(fresh, range(len(table), len(table) + len(fresh))))
                table = np.concatenate([table, own.log_scores(fresh, probabilities)])
                for row, words in held:
                    at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                    log = table[at].sum(axis=0) + prior
                    odds = np.exp(log - log.max())
                    best = int(log.argmax())
                    lang[row], odds_of[row] = languages[best], float(odds[best] / odds.sum())
                held.clear()

            for row, text in enumerate(texts):
                words = words_of(text.as_py()) if languages else []
                if any(c.isalpha() and c != START for w in words for c in w):
                    held.append((row, words))
                    size += len(words)
                if size > BATCH_CHARS // 8:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(odds_of)],
                                             names=[*names, prediction, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(judge, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that training never reads."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit_documents(spark: SparkSession, docs: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Model from the documents that are not held out."""
    return fit(spark, docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), path)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = vocabulary_path()
    model = fit_documents(spark, docs, path)
    done = predict(docs.select("doc_id", "text"), model, path)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
