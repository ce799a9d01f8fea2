"""Ranked lexical search by hashed max-sketches.

Documents become an index once: their number of terms and their distinct terms with counts. A search folds each
document's term impacts into a sketch: two rows of coordinates, each coordinate the largest impact of the terms that
hash to it. The smaller of a term's two coordinates is never below its impact, so one batched lookup of all query
terms gives an upper bound of every (query, document) score. Documents are rescored exactly by falling bound until
the bound is below the query's worst kept score; no score is left out that could still count.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Terms are held
as 64-bit hashes. Weights and impacts are the integers stated at ``weight`` and ``impacts``.

Defined cases: a text that is null, empty or without terms is in no count and never found; an item without terms finds
nothing. Every document row counts as a document of its own, repeated rows included; equal scores rank by ascending id,
a row without an id last. Rows that repeat an item's id and text are one item; different texts under one id add up.
Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch
from .words import slices, word_hashes

KINDS = np.zeros(256, bool)  # bytes that terms are made of
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = True
SKETCH = 2048  # coordinates of a sketch row
TURNS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # one hash of a term for each sketch row
DOCS_AT_ONCE = 256
ITEMS_AT_ONCE, TERMS_AT_ONCE = 512, 1 << 17  # bound of what travels to the tasks with one pass
LOOKUPS_AT_ONCE = 8192
STEP = 8  # documents of a query that are rescored between two looks at the threshold
SALTS = 64


def weight(documents: int, holders: int) -> int:
    """Weight of a term that ``holders`` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def impacts(times: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Impact of a term that occurs ``times`` in a document of ``length`` terms."""
    norm = 25 + (75 * length * documents) // terms
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


# -- index ----------------------------------------------------------------------------------------------------------

def term_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct term hashes of every text, and how often each occurs."""
    for lo, hi, data, offsets in slices(column):
        hashes, _, _, firsts = word_hashes(data, offsets, kinds=KINDS)
        for i in range(hi - lo):
            own = np.sort(hashes[firsts[i]:firsts[i + 1]])
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            yield own[starts], np.diff(np.append(starts, len(own)))


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): number of terms, packed sorted 64-bit terms, packed 32-bit counts; documents with terms only."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(int(c.sum()), t.tobytes(), c.astype(np.uint32).tobytes()) for t, c in term_counts(batch.column(1))]
            n, terms, counts = zip(*held) if held else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.where("text is not null").mapInArrow(pack, "doc_id long, n long, terms binary, counts binary").where("n > 0")


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, term, times) of all items."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(term_counts(batch.column(1)))
            rows = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
            terms = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.uint64)
            times = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms.view(np.int64)), pa.array(times)],
                                             names=["item_id", "term", "times"])

    texts = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text"))
    counted = texts.where("text is not null").distinct().mapInArrow(split, "item_id long, term long, times long")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


# -- search ---------------------------------------------------------------------------------------------------------

@dataclass
class Queries:
    """A bounded block of items: terms item by item, with their weights times their occurrences."""
    items: list[int | None]
    starts: np.ndarray  # first term of each item, and the end
    terms: np.ndarray
    weights: np.ndarray


def item_blocks(terms: DataFrame) -> Iterator[list]:
    """The items' rows (item_id, term, times) in blocks of bounded size, ordered by item."""
    items, rows = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(-(-items // ITEMS_AT_ONCE), -(-rows // TERMS_AT_ONCE))
    for k in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "term").collect()
        if block:
            yield block


def holders(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each of the sorted terms occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own in batch.column(0):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += own[at] == terms
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(total)], names=["term", "df"])

    found = index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r[0]: r[1] for r in found.collect()}


class Best:
    """The best scores of every query so far."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.query, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.absent = np.zeros(0, bool)  # documents without an id
        self.least = np.zeros(queries, np.int64)  # a full query's worst kept score

    def merge(self, query: np.ndarray, doc: np.ndarray, absent: np.ndarray, score: np.ndarray) -> None:
        new = ((self.query, query), (self.doc, doc), (self.absent, absent), (self.score, score))
        query, doc, absent, score = (np.concatenate(p) for p in new)
        order = np.lexsort((doc, absent, -score, query))
        query, doc, absent, score = query[order], doc[order], absent[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.top
        full = rank == self.top - 1
        self.least[query[full]] = score[full]
        self.query, self.doc, self.absent, self.score = query[keep], doc[keep], absent[keep], score[keep]


class Block:
    """Some documents of the index, with their impacts folded into sketches."""

    def __init__(self, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], documents: int, total: int):
        self.terms = terms
        sizes = np.array([len(t) for t in terms])
        flat = impacts(np.concatenate(counts).astype(np.int64), np.repeat(lengths, sizes), documents, total)
        self.ends = np.cumsum(sizes)
        self.flat = flat
        self.docs = len(terms)
        doc, held = np.repeat(np.arange(self.docs), sizes), np.concatenate(terms)
        self.sketches = []
        for turn in TURNS:
            sketch = np.zeros(SKETCH * self.docs, np.float32)  # impacts are below 2 ** 24 and exact here
            np.maximum.at(sketch, places(held, turn) * self.docs + doc, flat.astype(np.float32))
            self.sketches.append(sketch.reshape(SKETCH, self.docs))

    def bounds(self, queries: Queries, spots: list[np.ndarray]) -> np.ndarray:
        """(query, document): no score is above its bound."""
        out = np.zeros((len(queries.items), self.docs), np.float32)
        owner = np.repeat(np.arange(len(queries.items)), np.diff(queries.starts))
        for lo in range(0, len(queries.terms), LOOKUPS_AT_ONCE):
            part = slice(lo, lo + LOOKUPS_AT_ONCE)
            most = self.sketches[0][spots[0][part]]
            for sketch, spot in zip(self.sketches[1:], spots[1:]):
                np.minimum(most, sketch[spot[part]], out=most)
            most *= queries.weights[part, None].astype(np.float32)
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(owner[part]) > 0]))
            out[owner[part][firsts]] += np.add.reduceat(most, firsts, axis=0)
        return out * np.float32(1 + (np.diff(queries.starts).max() + 4) * 2.0 ** -22)  # above all rounding of the sums

    def scores(self, queries: Queries, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Exact scores of (query, document) pairs."""
        out = np.zeros(len(query), np.int64)
        order = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) > 0, [True]]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            pairs = order[lo:hi]
            d = int(doc[pairs[0]])
            own = self.terms[d]
            parts = [slice(queries.starts[q], queries.starts[q + 1]) for q in query[pairs]]
            wanted = np.concatenate([queries.terms[p] for p in parts])
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            gain = np.where(own[at] == wanted, self.flat[self.ends[d] - len(own) + at], 0) * np.concatenate([queries.weights[p] for p in parts])
            out[pairs] = np.add.reduceat(gain, np.cumsum([0] + [p.stop - p.start for p in parts[:-1]]))
        return out

    def search(self, queries: Queries, spots: list[np.ndarray], ids: np.ndarray, absent: np.ndarray, best: Best) -> int:
        """Rescore by falling bound until the threshold. Returns the number of pairs rescored."""
        bounds = self.bounds(queries, spots)
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, 1)
        done = 0
        active = np.arange(len(queries.items))
        for lo in range(0, self.docs, STEP):
            open_ = (falling[active, lo:lo + STEP] >= best.least[active, None]) & (falling[active, lo:lo + STEP] > 0)
            active, open_ = active[open_[:, 0]], open_[open_[:, 0]]
            if not len(active):
                break
            row, column = np.nonzero(open_)
            query, doc = active[row], order[active[row], lo + column]
            score = self.scores(queries, query, doc)
            done += len(score)
            hit = score > 0
            best.merge(query[hit], ids[doc[hit]], absent[doc[hit]], score[hit])
        return done


def places(terms: np.ndarray, turn: np.uint64) -> np.ndarray:
    """Coordinates of terms in one sketch row."""
    return ((terms * turn) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def search_index(index: DataFrame, terms: DataFrame, top: int) -> DataFrame | None:
    """(item_id, doc_id, score): each task's best documents of each item; None without items or documents."""
    documents, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    result = None
    for rows in item_blocks(terms) if documents else ():
        item = np.array([0 if r[0] is None else r[0] for r in rows])
        absent = np.array([r[0] is None for r in rows])
        starts = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (absent[1:] != absent[:-1]), [True]]))
        held = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        df = holders(index, np.unique(held))
        weights = np.array([weight(documents, df[r[1]]) * r[2] for r in rows], np.int64)
        queries = Queries([rows[s][0] for s in starts[:-1]], starts, held, weights)

        def find(batches: Iterator[pa.RecordBatch], queries: Queries = queries) -> Iterator[pa.RecordBatch]:
            spots = [places(queries.terms, turn) for turn in TURNS]
            best = Best(len(queries.items), top)
            for whole in batches:
                for lo in range(0, whole.num_rows, DOCS_AT_ONCE):
                    batch = whole.slice(lo, DOCS_AT_ONCE)
                    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
                    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)]
                    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                    absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                    Block(batch.column(1).to_numpy(), own, counts, documents, total).search(queries, spots, ids, absent, best)
            items = pa.array([queries.items[q] for q in best.query.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([items, pa.array(best.doc, pa.int64(), mask=best.absent), pa.array(best.score)],
                                             names=["item_id", "doc_id", "score"])

        part = index.mapInArrow(find, "item_id long, doc_id long, score long")
        result = part if result is None else result.unionByName(part)
    return result


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    scratch = Scratch(spark, "lexical")
    index = scratch.keep(build_index(docs), "index")
    terms = scratch.keep(item_terms(items), "terms")
    found = search_index(index, terms, top)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    falling = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*falling))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*falling))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP12_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
found AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
held AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM found GROUP BY r, doc_id, term),
sized AS (SELECT r, count(*)::BIGINT AS n FROM found GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
normed AS (SELECT r, 25 + (75 * n * docs) // total AS m FROM sized, whole),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (
  SELECT a.item_id, h.r, h.doc_id, CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * d.m))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weighed w USING (term) JOIN normed d USING (r) GROUP BY a.item_id, h.r, h.doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INT) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
