"""Benchmark decontamination by SimHash windows the size of each item.

A benchmark item is matched against windows of a document with as many words as the item, at every word offset.
Windows get a 64-bit SimHash of their words (a sliding sum of signed bits), and a multi-index of Hamming blocks over
the items' fingerprints finds every item within the radius: the 64 bits are cut into ``BLOCKS`` blocks, and two
fingerprints at most ``RADIUS`` apart agree in some block up to ``RADIUS // BLOCKS`` bits, so listing each item under
all block values that near misses nothing. Candidates are verified by the exact weighted Jaccard similarity of their
shingles, a shingle weighing as often as it occurs.

Windows are only laid where they can match: around shingles that some item has too, in the sizes of the items that
have them (a similarity above 0 needs a common shingle). Documents are read once per block of items and not shuffled.
A block of items is bounded in rows and bytes, so what is sent to the tasks doesn't grow with the benchmark.

Defined cases: a null text, or one without words, matches nothing, on either side. A text with fewer words than the
shingle width is one shingle. A document with fewer words than an item is one window. Repeated documents and items
are each reported. Ties in similarity go to the earlier window. Extra columns are ignored (``drop_leaks`` keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import shingle_hashes, slices, word_hashes

WIDTH, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS = 64, 14, 5
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
FILTER_BITS = 22

Leak = tuple[int, int, int, int, int, float]  # document, item, first word, words, Hamming distance, similarity


def signed_sums(words: np.ndarray) -> np.ndarray:
    """Running sums of the words' bits as +1 or -1; row i sums the first i words."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(words) + 1, BITS), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts``."""
    bits = (sums[starts + size] - sums[starts]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Weighted Jaccard of two arrays of shingle hashes with repeats."""
    a, na = np.unique(one, return_counts=True)
    b, nb = np.unique(two, return_counts=True)
    _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[at], nb[bt]).sum())
    return common / (len(one) + len(two) - common) if len(one) and len(two) else 0.0


class HammingIndex:
    """All fingerprints within ``RADIUS`` of a query, by blocks of bits."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        edges = np.linspace(0, BITS, BLOCKS + 1).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            masks = [sum(1 << b for b in chosen) for near in range(RADIUS // BLOCKS + 1) for chosen in combinations(range(hi - lo), near)]
            value = (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            keys = (value[:, None] ^ np.array(masks, np.uint64)[None, :]).reshape(-1)
            item = np.repeat(np.arange(len(prints)), len(masks))
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.uint64(lo), np.uint64((1 << (hi - lo)) - 1), keys[order], item[order]))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, fingerprint, distance) of all pairs at most ``RADIUS`` apart."""
        pairs = []
        for shift, mask, keys, item in self.blocks:
            value = (queries >> shift) & mask
            lo, hi = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
            size = hi - lo
            query = np.repeat(np.arange(len(queries)), size)
            at = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + np.repeat(lo, size)
            pairs.append(query * len(self.prints) + item[at])
        found = np.unique(np.concatenate(pairs))
        query, item = found // len(self.prints), found % len(self.prints)
        distance = np.bitwise_count(queries[query] ^ self.prints[item])
        near = distance <= RADIUS
        return query[near], item[near], distance[near]


class Items:
    """One bounded block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int, least: float):
        self.width, self.least = width, least
        _, _, data, offsets = next(slices(pa.array(texts, pa.string()), 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        words, _, _, firsts = word_hashes(data, offsets)
        self.ids, self.words = [], []
        for i, name in enumerate(ids):
            if firsts[i] < firsts[i + 1]:
                self.ids.append(name)
                self.words.append(words[firsts[i]:firsts[i + 1]])
        self.shingles = [shingle_hashes(w, width) for w in self.words]
        by_size = defaultdict(list)
        for i, w in enumerate(self.words):
            by_size[len(w)].append(i)
        self.by_size = {size: np.array(rows) for size, rows in by_size.items()}
        self.index = {size: HammingIndex(np.concatenate([fingerprints(signed_sums(self.words[i]), np.zeros(1, np.int64), size) for i in rows]))
                      for size, rows in self.by_size.items()}
        # shingles by their number of words, each with the sizes of the items that have it
        self.anchors = {}
        for used in sorted({min(width, size) for size in by_size}):
            rows = [i for size, own in by_size.items() if min(width, size) == used for i in own]
            pairs = np.unique(np.concatenate([np.stack([self.shingles[i], np.full(len(self.shingles[i]), len(self.words[i]), np.uint64)], 1) for i in rows]), axis=0)
            table = np.zeros(1 << FILTER_BITS, bool)
            table[pairs[:, 0] & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.anchors[used] = (pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), table)

    def leaks(self, texts: pa.Array) -> Iterator[Leak]:
        """Best match of every (row, item) at or above the wanted similarity."""
        for row, _, data, offsets in slices(texts):
            words, _, _, firsts = word_hashes(data, offsets)
            spots = defaultdict(lambda: defaultdict(list))
            for used, (keys, sizes, table) in self.anchors.items():
                if len(words) < used:
                    continue
                shingles = shingle_hashes(words, used)
                maybe = np.flatnonzero(table[shingles & np.uint64((1 << FILTER_BITS) - 1)])
                at = np.searchsorted(keys, shingles[maybe])
                hit = keys[np.minimum(at, len(keys) - 1)] == shingles[maybe]
                maybe, at = maybe[hit], at[hit]
                text = np.searchsorted(firsts, maybe, side="right") - 1
                inside = maybe + used <= firsts[text + 1]
                for place, first, doc in zip(maybe[inside].tolist(), at[inside].tolist(), text[inside].tolist()):
                    while first < len(keys) and keys[first] == shingles[place]:
                        spots[doc][int(sizes[first])].append(place - int(firsts[doc]))
                        first += 1
            # a text shorter than the shingle width is one shingle, which no longer item can have: its widths differ
            for doc in sorted(spots):
                yield from self._match(row + doc, words[firsts[doc]:firsts[doc + 1]], spots[doc])

    def _match(self, row: int, words: np.ndarray, spots: dict[int, list[int]]) -> Iterator[Leak]:
        sums = signed_sums(words)
        best: dict[int, Leak] = {}
        for size, places in spots.items():
            used = min(size, len(words))
            marks = np.zeros(len(words) - used + 2, np.int64)
            places = np.array(places)
            np.add.at(marks, np.maximum(places - used + 1, 0), 1)
            np.add.at(marks, np.minimum(places, len(words) - used) + 1, -1)
            starts = np.flatnonzero(marks.cumsum()[:-1] > 0)
            query, item, distance = self.index[size].within(fingerprints(sums, starts, used))
            for q, i, d in zip(query.tolist(), item.tolist(), distance.tolist()):
                start, which = int(starts[q]), int(self.by_size[size][i])
                score = similarity(shingle_hashes(words[start:start + used], self.width), self.shingles[which])
                if score >= self.least and (which not in best or score > best[which][5]):
                    best[which] = (row, self.ids[which], start, used, d, score)
        yield from best.values()


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list[int], list[str | None]]]:
    """The benchmark in blocks of bounded rows and bytes."""
    items = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text is not null")
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-count // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE), 0)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity): the best window of every (document, item) that match."""
    schema = "doc_id long, item_id long, first_word long, n_words long, hamming long, similarity double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = None
    for ids, held in item_blocks(benchmark, "item_id", "text"):
        def match(batches: Iterator[pa.RecordBatch], ids=ids, held=held) -> Iterator[pa.RecordBatch]:
            items = Items(ids, held, width, least)
            for batch in batches:
                rows = list(items.leaks(batch.column(1)))
                columns = list(zip(*rows)) or [()] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                arrays[0] = batch.column(0).take(arrays[0])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"])

        part = texts.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with all their columns."""
    for ids, held in item_blocks(benchmark, "item_id", "text"):
        def clean(batches: Iterator[pa.RecordBatch], ids=ids, held=held) -> Iterator[pa.RecordBatch]:
            items = Items(ids, held, width, least)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for leak in items.leaks(batch.column(batch.schema.get_field_index("text"))):
                    keep[leak[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(spark, spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
