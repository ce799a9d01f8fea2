"""Near-duplicate groups by SimHash, compared bit-sliced.

A text's fingerprint has a bit for each bit of a 64-bit hash: it is set if more than half of the text's word shingles
(repeats included) have it set. Fingerprints at most ``radius`` bits apart are linked. Equal fingerprints are one
class. The 64 bits are cut into radius + 2 stretches; two fingerprints within the radius agree on at least two of
them, so every pair of stretches is a table that names buckets, and a linked pair meets in a bucket for certain.

A block of buckets is stored vertically: plane b holds bit b of all its fingerprints. One exclusive-or of a plane with
a fingerprint's bit gives a mismatch bit for each member at once; carry-save adders add the mismatch planes into
bitwise counters that many distances share. Fingerprints whose distances to the whole block have passed the radius
leave the block, and the block is abandoned when none stays. Links of a block come out as stars, so a family of m
fingerprints gives at most m - 1 rows. A bucket of more than ``BLOCK_ROWS`` fingerprints is cut into parts by hash, and
every two parts meet in a task of their own.

Defined cases: a text that is null or has no words has fingerprint zero, which is linked like any other; fewer words
than the width are one shingle. Every row is judged by its own text, so rows that share an id may lie in different
groups; a row without an id takes its group's smallest id, or null if the group has none. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .tables import Scratch

BITS = 64
SEED = 42
BLOCK_ROWS = 1024  # fingerprints of one bucket that meet as one part
BLOCK_TARGET = 512  # rows of small buckets that share a block
TEXT_STEP = 1 << 20  # bytes of a text that are cut into words at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BLANK = re.compile(rb"[\x20\x09-\x0D]")


# -- fingerprints ---------------------------------------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, a stretch of the text at a time."""
    held: list[bytes] = []
    lo, first = 0, True
    while lo < len(text):
        cut = BLANK.search(text, lo + TEXT_STEP)
        hi = cut.end() if cut else len(text)
        held += text[lo:hi].lower().split()
        lo = hi
        if len(held) >= width:
            runs = map(b" ".join, zip(*(held[k:] for k in range(width))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(held) - width + 1)
            held = held[len(held) - width + 1:]
            first = False
    if first and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the shingle hashes; zero without words."""
    total, votes = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):  # 255 rows of ones still fit a byte
            votes += np.add.reduce(bits[lo:lo + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of (doc_id, text): the fingerprint as a signed long."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(sign, "doc_id long, fp long")


# -- vertical comparison --------------------------------------------------------------------------------------------

class Counters:
    """Carry-save counters of many distances: bit k of each counter lies in plane k. ``over`` marks those beyond the radius."""

    def __init__(self, over: np.ndarray, radius: int):
        self.over = over
        levels = radius.bit_length()
        start = (1 << levels) - 1 - radius  # counters begin so that they overflow just beyond the radius
        self.sums = [np.full(over.shape, ALL if start >> k & 1 else 0, np.uint64) for k in range(levels)]
        self.waiting: list[np.ndarray | None] = [None] * levels

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        """Add mismatch bits of weight 2 ** level; two planes of one weight go through one full adder."""
        if level == len(self.sums):
            self.over |= plane
        elif self.waiting[level] is None:
            self.waiting[level] = plane
        else:
            kept, other = self.sums[level], self.waiting[level]
            odd = kept ^ other
            carry = (kept & other) | (odd & plane)
            self.sums[level], self.waiting[level] = odd ^ plane, None
            self.add(carry, level + 1)

    def settle(self) -> None:
        """Push planes that still wait for a partner through the adders."""
        for level in range(len(self.sums)):
            if self.waiting[level] is not None:
                self.add(np.zeros_like(self.over), level)

    def keep(self, rows: np.ndarray) -> None:
        self.over = self.over[rows]
        self.sums = [s[rows] for s in self.sums]
        self.waiting = [None if w is None else w[rows] for w in self.waiting]


def close_pairs(prints: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all pairs of a block at most ``radius`` bits apart; planes are read in the given order."""
    n = len(prints)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    masks = np.uint64(0) - bits[:n].astype(np.uint64)
    # partners up to a row's own place, and the padding, count as beyond the radius from the start
    past = np.clip(np.arange(n)[:, None] + 1 - 64 * np.arange(words)[None, :], 0, 64).astype(np.uint64)
    over = np.where(past == 64, ALL, (np.uint64(1) << (past & np.uint64(63))) - np.uint64(1))
    if n % 64:
        over[:, -1] |= ALL << np.uint64(n % 64)
    rows, counters = np.arange(n), Counters(over, radius)
    for done, b in enumerate(order, 1):
        counters.add(planes[b][None, :] ^ masks[rows, b][:, None])
        if done % 8 == 0:
            near = (counters.over != ALL).any(axis=1)
            if not near.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if 4 * near.sum() < 3 * len(rows):
                rows = rows[near]
                counters.keep(near)
    counters.settle()
    hit, partner = np.nonzero(np.unpackbits((~counters.over).view(np.uint8), axis=1, bitorder="little"))
    return rows[hit], partner


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is connected with by the pairs (i, j)."""
    label = np.arange(n)
    while not np.array_equal(label[i], label[j]):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
    return label[label]


# -- buckets --------------------------------------------------------------------------------------------------------

def stretches(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the radius + 2 stretches."""
    cuts = [round(BITS * k / (radius + 2)) for k in range(radius + 3)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def bucket_keys(radius: int) -> Column:
    """The buckets of a fingerprint: one for every two stretches."""
    def part(lo: int, size: int) -> Column:
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << size) - 1))

    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(part(*a), b[1]).bitwiseOR(part(*b)).alias("key"))
            for t, (a, b) in enumerate(combinations(stretches(radius), 2))]
    return F.explode(F.array(*keys))


def plane_order(table: int, radius: int) -> list[int]:
    """All bits, those that a table's buckets share last."""
    cuts = stretches(radius)
    shared = {b for lo, size in list(combinations(cuts, 2))[table] for b in range(lo, lo + size)}
    return [b for b in range(BITS) if b not in shared] + sorted(shared)


def compare_sorted(table: np.ndarray, group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (fingerprint, its head) among rows that lie bucket by bucket. Whole buckets share a block."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    many = np.repeat(sizes > 1, sizes)
    table, prints = table[many], prints[many]
    ends = np.cumsum(sizes[sizes > 1])
    lo = 0
    while lo < len(prints):
        hi = int(ends[min(np.searchsorted(ends, lo + BLOCK_TARGET), len(ends) - 1)])
        hi = min(hi, lo + int(np.searchsorted(table[lo:hi], table[lo], side="right")))  # one table, one order of planes
        block = np.unique(prints[lo:hi])
        i, j = close_pairs(block, radius, plane_order(int(table[lo]), radius))
        label = stars(len(block), i, j)
        own = label != np.arange(len(block))
        yield block[own], block[label[own]]
        lo = hi


def links(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links that join all fingerprints ``fp`` within the radius of each other."""
    spread = classes.select("fp", bucket_keys(radius).alias("k")).select("fp", "k.t", "k.key")
    hot = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK_ROWS)
    hot = scratch.keep(hot.select(F.col("t").alias("_t"), F.col("key").alias("_key"),
                                  F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("parts")), "hot")
    parts = F.coalesce("parts", F.lit(1))
    placed = spread.join(hot, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")), "left").select(
        "fp", "t", "key", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(
        F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")))
    dealt = placed.select("fp", "t", "key", F.explode(meets).alias("meet")).select("t", "key", "meet.i", "meet.j", "fp")
    dealt = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = columns if held is None else [np.concatenate(c) for c in zip(held, columns)]
            if len(held[0]) >= 1 << 15:
                changed = np.zeros(len(held[0]), bool)
                for column in held[:4]:
                    changed[1:] |= column[1:] != column[:-1]
                last = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
                yield from found([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None:
            yield from found(held)

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            changed = np.zeros(len(columns[0]), bool)
            for column in columns[:4]:
                changed[1:] |= column[1:] != column[:-1]
            for a, b in compare_sorted(columns[0], changed.cumsum(), columns[4].view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, radius: int = 3,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    scratch = Scratch(spark, "simhash")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = scratch.keep(fingerprints(texts, width), "signed")
    classes = scratch.keep(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    joined = scratch.keep(links(classes, radius, scratch), "links")
    labels = connected_components(joined, scratch).select(F.col("id").alias("_fp"), "component")
    grouped = scratch.keep(classes.join(labels, F.col("fp") == F.col("_fp")).select("fp", "rep", "component"), "grouped")
    heads = grouped.groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("head"))
    linked = grouped.join(heads, F.col("component") == F.col("_c")).select(F.col("fp").alias("_fp"), "head")
    named = scratch.keep(classes.join(linked, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("head", "rep").alias("component_id")), "named")
    return signed.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"))
