"""Repeated-substring removal by external induced sorting of sampled suffixes.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier. Sorting every suffix of a corpus would
take many times its size on disk, so the induction starts from sampled suffixes, as induced sorting does. Whole texts
that are equal to an earlier one go first: all their strings start earlier.

1. Sample. The suffix that starts at the smallest hashed ``SEED``-mer of a ``LENGTH``-byte window is an anchor. Equal
   windows choose the same place, so a repeated string has the same anchor, at the same distance, wherever it stands.
   Anchors whose seed occurs once are dropped by a fixed-size bit filter; false positives only cost work. A second
   filter holds what is left against longer strings: a window has at least half of its other bytes on one side of the
   seed, so a repeated window repeats the seed with that half. A side that occurs once is cut off, an anchor without
   either is dropped. Chance repeats of short seeds, which grow faster than the corpus, end here.
2. Deal. An anchor's tuple - its seed, places and the bytes around it - goes to the shard of its seed. The engine's
   external sort is the disk-backed queue: tuples arrive in seed order from spilled runs, and a task holds a bounded
   batch of whole seeds at a time, however large its shard is.
3. Sort the anchors' suffixes of a batch and take the common prefix of neighbours.
4. Induce. In round d, the suffixes d bytes before the anchors get their order from round d - 1 by one stable pass
   over the byte in front, and their common prefixes as one more than the least value between the two suffixes in the
   previous order. Neighbours whose common prefix reaches ``LENGTH`` are equal strings; all but the earliest are marked.
5. Marks go to their documents, which are cut where they are marked.

Defined cases: a null text is empty and loses nothing. Texts shorter than ``LENGTH`` bytes lose nothing. Equal strings
are told apart by document id, then start; equal strings of one id and start, as in repeated rows, do not make each other
a repeat. Rows that share an id but not the text are judged each by its own text. A row without an id is returned whole
and makes nothing else a repeat. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, salted_number
from .words import BASE, INVERSE, buffers, mix, powers, slices

LENGTH, SEED = 100, 38
REACH = LENGTH - SEED  # the farthest an anchor lies behind the start of its window
WIDTH = REACH + LENGTH
HALF = REACH // 2
FILTER_BITS = 27
BROADCAST_IDS = 1_000_000  # ids of whole copies that are sent to every task; more go through a shuffled join
WHOLE = -1  # a span that stands for the whole text
PART_BIT = 40  # a place carries the number of its text, among those of one id, above this many bits
PIECE, BATCH = 4 << 20, 40_000


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed hash) of every anchor of the texts in ``data``."""
    places, seeds = [], []
    for base in range(0, len(data), PIECE):
        piece = data[base:base + PIECE + LENGTH - 1]
        count = len(piece) - LENGTH + 1
        if count <= 0:
            break
        sums = prefix_sums(piece)
        hashes = mix((sums[SEED:] - sums[:-SEED]) * powers(INVERSE, len(piece) - SEED + 1))
        # the smallest hash, leftmost if equal: high bits of the hash, then the place
        low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        size, window = 1, REACH + 1
        while size * 2 <= window:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if window > size:
            low = np.minimum(low[:size - window], low[window - size:])
        ends = offsets[1:] - base
        text = np.searchsorted(ends, np.arange(count), side="right")
        chosen = (low[np.arange(count) + LENGTH <= ends[np.minimum(text, len(ends) - 1)]] & np.uint64(0xFFFFFF)).astype(np.int64)
        if len(chosen):
            chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
            places.append(chosen + base)
            seeds.append(hashes[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, seeds = np.concatenate(places), np.concatenate(seeds)
    fresh = np.concatenate([[True], places[1:] != places[:-1]])
    return places[fresh], seeds[fresh]


def seed_counts(docs: DataFrame) -> DataFrame:
    """(seed, n): the anchors' seeds, counted per batch."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(data, offsets)[1] for _, _, data, offsets in slices(batch.column(0), 1 << 20)]
            seed, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], names=["seed", "n"])
    return docs.select("text").mapInArrow(count, "seed long, n long")


def repeat_filter(counts: DataFrame) -> np.ndarray:
    """Bits of the seeds that occur more than once, as 64-bit words; 2**FILTER_BITS bits whatever the corpus size."""
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = (counts.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")
             .groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits"))).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def surroundings(column: pa.Array, repeats: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(seed, left, right, around, row, start) of the anchors whose seed may repeat, a slice of texts at a time.

    ``left`` and ``right`` are how far the text goes around the anchor, REACH and LENGTH at most.
    """
    for row, _, data, offsets in slices(column, 1 << 20):
        place, seed = anchors(data, offsets)
        keep = in_filter(repeats, seed)
        place, seed = place[keep], seed[keep]
        if not len(place):
            continue
        text = np.searchsorted(offsets, place, side="right") - 1
        left = np.minimum(place - offsets[text], REACH)
        right = np.minimum(offsets[text + 1] - place, LENGTH)
        at = place[:, None] + np.arange(-REACH, LENGTH)
        around = data[np.clip(at, 0, len(data) - 1)]
        blank(around, left, right)
        yield seed, left, right, around, row + text, place - offsets[text]


def blank(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Zero what lies beyond the ends."""
    at = np.arange(-REACH, LENGTH)
    around[(at < -left[:, None]) | (at >= right[:, None])] = 0


def sides(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, whether there is one) of the seed with the half before it, then with the half behind it."""
    for salt, lo, there in ((1, REACH - HALF, left >= HALF), (2, REACH, right >= SEED + HALF)):
        yield row_hashes(around[:, lo:lo + SEED + HALF], np.full(len(around), salt, np.uint64)), there


def side_counts(docs: DataFrame, spark: SparkSession, repeats: np.ndarray) -> DataFrame:
    """(seed, n): hashes of the longer strings around the anchors that may repeat, counted per batch."""
    shared = spark.sparkContext.broadcast(repeats)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [key[there] for _, left, right, around, _, _ in surroundings(batch.column(0), shared.value)
                     for key, there in sides(around, left, right)]
            key, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["seed", "n"])
    return docs.select("text").mapInArrow(count, "seed long, n long")


def tuples(docs: DataFrame, spark: SparkSession, repeats: np.ndarray, longer: np.ndarray) -> DataFrame:
    """(seed, left, right, around, docs, places): the anchors that may repeat, equal surroundings of a batch combined."""
    shared = spark.sparkContext.broadcast((repeats, longer))  # of fixed size

    def trimmed(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Without the anchors whose sides do not repeat, and only as far as windows over a repeating side reach."""
        seed, left, right, around, row, start = part
        before, behind = (there & in_filter(shared.value[1], key) for key, there in sides(around, left, right))
        left = np.where(behind & ~before, np.minimum(left, HALF), left)
        right = np.where(before & ~behind, np.minimum(right, LENGTH - HALF), right)
        keep = before | behind
        seed, left, right, around, row, start = (c[keep] for c in (seed, left, right, around, row, start))
        blank(around, left, right)
        return seed, left, right, around, row, start

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text_numbers = batch.column(2).to_numpy(zero_copy_only=False)
            parts = [trimmed(p) for p in surroundings(batch.column(1), shared.value[0])]
            if not sum(len(p[0]) for p in parts):
                continue
            seed, left, right, around, row, place = (np.concatenate(c) for c in zip(*parts))
            doc, place = ids[row], place + (text_numbers[row] << PART_BIT)
            same = distinct_rows(around, left, right)
            order = np.argsort(same, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
            head = order[first]
            edges = pa.array(np.append(first, len(order)), pa.int32())
            bytes_ = pa.py_buffer(np.ascontiguousarray(around[head]))
            marks = pa.py_buffer(np.arange(len(head) + 1, dtype=np.int32) * WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[head].view(np.int64)), pa.array(left[head], pa.int32()), pa.array(right[head], pa.int32()),
                 pa.Array.from_buffers(pa.binary(), len(head), [None, marks, bytes_]),
                 pa.ListArray.from_arrays(edges, pa.array(doc[order], pa.int64())),
                 pa.ListArray.from_arrays(edges, pa.array(place[order], pa.int64()))],
                names=["seed", "left", "right", "around", "docs", "places"])

    return docs.where("doc_id is not null").select("doc_id", "text", "part").mapInArrow(
        gather, "seed long, left int, right int, around binary, docs array<long>, places array<long>")


def row_hashes(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, begun with ``key``."""
    width = rows.shape[1]
    wide = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    words = wide.view(np.uint64)
    for j in range(words.shape[1]):
        key = mix(key * BASE + words[:, j])
    return key


def distinct_rows(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal surroundings and ends."""
    return row_hashes(around, mix(left.astype(np.uint64) * np.uint64(1000) + right.astype(np.uint64)))


def induce(around: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For distinct surroundings with the rank of their first place: whether the string that starts d bytes before the
    anchor (column d) also starts earlier, among the given ones."""
    n = len(around)
    flags = np.zeros((n, REACH + 1), bool)
    suffix = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    suffix[:, :LENGTH] = around[:, REACH:]
    columns = suffix.view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    common = np.zeros(n + 1, np.int64)  # with the suffix before; one more entry closes the last range
    same = around[order[1:], REACH:] == around[order[:-1], REACH:]
    common[1:n] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    last = np.iinfo(np.int64).max
    for d in range(REACH + 1):
        if d:
            front = around[order, REACH - d]
            turn = np.argsort(front, kind="stable")
            fresh = np.zeros(n + 1, np.int64)
            edges = np.flatnonzero(np.concatenate([[True], front[turn][1:] != front[turn][:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):  # one queue per byte
                if hi - lo > 1:
                    fresh[lo + 1:hi] = np.minimum.reduceat(common, turn[lo:hi] + 1)[:-1]
                    fresh[lo + 1:hi] += 1
            order, common = order[turn], np.minimum(fresh, LENGTH)
        starts = np.flatnonzero(common[:n] < LENGTH)
        valid = (left[order] >= d) & (right[order] >= LENGTH - d)
        own = np.where(valid, rank[order], last)
        earliest = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, n)))
        flags[order, d] = valid & (own > earliest)
    return flags


def marks_of(batch: pa.Table) -> pa.Table:
    """(doc_id, part, span): what is to be removed because of the tuples of whole seeds; span is start * 512 + length."""
    batch = batch.combine_chunks()
    left, right = batch["left"].to_numpy().astype(np.int64), batch["right"].to_numpy().astype(np.int64)
    around = buffers_of(batch["around"]).reshape(-1, WIDTH)
    key = distinct_rows(around, left, right)
    _, head, which = np.unique(key, return_index=True, return_inverse=True)
    docs, places = batch["docs"].combine_chunks(), batch["places"].combine_chunks()
    size = np.diff(docs.offsets.to_numpy())
    owner = np.repeat(which, size)
    doc, place = docs.flatten().to_numpy(), places.flatten().to_numpy()
    part, place = place >> PART_BIT, place & ((1 << PART_BIT) - 1)
    # equal (id, start) of several rows are one place: none of them is later than the other
    by = np.lexsort((place, doc))
    fresh = np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])])
    order = np.empty(len(by), np.int64)
    order[by] = fresh.cumsum()
    rank = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(rank, owner, order)
    left, right = left[head], right[head]
    flags = induce(around[head], left, right, rank)
    # a later place of equal surroundings repeats every string that fits
    later = order > rank[owner]
    near, far = np.maximum(LENGTH - right[owner], 0), left[owner]
    use = later & (far >= near)
    spans = [(doc[use], part[use], place[use] - far[use], far[use] - near[use] + LENGTH)]
    # the first place repeats the strings that were marked, in runs of neighbouring starts
    first = np.flatnonzero(~later)
    edge = np.diff(np.pad(flags[owner[first]], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    at = first[row]
    spans.append((doc[at], part[at], place[at] - hi + 1, hi - 1 - lo + LENGTH))
    doc, part, start, length = (np.concatenate(c) for c in zip(*spans))
    return pa.table({"doc_id": doc, "part": part, "span": start * 512 + length})


def buffers_of(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8)


def repeat_marks(tuples_: DataFrame) -> DataFrame:
    """(doc_id, part, span) of everything to remove, from tuples dealt and sorted by seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield from marks_of(table).to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                table = pa.Table.from_batches(held)
                seeds = table["seed"].to_numpy()
                cut = int(np.searchsorted(seeds, seeds[-1]))  # the last seed may go on
                if cut:
                    yield from settle(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows = table.num_rows - cut
        if held:
            yield from settle(pa.Table.from_batches(held))

    return tuples_.repartition("seed").sortWithinPartitions("seed").mapInArrow(run, "doc_id long, part long, span long")


def text_keys(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, part) of every row with an id, and (doc_id, k, part) of those whose id has several texts.

    ``k`` names the text, ``part`` numbers the texts of one id from 0.
    """
    keyed = scratch.keep(texts.where("doc_id is not null").select("doc_id", text_key(F.col("text")).alias("k")), "keyed")
    shared = keyed.groupBy("doc_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("doc_id")
    texts_of = scratch.keep(keyed.join(shared, "doc_id", "left_semi").distinct(), "shared")
    numbered = salted_number(texts_of, ["doc_id"], ["k"], "part").withColumn("part", F.col("part").cast("long"))
    several = scratch.keep(numbered.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "part"), "several")
    if several.isEmpty():
        return keyed.withColumn("part", F.lit(0).cast("long")), several
    found = keyed.join(several, (F.col("doc_id") == F.col("_id")) & (F.col("k") == F.col("_k")), "left")
    return found.select("doc_id", "k", F.coalesce("part", F.lit(0)).alias("part")), several


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_part(texts: DataFrame, several: DataFrame) -> DataFrame:
    """Add ``part`` to (doc_id, text); only texts of ids with several texts are named for it."""
    if several.isEmpty():
        return texts.withColumn("part", F.lit(0).cast("long"))
    ids = several.select(F.col("_id").alias("_shared")).distinct()
    named = texts.join(ids, F.col("doc_id") == F.col("_shared"), "left").withColumn(
        "k", F.when(F.col("_shared").isNotNull(), text_key(F.col("text"))))
    found = named.join(several, (F.col("doc_id") == F.col("_id")) & (F.col("k") == F.col("_k")), "left")
    return found.select("doc_id", "text", F.coalesce("part", F.lit(0)).alias("part"))


def whole_copies(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part) of the texts that a smaller id has too."""
    groups = keyed.groupBy(F.col("k").alias("_k")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return scratch.keep(keyed.join(groups, F.col("k") == F.col("_k")).where("doc_id > low").select("doc_id", "part").distinct(), "copies")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text bytes kept, n_bytes, n_removed, n_spans) of every document."""
    scratch = Scratch(spark, "suffixes")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed, several = text_keys(plain, scratch)
    texts = with_part(plain, several)
    copies = whole_copies(keyed, scratch)
    marked = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    first = texts.where("doc_id is not null").join(marked, ["doc_id", "part"], "left_anti")
    repeats = repeat_filter(seed_counts(first))
    longer = repeat_filter(side_counts(first, spark, repeats))
    marks = repeat_marks(tuples(first, spark, repeats, longer)).groupBy("doc_id", "part").agg(F.collect_list("span").alias("spans"))
    marks = marks.unionByName(copies.select("doc_id", "part", F.array(F.lit(WHOLE).cast("long")).alias("spans")))
    marks = scratch.keep(marks.select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), "spans"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            kept, removed, runs = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, spans in enumerate(batch.column(2)):
                own = data[offsets[i]:offsets[i + 1]]
                if spans.is_valid:
                    code = spans.values.to_numpy()
                    if code[0] == WHOLE:
                        gone = np.full(len(own), len(own) >= LENGTH)
                    else:
                        depth = np.zeros(len(own) + 1, np.int64)
                        np.add.at(depth, code // 512, 1)
                        np.add.at(depth, code // 512 + code % 512, -1)
                        gone = depth.cumsum()[:-1] > 0
                    removed[i] = gone.sum()
                    runs[i] = (gone & ~np.concatenate([[False], gone[:-1]])).sum()
                    own = own[~gone]
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = texts.join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("part") == F.col("_part")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
