"""Near-duplicate groups by circulant MinHash.

Two permutations make every signature coordinate: the first scatters shingles over a ring of slots, the second is
read from each slot onward, so coordinate k of a shingle is the second permutation shifted by k. A shingle's whole
signature is then one contiguous stretch of a table. Bands of the signature name buckets; documents of a bucket are
compared with the bucket's hub, which joins most of a group without listing its pairs. In buckets that still hold
several components, the members of different components are compared, block by block, and only links that join two
components come out. Links are confirmed by the exact Jaccard similarity of the full shingle sets. Documents with
equal sets are one class, represented by its smallest id.

Defined cases: a text without words is empty and linked with nothing; one with fewer words than the shingle width
is a single shingle. Repeated rows of one id are one document if their texts are equal; otherwise the row with the
larger set stands for the id. A row without an id is in no group. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .tables import Scratch
from .words import mix, shingle_hashes, slices, word_hashes

RING = 1 << 20
BANDS, ROWS = 32, 5  # a pair at similarity 0.8 meets in no band with probability 3e-6
SEED = 20240229
BLOCK_DOCS = 1024  # documents of a bucket that meet in one task: two blocks of as many at most

_tables: dict[tuple[int, int], np.ndarray] = {}


def second_permutation(size: int = BANDS * ROWS, ring: int = RING) -> np.ndarray:
    """The ring's permutation, continued past its end so that a stretch never wraps."""
    if (size, ring) not in _tables:
        order = np.random.Generator(np.random.PCG64(SEED)).permutation(ring).astype(np.uint32)
        _tables[size, ring] = np.concatenate([order, order[:size]])
    return _tables[size, ring]


def signature(shingles: np.ndarray, size: int = BANDS * ROWS, block: int = 2048) -> np.ndarray:
    """Circulant MinHash signature of one set of shingle hashes."""
    table = np.lib.stride_tricks.sliding_window_view(second_permutation(size), size)
    slots = (mix(shingles ^ np.uint64(SEED)) & np.uint64(RING - 1)).astype(np.int64)
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(slots), block):
        np.minimum(out, table[slots[lo:lo + block]].min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a column."""
    for lo, hi, data, offsets in slices(column):
        hashes, _, _, firsts = word_hashes(data, offsets)
        for i in range(hi - lo):
            h = np.sort(shingle_hashes(hashes[firsts[i]:firsts[i + 1]], width))
            yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, set_a, set_b, bands): set size, a 128-bit name of the set, and one hash per band."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(1, BANDS + 1, dtype=np.uint64)
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            names = np.zeros((2, batch.num_rows), np.uint64)
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            for i, found in enumerate(shingle_sets(batch.column(1), width)):
                count[i] = len(found)
                if len(found):
                    names[0, i] = mix(found).sum(dtype=np.uint64)
                    names[1, i] = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    rows = signature(found).reshape(BANDS, ROWS).astype(np.uint64)
                    key = turn
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
                    bands[i] = key
            flat = pa.array(bands.reshape(-1).view(np.int64))
            ends = pa.array(np.where(count > 0, BANDS, 0).cumsum(), pa.int32())
            kept = flat.filter(pa.array(np.repeat(count > 0, BANDS)))
            starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                 pa.ListArray.from_arrays(starts, kept)], names=["doc_id", "n", "set_a", "set_b", "bands"])

    return docs.mapInArrow(sign, "doc_id long, n long, set_a long, set_b long, bands array<long>")


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): sorted 64-bit hashes of the distinct shingles, packed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
    return docs.mapInArrow(pack, "doc_id long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = sets.select(F.col("doc_id").alias("_a"), F.col("shingles").alias("_x"))
    two = sets.select(F.col("doc_id").alias("_b"), F.col("shingles").alias("_y"))
    joined = pairs.join(one, F.col("a") == F.col("_a")).select("a", "b", "_x").join(two, F.col("b") == F.col("_b"))
    return joined.select("a", "b", "_x", "_y").mapInArrow(check, "a long, b long")


def compare_block(table: pa.Table, percent: int) -> pa.Table:
    """Links between the documents of one meeting of a bucket, enough to join all components that it can join."""
    table = table.combine_chunks()
    ids, component = table["doc_id"].to_numpy(), table["component"].to_numpy().copy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"].chunk(0)] if table.num_rows else []
    size = np.array([len(s) for s in sets])
    links = []
    order = np.argsort(size, kind="stable")
    ordered = size[order]
    for place, x in enumerate(order):
        # partners are no smaller, and no larger than the threshold allows
        last = int(np.searchsorted(ordered, size[x] * 100 // percent, side="right"))
        others = order[place + 1:last]
        for y in others[component[others] != component[x]]:
            if component[x] == component[y]:  # joined meanwhile
                continue
            at = np.searchsorted(sets[y], sets[x])
            common = int((sets[y][np.minimum(at, size[y] - 1)] == sets[x]).sum())
            if 100 * common >= percent * (size[x] + size[y] - common):
                links.append((ids[x], ids[y]))
                component[component == component[y]] = component[x]
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = scratch.keep(signatures(texts, width), "signed")
    named = signed.where(F.col("doc_id").isNotNull())
    classes = scratch.keep(named.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = named.join(classes.select(F.col("rep").alias("doc_id"), F.col("n").alias("_n"), F.col("set_a").alias("_sa"),
                                     F.col("set_b").alias("_sb")), "doc_id").where(
        (F.col("n") == F.col("_n")) & (F.col("set_a") == F.col("_sa")) & (F.col("set_b") == F.col("_sb")))
    spread = reps.select("doc_id", "n", F.explode("bands").alias("bucket")).distinct()
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("bucket").alias("_k"))
    members = scratch.keep(spread.join(shared, F.col("bucket") == F.col("_k")).select("bucket", "doc_id", "n"), "members")

    candidates = members.select(F.col("doc_id").alias("_id")).distinct()
    sets = scratch.keep(set_table(texts.join(candidates, F.col("doc_id") == F.col("_id"), "left_semi"), width)
                        .dropDuplicates(["doc_id", "shingles"]), "sets")
    # Round 1: every member is compared with the hub of its bucket.
    near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent  # a union is no smaller than its larger set
    hubs = members.groupBy(F.col("bucket").alias("_k")).agg(F.min("doc_id").alias("hub"), F.min_by("n", "doc_id").alias("hub_n"))
    pairs = members.join(hubs, (F.col("bucket") == F.col("_k")) & (F.col("doc_id") != F.col("hub")) & near)
    pairs = scratch.keep(pairs.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = scratch.keep(confirm(pairs, sets, percent), "links")
    labels = scratch.keep(connected_components(links, scratch), "labels")
    # Round 2: buckets whose members still lie in several components compare the members of different ones.
    known = labels.select(F.col("id").alias("_id"), "component")
    placed = scratch.keep(members.join(known, F.col("doc_id") == F.col("_id"), "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    # a bucket of two is done: its other member has met the hub
    state = placed.groupBy(F.col("bucket").alias("_k")).agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi and m > 2")
    parts = F.ceil(F.col("m") / BLOCK_DOCS).cast("int")
    rest = placed.join(state.select("_k", parts.alias("parts")), F.col("bucket") == F.col("_k")).select(
        "bucket", "doc_id", "component", "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int").alias("part"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(
        F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")))
    blocks = rest.withColumn("meet", F.explode(meets)).select("bucket", "meet.i", "meet.j", "doc_id", "component")
    held = blocks.join(sets.select(F.col("doc_id").alias("_a"), "shingles"), F.col("doc_id") == F.col("_a")).drop("_a")
    more = scratch.keep(held.groupBy("bucket", "i", "j").applyInArrow(
        lambda table: compare_block(table, percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        labels = scratch.keep(connected_components(links.unionByName(more), scratch), "labels")

    classed = classes.select(F.col("set_a").alias("_sa"), F.col("set_b").alias("_sb"), F.col("n").alias("_n"), "rep")
    classed = scratch.keep(classed.join(labels.select("id", "component"), F.col("rep") == F.col("id"), "left").select(
        "_sa", "_sb", "_n", F.coalesce("component", "rep").alias("component")), "classed")
    narrow = signed.select("doc_id", "n", "set_a", "set_b")
    joined = narrow.join(classed, (F.col("set_a") == F.col("_sa")) & (F.col("set_b") == F.col("_sb")) & (F.col("n") == F.col("_n"))
                         & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), width=2, percent=80)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sized AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
classes AS (SELECT min(doc_id) AS rep, any_value(n) AS n, k FROM (SELECT doc_id, n, list_sort(s) AS k FROM sized WHERE n > 0) GROUP BY k),
flat AS (SELECT rep, n, unnest(k) AS g FROM classes),
common AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common_n
  FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM common WHERE 100 * common_n >= 80 * (na + nb - common_n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT rep, rep FROM classes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
named AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, d.n AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, d.doc_id = coalesce(m.component, d.doc_id) AS kept
FROM sized d LEFT JOIN classes c ON c.k = list_sort(d.s) LEFT JOIN named m ON m.id = c.rep
"""
