"""Shards of even size that keep linked documents together: balanced label propagation.

Links. Documents with equal texts are linked to the smallest id among them. Near copies are linked as well: a text's
word shingles give four bands of minima, and the texts of a band are linked to the band's smallest id, with less weight.
Start. Groups of equal texts of at least a sixteenth of a shard, of which there are at most 16 a shard, get their start
shards by room, largest first; all members start there. Every other document starts on a shard by hash, in proportion
to the room that is left, so what keeps groups together is propagation. In each round every document counts its neighbours' shards (a
join and a partial aggregate) and asks to move to the shard that holds most of them. Requests are admitted under
quotas: moves both ways between two shards may swap, and a shard takes more only while it has room below its capacity.
The quota table has one row per (from, to, gain class, hash cell), so its size is fixed by parameters. In even rounds
local maxima of degree stay where they are, so that two neighbours don't change places for ever; in odd rounds a random
half of the documents may move. Rounds end when two in a row admit nothing, or when the weight of links inside shards
has not risen for ``ROUNDS`` rounds. Documents without links then fill the shards up to equal counts.

Law: ``rows``. Shard counts differ by one at most. A large group of equal texts is cut if it is larger than a shard, or
if neither spreading the groups nor packing them first-fit finds a shard with room for it; its parts are as large as
fit. A small group is cut if the quotas leave no room where its other members are.

Defined cases: a null text counts as empty and is linked with other null or empty texts. Rows that repeat a document id
move together where room allows and are counted each. Rows without an id are placed like documents without links. Ties
between shards go to the smaller shard. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, salted_number
from .words import mix, shingle_hashes, slices, word_hashes

SHARDS, ROUNDS, CELLS, CLASSES = 8, 3, 64, 32
PLANNED = 16  # a group of at least this part of a shard starts where it fits whole
EQUAL, NEAR = 8, 1  # weights of links
WIDTH, BANDS = 5, 4


def _admit(requests: np.ndarray, held: np.ndarray, capacity: int) -> np.ndarray:
    """Lowest admitted order number for every (from, to), of ``requests`` counted by (from, to, order number)."""
    total = requests.sum(axis=2)
    allowed = np.minimum(total, total.T)
    room = np.maximum(capacity - held, 0)
    for to in range(len(held)):
        for source in np.argsort(-(total[:, to] - allowed[:, to]), kind="stable"):
            more = min(room[to], total[source, to] - allowed[source, to])
            allowed[source, to] += more
            room[to] -= more
    above = requests[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # requests of this order number or a higher one
    fits = above <= allowed[:, :, None]
    return np.where(fits.any(axis=2), fits.argmax(axis=2), requests.shape[2])


def propagate_labels(spark: SparkSession, links: DataFrame, capacity: int, scratch: Scratch, shards: int = SHARDS,
                     rounds: int = ROUNDS, starts: DataFrame | None = None, room: np.ndarray | None = None,
                     journal: list[tuple[int, int]] | None = None) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b, weight), at most about ``capacity`` ids a shard.

    ``starts`` (id, start) has the first label of ids, one row each; others start by hash, in proportion to ``room``.
    ``rounds`` is how many rounds in a row may bring nothing. ``journal`` gets (requests, admitted moves) of each round.
    """
    both = scratch.keep(links.select("a", "b", "weight").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "both")
    degree = scratch.keep(both.groupBy("a").agg(F.sum("weight").alias("degree")).select(F.col("a").alias("id"), "degree"), "degree")
    rank = F.struct("degree", F.xxhash64("id").alias("hash"))
    near = both.join(degree.select(F.col("id").alias("_n"), rank.alias("rank")), F.col("b") == F.col("_n"))
    above = near.groupBy("a").agg(F.max("rank").alias("top"))
    seeds = degree.join(above, F.col("id") == F.col("a")).select("id", (rank >= F.col("top")).alias("seed"))
    label = _by_hash(np.ones(shards, np.int64) if room is None or not room.sum() else room)
    if starts is not None:
        seeds = seeds.join(starts, "id", "left")
        label = F.coalesce("start", label)
    labels = scratch.keep(seeds.select("id", "seed", label.cast("int").alias("label")), "labels")
    quiet, stale, most = 0, 0, -1
    for turn in itertools.count():
        votes = both.join(labels.select(F.col("id").alias("_n"), F.col("label")), F.col("b") == F.col("_n")).groupBy("a").agg(
            *[F.sum(F.when(F.col("label") == j, F.col("weight")).otherwise(0)).alias(f"v{j}") for j in range(shards)])
        best = F.greatest(*[F.struct(F.col(f"v{j}").alias("votes"), F.lit(-j).alias("shard")) for j in range(shards)])
        own = F.element_at(F.array(*[F.col(f"v{j}") for j in range(shards)]), F.col("label") + 1)
        asked = labels.join(votes, F.col("id") == F.col("a")).withColumn("best", best).select(
            "id", "seed", "label", (-F.col("best.shard")).alias("to"), own.alias("own"), (F.col("best.votes") - own).alias("gain"))
        free = ~F.col("seed") if turn % 2 == 0 else F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        cell = F.pmod(F.xxhash64("id", F.lit(100 + turn)), F.lit(CELLS))
        order = (F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(CLASSES - 1)) * CELLS + cell).cast("int")
        asked = scratch.keep(asked.withColumn("order", F.when(free & (F.col("gain") > 0), order)), "asked")
        requests = np.zeros((shards, shards, CLASSES * CELLS), np.int64)
        for source, to, number, count in asked.where("order is not null").groupBy("label", "to", "order").count().collect():
            requests[source, to, number] = count
        held = np.zeros(shards, np.int64)
        inside = 0
        for label, count, weight in asked.groupBy("label").agg(F.count(F.lit(1)), F.sum("own")).collect():
            held[label] = count
            inside += weight
        stale = 0 if inside > most else stale + 1
        most = max(most, inside)
        least = _admit(requests, held, capacity)
        limit = F.element_at(F.array(*[F.lit(int(x)) for x in least.reshape(-1)]), F.col("label") * shards + F.col("to") + 1)
        moved = (np.arange(CLASSES * CELLS) >= least[:, :, None]) & (requests > 0)
        if journal is not None:
            journal.append((int(requests.sum()), int(requests[moved].sum())))
        quiet = 0 if moved.any() else quiet + 1
        if quiet == 2 or stale == rounds:
            break
        if moved.any():
            fresh = scratch.keep(asked.select("id", "seed", F.when(F.col("order") >= limit, F.col("to")).otherwise(F.col("label")).alias("label")), "labels")
            scratch.drop(labels, asked)
            labels = fresh
    return labels.select("id", "label")


def _by_hash(room: np.ndarray) -> Column:
    """A shard for ``id`` by hash, in proportion to the room of each."""
    at = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(int(room.sum())))
    label = F.lit(len(room) - 1)
    for j in reversed(range(len(room) - 1)):
        label = F.when(at < int(room[:j + 1].sum()), F.lit(j)).otherwise(label)
    return label


def even_shards(spark: SparkSession, rows: DataFrame, links: DataFrame, scratch: Scratch, shards: int = SHARDS,
                starts: DataFrame | None = None, room: np.ndarray | None = None, journal: list[tuple[int, int]] | None = None) -> DataFrame:
    """Add shard and slot to ``rows`` (doc_id, ...), read from a written table. Counts differ by one at most."""
    total = rows.count()
    labels = propagate_labels(spark, links, total // shards, scratch, shards, starts=starts, room=room, journal=journal)
    placed = rows.join(labels, F.col("doc_id") == F.col("id"), "left").drop("id")
    order = [c for c in rows.columns]
    target = targets(total, shards)
    linked = salted_number(placed.where("label is not null"), ["label"], order, "_rank")
    goal = F.element_at(F.array(*[F.lit(int(x)) for x in target]), F.col("label") + 1)
    held = scratch.keep(linked.withColumn("label", F.when(F.col("_rank") < goal, F.col("label"))).drop("_rank")
                        .unionByName(placed.where("label is null")), "held")
    taken = np.zeros(shards, np.int64)
    for label, count in held.where("label is not null").groupBy("label").count().collect():
        taken[label] = count
    ends = (target - taken).cumsum()
    loose = salted_number(held.where("label is null"), [], order, "_rank")
    fill = F.lit(shards - 1)
    for j in reversed(range(shards - 1)):
        fill = F.when(F.col("_rank") < int(ends[j]), F.lit(j)).otherwise(fill)
    done = scratch.keep(held.where("label is not null").select(*order, F.col("label").cast("int").alias("shard"))
                        .unionByName(loose.select(*order, fill.cast("int").alias("shard"))), "shards")
    return salted_number(done, ["shard"], order, "slot")


def targets(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)


def plan_groups(sizes: list[tuple[int, int]], target: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Where groups go, from how many there are (n) of each size (m): rows (m, low, high, at, to, shard).

    Members ``at`` to ``to`` of the groups of m members numbered ``low`` to ``high`` go to ``shard``; ends are excluded.
    Groups larger than a shard first fill empty shards. What is left of them and the other groups follow by size, spread
    over the shards or, if that leaves some without a shard, packed first-fit. Those that fit nowhere are cut.
    """
    def packed(spread: bool) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
        room, plan, items, left = [int(t) for t in target], [], [], []
        for m, n in sorted(sizes, reverse=True):
            if m <= max(target):
                items.append((m, m, 0, n, 0))
                continue
            for turn in range(n):
                at = 0
                while m - at > max(target) and max(room) >= min(target):
                    j = room.index(max(room))
                    plan.append((m, turn, turn + 1, at, at + room[j], j))
                    at, room[j] = at + room[j], 0
                items.append((m - at, m, turn, turn + 1, at))
        for size, m, low, high, at in sorted(items, reverse=True):
            while low < high:
                before = low
                share = -(-(high - low) // len(room)) if spread else high - low
                for j in sorted(range(len(room)), key=lambda j: -room[j] if spread else j):
                    n = min(share, high - low, room[j] // size)
                    if n:
                        plan.append((m, low, low + n, at, at + size, j))
                        low, room[j] = low + n, room[j] - n * size
                if low == before:
                    left.append((size, m, low, high, at))
                    break
        for size, m, low, high, at in left:
            for turn in range(low, high):
                start, end = at, at + size
                while start < end:
                    j = room.index(max(room))
                    n = min(room[j], end - start) or end - start
                    plan.append((m, turn, turn + 1, start, start + n, j))
                    start, room[j] = start + n, room[j] - n
        return sum(size * (high - low) for size, _, low, high, _ in left), plan

    lost, plan = packed(True)
    return min((lost, plan), packed(False), key=lambda p: p[0])[1] if lost else plan


def bands(texts: DataFrame) -> DataFrame:
    """(doc_id, band): ``BANDS`` keys of every text with words, each from the smallest shingle hashes of two parts of the hash range."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for lo, hi, data, offsets in slices(batch.column(1)):
                hashes, _, _, firsts = word_hashes(data, offsets)
                for i in np.flatnonzero(np.diff(firsts) > 0):
                    found = np.sort(shingle_hashes(hashes[firsts[i]:firsts[i + 1]], WIDTH))
                    # the smallest hash from the start of each part on; after the last one, the smallest of all
                    part = np.searchsorted(found, np.arange(2 * BANDS, dtype=np.uint64) << np.uint64(64 - (2 * BANDS - 1).bit_length()))
                    low = found[np.where(part < len(found), part, 0)].reshape(BANDS, 2)
                    rows.append(np.full(BANDS, lo + i))
                    keys.append(mix(mix(low[:, 0] + np.arange(BANDS, dtype=np.uint64)) + low[:, 1]))
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key.view(np.int64))], names=["doc_id", "band"])

    return texts.mapInArrow(sign, "doc_id long, band long")


def near_copy_links(texts: DataFrame) -> DataFrame:
    """Links (a, b, weight) of documents that share a band, each to the band's smallest id; more bands weigh more."""
    signed = bands(texts)
    hubs = signed.groupBy(F.col("band").alias("_b")).agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    met = signed.join(hubs, (F.col("band") == F.col("_b")) & (F.col("doc_id") != F.col("hub")))
    return met.groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg((F.count(F.lit(1)) * NEAR).alias("weight"))


def group_links(spark: SparkSession, rows: DataFrame, texts: DataFrame, scratch: Scratch,
                target: np.ndarray) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Links (a, b, weight), the starts (id, start) of the large groups' documents, and the room these leave.

    Equal ``text_key``: each document is linked to the smallest id of its group. In a group that is cut, documents are
    linked to the smallest id of their part, and that one to the group's. Near copies are looked for among the groups'
    smallest ids, so a text counts once.
    """
    named = rows.where("doc_id is not null").select("doc_id", "text_key")
    groups = scratch.keep(named.groupBy("text_key").agg(
        F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("m")), "groups")
    same = F.col("text_key") == F.col("_k")
    several = groups.where("hub < last").select(F.col("text_key").alias("_k"), "hub", "m")
    least = max(int(target.max()) // PLANNED, 2)
    large = scratch.keep(several.where(F.col("m") >= least), "large")
    small = named.join(several.where(F.col("m") < least).select("_k", "hub"), same).where("doc_id <> hub").select(
        F.col("doc_id").alias("a"), F.col("hub").alias("b"))

    # at most 16 large groups a shard
    plan = plan_groups([(r["m"], r["n"]) for r in large.groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect()], target)
    room = target.copy()
    for _, low, high, at, to, shard in plan:
        room[shard] = max(room[shard] - (high - low) * (to - at), 0)
    planned = F.broadcast(spark.createDataFrame(plan, "_m long, low long, high long, at long, to long, start int"))
    placed = scratch.keep(salted_number(large, ["m"], ["_k"], "turn").join(
        planned, (F.col("m") == F.col("_m")) & (F.col("turn") >= F.col("low")) & (F.col("turn") < F.col("high")))
        .select("_k", "hub", "m", "at", "to", "start"), "placed")
    whole = F.col("to") - F.col("at") == F.col("m")
    kept = named.join(placed.where(whole), same).select("doc_id", "hub", F.col("hub").alias("head"), "start")
    # the parts are few: less than two for each shard and size of group
    pieces = F.broadcast(placed.where(~whole))
    numbered = salted_number(named.join(F.broadcast(placed.where(~whole).select("_k").distinct()), same, "left_semi"),
                             ["text_key"], ["doc_id"], "number")
    dealt = scratch.keep(numbered.join(pieces, same & (F.col("number") >= F.col("at")) & (F.col("number") < F.col("to")))
                         .select("doc_id", "_k", "hub", "start"), "dealt")
    heads = dealt.groupBy(F.col("_k").alias("_g"), F.col("start").alias("_s")).agg(F.min("doc_id").alias("head"))
    cut = dealt.join(F.broadcast(heads), (F.col("_k") == F.col("_g")) & (F.col("start") == F.col("_s"))).select(
        "doc_id", "hub", "head", "start")
    members = scratch.keep(kept.unionByName(cut), "members")
    equal = small.unionByName(members.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))).unionByName(
        members.where("doc_id = head").select(F.col("head").alias("a"), F.col("hub").alias("b")))
    starts = members.groupBy(F.col("doc_id").alias("id")).agg(F.min("start").alias("start"))

    first = groups.select(F.col("hub").alias("_hub")).distinct()
    near = near_copy_links(texts.join(first, F.col("doc_id") == F.col("_hub"), "left_semi"))
    weighed = equal.where("a <> b").distinct().withColumn("weight", F.lit(EQUAL).cast("long")).unionByName(near)
    return weighed.groupBy("a", "b").agg(F.sum("weight").alias("weight")), starts, room


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, journal: list[tuple[int, int]] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("text_key")), "rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    links, starts, room = group_links(spark, rows, texts, scratch, targets(rows.count(), shards))
    done = even_shards(spark, rows, scratch.keep(links, "links"), scratch, shards, starts, room, journal)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                       F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(spark, spark.read.parquet(f"{folder}/documents.parquet"))
