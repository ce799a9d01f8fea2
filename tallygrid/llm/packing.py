"""Best-two-fit packing of token pieces into sequences of a fixed length.

Texts are tokenized where they are read. Packing itself needs only how many pieces have each length: that
histogram has at most ``capacity`` rows whatever the corpus size, and pieces of equal length are interchangeable.
The packer fills a bin greedily (the largest piece that fits, again and again), then tries to replace its smallest
piece by two unpacked ones that fit the widened gap more tightly. One such pattern is repeated as often as the
histogram allows, so the plan has a few rows per length. Pieces are numbered inside their length, with hot lengths
salted, and looked up in the plan.

Defined cases: a null or empty text is its end token alone. Repeated documents are packed once each; a document
longer than the capacity is cut into pieces of the capacity, the last one shorter. Extra columns are ignored. An
empty table gives an empty result. Ties are broken by document id and piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, salted_number

CAPACITY, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
MEMO_WORDS = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokens(dict):
    """Token ids, as little-endian 32-bit bytes, of text between blanks; remembers up to ``MEMO_WORDS`` such words.

    The vocabulary lower-cases, drops white space and never merges across it, so words stand alone. A word of
    plain Latin characters is split by the vocabulary's own pattern and merged by rank; any other goes to the
    tokenizer itself.
    """

    MARK = b"\xff"  # stands for the end-of-word suffix; never a byte of UTF-8

    def __init__(self, path: str):
        super().__init__()
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        pattern = next(p["pattern"]["Regex"] for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.parts = regex.compile(pattern).findall
        self.simple = regex.compile(r"[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        suffix = held["model"]["end_of_word_suffix"]
        ranks: dict[bytes, int] = {}
        for token, number in held["model"]["vocab"].items():
            closed = token.endswith(suffix) and len(token) > len(suffix)
            raw = bytes(byte_of[c] for c in (token[:-len(suffix)] if closed else token)) + (self.MARK if closed else b"")
            ranks.setdefault(raw, number)
        self.merge = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if not word:
            ids: list[int] = []
        elif self.simple(word):
            ids = [i for part in self.parts(word.lower()) for i in self.merge(part.encode() + self.MARK)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        held = np.array(ids, "<u4").tobytes()
        if len(self) < MEMO_WORDS:
            self[word] = held
        return held

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; ``ids`` is little-endian 32-bit.

    Read the vocabulary at ``path`` on every executor.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordTokens(path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 if with_ids else 5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memo.of(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(rows)])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, schema)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Plan for ``counts[length]`` pieces: (length, first rank, first sequence, offset) of runs of equal bins.

    Every run gives consecutive ranks of a length to consecutive sequences at the same offset. A run's bin count
    is the distance to the next run of that length.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    plan, sequence = [], 0
    largest = np.zeros(capacity + 1, np.int64)  # the largest length up to i that is left

    def refresh() -> None:
        np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0), out=largest)

    refresh()
    while largest[capacity]:
        taken: list[int] = []
        gap = capacity

        def take(n: int) -> None:
            left[n] -= 1
            if not left[n]:
                refresh()

        def give(n: int) -> None:
            left[n] += 1
            if left[n] == 1:
                refresh()

        while gap and largest[gap]:
            n = int(largest[gap])
            take(n)
            taken.append(n)
            gap -= n
        if gap and len(taken) > 1:
            smallest = taken[-1]
            room = gap + smallest
            # pairs a >= b with a + b <= room: the best b for every a, from what is left
            a = np.flatnonzero(left[:room] > 0)
            b = largest[np.minimum(room - a, a)]
            twice = (a == b) & (left[a] < 2)
            if twice.any():
                b = np.where(twice, largest[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > smallest:
                i = int(total.argmax())
                taken.pop()
                give(smallest)
                for n in (int(a[i]), int(b[i])):
                    take(n)
                    taken.append(n)
        lengths, need = np.unique(taken, return_counts=True)
        times = 1 + int((left[lengths] // need).min())
        left[lengths] -= need * (times - 1)
        refresh()
        offset = 0
        for n in taken:
            plan.append((n, int(used[n]), sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return plan


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, length, ...), as read from a written table."""
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in histogram:
        counts[length] = count
    plan = np.array(sorted(best_two_fit(counts, capacity)), np.int64).reshape(-1, 4)
    keys, first, sequence, offset = (plan[:, 0] << 44) + plan[:, 1], plan[:, 1], plan[:, 2], plan[:, 3]
    numbered = salted_number(pieces, ["length"], ["doc_id", "piece", "start"], "_rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*names, F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, schema)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token ids of each sequence in order, from packed pieces that carry ``ids``."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return grouped.select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"),
                          F.col("p.doc_id").alias("doc_ids"))


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, with_ids: bool = False,
                   capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack; see ``token_pieces`` and ``pack_pieces`` for the columns."""
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(token_pieces(docs, path or vocabulary_path(), capacity=capacity, with_ids=with_ids), "pieces")
    return pack_pieces(spark, pieces, capacity)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         "sequence_id", "offset")
