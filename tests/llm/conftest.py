import pytest

EXTRA = ("id", "component", "label", "shard", "seed", "kept", "key", "rank", "score", "bucket", "n", "length", "_k", "_id", "_found", "ids")


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang]) tuples, with extra columns whose names operators use themselves."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", *["x"] * len(EXTRA)) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, "
                                     + ", ".join(f"`{c}` string" for c in EXTRA))
    return build


@pytest.fixture
def edge_docs(docs_of):
    """Nulls, empty, blank, short, very long and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, long), (7, long + " tail"), (7, long + " tail"),
                    (None, "no id at all"), (None, None), (8, "Ünïcode 日本語 text 😀 here"), (9, "\x00 nul \x1c byte")])
