"""Queries whose words are more than their segments of the vocabulary hold agree with their SQL, which numbers all words."""

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import tokens
from corpuskiln.plans import token_queries

from .compare import rows_of, rows_of_sql

#: Segments of a few words where SQL's begin, and such that meet.
SMALL = {"mn": (256, 258), "general": (24_576, 24_579)}
MEETING = {"mn": (256, 258), "general": (258, 261)}
FULL = {
    "token_a12_coverage": SMALL,
    "token_t15_completions": MEETING,
    "token_t5_round_trip": MEETING,
    "token_a13_round_trip_rate": MEETING,
    "token_t16_byte_targets": MEETING,
    "token_t8_vocabulary": SMALL,
    "token_a11_hit_report": MEETING,
    "token_a16_baselines": MEETING,
    "token_t4_spans": SMALL,
}


@pytest.mark.parametrize("name", FULL)
def test_full_segments(spark, duck, sf_dir, monkeypatch, name):
    monkeypatch.setattr(tokens, "SEGMENTS", FULL[name])
    assert rows_of(token_queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, token_queries.SQL[name])


def test_words_beyond_their_segment_have_tokens_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENTS", MEETING)
    rows = [(w, 9 - k) for k, w in enumerate(["ᠠ", "ᠡ", "ᠢ", "ᠣ"])] + [(w, 9 - k) for k, w in enumerate(["a", "b", "c", "d"])]
    known = tokens.running_vocabulary(spark.createDataFrame(rows, "word string, n long"))
    got = {r["word"]: (r["id"], r["token"]) for r in known.collect()}
    beyond = tokens.BEYOND
    assert got == {"ᠠ": (256, 256), "ᠡ": (257, 257), "ᠢ": (258, beyond), "ᠣ": (259, beyond + 2), "a": (258, 258), "b": (259, 259), "c": (260, 260), "d": (261, beyond + 1)}
    assert beyond > token_queries.END


@pytest.mark.parametrize("most", [0, 100])
def test_vocabularies_held_and_joined(spark, monkeypatch, most):
    monkeypatch.setattr(tokens, "HELD", most)
    texts = ["ᠮᠣᠩᠭᠣᠯ the cat", "é😀\x00 the", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    known = spark.createDataFrame([("the", 300), ("ᠮᠣᠩᠭᠣᠯ", tokens.BEYOND)], "word string, id long")
    ids = tokens.encode_ids(df, "k", "t", known)
    assert {r["k"]: r["ids"] for r in ids.collect()} == {0: [tokens.BEYOND, 32, 300, 32, *b"cat"], 1: [*"é😀\x00 ".encode(), 300]}
    assert {r["k"]: r["text"] for r in tokens.decode_ids(ids, "k", "ids", known).collect()} == {0: texts[0], 1: texts[1]}
    broken = spark.createDataFrame([(1, [300, 0xE2, 7, 5000, None]), (2, []), (3, None)], "k long, ids array<long>")
    assert {r["k"]: r["text"] for r in tokens.decode_ids(broken, "k", "ids", known).collect()} == {1: "the�\x07��", 2: "", 3: ""}
    assert tokens.encode_spans(df, "k", "t", known).where(F.element_at("ids", 1) >= 256).count() == 3


def test_large_vocabularies_go_row_by_row(spark):
    """What a GB of tables has of words is looked up; exploded and joined, its shuffles would be beyond the disk."""
    known = spark.range(605_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), (F.col("id") + 256).alias("id"))
    df = spark.createDataFrame([(1, "w0 w604999 w605000")], "k long, t string")
    ids = tokens.encode_ids(df, "k", "t", known)
    back = tokens.decode_ids(ids, "k", "ids", known)
    assert ids.first()["ids"] == [256, 32, 605_255, 32, *b"w605000"]
    assert back.first()["text"] == "w0 w604999 w605000"
    assert "posexplode" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_byte_targets_of_every_row_of_labels(spark):
    known = spark.createDataFrame([("ab", 300)], "word string, id long")
    rows = [[-100, -100, 300, 99, 0], [300, 99, 0, 5], [-100, -100], [], [None, -100, 300, 0], [0]]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, labels array<long>")
    got = {r["k"]: bytes(r["bytes"]) for r in tokens.byte_targets(df, "k", "labels", known).collect()}
    assert got == {0: b"abc", 1: b"abc", 2: b"", 3: b"", 4: b"ab", 5: b""}
    for bad in ([-100, 300, -100, 0], [300, -100], [300, None, 0], None):
        with pytest.raises(Exception, match="masked labels within a target"):
            tokens.byte_targets(spark.createDataFrame([(1, bad)], "k long, labels array<long>"), "k", "labels", known).collect()


@pytest.mark.parametrize("name", ["token_a11_hit_report", "token_a16_baselines"])
def test_reports_are_made_of_counted_segments(spark, sf_dir, name):
    """Occurrences are counted where they are cut; joined one by one, they are beyond the disk with a large vocabulary."""
    assert "posexplode" not in token_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
