"""Encoding of a corpus with a public tokenizer.

The vocabulary is loaded once on the driver and broadcast (about 2 MB, of fixed size). Texts stay where they were read:
one narrow stage, no shuffle, Arrow batches in and out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .bpe import DEFAULT_TOKENIZER, ByteBpe


@cache
def _vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


_shared: dict[tuple[str, str], object] = {}


def shared_vocabulary(spark: SparkSession, path: str = DEFAULT_TOKENIZER):
    """The vocabulary as a broadcast of this application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _shared:
        _shared[key] = spark.sparkContext.broadcast(_vocabulary(path))
    return _shared[key]


def _mapped(df: DataFrame, columns: list[str], schema: T.StructType, work: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.select(*columns).mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The columns `keep` of each row and, as `out`, the token ids of its text, special tokens excluded: their strings in
    a text are ordinary text.

    Null and empty texts give an empty list. Blank texts are encoded like any other. Repeated rows are encoded each;
    an empty table gives an empty table. Texts of any length are encoded whole. Columns not in `keep` are not read.
    """
    vocabulary = shared_vocabulary(df.sparkSession, tokenizer)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = vocabulary.value.encode(batch.column(batch.num_columns - 1).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, out])

    return _mapped(spread(df), [*keep, text], schema, work)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Like `encode_texts`, with the number of tokens in place of the ids; 0 for null and empty texts."""
    vocabulary = shared_vocabulary(df.sparkSession, tokenizer)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType(), False)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = vocabulary.value.count(batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*keep, out])

    return _mapped(spread(df), [*keep, text], schema, work)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The text that the ids stand for, bytes that are no UTF-8 as U+FFFD; null ids give null, unknown ids nothing."""
    vocabulary = shared_vocabulary(df.sparkSession, tokenizer)
    known: dict[int, bytes] = {}

    @F.pandas_udf("string")
    def decode(column):
        if not known:
            known.update(vocabulary.value.token_bytes())
        return column.map(lambda v: None if v is None else b"".join(known.get(i, b"") for i in v).decode("utf-8", "replace"))

    return df.withColumn(out, decode(F.col(ids)))
