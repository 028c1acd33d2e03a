"""Readers of corpora: lenient, loud and strict line-delimited JSON, JSON arrays, text in any encoding, archives."""

from __future__ import annotations

import json
import re
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

UTF16 = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}


def guess_encoding(head: bytes) -> str:
    """The encoding of a file by its first bytes: its mark, else UTF-16 where over a tenth are zero bytes (the side with
    more of them tells the order), else UTF-8 where it decodes but for a cut last character, else GB 18030."""
    if head[:2] in UTF16:
        return UTF16[head[:2]]
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head.count(0) > 0.1 * max(len(head), 1):
        return "utf-16-le" if head[1::2].count(0) >= head[0::2].count(0) else "utf-16-be"
    for cut in range(min(4, max(len(head), 1))):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "gb18030"


def decode_any(raw: bytes) -> str:
    """A file's text by trial: UTF-16 with a mark, then by its first bytes, bad characters replaced; marks are removed."""
    return raw.decode(guess_encoding(raw[:65536]), "replace").replace("﻿", "")


def json_lines(spark: SparkSession, path: str | list[str], key: str = "text") -> DataFrame:
    """(text, extra) of the lines of JSON files. Blank and broken lines are skipped, a bare string is its own text, other
    fields stay as JSON in `extra`. The parse is the JVM's; no schema is inferred."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    value = F.try_parse_json("value")
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.try_variant_get(value, f"$.{key}", "string"))
    return lines.where(value.isNotNull()).select(text.alias("text"), F.when(kind != "STRING", F.to_json(value)).alias("extra")).where("text is not null")


def json_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row (field, text) for each field that holds something, in the order of the fields."""
    held = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields)), lambda x: x.text.isNotNull() & (x.text != ""))
    return rows.select(F.explode(held).alias("x")).select("x.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that hold one JSON array, or an object with it under data or records."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", f"array<struct<{schema}>>")
    wrapped = F.from_json("value", f"struct<data: array<struct<{schema}>>, records: array<struct<{schema}>>>")
    rows = F.when(X.strip(F.col("value")).startswith("["), inner).otherwise(F.coalesce(wrapped["data"], wrapped["records"]))
    return whole.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(path, layout) of JSON files: array where the first printed character is a bracket, else lines."""
    head = F.ltrim(F.regexp_replace(F.make_valid_utf8(F.substring("content", 1, 4096).cast("string")), r"\A\s+", ""))
    return spark.read.format("binaryFile").load(path).select("path", F.when(head.startswith("["), "array").otherwise("lines").alias("layout"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Documents of text files that blank lines separate."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n\n")).alias("t")).select(X.strip(F.col("t")).alias("text")).where("text <> ''")


def text_files(spark: SparkSession, path: str | list[str], pattern: str = "*.txt") -> DataFrame:
    """(path, text) of all text files below a folder, each in its own encoding."""

    @F.pandas_udf(T.StringType())
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(decode_any)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", decoded("content").alias("text"))


def strict_json_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """(line, row, error): lines with exactly the given fields and types, and why others are rejected: unknown, missing or
    repeated fields, wrong types, no object. Repeated fields are invisible to the JVM's reader, so lines are parsed in
    Python."""
    kinds = {"string": str, "int": int, "double": float, "boolean": bool}

    def verdict(line: str) -> tuple[str | None, str | None]:
        def once(pairs):
            keys = [k for k, _ in pairs]
            if len(set(keys)) != len(keys):
                raise ValueError("repeated field")
            return dict(pairs)

        try:
            row = json.loads(line, object_pairs_hook=once)
        except ValueError as e:
            return None, "repeated field" if "repeated" in str(e) else "no JSON"
        if not isinstance(row, dict):
            return None, "no object"
        if set(row) != set(fields):
            return None, "other fields"
        for name, kind in fields.items():
            if type(row[name]) is not kinds[kind]:
                return None, f"type of {name}"
        return json.dumps(row, ensure_ascii=False, sort_keys=True), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [verdict(v) for v in batch["value"]]
            yield pd.DataFrame({"line": batch["value"], "row": [r for r, _ in found], "error": [e for _, e in found]})

    return spark.read.text(path).where("trim(value) <> ''").mapInPandas(run, "line string, row string, error string")


def loud_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files; a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def listed(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, size, modified) of the files at or below paths. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = files.option("pathGlobFilter", pattern) if pattern else files
    return files.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _opened(path: str, seekable: bool = False):
    """A file of any store as a stream; nothing of it is held but what is being read."""
    store, name = pa_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return store.open_input_file(name) if seekable else store.open_input_stream(name)


def _one_each(files: DataFrame) -> DataFrame:
    """Files in as many partitions as there are, up to four for each core: each is a stream of unknown length."""
    spark = files.sparkSession
    return files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)), "path")


def tar_members(spark: SparkSession, path: str, image: str = "png", batch: int = 64) -> DataFrame:
    """(path, stem, image, meta, orphans): pairs of adjacent members of one stem in tar files, in either order. Members
    without their partner are counted: the last row of each archive has no stem, and their number as `orphans`. Archives
    are read as streams, of which one batch of pairs is held at a time; archives of one stream each are the parallelism."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "stem", "image", "meta", "orphans"]
        for names in batches:
            for name in names["path"]:
                held: dict[str, bytes] = {}
                stem, rows, orphans = None, [], 0
                with _opened(name) as source, tarfile.open(fileobj=source, mode="r|*") as archive:
                    for member in archive:
                        if not member.isfile():
                            continue
                        base, _, suffix = member.name.rpartition(".")
                        if base != stem or suffix in held:
                            orphans += len(held)
                            held, stem = {}, base
                        if suffix in (image, "json"):
                            held[suffix] = archive.extractfile(member).read()
                        if len(held) == 2:
                            rows.append((name, stem, held[image], held["json"].decode("utf-8", "replace"), 0))
                            held, stem = {}, None
                            if len(rows) == batch:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                rows.append((name, None, None, None, orphans + len(held)))
                yield pd.DataFrame(rows, columns=columns)

    return _one_each(listed(spark, path).select("path")).mapInPandas(run, "path string, stem string, image binary, meta string, orphans long")


def tar_pairs(spark: SparkSession, path: str, image: str = "png") -> DataFrame:
    """(path, stem, image, meta) of the pairs of tar files."""
    return tar_members(spark, path, image).where("stem is not null").drop("orphans")


def tar_counts(spark: SparkSession, path: str, image: str = "png") -> DataFrame:
    """(path, pairs, orphans) of every archive."""
    return tar_members(spark, path, image).groupBy("path").agg(F.count("stem").alias("pairs"), F.sum("orphans").alias("orphans"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".jsonl", batch: int = 1000) -> DataFrame:
    """(unit, value): the lines of the members of zip files, with archive and member as unit; read as streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            for name in names["path"]:
                with _opened(name, seekable=True) as source, zipfile.ZipFile(source) as archive:
                    for member in sorted(n for n in archive.namelist() if n.endswith(suffix)):
                        with archive.open(member) as lines:
                            filled = (x for line in lines if (x := line.decode("utf-8", "replace").rstrip("\r\n")).strip())
                            while rows := list(islice(filled, batch)):
                                yield pd.DataFrame({"unit": f"{name}!{member}", "value": rows})

    return _one_each(listed(spark, path).select("path")).mapInPandas(run, "unit string, value string")


def units(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uid, path, member) of all units of work below paths in a fixed order: files, and the members of zip files. The uid
    depends on path and member alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            rows = []
            for name in names["path"]:
                if name.endswith(".zip"):
                    with _opened(name, seekable=True) as source, zipfile.ZipFile(source) as archive:
                        rows += [(name, m) for m in archive.namelist() if not m.endswith("/")]
                else:
                    rows.append((name, None))
            yield pd.DataFrame(rows, columns=["path", "member"])

    found = listed(spark, paths).select("path").mapInPandas(run, "path string, member string").distinct()
    uid = F.substring(F.sha2(F.concat_ws("!", "path", "member"), 256), 1, 16)
    return found.select(uid.alias("uid"), "path", "member").orderBy("path", "member")


# scans by format


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Documents of text files, one a line, stripped; blank lines are none."""
    return spark.read.text(path).select(X.strip(F.col("value")).alias("text")).where("text <> ''")


def parquet_column(spark: SparkSession, path: str | list[str], column: str = "text", limit: int | None = None) -> DataFrame:
    """One column of Parquet files as text, without nulls and empty texts; a missing column is an error of the plan. A
    limit ends the scan early: the limit is the feature."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col(column).cast("string").alias("text")).where("text is not null and text <> ''")
    return rows if limit is None else rows.limit(limit)


def wiki_dump(spark: SparkSession, root: str, date: str, lang: str, limit: int | None = None) -> DataFrame:
    """The texts of one dump of a wiki, in the folder `date`.`lang`."""
    return parquet_column(spark, f"{root}/{date}.{lang}/*.parquet", "text", limit)


def json_column(spark: SparkSession, path: str | list[str], column: str = "text", limit: int | None = None) -> DataFrame:
    """One field of line-delimited JSON as text; other fields are not parsed. Broken lines and empty fields are left out."""
    rows = spark.read.schema(f"`{column}` string").json(path).select(F.col(column).alias("text")).where("text is not null and text <> ''")
    return rows if limit is None else rows.limit(limit)


def long_documents(spark: SparkSession, path: str, column: str = "text", least: int = 1) -> DataFrame:
    """Documents of line-delimited JSON of at least so many characters."""
    return json_column(spark, path, column).where(F.length("text") >= least)


def bundle(spark: SparkSession, root: str, parts: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(part, field, text) of a set of named files: each of (name, kind, fields), kind lines, array or text."""

    def rows(name: str, kind: str, fields: list[str]) -> DataFrame:
        if kind == "text":
            return text_lines(spark, f"{root}/{name}").select(F.lit(name).alias("part"), F.lit("text").alias("field"), "text")
        schema = ", ".join(f"`{f}` string" for f in fields)
        read = json_array(spark, f"{root}/{name}", schema) if kind == "array" else spark.read.schema(schema).json(f"{root}/{name}")
        return json_fields(read, fields).select(F.lit(name).alias("part"), "field", "text")

    return reduce(DataFrame.unionByName, (rows(*part) for part in parts))


FORMATS = {"parquet": "parquet", "jsonl": "jsonl", "json": "jsonl", "ndjson": "jsonl", "txt": "txt", "text": "txt"}


def resolve_shards(spark: SparkSession, spec: str | list[str], suffixes: tuple[str, ...] = tuple(FORMATS)) -> list[str]:
    """The files that a folder, pattern, file or list of them names, sorted. A file that is named twice, two files of one
    base name and an empty result are errors. The listing is the driver's, of names only."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for part in [spec] if isinstance(spec, str) else spec:
        path = jvm.org.apache.hadoop.fs.Path(part)
        store = path.getFileSystem(conf)
        for status in store.globStatus(path) or []:
            if status.isDirectory():
                files = store.listFiles(status.getPath(), True)
                while files.hasNext():
                    name = files.next().getPath().toString()
                    if name.rpartition(".")[2] in suffixes and not name.rpartition("/")[2].startswith(("_", ".")):
                        found.append(name)
            else:
                found.append(status.getPath().toString())
    names = [f.rpartition("/")[2] for f in found]
    if len(set(found)) < len(found):
        raise ValueError("a file is named twice")
    if len(set(names)) < len(names):
        raise ValueError("two files have one name")
    if not found:
        raise ValueError(f"no files: {spec}")
    return sorted(found)


def infer_format(paths: list[str]) -> str:
    """The one format of files by their suffixes; several formats or an unknown one are errors."""
    kinds = {FORMATS.get(p.rpartition(".")[2].lower()) for p in paths}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(f"formats: {sorted(map(str, kinds))}")
    return kinds.pop()


def source_texts(spark: SparkSession, spec: str | list[str], column: str = "text", min_chars: int = 1, strip_urls: bool = False, keep_script: str | None = None) -> DataFrame:
    """The cleaned texts of a source of a mix, in whatever format its files are: text files are decoded by their own
    encoding, address lines and lines of other scripts go if asked, and texts below `min_chars` (1 at least) are dropped."""
    files = resolve_shards(spark, spec)
    kind = infer_format(files)
    if kind == "parquet":
        rows = parquet_column(spark, files, column)
    elif kind == "jsonl":
        rows = json_lines(spark, files, column).select("text")
    else:
        rows = text_files(spark, files).select(F.explode(F.split("text", r"\r\n?|\n")).alias("text"))
    text = F.col("text")
    text = X.strip_url_lines(text) if strip_urls else text
    text = X.keep_script_lines(text, keep_script) if keep_script else text
    return rows.select(X.strip(text).alias("text")).where(F.length("text") >= max(min_chars, 1))


def shard_indices(spec: str) -> list[int]:
    """Shard numbers of `a:b`, `a:b:step` or a comma list of numbers and ranges; repeated ones are an error."""
    found: list[int] = []
    for part in spec.split(","):
        bounds = [int(x) for x in part.split(":")]
        if len(bounds) > 3 or (len(bounds) == 3 and bounds[2] < 1):
            raise ValueError(f"no range: {part}")
        found += range(*bounds) if len(bounds) > 1 else bounds
    if len(set(found)) < len(found) or any(k < 0 for k in found):
        raise ValueError(f"repeated or negative shards: {spec}")
    return found


def dealt_shards(shards_: DataFrame, index: str, ranks: int, workers: int = 1) -> DataFrame:
    """(index, rank, worker): shards dealt to ranks in turn, then to the workers of each rank. With fewer shards than ranks
    every rank gets all of them, so that none is without data; no shards at all are an error."""
    n = shards_.count()
    if not n:
        raise ValueError("no shards")
    if n < ranks:
        every = shards_.select(index, F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
        return every.select(index, F.col("rank").cast("long").alias("rank"), F.pmod(F.col(index), F.lit(workers)).cast("long").alias("worker"))
    return shards_.select(index, F.pmod(F.col(index), F.lit(ranks)).cast("long").alias("rank"), F.pmod(F.floor(F.col(index) / ranks), F.lit(workers)).cast("long").alias("worker"))


def shuffled_rows(rows: DataFrame, key: str, seed: int, targets: str, frames: str) -> DataFrame:
    """Rows in a random order fixed by the seed, as `place`; rows whose target is longer than their frames are skipped."""
    return rows.where(F.col(targets) <= F.col(frames)).withColumn("place", F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string")), 256))


def shards(listing: DataFrame, excluded: list[int] = (), pattern: str = r"shard-(\d+)\.tar$", path: Column | str = "path") -> DataFrame:
    """(path, shard) of a listing in the order of the shard's number, without excluded ones and other files."""
    number = F.regexp_extract(path, pattern, 1)
    return listing.where(number != "").select("path", number.cast("long").alias("shard")).where(~F.col("shard").isin(*(excluded or [-1]))).orderBy("shard")
