"""Operators against brute force on small fixtures."""

import hashlib
import io
import json
import random
import re
import tarfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import morphology
from corpuskiln.functions import text as X
from corpuskiln.operators import chunks, components, dedup, joins, planning, scoring, sequence, tokens
from corpuskiln.plans import row_queries, table_queries
from corpuskiln.sources import readers, sinks
from corpuskiln.streaming import streams

ALPHABET = "aAé bᠠᠡ᠋ 文。\n\t .,1²x"


def texts(n=120, size=60, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)] + [None, "", " "]


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "k int, text string")
    return [r[1] for r in df.select("k", expression(X.text_of("text")).alias("v")).orderBy("k").collect()]


def test_strip_and_collapse_follow_python(spark):
    values = texts()
    assert column(spark, values, X.strip) == [(v or "").strip() for v in values]
    assert column(spark, values, X.collapse) == [re.sub(r"\s+", " ", v or "").strip() for v in values]


def test_web_normalize_follows_python(spark):
    def slow(t):
        t = re.sub("[​‌‍﻿­⁠]", "", unicodedata.normalize("NFKC", t or ""))
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t.replace("\r\n", "\n").replace("\r", "\n"))
        t = "\n".join(re.sub(r"[^\S\n]+", " ", x).strip() for x in t.split("\n"))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    values = [*texts(), "ａ１\r\nb\r\n\r\n\r\n\r\nc​d\x07"]
    assert column(spark, values, X.web_normalize) == [slow(v) for v in values]


def test_source_clean(spark):
    values = ["﻿ none ", "NaN", "a\nb\x07c", "é", None, "null x"]
    assert column(spark, values, X.source_clean) == ["", "", "a b c", "é", "", "null x"]


def test_mongolian_normalize(spark):
    line = "ᠮᠣᠩᠭᠣᠯ ᠪᠢᠴᠢᠭ"
    values = [f"# Page 12\n{line}  http://x.y/z ***\n\n\n版权所有 {line}\n=====\n{line} a.b@c.de\n", None, "short"]
    assert column(spark, values, X.mongolian_normalize) == [f"{line} *\n\n{line}", "", ""]


def test_native_spaces(spark):
    values = ["ᠠ ᠢ", "a ᠢ", "ᠠ b", "x y"]
    assert column(spark, values, X.native_spaces) == ["ᠠ ᠢ", "a ᠢ", "ᠠ b", "x y"]


def test_ngrams(spark):
    def slow(t, n):
        s = re.sub(r"\s+", "", t or "")
        grams = [s[i : i + n] for i in range(len(s) - n + 1)]
        return 1 - len(set(grams)) / len(grams) if len(s) >= n + 1 else 0.0

    values = texts()
    for n in (2, 3, 4):
        assert column(spark, values, lambda t, n=n: X.ngram_repeat_fraction(t, n)) == pytest.approx([slow(v, n) for v in values])


def test_split_text_keeps_everything_within_the_limit():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(1, 300)))
        parts = chunks.split_text(text, 20)
        if len(text) > 20:
            assert all(0 < len(p) <= 20 for p in parts)
            assert "".join("".join(parts).split()) == "".join(text.split())


def test_splits_words_paragraphs_and_slices():
    assert chunks.split_text("aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert chunks.split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunks.split_text("ab", 10) == ["ab"]


def test_prefix_sum_is_the_running_total_for_any_partitioning(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None]), rng.randint(0, 9)) for k in rng.sample(range(100_000), 500)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k long, g string, v long").repartition(parts)
        got = {r["k"]: r["before"] for r in sequence.prefix_sum(df, "k", F.col("v"), "before", ("g",)).collect()}
        want, sums = {}, {}
        for k, g, v in sorted(rows, key=lambda r: r[0]):
            want[k] = sums.get(g, 0)
            sums[g] = sums.get(g, 0) + v
        assert got == want
    assert sequence.prefix_sum(spark.createDataFrame([], "k long, v long"), "k", F.col("v"), "s").count() == 0


def test_next_fit():
    assert [p for p, _ in sequence.next_fit([3, 3, 4, 11, 2, 2], 8)] == [0, 0, 1, 2, 3, 3]
    assert list(sequence.next_fit([], 8)) == []


def test_token_windows_cover_every_neighbour(spark):
    rows = spark.createDataFrame([(n, n) for n in range(60)], "k long, n long")
    found = {}
    for r in sequence.token_windows(rows, "k", "n", 7).collect():
        found.setdefault(r["k"], []).append((r["token_start"], r["token_end"]))
    for n in range(1, 60):
        pairs = {(i, i + 1) for a, b in found[n] for i in range(a, b - 1)}
        assert pairs == {(i, i + 1) for i in range(n - 1)} and all(b - a <= 7 for a, b in found[n])


def test_plateau_stops_after_patience():
    steps = list(sequence.plateau(enumerate([5, 4, 3, 3, 3, 3, 3]), 1, 0, 0.0, 3))
    assert [s[4] for s in steps] == [False] * 5 + [True, True]


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(7)
    edges = {"chain": [(k, k + 1) for k in range(200)], "star": [(0, k) for k in range(1, 200)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]}[shape]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame([*edges, *edges[:5]], "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    sigs = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(4)] + [base[0]] * 3
    sigs = [s & (2**64 - 1) for s in sigs]
    signed = [s - 2**64 if s >= 2**63 else s for s in sigs]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, sig long")
    got = {(r["a"], r["b"], r["dist"]) for r in dedup.near_pairs(df, 6).collect()}
    want = {(i, j, d) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := (sigs[i] ^ sigs[j]).bit_count()) <= 6}
    assert got == want


def test_near_pairs_at_a_limit_that_does_not_divide_the_bits(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    sigs = [base, *(base ^ sum(1 << k for k in range(low, 64, 5)) for low in range(5)), base ^ sum(1 << k for k in (*range(0, 64, 5), 1))]
    for d in (13, 14, 15):
        sigs += [base ^ sum(1 << k for k in rng.sample(range(64), d)) for _ in range(20)]
    sigs = [s - 2**64 if s >= 2**63 else s for s in sigs]
    got = {(r["a"], r["b"], r["dist"]) for r in dedup.near_pairs(spark.createDataFrame(list(enumerate(sigs)), "doc_id long, sig long"), 14).collect()}
    want = {(i, j, d) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := ((sigs[i] ^ sigs[j]) & (2**64 - 1)).bit_count()) <= 14}
    assert {(0, 1, 13), (0, 6, 14)} <= want
    assert got == want


@pytest.mark.parametrize("limit", range(21))
def test_near_pairs_equal_brute_force_at_every_limit(spark, limit):
    """Among them, for every limit, a pair that differs in one bit of each band, and one in `limit` bits of one band."""
    rng = random.Random(limit)
    base = rng.getrandbits(64)
    sigs = [base, base ^ sum(1 << (k * 64 // max(limit, 1)) for k in range(limit)), base ^ ((1 << limit) - 1), base ^ ((1 << (limit + 1)) - 1)]
    sigs += [base ^ sum(1 << k for k in rng.sample(range(64), d)) for d in range(limit + 3) for _ in range(4)]
    sigs = [s - 2**64 if s >= 2**63 else s for s in sigs]
    df = spark.createDataFrame([*enumerate(sigs), (None, sigs[0]), (-1, None)], "doc_id long, sig long").coalesce(1)
    got = {(r["a"], r["b"], r["dist"]) for r in dedup.near_pairs(df, limit).collect()}
    assert got == {(i, j, d) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := ((sigs[i] ^ sigs[j]) & (2**64 - 1)).bit_count()) <= limit}


def test_band_plans_cover_the_limit():
    for limit in range(33):
        for n in (10, 10_000, 10_000_000):
            parts, radius = dedup.band_plan(limit, n)
            assert 2 <= parts <= 64 and parts * (radius + 1) > limit


def test_bands_hold_every_bit_once():
    for parts in range(2, 65):
        assert sorted(k for low, width in dedup.band_places(parts) for k in range(low, low + width)) == list(range(64))
        assert all(width for _, width in dedup.band_places(parts))


def test_first_independent_is_the_sequential_rule(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    kept = []
    for k in range(60):
        if not any((j, k) in pairs for j in kept):
            kept.append(k)
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = dedup.first_independent(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert sorted(r["node"] for r in got.where("kept").collect()) == kept


def test_simhash_votes():
    assert dedup.simhash([]) == 0
    assert dedup.simhash(["a", "b"]) == dedup.simhash(["a b"])
    assert dedup.simhash(list("abcdefgh")) != 0


def test_near_dedup_keeps_short_texts(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, long), (2, long + " x"), (3, "short"), (4, "short"), (5, None), (6, long)]
    got = {r["doc_id"]: r["reason"] for r in dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), limit=8).collect()}
    assert got[1] is None and got[3] is None and got[4] == "exact" and got[6] == "exact" and got[2] in (None, "near")


def test_box_join(spark):
    rng = random.Random(9)
    boxes = [(g, k, x, y, x + rng.randint(0, 90), y + rng.randint(0, 90)) for k in range(60) for g, x, y in [(rng.choice("ab"), rng.randint(-100, 100), rng.randint(-100, 100))]]
    df = spark.createDataFrame(boxes, "g string, id long, x0 int, y0 int, x1 int, y1 int")
    got = {(r["g"], r["a_id"], r["b_id"], r["area"], r["inside"]) for r in joins.box_join(df, df, ["g"], cell=32).collect()}
    want = set()
    for a in boxes:
        for b in boxes:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[0] == b[0] and w > 0 and h > 0:
                want.add((a[0], a[1], b[1], w * h, a[2] <= b[2] and a[3] <= b[3] and b[4] <= a[4] and b[5] <= a[5]))
    assert got == want


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_minimal_and_spells_both_sides():
    rng = random.Random(6)
    for _ in range(300):
        p, r = ("".join(rng.choice("abᠠ") for _ in range(rng.randint(0, 8))) for _ in range(2))
        steps = scoring.align(p, r)
        assert sum(s[0] != "match" for s in steps) == slow_distance(p, r)
        assert "".join(s[1] or "" for s in steps) == r and "".join(s[2] or "" for s in steps) == p
    assert [s[0] for s in scoring.align("ab", "b")] == ["insertion", "match"]


def test_error_rates(spark):
    rng = random.Random(8)
    rows = [("x", "".join(rng.choice("ab᠋ᠠ ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab᠋ᠠ ") for _ in range(rng.randint(0, 12)))) for _ in range(60)] + [("x", None, "")]
    got = scoring.error_rates(spark.createDataFrame(rows, "g string, pred string, ref string"), ["g"]).first()
    fold = lambda t: (t or "").replace("᠋", "")
    clusters = lambda t: re.findall("(?s).᠋*", t or "")
    for name, unit in (("cer", lambda t: t or ""), ("folded_cer", fold), ("grapheme_cer", clusters), ("wer", lambda t: fold(t).split())):
        top = sum(slow_distance(unit(p), unit(r)) for _, p, r in rows)
        assert got[name] == pytest.approx(top / sum(max(len(unit(r)), 1) for _, _, r in rows), abs=1e-6)


def test_bootstrap_is_reproducible(spark):
    import numpy as np

    rows = {"x": np.array([[1, 2, 10], [3, 1, 12], [0, 0, 9]])}
    a = [r["delta"] for r in scoring.paired_bootstrap(spark, rows, {"x": 1.0}, 50).orderBy("resample").collect()]
    seed = '{"bucket":"x","resample":0,"schema_version":1,"seed":42}'
    draw = scoring.lcg_draws(seed, scoring.lcg_jumps(3), 3)
    state, steps = int(hashlib.sha256(seed.encode()).hexdigest()[:16], 16), []
    for _ in range(3):
        state = (6364136223846793005 * state + 1442695040888963407) % 2**64
        steps.append(state % 3)
    assert draw.tolist() == steps
    left, right, units = rows["x"][draw].sum(axis=0)
    assert a[0] == left / units - right / units and len(set(a)) > 1


def test_rectangles_and_windows():
    rng = random.Random(3)
    for _ in range(50):
        boxes = [(x, y, x + rng.randint(0, 6), y + rng.randint(0, 6)) for _ in range(5) for x, y in [(rng.randint(0, 9), rng.randint(0, 9))]]
        cells = [(i, j) for b in boxes for i in range(b[0], b[2]) for j in range(b[1], b[3])]
        assert planning.union_and_overlap(boxes) == (len(set(cells)), len({c for c in cells if cells.count(c) > 1}))
    plan = planning.window_plan(1000, 700, 14, 100)
    assert planning.union_and_overlap(plan) == (700_000, 0)
    with pytest.raises(ValueError):
        planning.window_plan(10_000, 10_000, 1, 4, limit=10)


def test_quota_cycle_closes():
    assert sorted(table_queries.CYCLE) == sorted(b for b, n in table_queries.QUOTAS.items() for _ in range(n))


def test_guess_encoding():
    assert readers.guess_encoding("﻿x".encode("utf-16-le")) == "utf-16-le"
    assert readers.guess_encoding("abc".encode("utf-16-be")) == "utf-16-be"
    assert readers.guess_encoding("文字".encode()[:-1]) == "utf-8"
    assert readers.guess_encoding("中文网页".encode("gb18030")) == "gb18030"
    assert readers.guess_encoding(b"") == "utf-8"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n\nbroken\n"bare"\n{"other": 2}\n')
    assert sorted(r["text"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["bare", "x"]
    (tmp_path / "b.json").write_text('{"data": [{"t": "p"}, {"t": "q"}]}')
    (tmp_path / "c.json").write_text('\n [{"t": "r"}]')
    assert sorted(r["t"] for f in "bc" for r in readers.json_array(spark, str(tmp_path / f"{f}.json"), "t string").collect()) == ["p", "q", "r"]
    assert {r["path"][-6:]: r["layout"] for r in readers.layout(spark, str(tmp_path / "*.json")).collect()} == {"b.json": "lines", "c.json": "array"}
    (tmp_path / "d.txt").write_bytes("ᠮᠣᠩ\nx".encode("utf-16"))
    assert [r["text"] for r in readers.text_files(spark, str(tmp_path)).collect()] == ["ᠮᠣᠩ\nx"]
    (tmp_path / "e.text").write_text("one\ntwo\n\n\n\n three ")
    assert [r["text"] for r in readers.paragraphs(spark, str(tmp_path / "e.text")).collect()] == ["one\ntwo", "three"]
    (tmp_path / "f.jsonl").write_text('{"a": 1}\n{"a": 1, "a": 2}\n{"a": true}\n{"b": 1}\n[1]\n{')
    errors = [r["error"] for r in readers.strict_json_lines(spark, str(tmp_path / "f.jsonl"), {"a": "int"}).collect()]
    assert errors == [None, "repeated field", "type of a", "other fields", "no object", "no JSON"]


def test_tar_pairs(spark, tmp_path):
    with tarfile.open(tmp_path / "shard-1.tar", "w") as archive:
        for name, data in (("a.png", b"1"), ("a.json", b"{}"), ("b.json", b"[]"), ("c.json", b"{}"), ("c.png", b"3"), ("d.png", b"4")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    got = [(r["stem"], bytes(r["image"])) for r in readers.tar_pairs(spark, str(tmp_path / "shard-1.tar")).collect()]
    assert got == [("a", b"1"), ("c", b"3")]
    listing = spark.createDataFrame([(f"x/shard-{n}.tar",) for n in (10, 9, 2)] + [("y.txt",)], "path string")
    assert [r["shard"] for r in readers.shards(listing, [9]).collect()] == [2, 10]


def test_receipts(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(10).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"))
    sinks.write_text_lines(df.coalesce(2), path)
    contract = sinks.receipt(spark, path, rows=10)
    assert sinks.verify(spark, path, contract) == []
    assert sinks.verify(spark, path, contract | {"rows": 11}) == ["the contract's own digest"]
    sinks.publish(contract, str(tmp_path / "contract.json"))
    assert json.loads((tmp_path / "contract.json").read_text()) == contract
    with pytest.raises(FileExistsError):
        sinks.publish(contract, str(tmp_path / "contract.json"))
    sinks.write_row_shards(df, str(tmp_path / "shards"), "id", 4)
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().orderBy("shard").collect()] == [4, 4, 2]


def test_all_boxes_are_joined(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k // 7, k % 7 + 1, rng.randint(1, 2), rng.randint(0, 60), float(rng.randint(1, 40)), rng.choice("ANR")) for k in range(70)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, table_queries.join_j14_boxes(spark, str(tmp_path)).collect()))
    boxes = [(g, o * 10 + n, p, o, p + int(q), round(o + q / 2)) for o, n, g, p, q, _ in rows]
    want = []
    for a in boxes:
        for b in boxes:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[0] == b[0] and w > 0 and h > 0:
                want.append((a[0], a[1], b[1], w * h, a[2] <= b[2] and a[3] <= b[3] and b[4] <= a[4] and b[5] <= a[5]))
    assert got == sorted(want)


def test_schedule_goes_on_in_later_epochs(spark):
    sizes = {"print": 7, "handwritten_good": 50, "handwritten_medium": 1}
    ids = {b: [f"{b}-{k}" for k in range(n)] for b, n in sizes.items()}
    df = spark.createDataFrame([(b, i) for b, held in ids.items() for i in held] * 2 + [(None, "x")], "quota_buckets string, sample_id string")
    got = {r["draw"]: (r["bucket"], r["epoch"], r["sample_id"]) for r in table_queries.quota_schedule(df, 100).collect()}
    drawn, want = dict.fromkeys(table_queries.QUOTAS, 0), {}
    for draw in range(100):
        bucket = table_queries.CYCLE[draw % 20]
        if bucket in sizes:
            epoch, at = divmod(drawn[bucket], sizes[bucket])
            order = sorted(ids[bucket], key=lambda i: (hashlib.sha256("\0".join(["7", bucket, str(epoch), i, "order"]).encode()).hexdigest(), i))
            want[draw] = (bucket, epoch, order[at])
        else:
            want[draw] = (bucket, None, None)
        drawn[bucket] += 1
    assert got == want


def test_components_by_pixel_and_cluster_and_locks(spark, tmp_path):
    sources = [(k, f"d{k}", f"c{k}", None) for k in "abcefghx"] + [("i", "d-lock", "ci", None), ("j", None, None, None)]
    reviews = [("a", "px"), ("b", "px"), ("g", "py"), ("h", "py"), ("orphan", "px"), ("x", None)]
    samples = [(k, s, (f"d{k}", f"c{k}", None, n)) for k, s, n in [("b", "kl_selection", "n1"), ("c", None, "n1"), ("e", None, "n2"), ("f", None, "n2"), ("g", "train", None), ("h", "formal_monitor", None)]]
    samples.append(("z", "sft_validation", ("d-lock", None, None, None)))
    for name, rows, schema in (
        ("sources", sources, "sample_id string, source_document_id string, source_capture_id string, writer_id string"),
        ("reviews", reviews, "sample_id string, canonical_pixel_sha256 string"),
        ("samples", samples, "sample_id string, split string, group_ids struct<document_id:string,capture_id:string,writer_id:string,near_duplicate_cluster:string>"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["sample_id"]: r for r in row_queries.split_d7_components(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted("abcefghijx")
    groups = {}
    for k, r in got.items():
        groups.setdefault(r["component"], set()).add(k)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["e", "f"], ["g", "h"], ["i"], ["j"], ["x"]]
    assert {(got[k]["split"], got[k]["origin"]) for k in "abc"} == {("kl_selection", "lock")}
    assert {(got[k]["split"], got[k]["origin"]) for k in "gh"} == {(None, "conflict")}
    assert (got["i"]["split"], got["i"]["origin"]) == ("sft_validation", "lock")
    assert all(got[k]["origin"] == "hash" and got[k]["split"] for k in "efjx")


def test_truncation_spares_spans(spark):
    rows = [([0, 40, 1, 41, 2, 40, 3, 4, 41, 5], 7), ([0, 40, 1, 41], 4), ([0, 40, 1, 41, 2], 4), ([40, 1, 2, 3], 2), ([41, 1, 40, 40, 2, 41, 3, 41, 4], 6), ([0, 1, 2], 2)]
    want = [([0, 40, 1, 41, 2], [(1, 4)]), ([0, 40, 1, 41], [(1, 4)]), ([0, 40, 1, 41], [(1, 4)]), ([], []), ([41, 1], []), ([0, 1], [])]
    for (c, limit), (kept, spans) in zip(rows, want):
        df = spark.createDataFrame([(c,)], "c array<int>").withColumn("s", sequence.bracket_spans(F.col("c"), 40, 41))
        payloads = F.transform("s", lambda s: s.start)
        r = df.select(sequence.truncated(F.col("c"), F.col("s"), payloads, limit).alias("r")).first()["r"]
        assert (r["c"], [tuple(s) for s in r["spans"]], r["payloads"]) == (kept, spans, [s for s, _ in spans])


def test_truncation_of_overlapping_spans(spark):
    df = spark.createDataFrame([(list(range(12)), [(2, 5), (4, 9)], ["a", "b"])], "c array<int>, s array<struct<start:int,end:int>>, p array<string>")
    r = df.select(sequence.truncated(F.col("c"), F.col("s"), F.col("p"), 8).alias("r")).first()["r"]
    assert (r["c"], r["spans"], r["payloads"]) == ([0, 1], [], [])


def test_archives_are_read_as_streams(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with tarfile.open(tmp_path / "shard-3.tar", "w") as archive:
        for name in ("a.png", "a.json", "b.json", "b.png", "c.png", "d.json", "d.json", "d.png", "e.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            archive.addfile(info, io.BytesIO(b"{}"))
    path = str(tmp_path / "*.tar")
    assert sorted(r["stem"] for r in readers.tar_pairs(spark, path).collect()) == ["a", "b", "d"]
    assert [(r["pairs"], r["orphans"]) for r in readers.tar_counts(spark, path).collect()] == [(3, 2)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("x.jsonl", "1\n\n2\n")
        archive.writestr("y.txt", "3")
    lines = readers.zip_members(spark, str(tmp_path / "z.zip"), batch=1).collect()
    assert [r["value"] for r in lines] == ["1", "2"] and lines[0]["unit"].endswith("z.zip!x.jsonl")
    found = readers.units(spark, [str(tmp_path)]).collect()
    assert [(r["path"].rpartition("/")[2], r["member"]) for r in found] == [("shard-3.tar", None), ("z.zip", "x.jsonl"), ("z.zip", "y.txt")]
    assert [r["uid"] for r in found] == [r["uid"] for r in readers.units(spark, [str(tmp_path)]).collect()]


def test_shard_specs(spark, tmp_path):
    for name in ("a/x.jsonl", "a/y.jsonl", "b/x.jsonl", "a/_SUCCESS", "c/t.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"text": "t"}\n')
    names = lambda spec: [f.rpartition("/")[2] for f in readers.resolve_shards(spark, spec)]
    assert names(f"{tmp_path}/a") == ["x.jsonl", "y.jsonl"] == names([f"{tmp_path}/a/y.*", f"{tmp_path}/a/x.jsonl"])
    for spec in ([f"{tmp_path}/a", f"{tmp_path}/a/x.jsonl"], [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/none*"):
        with pytest.raises(ValueError):
            readers.resolve_shards(spark, spec)
    assert readers.infer_format(["x.txt", "y.TXT"]) == "txt"
    with pytest.raises(ValueError):
        readers.infer_format(["x.txt", "y.parquet"])
    assert readers.shard_indices("0:6:2,9") == [0, 2, 4, 9] and readers.shard_indices("3") == [3]
    for spec in ("1,0:3", "0:4:0", "-1"):
        with pytest.raises(ValueError):
            readers.shard_indices(spec)


def test_source_texts_of_every_format(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("ᠮᠣᠩ one\r\nhttps://x.invalid\r\n\r\nab".encode("utf-16"))
    got = [r["text"] for r in readers.source_texts(spark, str(tmp_path / "t"), min_chars=3, strip_urls=True).collect()]
    assert got == ["ᠮᠣᠩ one"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"text": " x "}\n"bare"\nbroken\n{"text": ""}\n')
    assert sorted(r["text"] for r in readers.source_texts(spark, str(tmp_path / "j")).collect()) == ["bare", "x"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.json").write_text('{"data": [{"q": "1", "a": "2"}, {"q": "", "a": "3"}]}')
    (tmp_path / "b" / "t.txt").write_text("line\n\n")
    rows = readers.bundle(spark, str(tmp_path / "b"), [("p.json", "array", ["q", "a"]), ("t.txt", "text", [])])
    assert sorted((r["part"], r["field"], r["text"]) for r in rows.collect()) == [("p.json", "a", "2"), ("p.json", "a", "3"), ("p.json", "q", "1"), ("t.txt", "text", "line")]


def test_fewer_shards_than_ranks_are_given_to_all(spark):
    three = spark.range(3).withColumnRenamed("id", "i")
    assert {(r["i"], r["rank"]) for r in readers.dealt_shards(three, "i", 5, 2).collect()} == {(i, k) for i in range(3) for k in range(5)}
    assert {(r["i"], r["rank"], r["worker"]) for r in readers.dealt_shards(three, "i", 2, 2).collect()} == {(0, 0, 0), (1, 1, 0), (2, 0, 1)}
    with pytest.raises(ValueError):
        readers.dealt_shards(three.limit(0), "i", 2)


def test_rotation_and_states_and_reports(spark, tmp_path):
    assert list(sinks.rotated([5, 5, 5, 50, 1, 1, 1, 1], 3, 12)) == [0, 0, 1, 2, 3, 3, 3, 4]
    shards = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "s string, n int")
    marks = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4), ("d", 4)], "s string, n int")
    states = {r["s"]: r["state"] for r in sinks.shard_states(shards, marks.union(spark.createDataFrame([("z", 1)], marks.schema)), ["s"], ["n"]).collect()}
    assert states == {"a": "complete", "b": "changed", "c": "complete", "d": "several"}
    assert sinks.shard_states(shards, marks.limit(0), ["s"], ["n"]).where("state = 'missing'").count() == 4
    path = f"file://{tmp_path}/report.json"
    sinks.write_report(spark, {"b": 1, "a": "ä"}, path)
    assert (tmp_path / "report.json").read_bytes() == '{"a":"ä","b":1}'.encode()
    with pytest.raises(FileExistsError):
        sinks.write_report(spark, {}, path)
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    one, other = (sinks.listing_signature(f, seed=s).first()["signature"] for f, s in ((files, 1), (files.repartition(2).orderBy("size"), 1)))
    assert one == other != sinks.listing_signature(files, seed=2).first()["signature"]
    assert sinks.listing_signature(files.limit(0)).first()["n_files"] == 0


def test_two_tracks_round_trip(spark):
    texts = ["ᠮᠣᠩᠭᠣᠯ ᠪᠢᠴᠢᠭ ᠦᠨ the cat, the cat!", "the\n\tcat 漢字 é😀", "", None, " ", "ᠮᠣᠩᠭᠣᠯ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = spark.createDataFrame([("the", 3), ("cat", 3), ("ᠮᠣᠩᠭᠣᠯ", 2), ("rare", 1)], "word string, n long")
    known = tokens.unified_vocabulary(counts, 2)
    assert {(r["word"], r["id"]) for r in known.collect()} == {("cat", 24576), ("the", 24577), ("ᠮᠣᠩᠭᠣᠯ", 256)}
    assert tokens.round_trips(df, "doc_id", "text", known).where("same").count() == 6
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode_ids(df, "doc_id", "text", known).collect()}
    assert set(ids) == {0, 1, 4, 5} and ids[5] == [256] and ids[4] == [32] and ids[1][:3] == [24577, 10, 9]
    spans = [r for r in tokens.encode_spans(df, "doc_id", "text", known).where("doc_id = 0").orderBy("at").collect()]
    assert "".join(r["piece"] for r in spans) == texts[0] and [r["track"] for r in spans][:3] == ["mn", "general", "mn"]
    assert all(a["end"] == b["start"] for a, b in zip(spans, spans[1:])) and spans[0]["start"] == 0
    report = {r["track"]: r for r in tokens.hit_report(tokens.encode_spans(df, "doc_id", "text", known)).collect()}
    assert report["mn"]["word_hits"] == 2 and report["mn"]["n_pieces"] == 3


def test_decoding_of_completions(spark):
    known = spark.createDataFrame([("ab", 300), ("c", 301)], "word string, id long")
    rows = [(1, [300, 0xE2, 0x82, 0xAC, 301]), (2, [300, 0xE2, 7]), (3, [300, 5000]), (4, [300, 2, 301]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "k long, ids array<long>")
    got = {r["k"]: r["text"] for r in tokens.decode_ids(df, "k", "ids", known).collect()}
    assert got == {1: "ab€c", 2: "ab�\x07", 3: "ab�", 4: "ab\x02c", 5: "", 6: ""}
    ended = {r["k"]: r["text"] for r in tokens.decode_ids(df, "k", "ids", known, eos=2, unfinished=True).collect()}
    assert ended[4] == "ab" and ended[1] == "ab€c�" and ended[6] == "�"
    chunks = spark.createDataFrame([(1, [b"a\xe2", b"\x82", b"\xacb"]), (2, [b"\xe2"]), (3, None)], "k long, c array<binary>")
    assert {r["k"]: r["pieces"] for r in tokens.stream_decode(chunks, "k", "c").collect()} == {1: ["a", "", "€b"], 2: ["", "�"], 3: []}


def test_a_full_segment_raises(spark):
    counts = spark.range(40_961).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("n"))
    with pytest.raises(Exception, match="full"):
        tokens.unified_vocabulary(counts).collect()
    assert tokens.unified_vocabulary(counts.where("id > 0")).agg(F.max("id")).first()[0] == 65_535


def test_merges_keep_to_boundaries(spark):
    merges = [("a", "b"), ("ab", "a"), ("c", "d"), ("ab", "cd"), ("a", "᠋")]
    ranks = {pair: k for k, pair in enumerate(merges)}
    assert tokens.constrained_merges("ababcd", ranks) == ["ab", "abcd"]
    assert tokens.constrained_merges("abcd", ranks) == ["abcd"]
    assert tokens.constrained_merges("abcd", ranks, frozenset({2})) == ["ab", "cd"]
    assert tokens.constrained_merges("a᠋b", ranks) == ["a", "᠋", "b"]
    assert tokens.constrained_merges("", ranks) == []
    words = spark.createDataFrame([("abcd", [2]), ("abcd", [2]), ("aba", [1]), (None, None)], "word string, cuts array<int>")
    got = tokens.encode_words(words, merges, cuts="cuts")
    assert {r["word"]: r["tokens"] for r in got.collect()} == {"abcd": ["ab", "cd"], "aba": ["a", "b", "a"]}
    joined = got.join(words.distinct().withColumnRenamed("cuts", "boundaries"), "word")
    recall = tokens.boundary_recall(joined).first()
    assert (recall["n_boundaries"], recall["n_kept"], recall["recall"]) == (2, 2, 1.0)


def test_frequency_rank_is_the_order_by_count_and_bytes(spark):
    rng = random.Random(9)
    words = list({"".join(rng.choice("abᠣé") for _ in range(rng.randint(1, 5))) for _ in range(200)})
    rows = [("g" if rng.random() < 0.8 else "h", w, rng.randint(1, 3)) for w in words]
    got = {(r["g"], r["word"]): r["rank"] for r in tokens.frequency_rank(spark.createDataFrame(rows, "g string, word string, n long"), "g").collect()}
    for group in "gh":
        order = sorted((w for g, w, _ in rows if g == group), key=lambda w: (-next(n for g, x, n in rows if x == w), w.encode()))
        assert [got[group, w] for w in order] == list(range(len(order)))


def test_passes_have_orders_of_their_own_and_resume(spark):
    rows = spark.createDataFrame([(k,) for k in range(30)] * 2, "id long")
    whole = streams.passes(rows, "id", 3, 0, 2).orderBy("pass", "at").collect()
    first, second = ([r["id"] for r in whole if r["pass"] == p] for p in (0, 1))
    assert sorted(first) == sorted(second) == list(range(30)) and first != second
    rest = streams.passes(rows, "id", 3, 0, 2, after=(0, 27)).orderBy("pass", "at").collect()
    assert [r["id"] for r in rest] == first[28:] + second
    left = streams.fast_forward(streams.passes(rows, "id", 3, 0, 1), "at", 2, 3, 4).orderBy("at").collect()
    assert [r["id"] for r in left] == first[24:] and left[0]["batch"] == 6
    mixed = streams.mixed({"a": (rows, 3.0), "b": (rows, 1.0)}, "id", 1).orderBy("due", "source").limit(20).collect()
    assert sum(r["source"] == "a" for r in mixed) == 15


def test_a_sampler_prepares_the_same_batch_until_it_is_committed(spark, tmp_path):
    ordered = streams.passes(spark.range(10), "id", 1, 0, 1)
    sampler = streams.TransactionalSampler(ordered, "at", 4, streams.Ledger(spark, f"file://{tmp_path}/ledger"))
    ids = lambda s: sorted(r["id"] for r in s.prepare().collect())
    first = ids(sampler)
    assert first == ids(sampler) and len(first) == 4
    twin = streams.TransactionalSampler(ordered, "at", 4, streams.Ledger(spark, f"file://{tmp_path}/ledger"))
    assert sampler.commit() == 0
    with pytest.raises(RuntimeError):
        twin.commit()
    again = streams.TransactionalSampler(ordered, "at", 4, streams.Ledger(spark, f"file://{tmp_path}/ledger"))
    assert again.next == 1 and ids(again) == ids(sampler) and not set(first) & set(ids(again))


def test_suffixes_follow_harmony_and_order(spark):
    rows = [("ᠠᠮᠠ", "ᠤᠨ", "all_variants"), ("ᠠᠮᠠ", "ᠦᠨ", "all_variants"), ("ᠠᠮᠠ", "ᠦᠨ", "none"), ("ᠮᠢᠨ", "ᠦᠨ", "masculine"), ("ᠠᠡ", "ᠦ", "masculine"), ("ᠡᠮᠡ", "ᠤᠨ", "feminine")]
    df = spark.createDataFrame(rows, "stem string, suffix string, declared string")
    stem, suffix = morphology.harmony(F.col("stem")), morphology.harmony(F.col("suffix"))
    assert [r[0] for r in df.select(stem).collect()] == ["masculine", "masculine", "masculine", "neutral", "mixed", "feminine"]
    assert [r[0] for r in df.coalesce(1).select(morphology.harmonizes(stem, suffix, F.col("declared"))).collect()] == [True, False, True, True, True, True]
    kinds = spark.createDataFrame([("plural", "case"), ("case", "plural"), ("particle", "case"), ("x", "case")], "a string, b string")
    assert [r[0] for r in kinds.coalesce(1).select(morphology.stacks(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    many = spark.createDataFrame([(["plural", "case", "case"],), (["plural", "plural"],), ([],)], "k array<string>")
    assert [r[0] for r in many.coalesce(1).select(morphology.sane(F.col("k"))).collect()] == [True, False, True]
    letters = {r["code"] for r in morphology.alphabet(spark).collect()}
    assert 0x1820 in letters and 0x1801 not in letters and 0x180B not in letters


def test_next_fit_flushes_what_stands_alone(spark):
    assert list(sequence.next_fit([3, 3, 9, 3, 2, 2], 8, 1, [False, False, False, False, True, False])) == [(0, 0), (0, 4), (1, 0), (2, 0), (3, 0), (4, 0)]
    rows = spark.createDataFrame([("s", k, n, n * 2) for k, n in enumerate([3, 3, 3, 0])], "by string, at int, n int, words int")
    got = [tuple(r) for r in sequence.next_fit_packs(rows, "by", "at", "n", 8, words="words").orderBy("at").collect()]
    assert got == [("s", 0, 0, 0, 0), ("s", 1, 0, 4, 6), ("s", 2, 1, 0, 0)]


def test_new_rows_meet_the_state_of_earlier_batches(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    a, b, c = text(), text(), text()
    close = a.split()
    close[0] = "other"
    schema = "doc_id long, text string"
    dedup.dedup_state(spark.createDataFrame([(1, a), (2, None)], schema), str(tmp_path))
    dedup.dedup_state(spark.createDataFrame([(3, b)], schema), str(tmp_path))
    batch = spark.createDataFrame([(4, a + " "), (5, " ".join(close)), (6, c), (7, c), (8, ""), (9, b)], schema)
    got = {r["doc_id"]: r["reason"] for r in dedup.new_rows(batch, str(tmp_path), limit=8).collect()}
    assert got == {4: "exact", 5: "near", 6: None, 7: "exact", 8: "exact", 9: "exact"}


def test_special_tokens_end_a_segment(spark):
    df = spark.createDataFrame([("a<|x|>b <|y z|> ᠮᠣ",)], "t string")
    assert df.select(X.found(F.col("t"), row_queries.SEGMENT)).first()[0] == ["a", "<|x|>", "b", " ", "<|y", " ", "z|>", " ", "ᠮᠣ"]


def test_byte_targets_of_rows(spark):
    known = spark.createDataFrame([("ab", 300)], "word string, id long")
    rows = [(1, [-100, -100, 300, 0xE2, 0x82, 0xAC, 7000]), (2, [-100, 7000]), (3, [-100, -100]), (4, [])]
    df = spark.createDataFrame(rows, "k long, labels array<long>")
    got = {r["k"]: bytes(r["bytes"]) for r in tokens.byte_targets(df, "k", "labels", known, end=7000).collect()}
    assert got == {1: "ab€".encode(), 2: b"", 3: b"", 4: b""}
    with pytest.raises(Exception, match="masked"):
        tokens.byte_targets(spark.createDataFrame([(1, [300, -100, 7000])], df.schema), "k", "labels", known, end=7000).collect()
    assert spark.createDataFrame([(b"a\xe2",)], "b binary").select(tokens.bytes_text(F.col("b"))).first()[0] == "a�"


def test_mean_intervals_hold_the_mean(spark):
    rng = random.Random(3)
    rows = [("a", rng.randint(0, 9)) for _ in range(400)] + [("b", 5)] * 9 + [("b", None)]
    got = {r["g"]: r for r in scoring.mean_intervals(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()}
    values = [v for g, v in rows if g == "a"]
    mean = sum(values) / 400
    spread = (sum((v - mean) ** 2 for v in values) / 400) ** 0.5 / 20
    assert got["a"]["n"] == 400 and got["a"]["mean"] == pytest.approx(mean)
    assert got["a"]["low"] == pytest.approx(mean - 1.96 * spread, abs=0.3 * spread) and got["a"]["high"] == pytest.approx(mean + 1.96 * spread, abs=0.3 * spread)
    assert (got["b"]["low"], got["b"]["mean"], got["b"]["high"], got["b"]["n"]) == (5, 5, 5, 9)


def test_prefix_sums_of_sparse_keys(spark):
    rng = random.Random(8)
    keys = rng.sample(range(-(2**40), 2**40), 300)
    df = spark.createDataFrame([(k, rng.randint(0, 9)) for k in keys], "k long, v int")
    got = {r["k"]: r["before"] for r in sequence.prefix_sum(df, "k", F.col("v"), "before", block=2**33).collect()}
    assert got == {r["k"]: r["before"] for r in sequence.prefix_sum(df, "k", F.col("v"), "before").collect()}
    total = 0
    for r in sorted(df.collect()):
        assert got[r["k"]] == total
        total += r["v"]
    assert sequence.block_width(df, "k") > 2**40 and sequence.block_width(df.limit(0), "k") == sequence.BLOCK
    assert sequence.row_index(df.limit(0), "k").count() == 0
