"""Operators for training data: against brute force, round trips, and on awkward input."""

import collections
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import bpe, budget, encode, mixing, normalize, packing, quality, queries, sampling, splits

from ..compare import rows_of, rows_of_sql

ALPHABET = " \t\n'sStrevmdlLaé\u03011²Ⅳ٣!?.—\u180b\u180e\u200d😀ᠣᠤ文 "


@pytest.fixture(scope="module")
def model():
    return encode._vocabulary(bpe.DEFAULT_TOKENIZER)


def some_texts(n=400, size=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, duck, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.SQL[name])


# 6


def test_ids_are_those_of_the_library(model):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    library.encode_special_tokens = True
    rng = random.Random(2)
    texts = some_texts() + ["<|endoftext|> x", "'s't're've'm'll'd", "a" * 6000, "ab" * 2500, "".join(rng.choice("abcdefghij") for _ in range(6000)), "x   y", "tail  "]
    ids, offsets = model.encode(texts)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert model.count([*texts, None, ""]).tolist() == [*(offsets[1:] - offsets[:-1]).tolist(), 0, 0]


def test_encode_texts_handles_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (3, "hello world", "d"), (4, " ", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode.encode_texts(df).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995]), (4, [220])]
    assert encode.encode_texts(df.limit(0)).count() == 0


def test_decoding_restores_texts(spark):
    texts = some_texts(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = encode.decode_ids(encode.encode_texts(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == texts


# 3


def test_prefix_states_count_like_the_encoder(model):
    words, _ = model.split_words([t for t in some_texts(600) if t])
    words = sorted({w.encode() for w in words} | {b"a" * k for k in range(1, 40)})
    rng = random.Random(4)
    words = sorted({*words, *("".join(rng.choice("abet ᠣᠤ") for _ in range(rng.randint(1, 400))).encode() for _ in range(300))})
    states = budget.PrefixStates(model, budget.Automaton(model))
    _, offsets = model.encode_words([w.decode() for w in words])
    for size in (7, len(words)):
        assert [n for k in range(0, len(words), size) for n in states.tokens(words[k : k + size])] == (offsets[1:] - offsets[:-1]).tolist()


def test_tokens_of_documents_are_those_of_the_encoder(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = encode.encode_texts(documents).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
    assert encoded.exceptAll(budget.document_tokens(documents)).isEmpty()


def test_document_tokens_and_budget(spark, model):
    texts = [*some_texts(80), None, "", "the the the"]
    rows = [(k, t, "en" if k % 2 else " EN ", "s1" if k % 3 else None, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (0, "twice", "en", "s1", None)], "doc_id long, text string, lang string, source string, domain string")
    want = dict(enumerate(model.count(texts).tolist()))
    want[0] += model.count(["twice"])[0]
    got = {r["doc_id"]: r["n_tokens"] for r in budget.document_tokens(df).collect()}
    assert got == want
    unnamed = spark.createDataFrame([(None, "no key", "en", "s1", None), (None, "the", "en", "s1", None)], df.schema)
    want[None] = int(model.count(["no key", "the"]).sum())
    assert {r["doc_id"]: r["n_tokens"] for r in budget.document_tokens(df.union(unnamed)).collect()} == want
    df = df.union(unnamed)
    slices = {(r["slice"], r["value"]): r["n_tokens"] for r in budget.token_budget(df).collect()}
    assert slices[("all", None)] == sum(want.values()) == slices[("lang", "en")]
    assert budget.document_tokens(df.limit(0)).count() == 0


def stats_rows(spark, rows):
    schema = "run_id string, source string, weight double, docs long, chars long, sampled_docs long, sampled_chars long, sampled_tokens long, est_tokens long, target_tokens double, repeat_factor double, emit_prob double, measured_at timestamp_ntz, received_at timestamp_ntz"
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], schema)


def test_audit_and_plan_of_runs(spark):
    rows = [
        ("r", "a", 1.0, 1, 100, 1, 10, 5, 50), ("r", "a", 1.0, 1, 100, 1, 10, 5, 50),  # twice
        ("r", "b", None, 1, 100, 1, 10, 5, 52), ("r", "c", 98.0, 1, 10, 1, 0, 7, None), ("r", "d", 0.0, 1, None, 1, 1, 1, 9), ("q", "a", 0.0, None, None, None, None, None, None),
    ]
    stats = stats_rows(spark, rows)
    assert {(r["source"], r["wrong"]) for r in budget.audit_estimates(stats).where("run_id = 'r'").collect()} == {("a", False), ("b", True), ("c", True), ("d", None)}
    runs = spark.createDataFrame([("r", None, None, 1)], "run_id string, total_tokens long, max_epochs double, seed int")
    plan = {(r["run_id"], r["source"]): r for r in mixing.plan_runs(stats, runs).collect()}
    # sizes 50, 50, 7, 9: the target of c is 0.98 of 116
    assert plan["r", "c"]["exhausted"] and plan["r", "c"]["repeat_factor"] == 4.0 and plan["r", "c"]["emit_prob"] == 1.0
    assert plan["r", "a"]["repeat_factor"] == pytest.approx(1.16 / 50) and not plan["r", "a"]["exhausted"]
    assert plan["r", "d"]["repeat_factor"] == 0 and plan["q", "a"]["target_tokens"] in (0, None)


# 1


def slow_form(text, table):
    text = "".join("".join(p for _, p in table[c]) if c in table else c for c in text)
    text = re.sub("\r\n?", "\n", unicodedata.normalize("NFD", text))
    letter = "[ᠠ-ᡸᢀ-ᢪ]"
    text = re.sub(f"(?<!{letter})(?<!{letter}[᠋-᠍᠏]) | (?!{letter})", " ", text)
    text = re.sub(" ?\n ?", "\n", re.sub(" {2,}", " ", text))
    return unicodedata.normalize("NFC", text.strip(" \n"))


def test_forms_are_those_of_brute_force(spark):
    rng = random.Random(5)
    letters = "aаｅé\u0301\u0308ü ᠣᠤᠥᠦ\u180b \u3000\u200b\n\rﬁⅣ²①日⽇K\u0591"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(500)] + ["", " ", "a" * 20_000 + "ạ\u0301"]
    table = dict(normalize.shape_table())
    df = spark.createDataFrame([(t, "x") for t in texts] + [(None, "x")], "text string, canonical string")
    got = {r["text"]: r["canonical"] for r in normalize.normalize_texts(df).collect()}
    assert got.pop(None) is None
    assert got == {t: slow_form(t, table) for t in texts}


def test_what_looks_the_same_and_what_does_not(spark):
    same = [("é", "é"), ("ａ", "a"), ("со", "co"), ("ᠣ", "ᠤ"), ("a b", " a  b​"), ("ﬁ", "fi"), ("ậ", "ậ"), ("ậ", "ậ"), ("й", "й"), ("⽇", "日"), ("‐", "-"), ("Ⅳ", "IV"), ("ә", "ə"), ("ǝ", "ə"), ("ꓮꓐ", "AB"), ("Ⲟⲟ", "Oo"), ("ᎠᎡᏀ", "DRG"), ("ʼ", "’"), ("∙", "·")]
    other = [("a", "A"), ("e", "é"), ("1", "¹"), ("1", "①"), (".", ","), ("a\nb", "a b"), ("ᠣ", "ᠣ᠋"), ("ᠣᠠ", "ᠣ᠎ᠠ"), ("ᠣ ᠣ", "ᠣ ᠣ"), ("у", "ү"), ("o", "ө"), ("日", "旦"), ("Ə", "Ǝ"), ("–", "-"), ("У", "Ү")]
    rows = [(f"{kind}{k}{side}", t) for kind, pairs in (("s", same), ("o", other)) for k, pair in enumerate(pairs) for side, t in zip("ab", (pair[0] + kind * 9 + str(k), pair[1] + kind * 9 + str(k)))]
    got = {(r["text_a"], r["text_b"]) for r in normalize.look_alike_pairs(spark.createDataFrame([*rows, ("n", None), ("e", " "), ("z", "\u200b"), rows[0]], "key string, text string")).collect()}
    assert got == {(f"s{k}a", f"s{k}b") for k in range(len(same))}


def test_classes_are_those_of_the_pairs(spark):
    rows = [("a", "со"), ("b", "co"), ("c", "co"), ("d", "x"), ("e", None), ("f", " "), ("a", "со"), ("g", "х"), ("g", "ｘ")]
    got = {r["key"]: r for r in normalize.look_alike_classes(spark.createDataFrame(rows, "key string, text string")).collect()}
    assert set(got) == set("abcdg") and len({got[k]["class_id"] for k in "abc"}) == 1
    assert {k: (r["n_texts"], r["n_keys"]) for k, r in got.items()} == {"a": (2, 3), "b": (2, 3), "c": (2, 3), "d": (3, 2), "g": (3, 2)}
    assert normalize.look_alike_classes(spark.createDataFrame([], "key string, text string")).count() == 0


def test_look_alikes_lead_to_shapes_that_stay():
    table = dict(normalize.shape_table())
    for shape in [*normalize.LOOK_ALIKES.values(), *normalize.SAME_SHAPE.values()]:
        assert shape not in table or "".join(p for _, p in table[shape]) == shape


def test_pairs_in_a_hot_class_are_whole(spark):
    rows = [(f"k{i:03d}", "а" if i % 3 else "a") for i in range(60)]
    got = {(r["text_a"], r["text_b"]) for r in normalize.look_alike_pairs(spark.createDataFrame(rows, "key string, text string")).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and x != y}


# 2


def source_rows(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, source_document_id string, source_capture_id string, writer_id string, style string, difficulty string, font_id string")


def test_groups_are_those_of_union_find(spark):
    rng = random.Random(3)
    spell = lambda p, n: rng.choice([f"{p}-{n:03d}", f"{p.upper()}_{n:03d}", f" {p} {n:03d}\t", f"{p}{n:03d}"])
    rows = []
    for k in range(300):
        ids = [rng.choice([None, "unknown", "", spell(p, rng.randrange(150))]) for p in ("doc", "cap", "wr")]
        rows.append((f"s{k:03d}", *ids, "print", None, "f"))
    rows += [("s000", "doc-001", None, None, "print", None, "f"), ("s000", "doc-149", None, None, "print", None, "f"), (None, "doc-001", None, None, None, None, "f")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        if r[0]:
            for kind, raw in enumerate(r[1:4]):
                bare = "".join(c for c in (raw or "").lower() if c.isalnum())
                if any(c.isdigit() for c in bare):
                    a, b = find(r[0]), find((kind, bare))
                    if a != b:
                        parent[a] = b
            find(r[0])
    members = collections.defaultdict(list)
    for s in {r[0] for r in rows if r[0]}:
        members[find(s)].append(s)
    want = {s: min(g) for g in members.values() for s in g}
    for parts in (1, 5):
        got = {r["sample_id"]: r["group_id"] for r in splits.related_groups(source_rows(spark, rows).repartition(parts)).collect()}
        assert got == want
    assert splits.related_groups(source_rows(spark, rows).limit(0)).count() == 0


def test_splits_keep_groups_and_come_near_the_fractions(spark):
    rng = random.Random(4)
    rows = [(f"s{k}", f"doc-{rng.randrange(400)}", None, None, rng.choice(["print", "Hand-written"]), rng.choice(["good", "poor"]), "f") for k in range(3000)]
    policy = spark.createDataFrame([("train", 0.8, 1), ("test", 0.2, 1), ("none", 0.0, 1), ("nil", None, 1)], "split string, fraction double, seed int")
    got = splits.assign_splits(source_rows(spark, rows), policy)
    kept = got.collect()
    assert len(kept) == 3000 and len({r["group_id"] for r in kept}) == len({(r["group_id"], r["split"]) for r in kept})
    report = {r["split"]: r["share"] for r in splits.split_report(got, policy).collect()}
    assert report["train"] == pytest.approx(0.8, abs=0.005) and report["none"] == 0


# 4


def test_balance_meets_targets_within_the_cap(spark):
    rng = random.Random(6)
    units = [(s, float(rng.randint(1, 500))) for s in "abcd" for _ in range(300)] + [("a", 0.0), ("e", None), (None, 5.0)]
    size = collections.Counter()
    for s, x in units:
        if s and x:
            size[s] += x
    targets = {"a": 0.3 * size["a"], "b": 2.7 * size["b"], "c": 4.5 * size["c"], "d": 0.0, "z": 10.0}
    asked = spark.createDataFrame([(s, t, 4.0) for s, t in targets.items()], "source string, target double, cap double")
    df = spark.createDataFrame(units, "source string, size double")
    solved = mixing.balance(df, asked, ["source"])
    state = {r["source"]: r["state"] for r in solved.collect()}
    assert state == {"a": "solved", "b": "solved", "c": "exhausted", "d": "empty", "z": "exhausted"}
    sums = {r["source"]: r["t"] for r in df.join(solved, "source").groupBy("source").agg(F.sum(F.col("size") * mixing.rate_of(F.col("size"))).alias("t")).collect()}
    assert sums["a"] == pytest.approx(targets["a"], rel=1e-6) and sums["b"] == pytest.approx(targets["b"], rel=1e-6)
    assert sums["c"] == pytest.approx(4 * size["c"]) and sums["d"] == 0


def test_mix_reports_actual_shares(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(["word"] * rng.randint(1, 30)), "a" if k % 3 else "b") for k in range(900)] + [(900, None, "a"), (901, "x", None), (902, "y", "other")]
    sources = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 0.0)], "source string, weight double")
    mix, report = mixing.mix_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), sources)
    kept = mix.collect()
    assert {r["source"] for r in kept} == {"a", "b"} and all(0 <= r["copies"] <= 4 for r in kept)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["a"]["actual_share"] == pytest.approx(0.5, abs=0.002) and rows["c"]["actual_share"] == 0
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    # systematic rounding misses a target by about a document
    assert all(abs(r["mixed_tokens"] - r["filled_tokens"]) <= 40 for r in rows.values())


def test_what_exhausted_sources_leave_over_is_filled():
    assert mixing.fill_targets([("a", 0.5, 10.0), ("b", 0.25, 100.0), ("c", 0.25, 100.0)], 100.0, 4.0) == {"a": 40.0, "b": 30.0, "c": 30.0}
    assert mixing.fill_targets([("a", 0.5, 1.0), ("b", 0.5, 2.0)], 100.0, 4.0) == {"a": 4.0, "b": 8.0}
    assert mixing.fill_targets([("a", 0.0, 5.0)], 10.0, 4.0) == {"a": 0.0}


# 5


def test_draws_hold_their_quotas(spark):
    rows = [(f"s{k % 900}", ["print", "handwritten_good", None][k % 3], "handwritten", "poor", None) for k in range(1000)]
    samples = spark.createDataFrame(rows, "sample_id string, quota_buckets string, style string, difficulty string, updated_at timestamp_ntz")
    targets = spark.createDataFrame([("d", "print", 0.5, 2, 0.5), ("d", "handwritten_good", 0.5, 400, 0.5), ("d", "nothing", 0.1, 1, 0.5), ("e", "print", 0.2, 2, 1.0), ("e", "print", 0.2, 2, 1.0), ("e", "handwritten_poor", None, None, None)], "draw_id string, quota_bucket string, target_share double, min_rows int, draw_fraction double")
    drawn, report = sampling.draw_samples(samples, targets)
    got = collections.Counter((r["draw_id"], r["quota_bucket"]) for r in drawn.collect())
    assert got == {("d", "print"): 225, ("d", "handwritten_good"): 300, ("e", "print"): 180}
    assert drawn.count() == drawn.distinct().count()
    assert {(r["draw_id"], r["quota_bucket"]) for r in report.where("short").collect()} == {("d", "handwritten_good"), ("d", "nothing")}
    again = sampling.draw_samples(samples.repartition(7), targets)[0]
    assert again.exceptAll(drawn).isEmpty()
    assert sampling.draw_samples(samples.limit(0), targets)[0].isEmpty()


def test_reservoirs_that_are_too_small_are_filled_again(spark):
    """Without slack partitions drop what a quota needs; the draw is the same nevertheless, the records of lowest priority."""
    rows = [(f"s{k}", "ab"[k % 3 == 0], "print", None, None) for k in range(3000)]
    samples = spark.createDataFrame(rows, "sample_id string, quota_buckets string, style string, difficulty string, updated_at timestamp_ntz")
    targets = spark.createDataFrame([("d", "a", 0.1, 0, 1.0), ("d", "b", 0.2, 0, 1.0), ("e", "a", 0.1, 7, 0.1)], "draw_id string, quota_bucket string, target_share double, min_rows int, draw_fraction double")
    tight, loose = (sampling.draw_samples(samples, targets, slack=s)[0] for s in (0.01, 50.0))
    assert tight.exceptAll(loose).isEmpty() and loose.exceptAll(tight).isEmpty()
    held = collections.Counter((r["draw_id"], r["quota_bucket"]) for r in tight.collect())
    assert held == {("d", "a"): 300, ("d", "b"): 600, ("e", "a"): 30}
    first = samples.where("quota_buckets = 'a'").select("sample_id").orderBy(F.xxhash64(F.lit(11), "sample_id")).limit(300)
    assert first.exceptAll(tight.where("draw_id = 'd' and quota_bucket = 'a'").select("sample_id")).isEmpty()


# 7


def test_packing_is_whole_and_within_capacity(spark, model):
    rng = random.Random(8)
    docs = [(k, "word " * rng.randint(0, 60), rng.choice("aab")) for k in range(300)] + [(300, None, "a"), (301, "x " * 500, None), (302, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    bins = spark.createDataFrame([("s", 32), ("l", 200), ("n", None), ("z", 0)], "bin_kind string, capacity_tokens int")
    packed = packing.pack_documents(df, bins).collect()
    want = dict(enumerate(model.count([t for _, t, _ in docs]).tolist()))
    for kind, capacity in (("s", 32), ("l", 200)):
        rows = [r for r in packed if r["bin_kind"] == kind]
        filled, placed, pieces = collections.Counter(), collections.Counter(), collections.Counter()
        for r in rows:
            filled[r["part"], r["bin"]] += r["n_tokens"]
            placed[r["doc_id"]] += r["n_tokens"]
            pieces[r["doc_id"]] += 1
        assert max(filled.values()) <= capacity and dict(placed) == {k: n for k, n in want.items() if n}
        assert all(n == 1 for k, n in pieces.items() if want[k] <= capacity)
        assert sum(filled.values()) / (capacity * len(filled)) > 0.95
    assert packing.pack_documents(df.limit(0), bins).count() == 0


def test_bins_follow_the_mixture():
    queues = packing.Queues({"a": 0.75, "b": 0.25}, {"a": 0.0, "b": 0.0}, 400)
    for k in range(300):
        queues.put("a", 10, ("a", k))
        if k % 3 == 0:
            queues.put("b", 10, ("b", k))
    filled = list(queues.bins())
    for chosen in filled[:-1]:
        assert sum(size for _, size in chosen) == 400
        assert 8 <= sum(s == "b" for (s, _), _ in chosen) <= 12
    assert sum(map(len, filled)) == 400


@pytest.mark.parametrize("part_items", [20_000, 60])
def test_bins_are_nearer_to_the_mixture_than_by_chance(spark, sf_dir, model, part_items):
    """Real documents, in one packing partition and in several, against the same pieces in random order."""
    documents, sources = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "mix_sources"))
    bins = spark.createDataFrame([("b", 8192)], "bin_kind string, capacity_tokens int")
    packed = packing.pack_documents(documents, bins, sources, part_items=part_items)
    report = packing.packing_report(packed, sources).first()
    shares = {r["source"]: r["target_share"] for r in packing.packed_sources(packed, sources).collect()}
    assert sum(shares.values()) == pytest.approx(1)
    rows = packed.select("source", "n_tokens").collect()
    rng, chance = random.Random(1), []
    for _ in range(5):
        rng.shuffle(rows)
        room, held, apart = 8192, collections.Counter(), []
        for source, n in [*rows, (None, 8193)]:
            if n > room:
                apart.append(1 - sum(min(x / held.total(), shares[s]) for s, x in held.items()))
                room, held = 8192, collections.Counter()
            room -= n
            held[source] += n
        chance.append(sum(apart) / len(apart))
    assert report["supply_deviation"] <= report["deviation"] < sum(chance) / 5
    assert report["n_tokens"] == sum(n for _, n in rows)


# 8


PROSE = "The primer covers the tax, and the scribe of the river has quietly marked a narrow page. It was the clerk that kept the ledger, not the reader of the old verse. No bell is known to be as rare as this song."


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("prose", PROSE), ("prose", "Dogs chase cats daily. Farmers plant seeds every spring. Children sing songs loudly together."),
        ("prose", "El perro duerme en la casa. La mujer compra pan en el mercado. Los niños juegan en el parque con sus amigos."),
        ("junk", "ssenuytf ioeric ,oh stl, otlesoeod a sub  edaceg ht ideeltrea pb  odw  in e t ormen.neiveleo eaocee hso gteb t"),
        ("prose", "A heading\n\n" + PROSE + "\n\n[3] https://x.invalid/4"), ("prose", "\n".join("- " + s.strip() + "." for s in PROSE.split(".") if s.strip())),
        ("table", "a|b|c\n" * 9), ("table", "name\tsize\n" + "\n".join(f"x{k}\t{k}" for k in range(9))), ("table", "\n".join(f"{k}\tThe scribe of the river has marked a page.\t{k}" for k in range(9))),
        ("list", "\n".join(f"{k}. a narrow page of the scribe," for k in range(1, 9))), ("list", "\n".join(f"chapter {k} ........ {k}" for k in range(9))),
        ("junk", "seal stamp river " * 40), ("junk", "The scribe of the river has marked a page. " * 30), ("junk", "qwxz " * 50), ("junk", "NaN"), ("junk", "?" * 400),
        ("junk", "Th$ pr@m%r c#v&rs th% t@x, @nd th# scr&b% #f th$ r@v%r h#s m&rk%d @ p$g#."),
    ],
)
def test_kinds(kind, text):
    found = dict(zip((n for n, _ in quality.FIELDS), quality.measure(text)))
    assert found["is_prose"] == (kind == "prose")
    if kind in ("table", "list"):
        assert found["kind"] == kind


LINES = ["the red house", "an old bridge", "one tall tower", "a deep river", "the long road", "a green field", "some dry wells", "the last gate"]


@pytest.mark.parametrize(
    ("detector", "text"),
    [
        ("table_rows", "\n".join(f"{k}\tThe scribe of the {w} has marked a page.\t{k}" for k, w in enumerate("north south east west inner outer".split()))),
        ("table_rows", "\n".join(f"{w:<16}It was kept by the clerk in {k}." for k, w in enumerate("north south east west inner outer".split()))),
        ("indented_entries", "\n".join(f"- The gate of {w} was closed." for w in "north south east west inner outer".split())),
        ("edge_entries", "\n".join(f"{w.capitalize()} of the page was kept ........ {k}" for k, w in enumerate("ink seal leaf cord".split())) + "\n" + "The clerk had the ledger."),
        ("even_entries", "\n".join(LINES * 2) + "\nIt was the clerk that kept the ledger of the town."),
    ],
)
def test_every_detector_decides_some_text(monkeypatch, detector, text):
    assert quality.measure(text)[-1] is False
    monkeypatch.setattr(quality, detector, {"edge_entries": lambda *a: set()}.get(detector, lambda *a: (set(), 0.0)))
    assert quality.measure(text)[-1] is True


def test_common_words_are_those_of_the_corpus(spark):
    rows = [(f"the fox number {k} ran", ) for k in range(40)] + [(f"ба {k} лис", ) for k in range(4)] + [(None,), ("",)]
    found = quality.common_words(spark.createDataFrame(rows, "text string"))
    assert found == {"the", "fox", "number", "ran", "ба", "лис"}
    statistics = quality.quality_statistics(spark.createDataFrame([(1, "the fox and others")], "doc_id long, text string"), common=found).first()
    assert statistics["common_words"] == 0.5


def test_autocorrelation_has_no_lag_limit():
    rng = random.Random(2)
    assert quality.autocorrelation([k % 30 * 3 for k in range(300)]) > 0.5
    assert quality.autocorrelation([rng.randint(0, 90) for _ in range(300)]) < 0.1
    assert quality.autocorrelation([5] * 9) == 1 and quality.autocorrelation([1, 2, 3]) == 0


def test_statistics_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, PROSE), (4, PROSE), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.quality_statistics(df).collect()}
    assert [got[k]["kind"] for k in (1, 2, 3)] == [None] * 3 and got[4]["word_count"] == 43 and got[5]["n_chars"] == 100_000
    assert sorted(r["doc_id"] for r in quality.no_prose(df).collect()) == [5]
    assert quality.quality_statistics(df.limit(0)).count() == 0


def test_labels_agree(spark, sf_dir):
    """Hand labels, of which some are wrong; the rules were tuned on tables of this kind, so this guards against regressions only."""
    labels = spark.read.parquet(f"{sf_dir}/doc_labels.parquet").where("kind is not null").groupBy("doc_id").agg(F.mode("kind").alias("label"))
    found = quality.quality_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kind is not null").join(labels, "doc_id")
    assert found.agg(F.avg(F.when((F.col("label") == "prose") == F.col("is_prose"), 1.0).otherwise(0.0))).first()[0] >= 0.8
