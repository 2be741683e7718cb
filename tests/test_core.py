import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import columns as C
from lexiloom.operators import batching, components, dedup, linguistic, metrics, nesting, profile, split, validation, vocab
from lexiloom.operators.prefix import running_total
from lexiloom.sources import readers, sinks

RNG = random.Random(5)


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


@pytest.mark.parametrize("value,want", [(None, "[NA]"), ("", "[NA]"), ("　 ", "[NA]"), (" High ", "high"), ("none", "none"), ("-", "-"), ("[NA]", "[NA]")])
def test_category(spark, value, want):
    assert one(spark, C.category(F.col("x")), value) == want


@pytest.mark.parametrize("n,want", [(1, "len_1_8"), (8, "len_1_8"), (9, "len_9_16"), (40, "len_33_64"), (500, "len_129_plus"), (0, "len_129_plus"), (None, "len_129_plus")])
def test_length_bucket(spark, n, want):
    assert one(spark, C.length_bucket(F.col("x")), n, "long") == want


@pytest.mark.parametrize("raw,want", [(" ˈAH1 ", "AH"), ("th", "tʰ"), ("q", "k"), ("ˈ", "ˈ"), (None, ""), ("aɪ", "aɪ"), ("r", "ɹ")])
def test_spelling(spark, raw, want):
    assert one(spark, C.phoneme_spelling(F.col("x")), raw) == want


def test_small_functions(spark):
    assert one(spark, C.flag(F.col("x")), " TRUE ") == "true" and one(spark, C.flag(F.col("x")), None) == "false" and one(spark, C.flag(F.col("x")), "maybe") is None
    assert one(spark, C.word_language(F.col("x")), "你好，") == "zh" and one(spark, C.word_language(F.col("x")), "hi") == "en" and one(spark, C.word_language(F.col("x")), "") == "zh"
    assert one(spark, C.is_pause(F.col("x")), "，。") and one(spark, C.is_pause(F.col("x")), None) and not one(spark, C.is_pause(F.col("x")), "a")
    assert one(spark, C.tone_digit(F.col("x")), "hao3") == 3 and one(spark, C.tone_digit(F.col("x")), "hao") is None
    assert [one(spark, C.round_even(F.col("x")), v, "double") for v in (66.25, 0.15, 2.675)] == [round(v, 1) for v in (66.25, 0.15, 2.675)]
    assert one(spark, C.class_name(F.col("x"), ["a", "b"]), 1, "int") == "b" and one(spark, C.class_name(F.col("x"), ["a", "b"]), 7, "int") == "<unknown:7>"
    soft = one(spark, C.softmax(F.array(F.lit(1.0), F.lit(3.0))))
    assert math.isclose(sum(soft), 1) and math.isclose(soft[1] / soft[0], math.e**2)
    assert one(spark, C.best_class(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, C.text_signature(F.col("x")), " a　\n b ") == "a b"
    assert len({r[0] for r in C.articulation_rows()}) == 72


def test_running_total_over_a_hot_key(spark):
    data = [(i, "hot" if i % 3 else "k%d" % (i % 7), RNG.randrange(5)) for i in range(900)] + [(900, None, 4)]
    df = running_total(spark.createDataFrame(data, "id long, k string, v long"), ["k"], [F.col("id")], F.col("v"), "upto")
    want, sums = {}, {}
    for i, k, v in data:
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert {r.id: r.upto for r in df.collect()} == want


def brute_components(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_components(spark):
    e = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 20)] + [(200 + RNG.randrange(20), 200 + RNG.randrange(20)) for _ in range(15)]
    df = spark.createDataFrame([*e, (None, 3), (7, 7)], "a long, b long")
    assert {r.id: r.root for r in components.components(df).collect()} == brute_components([x for x in e if x[0] != x[1]])
    assert components.components(df.limit(0)).count() == 0


def test_shingles_and_pairs(spark):
    seqs = [("a", list("abcdefghij")), ("b", list("abcdefghix")), ("c", list("qrstuvw")), ("d", ["a", "b"]), ("e", []), ("f", ["-", "_"])]
    s = spark.createDataFrame(seqs, "id string, p array<string>").select("id", dedup.shingles(F.col("p")).alias("hashes"))
    n = {r.id: len(r.hashes) for r in s.collect()}
    assert n == {"a": 7, "b": 7, "c": 4, "d": 1, "e": 1, "f": 1}
    near, _, skipped = dedup.near_pairs(s, 0.7, cap=512)
    assert {(r.a, r.b) for r in near.collect()} == {("a", "b"), ("e", "f")} and skipped.count() == 0
    near, _, skipped = dedup.near_pairs(s, 0.7, cap=1)
    assert {(r.a, r.b) for r in near.collect()} == {("a", "b"), ("e", "f")} and skipped.count() > 0


def test_bottom_k_and_jaccard(spark):
    assert one(spark, dedup.bottom_k(F.array(*map(F.lit, [9, 1, 5, 3, 7])), 3)) == [1, 3, 5]
    j = lambda a, b: one(spark, dedup.jaccard(F.array(*map(F.lit, a)).cast("array<int>"), F.array(*map(F.lit, b)).cast("array<int>")))
    assert j([1, 2], [2, 3]) == pytest.approx(1 / 3) and j([], []) == 1.0


def greedy(sizes, ratios):
    total = sum(s * c for s, c in sizes.items())
    fill, out = dict.fromkeys(ratios, 0), {}
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            n = max(ratios, key=lambda n: (ratios[n] * total - fill[n], n))
            fill[n] += s
            out[(s, n)] = out.get((s, n), 0) + 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_greedy_counts(seed):
    r = random.Random(seed)
    sizes = {r.randrange(1, 40): r.randrange(1, 30) for _ in range(r.randrange(1, 7))}
    assert {(s, n): c for s, n, c in split.greedy_counts(sizes, split.RATIOS)} == greedy(sizes, split.RATIOS)


def test_assignment_keeps_groups(spark):
    g = spark.createDataFrame([(f"s{i}", "hot" if i % 3 == 0 else f"g{i // 2}") for i in range(300)], "sample_id string, root string")
    a = split.assign(g)
    assert a.count() == 300 and split.leaks(a, g.select("sample_id", F.col("root").alias("signature"))).count() == 0
    assert sum(r.n for r in split.split_report(a).collect()) == 300


def greedy_batches(lengths, budget):
    out, cur = [], []
    for n in sorted(lengths):
        if cur and n * (len(cur) + 1) > budget:
            out.append(cur)
            cur = []
        cur.append(n)
    return out + [cur] if cur else out


@pytest.mark.parametrize("seed", range(20))
def test_token_budget(seed):
    r = random.Random(seed)
    lengths = sorted(r.choice((3, 7, 8, 50, r.randrange(1, 60))) for _ in range(200))
    plan, batches = batching.layout({n: lengths.count(n) for n in set(lengths)}, 300)
    where = [b for n, _, b, room, cap in plan for b in [b if k < room else b + 1 + (k - room) // cap for k in range(lengths.count(n))]]
    want = [k for k, b in enumerate(greedy_batches(lengths, 300)) for _ in b]
    assert where == want and batches == want[-1] + 1
    assert batching.layout({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        batching.layout({11: 1}, 10)
    with pytest.raises(ValueError):
        batching.layout({1: 1}, 0)


def test_planned_batches(spark):
    r = random.Random(3)
    rows_ = [(f"s{i:03d}", r.randrange(1, 30)) for i in range(150)]
    df = spark.createDataFrame(rows_, "id string, len int").withColumns({c: F.lit("z") for c in ("_all", "batch_", "rank_")})
    want = greedy_batches([n for _, n in rows_], 100)
    got = batching.plan_batches(df, "id", "len", 100).collect()
    assert [sorted(x.len for x in got if x.batch == k) for k in range(len(want))] == want and sorted(x["rank"] for x in got) == list(range(1, 151))
    mixed = {e: {x.id: x.batch for x in batching.plan_batches(df, "id", "len", 100, seed=1, epoch=e).collect()} for e in (0, 1)}
    groups = lambda m: sorted(sorted(i for i in m if m[i] == b) for b in set(m.values()))
    assert groups(mixed[0]) == groups(mixed[1]) == groups({x.id: x.batch for x in got}) and mixed[0] != mixed[1] and set(mixed[0].values()) == set(range(len(want)))
    assert batching.plan_batches(df, "id", "len", 100, drop_last=True).count() == 150 - len(want[-1])
    assert batching.plan_batches(df.limit(0), "id", "len", 100, seed=1).count() == 0


def test_shuffle_files_go_with_their_write(spark):
    """A written step leaves no shuffle files behind, whenever the driver collects its garbage, and no setting; its rows and joins of it are whole."""
    import os
    import time

    from lexiloom.storage import cut

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    setting = spark.conf.get(key, None)
    df = spark.range(0, 20_000, 1, 4).withColumn("key", F.col("id") % 100).repartition(4, "key")
    grouped = df.groupBy("id").agg(F.max("key").alias("key"))
    old = files()
    written = cut(grouped)
    both = cut(written.join(grouped, ["id", "key"]))
    for _ in range(20):
        if not files() - old:
            break
        time.sleep(0.2)
    assert not files() - old and spark.conf.get(key, None) == setting
    assert both.count() == grouped.count() == written.distinct().count() == 20_000


def test_hot_key_is_split(spark, monkeypatch):
    """A key with half of all rows: a side grouped by the key keeps AQE from splitting the join, a written one does not."""
    from lexiloom.storage import cut, skew_safe

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 200_000
        df = cut(spark.range(0, n, 1, 8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("value"), F.sha2(F.col("id").cast("string"), 256).alias("pad")))
        grouped = df.groupBy("key").agg(F.min("value").alias("least"))

        def largest(side):
            with skew_safe(spark):
                out = cut(df.join(side, "key").withColumn("p", F.spark_partition_id()))
            assert out.count() == n
            return out.groupBy("p").count().agg(F.max("count")).first()[0]

        assert largest(cut(grouped)) < 0.3 * n < largest(grouped)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_cuts_are_dropped(spark):
    from pathlib import Path

    from lexiloom.storage import cut, shared_dir, tidy

    @tidy
    def operator(df):
        a = cut(df, "dropped-one")
        return cut(a.where("id > 1"), "kept-one")

    out = operator(spark.range(5))
    names = {p.name.rsplit("-", 1)[0] for p in Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/")).iterdir()}
    assert out.count() == 3 and "kept-one" in names and "dropped-one" not in names


def test_radix_percentiles_of_the_profile(spark):
    import numpy as np

    r = random.Random(5)
    xs = [r.uniform(-5, 200) for _ in range(400)] + [0.0, -0.0, 1e-310]
    df = spark.createDataFrame([("a" if i % 3 else None, x) for i, x in enumerate(xs)] + [("b", None), ("b", float("nan")), ("b", float("inf"))], "g string, x double")
    one = profile.numeric_profile(df, "x").first()
    assert one.n == len(xs) and [one.p05, one.p50, one.p95] == pytest.approx([np.percentile(xs, p) for p in (5, 50, 95)])
    by = {q.g: q for q in profile.numeric_profile(df, "x", ["g"]).collect()}
    assert set(by) == {"a", None} and by["a"].p50 == pytest.approx(np.percentile([x for i, x in enumerate(xs) if i % 3], 50))


def test_padding(spark, rows):
    df = spark.createDataFrame([("a", 0, [1, 2, 3]), ("b", 0, [4]), ("c", 1, [5, 6])], "id string, batch int, x array<int>")
    got = {r.id: (r.x, r["mask"]) for r in batching.pad_batches(df, "batch", {"x": -100}).collect()}
    assert got == {"a": ([1, 2, 3], [True] * 3), "b": ([4, -100, -100], [True, False, False]), "c": ([5, 6], [True] * 2)}


def test_classification(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 3, None], [0, 1, 1, 1, 2, 0, 1])), "t int, p int")
    m = metrics.confusion(df, "t", "p", 4)
    assert m.count() == 16
    o = metrics.overall(m).first()
    assert o.accuracy == pytest.approx(4 / 6) and o.total == 6
    nine = spark.createDataFrame([(0, 0)] * 9 + [(1, 0)], "t int, p int")
    assert metrics.overall(metrics.confusion(nine, "t", "p", 2)).first().weighted_f1 == pytest.approx(9 * (1.8 / 1.9) / 10)
    c = {r["class"]: r for r in metrics.per_class(metrics.confusion(spark.createDataFrame(list(zip([0, 0, 0, 1, 1], [0, 0, 1, 1, 0])), "t int, p int"), "t", "p", 2)).collect()}
    assert c[0].precision == pytest.approx(2 / 3) and c[1].recall == pytest.approx(1 / 2) and c[0].support == 3
    empty = metrics.overall(metrics.confusion(df.limit(0), "t", "p", 4)).first()
    assert (empty.accuracy, empty.total) == (0.0, 0)


def test_regression(spark):
    df = spark.createDataFrame([(0.0, 10.0), (0.0, 20.0), (0.0, -30.0), (0.0, 40.0), (None, 1.0)], "t double, p double")
    r = metrics.errors(df, F.col("t"), F.col("p")).first()
    assert (r.n, r.mae, r.median) == (4, 25.0, 25.0) and r.rmse == pytest.approx(750**0.5)
    assert metrics.errors(df.limit(0), F.col("t"), F.col("p")).first().mae == 0.0


def test_gate(spark):
    base = {"global_step": 10, "saw_non_finite_loss": False, "final_train_loss": 0.1, "final_train_viseme_accuracy": 0.99, "final_train_strength_mae": 1.0}
    good = spark.createDataFrame([(*base.values(), (0.99, 1.0))], "global_step int, saw_non_finite_loss boolean, final_train_loss double, final_train_viseme_accuracy double, final_train_strength_mae double, validation struct<val_viseme_accuracy: double, val_strength_mae: double>")
    assert metrics.gate(good).count() == 8 and metrics.gate_verdict(metrics.gate(good)).first().passed
    for change in ({"final_train_loss": F.lit(float("nan"))}, {"final_train_viseme_accuracy": F.lit("0.99")}, {"validation": F.lit(None).cast("struct<val_viseme_accuracy: double>")}, {"global_step": F.lit(None).cast("int")}):
        assert not metrics.gate_verdict(metrics.gate(good.withColumns(change))).first().passed
    assert not metrics.gate_verdict(metrics.gate(good.drop("final_train_loss"))).first().passed


def test_running_best(spark, rows):
    log = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate([1.0, 1.0, float("nan"), 2.0, 1.5, None])], "run string, step long, v double")
    got = rows(metrics.running_best(log, "run", "step", "v"), "step", "best", "improved", "since")
    assert got == [(1, 1.0, True, 0), (2, 1.0, False, 1), (3, 1.0, False, 2), (4, 2.0, True, 0), (5, 2.0, False, 1), (6, 2.0, False, 2)]


def token(**k):
    return {"phoneme": "a", "language": "zh", "surface_tone": 1, "labels": {"viseme_id": 1, "strength": 5.0}, **k}


BAD = [
    ({"phoneme": " "}, "phoneme missing"), ({"phoneme": 3}, "phoneme missing"), ({"language": None}, "language missing"), ({"language": "fr"}, "language not supported"),
    ({"surface_tone": True}, "surface_tone is no integer"), ({"surface_tone": 1.5}, "surface_tone is no integer"), ({"surface_tone": 9}, "Chinese tone out of range"), ({"stress": 1}, "Chinese stress"),
    ({"language": "en"}, "English tone"), ({"language": "en", "surface_tone": 0, "stress": 4}, "English stress out of range"), ({"labels": None}, "labels missing"), ({"labels": [1]}, "labels is no object"),
    ({"labels": {"strength": 1}}, "viseme_id missing"), ({"labels": {"viseme_id": 1}}, "strength missing"), ({"labels": {"viseme_id": 18, "strength": 1}}, "viseme_id out of range"),
    ({"labels": {"viseme_id": "1", "strength": 1}}, "viseme_id is no integer"), ({"labels": {"viseme_id": 1, "strength": 101}}, "strength out of range"), ({"labels": {"viseme_id": 1, "strength": True}}, "strength is no number"),
    ({"labels": {"viseme_id": 1, "strength": 1, "strength_source": "Human", "raw_value": 3}}, "human strength with raw value"), ({"strength": 3}, "target fields among features"), ({"features": {"talk": 1}}, "target fields in features block"),
    ({"articulatory": {"size": 1}}, "articulatory has unknown fields"), ({"articulatory": 4}, "articulatory is no object"), ({"boundary": {"word_start": "maybe"}}, "boundary.word_start is no flag"), ({"syllable_role": [1]}, "syllable_role is no category"),
]


def test_rejections(spark):
    cases = [({"tokens": [token(**c)]}, r) for c, r in BAD] + [({}, "tokens missing"), ({"tokens": 3}, "tokens is no list"), ({"tokens": []}, "tokens empty"), ({"tokens": [3]}, "token is no object"), ([], "sample is no object"), ({"tokens": [token()], "teacher_metadata": [1]}, "teacher_metadata is no object"), ({"tokens": [token()] * 257}, "too many tokens")]
    cases.append(({"tokens": [token()], "schema_version": "other"}, "schema version"))
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(900, "{"), (901, None), (902, json.dumps({"tokens": [token(stress=0.0, boundary={"word_start": "TRUE", "word_end": None}, articulatory=None)]}))], "line_no long, value string")
    out = {r.line_no: [v.rule for v in r.violations] for r in validation.violations(df, "value", validation.Rules(schema_version="v")).collect()}
    for i, (c, rule) in enumerate(cases):
        assert out[i][0] == rule, (c, out[i])
    assert out[900] == out[901] == ["unreadable"] and out[902] == []
    with pytest.raises(validation.InvalidRecord):
        validation.fail_fast(validation.violations(df, "value"), "line_no")


STRENGTHS = [
    (("vowel", "low", None, None, "nucleus", 3, 0, "zh", "false", "true", "true"), 88 + 5, 0.96 * 0.92, -1.0, 0.92),
    (("consonant", None, "nasal", "alveolar", "onset", 2, 0, "zh", "true", "false", "false"), 62.0, 1.02 * 0.92, 1.5, 1.0),
]


def test_pseudo_strength(spark):
    schema = "sample_id string, token_index long, articulatory_type string, articulatory_height string, articulatory_manner string, articulatory_place string, syllable_role string, surface_tone int, stress int, language string, boundary_word_start string, boundary_word_end string, boundary_phrase_end string, articulatory_rounded string"
    for row, base, times, more, phrase in STRENGTHS:
        df = spark.createDataFrame([("s", 1, *row, "false")], schema)
        assert linguistic.pseudo_strength(df).first().pseudo_strength == pytest.approx((base * times + more) * phrase)
    silent = spark.createDataFrame([("s", 1, "silence", *[None] * 11), ("s", 2, *[None] * 12)], schema)
    assert [r.pseudo_strength for r in linguistic.pseudo_strength(silent).orderBy("token_index").collect()] == [0.0, 55.0]


def test_tones(spark):
    texts = [("a", "一个", [1, 4]), ("b", "第一", [4, 1]), ("c", "不去", [4, 4]), ("d", "你好", [3, 3]), ("e", "我很好，你好", [3, 3, 3, None, 3, 3]), ("f", "一，去", [1, None, 4])]
    df = spark.createDataFrame([(k, i + 1, c, t) for k, s, ts in texts for i, (c, t) in enumerate(zip(s, ts))], "sample_id string, pos int, ch string, tone int")
    got = {}
    for r in linguistic.surface_tones(df).orderBy("sample_id", "pos").collect():
        got.setdefault(r.sample_id, []).append(r.surface)
    assert got == {"a": [2, 4], "b": [4, 1], "c": [2, 4], "d": [2, 3], "e": [2, 2, 3, None, 2, 3], "f": [1, None, 4]}


def test_roles(spark):
    df = spark.createDataFrame([("s", i, p, 1) for i, p in enumerate(["s", "t", "ɑ", "p"])] + [("s", 9, "-", 2), ("s", 10, "t", 3), ("s", 11, "s", 3), ("s", 12, "a", None)], "sample_id string, token_index long, phoneme string, syl int")
    got = {r.token_index: r.role for r in linguistic.syllable_roles(df, ["sample_id", "syl"]).collect()}
    assert got == {0: "onset", 1: "onset", 2: "nucleus", 3: "coda", 9: "silence", 10: "onset", 11: "other", 12: None}


def test_vocabulary(spark):
    cols = {f: "string" for f in vocab.FIELDS} | {"surface_tone": "long", "stress": "long"}
    schema = "sample_id string, token_index long, " + ", ".join(f"{k} {v}" for k, v in cols.items())
    row = lambda i, p, place: ("s", i, p, "zh", 1, 0, None, "consonant", None, None, None, place, None, "false", None, "true", None, None, None, None)
    df = spark.createDataFrame([row(1, "b", "labiovelar"), row(2, "a", "alveolopalatal"), row(3, "b", None)], schema)
    v = vocab.build(df)
    ids = {(r.field, r.token): r.id for r in v.collect()}
    assert ids["phoneme", "a"] == 2 and ids["phoneme", "b"] == 3 and ids["articulatory_place", "labiovelar"] == 14 and ids["articulatory_place", "alveolopalatal"] == 15
    assert vocab.problems(v).count() == 0 and vocab.problems(v.where("token <> '[PAD]' or field <> 'stress'")).count() > 0
    e = vocab.encode(df, v).orderBy("token_index").collect()
    assert [r.phoneme for r in e] == [3, 2, 3] and e[2].articulatory_place == ids["articulatory_place", "[NA]"] and e[0].syllable_role == ids["syllable_role", "other"]
    assert vocab.build(df.limit(0)).where("field = 'phoneme'").count() == 2
    assert len(vocab.fingerprint(v)) == 16


def test_vocab_file(spark, tmp_path):
    v = spark.createDataFrame([("f", "[PAD]", 0), ("f", "[UNK]", 1), ("f", "é", 2)], "field string, token string, id long")
    vocab.save(v, str(tmp_path / "v.json"))
    assert sorted(map(tuple, vocab.load(spark, str(tmp_path / "v.json")).collect())) == sorted(map(tuple, v.collect()))
    with pytest.raises(ValueError):
        vocab.load(spark, str(tmp_path / "v.json"), "2")


def test_lines_and_split_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'  {{"n": {i}}}\n' + ("\n" if i % 4 == 0 else "") for i in range(40)), encoding="utf-8")
    lines = readers.read_lines(spark, str(tmp_path / "x.jsonl"))
    got = {r.line_no: json.loads(r.value)["n"] for r in lines.collect()}
    want = {k + 1: json.loads(s)["n"] for k, s in enumerate((tmp_path / "x.jsonl").read_text().splitlines()) if s.strip()}
    assert got == want
    chosen = spark.createDataFrame([(1,), (4,)], "line_no long")
    assert sinks.write_split(lines, chosen, str(tmp_path / "out")) == 2
    with pytest.raises(ValueError):
        sinks.write_split(lines, spark.createDataFrame([(2,)], "line_no long"), str(tmp_path / "out2"))


def test_loading(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text(json.dumps({"tokens": [token()]}) + "\n")
    (tmp_path / "none.jsonl").write_text("\n")
    assert readers.load_split(spark, str(tmp_path / "ok.jsonl")).count() == 1
    with pytest.raises(ValueError):
        readers.load_samples(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(ValueError):
        readers.load_samples(spark, str(tmp_path / "ok.jsonl"), limit=0)
    with pytest.raises(ValueError):
        readers.build_config(validation.Rules, {"max_token": 3})
    assert readers.build_config(validation.Rules, {"languages": ["zh"]}).languages == ("zh",)


def test_pair_roundtrip(spark, tmp_path):
    t = spark.createDataFrame([("a", 2, "y", None), ("a", 1, "x", 1.0), ("b", 1, "z", float("nan"))], "sample_id string, token_index long, phoneme string, strength double")
    s = spark.createDataFrame([("a", "A", 1), ("a", "B", 2), ("c", "C", 1)], "sample_id string, text string, ingested_at int")
    sinks.write_pair(t, s, str(tmp_path / "train.tokens.parquet"))
    nested = readers.load_split(spark, str(tmp_path / "train.tokens.parquet"))
    got = {r.sample_id: (r.text, [x.phoneme for x in r.tokens]) for r in nested.collect()}
    assert got == {"a": ("B", ["x", "y"]), "b": (None, ["z"]), "c": ("C", [])}
    assert nesting.differences(t, nesting.flatten(nested).select(*t.columns), ["sample_id", "token_index"]).count() == 0
    changed = t.withColumn("strength", F.lit(2.0)).where("phoneme <> 'z'")
    assert nesting.differences(t, changed, ["sample_id", "token_index"]).count() == 3
    with pytest.raises(ValueError):
        readers.sibling("x.parquet")


def test_tsv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.tsv").write_text("a\\tb\t1\n\\N\t\\N\nc\\\\n\t3\n")
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())])
    assert sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / "x.tsv"), schema).collect()), key=repr) == sorted([("a\tb", 1), (None, None), ("c\\n", 3)], key=repr)
    (tmp_path / "bad.tsv").write_text("a\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        readers.read_tsv(spark, str(tmp_path / "bad.tsv"), schema).collect()


def test_artifacts_and_events(spark, tmp_path):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int")
    m = metrics.confusion(df, "t", "p", 3)
    out = sinks.write_artifacts(str(tmp_path), metrics.overall(m), metrics.per_class(m), m, metrics.errors(df, F.col("t").cast("double"), F.col("p").cast("double")), df.limit(1))
    assert "2,NaN,NaN,NaN,0" in open(out["per_class"]).read() and json.load(open(out["metrics"]))["total"] == 3
    sinks.append_event(str(tmp_path / "e.jsonl"), "s", "m", stage="x", a=1)
    assert json.loads((tmp_path / "e.jsonl").read_text())["field_stage"] == "x"


def test_cache(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.cached(build, key, str(tmp_path), spark).count() == 3
    assert len(made) == 2


def test_profile_of_nothing(spark):
    t = spark.createDataFrame([], "sample_id string, token_index long, phoneme string, strength double, viseme_id long")
    r = profile.lengths(t).first()
    assert (r.sentences, r.tokens, r["mean"]) == (0, 0, None)
    assert profile.numeric_profile(t, "strength").first().n == 0 and profile.missing_classes(t, 3).count() == 3
    assert profile.coverage(t, t).first().unknown_rate is None


def test_streamed_windows(spark, tmp_path):
    from lexiloom.streaming import logs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"run": "r", "step": i, "value": float(i), "at": f"2025-01-01T00:0{i % 10}:00Z"}) + "\n" for i in range(1, 11)))
    q = logs.step_windows(logs.read_log(spark, str(tmp_path / "in")), 5).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window, r.steps, r["mean"]) for r in spark.table("w").collect()) == [(0, 5, 3.0), (1, 5, 8.0)]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p3_found" in e.queries()


def test_record_violations_on_every_path(spark, tmp_path, rows):
    from lexiloom.plans import core_queries

    bad = '{"phoneme": "", "language": "xx"}'
    text = bad.replace('"', '\\"')
    payloads = [
        f'{{"tokens": [{bad}]}}',
        f'{{"envelope": {{"sample": {{"tokens": [{bad}]}}}}}}',
        f'{{"samples": [{{"tokens": [{bad}]}}, {{"tokens": [{bad}]}}]}}',
        f'{{"phrases": [{{"words": [{{"tokens": [{bad}]}}]}}]}}',
        f'{{"tokens": "[{text}]"}}',
        "{broken",
        '{"tokens": 3}',
        "{}",
    ]
    spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "raw_id string, payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    got = {r.rule: (r.records, r.times) for r in core_queries.record_violations(spark, str(tmp_path)).collect()}
    assert got == {"phoneme missing": (6, 6), "language not supported": (6, 6), "labels missing": (6, 6), "unreadable": (1, 1), "tokens is no list": (1, 1), "tokens missing": (1, 1)}


def test_missing_classes_reads_every_strength(spark, tmp_path):
    from lexiloom.plans import core_queries

    t = [("s", i, i, 50.0) for i in range(16)] + [("s", 16, 16, None)]
    spark.createDataFrame(t, "sample_id string, token_index long, viseme_id long, strength double").write.parquet(f"{tmp_path}/tokens.parquet")
    assert [r.viseme_id for r in core_queries.missing_classes(spark, str(tmp_path)).collect()] == [17]


def test_long_prefix_lists_are_cut(spark, monkeypatch):
    """Sets that all share their hashes, in blocks of three: the same pairs as in one."""
    r = random.Random(9)
    sets = [(f"s{i:02d}", sorted(r.sample(range(12), 10))) for i in range(30)]
    df = spark.createDataFrame(sets, "id string, hashes array<long>")
    found = []
    for block in (4096, 3):
        monkeypatch.setattr(dedup, "BLOCK", block)
        found.append(sorted(tuple(x) for x in dedup.verified(df, dedup.prefix_pairs(df, 0.8), 0.8).select("a", "b").collect()))
    want = sorted((a, b) for a, x in sets for b, y in sets if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= 0.8)
    assert found[0] == found[1] == want and want


def test_pairs_beyond_the_threshold_are_not_written(spark, monkeypatch):
    """Sets under common hashes that differ in too many are counted, not written as pairs, in blocks too; the number of candidates is that of the definition."""
    r = random.Random(11)
    sets = [(f"s{i:03d}", sorted(r.sample(range(300), 30))) for i in range(120)]
    sets += [(f"t{i:03d}", sorted([*h[:-1], 1000 + i])) for i, (_, h) in enumerate(sets[:15])] + [("u0", [-5]), ("u1", [-5]), ("u2", [2**40])]
    df = spark.createDataFrame(sets, "id string, hashes array<long>")
    alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = sorted((a, b) for a, x in sets for b, y in sets if a < b and alike(x, y) >= 0.8)
    assert len(want) == 16
    often = collections.Counter(h for _, x in sets for h in x)
    buckets = collections.Counter(h for _, x in sets for h in sorted(x)[:8])

    def candidates(cap):
        inside = [(i, x) for i, x in sets if any(buckets[h] > cap for h in sorted(x)[:8])]
        n = collections.Counter(h for _, x in inside for h in x)
        rare = {i: set(sorted(x, key=lambda h: (n[h], h))[: len(x) - math.ceil(len(x) * 0.8 - 1e-9) + 1]) for i, x in inside}
        low = {i: {h for h in sorted(x)[:8] if buckets[h] <= cap} for i, x in sets}
        size = {i: len(x) for i, x in sets}
        near = lambda a, b: size[b] >= 0.8 * size[a] - 1e-9 and size[a] >= 0.8 * size[b] - 1e-9
        return sum(bool(low[a] & low[b]) or bool(rare.get(a, set()) & rare.get(b, set())) and near(a, b) for a in low for b in low if a < b)

    assert max(often.values()) > 5
    for block in (4096, 5):
        monkeypatch.setattr(dedup, "BLOCK", block)
        pairs = dedup.prefix_pairs(df, 0.8)
        assert sorted(tuple(x) for x in dedup.verified(df, pairs, 0.8).select("a", "b").collect()) == want
        assert pairs.count() < 2 * len(want)
        for cap in (3, 10, 1000):
            near, pairs, _ = dedup.near_pairs(df, 0.8, cap=cap)
            assert {(x.a, x.b) for x in near.collect()} <= {*want} and pairs.where("a is not null").count() < 2 * len(want)
            assert pairs.agg(F.sum("n")).first()[0] == candidates(cap)
    monkeypatch.setattr(dedup, "FREQUENT_ROWS", 10)
    assert sorted(tuple(x) for x in dedup.verified(df, dedup.prefix_pairs(df, 0.8), 0.8).select("a", "b").collect()) == want
    assert dedup.prefix_pairs(df.limit(0), 0.8).count() == 0


def test_signatures_do_not_shuffle_sequences(spark, rows):
    """Signatures of texts and sequences are found without a join of the sequences, which would shuffle each of them; samples without tokens have none."""
    from lexiloom.storage import cut

    seqs = cut(spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["x", "y"]), ("d", ["z"])], "sample_id string, phonemes array<string>"), "sequences")
    samples = spark.createDataFrame([("a", " hi\n you"), ("a", "later"), ("b", None), ("c", "hi you"), ("d", "  "), ("none", "hi you")], "sample_id string, text string")
    found = dedup.signatures(samples, seqs)
    assert rows(found, "sample_id", "signature") == sorted([("a", "p:x y"), ("a", "t:hi you"), ("b", "p:"), ("c", "p:x y"), ("c", "t:hi you"), ("d", "p:z")], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    joins = [k for k, x in enumerate(plan) if "Join" in x]
    below = [x for k in joins for n, x in enumerate(plan) if n > k and all(depth(y) > depth(plan[k]) for y in plan[k + 1 : n + 1])]
    assert joins and below and not any("phonemes" in x for x in below)


def test_current_leaks_reads_tokens_once(spark, monkeypatch, tmp_path):
    """Sequences are made once for the groups and the signatures; the leaks are those of both."""
    from lexiloom.plans import core_queries

    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "z")], "sample_id string, text string").write.parquet(f"{tmp_path}/samples.parquet")
    spark.createDataFrame([(k, i, p) for k, w in (("a", "tuvw"), ("b", "tuvw"), ("c", "mnop")) for i, p in enumerate(w)], "sample_id string, token_index long, phoneme string").write.parquet(f"{tmp_path}/tokens.parquet")
    spark.sql("select col1 sample_id, col2 split_name, timestamp'2025-01-01' assigned_at from values ('a', 'train'), ('b', 'test'), ('c', 'train')").write.parquet(f"{tmp_path}/split_members.parquet")
    made, real = [], dedup.sequences
    monkeypatch.setattr(dedup, "sequences", lambda t: made.append(1) or real(t))
    assert sorted((r.kind, r.splits) for r in core_queries.current_leaks(spark, str(tmp_path)).collect()) == [("group", 2), ("signature", 2), ("signature", 2)] and len(made) == 1


def test_sketch_search_holds_one_copy_of_the_sets(spark):
    """After the sketch search the sets lie in the shared folder once, and those of skipped buckets were compared in parts, whose pairs are all counted."""
    import os

    from lexiloom.storage import shared_dir

    r = random.Random(12)
    df = spark.createDataFrame([(f"s{i:03d}", sorted(r.sample(range(200), 20))) for i in range(100)], "id string, hashes array<long>")
    folder = shared_dir(spark).removeprefix("file:")
    old = {*os.listdir(folder)}
    near, pairs, skipped = dedup.near_pairs(df, 0.8, cap=3)
    left = collections.Counter(x.split("-")[0] for x in {*os.listdir(folder)} - old)
    assert (left["sets"], left["inside"], left["sketched"], left["candidates"]) == (0, 0, 1, 1 + dedup.PARTS) and skipped.count()
    assert dedup.PARTS > 1 and near.count() == 0 and pairs.agg(F.sum("n")).first()[0] > 100


def test_metric_states_merge(spark):
    r = random.Random(1)
    data = [(r.choice("abc"), r.randrange(4), r.randrange(4), r.uniform(0, 100), r.uniform(0, 100)) for _ in range(200)] + [("a", None, 1, 5.0, None), ("b", 1, None, None, 3.0)]
    df = spark.createDataFrame(data, "day string, t int, p int, x double, y double")
    whole = metrics.finalise(metrics.merge_states(metrics.state(df, "t", "p", "x", "y")), 4).first()
    parts = [metrics.state(df.where(F.col("day") == k), "t", "p", "x", "y") for k in "abc"]
    merged = metrics.finalise(metrics.merge_states(*parts), 4).first()
    assert all(whole[c] == pytest.approx(merged[c]) for c in whole.asDict())
    direct = metrics.errors(df, F.col("x"), F.col("y")).first()
    assert whole.mae == pytest.approx(direct.mae) and whole.rmse == pytest.approx(direct.rmse) and whole.accuracy == pytest.approx(metrics.overall(metrics.confusion(df, "t", "p", 4)).first().accuracy)
    empty = metrics.finalise(metrics.state(df.limit(0), "t", "p", "x", "y"), 4).first()
    assert (empty.accuracy, empty.mae, empty.total) == (0.0, 0.0, 0)
    assert metrics.masked(df.limit(0), F.lit(True), "t", "p", "x", "y").first().mae == 0.0
    row = lambda *v: spark.createDataFrame([v], "accuracy double, macro_f1 double, mae double")
    assert [r.passed for r in metrics.acceptance(row(0.95, 0.92, 8.0), row(0.955, 0.0, 0.0)).collect()] == [True] * 3
    assert [r.passed for r in metrics.acceptance(row(0.94, float("nan"), None), row(0.955, 0.0, 0.0)).collect()] == [False] * 3


def test_service_requests(spark):
    from lexiloom.operators import requests

    body = {"visemes": [{"ipa": None, "word": "，"}, {"ipa": "-", "word": "好", "wordIndex": 1, "charIndex": 1}, {"ipa": "a", "word": "好", "wordIndex": 1, "charIndex": 1, "startPercent": 0.5}, {"word": "。", "wordIndex": 2}, {"ipa": "t", "word": "hi", "wordIndex": 3}, None]}
    df = spark.createDataFrame([("r1", json.dumps(body)), ("r2", json.dumps({"visemes": []})), ("r3", "{bad"), ("r4", None)], "request_id string, payload string")
    rows_ = requests.request_rows(df)
    got = [(r.phoneme, r.char_index, r.word_index, r.word) for r in rows_.where("request_id = 'r1'").orderBy("position").collect()]
    assert got == [("_", 0, 0, "，"), ("_", 1, 1, "好"), ("a", 1, 1, "好"), ("_", 0, 2, "。"), ("t", 0, 3, "hi")]
    assert sorted(r.request_id for r in rows_.where("error is not null").collect()) == ["r2", "r3", "r4"]
    tones = spark.createDataFrame([("r1", 1, 3)], "request_id string, char_index long, tone long")
    t = requests.request_tokens(rows_, tones).orderBy("position").collect()
    assert [r.surface_tone for r in t] == [5, 3, 3, 5, 0] and [r.language for r in t] == ["zh"] * 4 + ["en"]
    assert [(r.word_start, r.word_end) for r in t] == [(True, True), (True, False), (False, True), (True, True), (True, True)]
    assert [r.phrase_end for r in t] == [True, False, False, True, True] and [r.phrase_start for r in t] == [False, True, False, False, True]
    assert [r.boundary_type for r in t] == ["minor", "none", "none", "major", "none"] and [r.syllable_role for r in t] == ["silence", "silence", "nucleus", "silence", "onset"]
    out = requests.responses(requests.request_tokens(rows_, tones).withColumns({"predicted": F.lit("open"), "strength": F.lit(1.5)}))
    answer = json.loads(out.first().visemes)
    assert [a["ipa"] for a in answer] == ["-", "-", "a", "-", "t"] and answer[2]["startPercent"] == 0.5 and "startPercent" not in answer[0] and answer[0]["word"] == "，" and "charIndex" not in answer[0]


def test_revalidated_pair(spark, tmp_path):
    cols = "sample_id string, token_index long, phoneme string, language string, surface_tone long, stress long, viseme_id long, strength double"
    good = spark.createDataFrame([("a", 2, "x", "zh", 1, 0, 3, 5.0), ("a", 1, "y", "zh", 1, 0, 3, 5.0)], cols)
    s = spark.createDataFrame([("a", "A", 1)], "sample_id string, text string, ingested_at int")
    sinks.write_pair(good, s, str(tmp_path / "good.tokens.parquet"))
    assert readers.read_pair(spark, str(tmp_path / "good.tokens.parquet"), rules=validation.Rules()).count() == 1
    assert [t["phoneme"] for t in json.loads(nesting.records(good, s).first().value)["tokens"]] == ["y", "x"]
    sinks.write_pair(good.withColumn("stress", F.lit(2).cast("long")), s, str(tmp_path / "bad.tokens.parquet"))
    with pytest.raises(validation.InvalidRecord):
        readers.read_pair(spark, str(tmp_path / "bad.tokens.parquet"), rules=validation.Rules())


def test_generated_corpus_has_its_duplicates(spark):
    from lexiloom.sources import generate

    c = generate.corpus(spark, 200, exact=0.1, near=0.1, seed=3, shortest=90, longest=120)
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, generate.corpus(spark, 200, exact=0.1, near=0.1, seed=3, shortest=90, longest=120).repartition(3).collect()))
    s = c.select("sample_id").distinct().withColumn("text", F.lit(None).cast("string"))
    groups = {r.sample_id: r.root for r in dedup.duplicate_groups(s, c)["groups"].collect()}
    pairs = {(r.sample_id, r.copy_of) for r in c.where("copy_of is not null").select("sample_id", "copy_of").distinct().collect()}
    same = sum(groups[a] == groups[b] for a, b in pairs)
    assert len(pairs) == same == 40


def test_reports(spark):
    from lexiloom.sources import reports

    checks = spark.createDataFrame([("a", True), ("b", False)], "check string, passed boolean")
    assert "FAIL" in reports.gate_report(checks).splitlines()[-1] and "pass" in reports.gate_report(checks.where("passed"))
    t = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("r", 1, "x")], "sample_id string, token_index long, phoneme string")
    text = reports.profile_report(profile.lengths(t), profile.frequencies(t, ("phoneme",)), ("phoneme",))
    assert "sentences" in text and "x: 66.67%, y: 33.33%" in text
    m = metrics.confusion(spark.createDataFrame([(0, 0), (1, 0)], "t int, p int"), "t", "p", 2)
    assert "accuracy" in reports.evaluation_report(metrics.overall(m), metrics.errors(spark.createDataFrame([(1.0, 2.0)], "t double, p double"), F.col("t"), F.col("p")), metrics.per_class(m))


def test_cache_key_follows_the_source(tmp_path):
    p = tmp_path / "x"
    p.write_text("a")
    one = sinks.cache_key(str(p), 1, "v", {"human": 2.0})
    assert one == sinks.cache_key(str(p), 1, "v", {"human": 2.0}) != sinks.cache_key(str(p), 2, "v", {"human": 2.0})
    p.write_text("ab")
    assert sinks.cache_key(str(p), 1, "v", {"human": 2.0}) != one


def test_tsv_escapes(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.tsv").write_text("\\`\\=\\'\n")
    assert readers.read_tsv(spark, str(tmp_path / "x.tsv"), T.StructType([T.StructField("s", T.StringType())])).first().s == "`='"
