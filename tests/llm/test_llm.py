import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import bpe, cosine, duplicates, encoding, features, graph, looks, mixing, percentiles, rtree, similar, splits

RNG = random.Random(11)
CLASH = ["id", "look", "text_form", "u", "v", "x", "p", "key", "h", "n", "letters", "_t", "_h", "runs", "flag", "part", "side", "rank", "one", "who", "first"]


def with_clashes(df):
    """Extra columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("z") for c in CLASH if c not in df.columns})


# 1. One form of look-alike texts

PAIRS = [("Maria", "Mаrіа"), ("café", "café"), ("ａｂｃ１", "abc1"), ("a​b", "ab"), ("a b", "a b"), ("  ab　", "ab"), ("口", "⼝"), ("﻿x", "x"), ("ɛ", "ε"), ("ё", "ë")]
APART = [("ab", "Ab"), ("a", "á"), ("a b", "ab"), ("1", "l"), ("。", "."), ("ɑ", "a"), ("–", "-"), ("звук", "3вук")]


@pytest.mark.parametrize("form", [looks.Form(), looks.Form(Counter({("", "М"): 9, ("М", "а"): 9, ("a", "b"): 50}))])
def test_form(form):
    assert all(form(a) == form(b) for a, b in PAIRS)
    assert all(form(a) != form(b) for a, b in APART)
    assert form("") == form(" ​ ") == ""
    long = "Mаrіа " * 50_000
    assert form(long) == form("Maria " * 50_000)


def test_viterbi_is_script_consistent():
    form = looks.Form(Counter({("", "a"): 50, ("a", "b"): 50, ("", "з"): 5, ("з", "в"): 5, ("в", "у"): 5, ("у", "к"): 5}))
    assert form("звyк") == "звук" and form("аb") == "ab"


def test_lattice_path_is_best():
    form = looks.Form(Counter({(a, b): RNG.randrange(1, 9) for a in ["", *"aаbсc"] for b in "aаbсc"}))
    from itertools import product

    for word in ("acа", "сcab", "аааcс"):
        ways = ["".join(w) for w in product(*[looks.CLASSES.get(c, c) for c in word])]
        cost = lambda w: sum(form.step(a, b) for a, b in zip(["", *w], w))
        assert cost(form(word)) == pytest.approx(max(map(cost, ways)))


def test_same_looking_texts(spark, rows):
    data = [("s1", "Maria"), ("s2", "Mаria"), ("s3", "Maria"), ("s2", "Mаria"), ("s4", None), ("s5", ""), ("s6", "​"), ("s7", "maria"), (None, "Mаria"), ("s8", "Mаriа")]
    df = with_clashes(spark.createDataFrame(data, "sample_id string, text string"))
    form = looks.learn_form(df, "text")
    assert rows(looks.same_looking_texts(df, form)) == [("s1", "s2"), ("s1", "s8"), ("s2", "s3"), ("s2", "s8"), ("s3", "s8")]
    assert looks.same_looking_texts(df.limit(0), looks.learn_form(df.limit(0), "text")).count() == 0
    assert rows(looks.look_classes(df, form)) == [("s1", "s1", 3), ("s2", "s1", 3), ("s3", "s1", 3), ("s7", "s7", 1), ("s8", "s1", 3)]
    assert looks.look_classes(df.limit(0), form).count() == 0


def test_marks_stay_inside_runs():
    """An accent neither ends a run nor hides its script."""
    form = looks.Form(Counter({("", "a"): 50, ("a", "b"): 50, ("", "з"): 5, ("з", "в"): 5, ("в", "у"): 5, ("у", "к"): 5}))
    assert form("зву\u0301yк") == form("зву\u0301ук") and form("e\u0301\u0323") == form("é\u0323") and form("a\u0301") != form("a")


def test_phoneme_map(spark, rows):
    t = with_clashes(spark.createDataFrame([("ә",), ("ə",), ("t​",), ("q",), (None,), ("",), (" t",), ("ә",)], "phoneme string"))
    inv = with_clashes(spark.createDataFrame([("ə",), ("t",), (None,)], "phoneme string"))
    assert rows(looks.phoneme_map(t, inv, looks.Form())) == sorted([("ә", "ə"), ("t​", "t"), (" t", "t")], key=repr)
    assert looks.phoneme_map(t, inv.limit(0), looks.Form()).count() == 0


# 2. Groups


def brute_groups(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def shapes():
    e = [(i, i + 1) for i in range(25)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    e += [(300 + i, 300 + j) for i in range(5) for j in range(i)] + [(400, 401), (401, 400), (500, 500), (600, 601), (601, 602), (602, 600), (602, 603)]
    e += [(700 + RNG.randrange(25), 700 + RNG.randrange(25)) for _ in range(24)]
    RNG.shuffle(e)
    return [(f"{a:04d}", f"{b:04d}") for a, b in e]


def test_pair_groups(spark):
    e = shapes()
    df = with_clashes(spark.createDataFrame([*e, (None, "0001"), ("0002", None), (None, None)], "sample_a string, sample_b string"))
    assert {r.sample_id: r.group_id for r in graph.pair_groups(df, "sample_a", "sample_b").collect()} == brute_groups(e)


def test_hook_and_shortcut(spark):
    e = [x for x in shapes() if x[0] != x[1]]
    got = graph.hook_and_shortcut(spark.createDataFrame(e, "u string, v string"))
    assert {r.x: r.p for r in got.collect()} == brute_groups(e)


def test_no_pairs(spark):
    df = spark.createDataFrame([], "sample_a string, sample_b string")
    assert graph.pair_groups(df, "sample_a", "sample_b").count() == 0 and graph.hook_and_shortcut(df.toDF("u", "v")).count() == 0


# 4. Percentiles


def test_radix_percentiles(spark):
    values = [("en", 1, x) for x in [0.0, -0.0, 1e-300, 3.5, 3.5, 3.5, 100.0]] + [("zh", None, RNG.uniform(0, 100)) for _ in range(500)] + [(None, 2, 7.25)] + [("zh", 3, -5.0), ("zh", 3, 1e9), ("zh", 3, 2.0)]
    df = with_clashes(spark.createDataFrame(values, "language string, viseme_id int, strength double"))
    got = {(r.language, r.viseme_id): r for r in percentiles.radix_percentiles(df, ["language", "viseme_id"], "strength").collect()}
    for key in {v[:2] for v in values}:
        xs = [v[2] for v in values if v[:2] == key]
        assert got[key].n == len(xs)
        for p in percentiles.PERCENTS:
            assert got[key][f"p{p:02d}"] == pytest.approx(np.percentile(xs, p), rel=1e-12)
    assert percentiles.radix_percentiles(df.limit(0), ["language"], "strength").count() == 0


def test_partials_add_up_within_the_bound(spark):
    values = [(RNG.choice("ab"), RNG.randrange(4), round(RNG.uniform(0, 100), 2)) for _ in range(3000)]
    df = spark.createDataFrame(values, "g string, day int, x double")
    parts = percentiles.partials(df, ["day", "g"], "x")
    got = {(r.g, r.percent): r for r in percentiles.merged_percentiles(parts, ["g"]).collect()}
    for g in "ab":
        xs = sorted(v[2] for v in values if v[0] == g)
        for p in percentiles.PERCENTS:
            exact = xs[max(1, -(-len(xs) * p // 100)) - 1]
            r = got[g, p]
            assert r.low <= exact <= r.high and r.high - r.low <= max(r.high, 1e-9) / 4096 and r.n == len(xs)


def test_strengths(spark, rows):
    schema = "sample_id string, token_index long, language string, viseme_id long, strength double"
    data = [("a", 1, "zh", 1, 5.0)] * 3 + [("a", 2, "zh", None, 101.0), ("a", 3, "zh", 1, float("nan")), ("a", 4, None, 2, None), ("a", 5, "en", 2, float("inf")), ("a", 6, "en", 2, 0.0), ("a", 6, "en", 2, 100.0), (None, 1, "en", 3, 4.0)]
    df = with_clashes(spark.createDataFrame(data, schema))
    assert rows(percentiles.strengths(df)) == sorted([("a", 1, "zh", 1, 5.0), ("a", 6, "en", 2, 0.0), (None, 1, "en", 3, 4.0)], key=repr)


# 5. Splits


def test_keep_together(spark):
    data = [("a", "Spk-1", "c1"), ("b", " sрk-1", None), ("c", "k2", "c1"), ("d", "", ""), ("e", None, None), ("f", "k3", "c9"), ("f", "k4", None), ("g", "k4", " "), ("h", "​", None), (None, "k4", None), ("a", "Spk-1", "c1")]
    df = with_clashes(spark.createDataFrame(data, "sample_id string, speaker_key string, script_id string"))
    groups = {r.sample_id: r.group_id for r in splits.keep_together(df).collect()}
    classes = {}
    for s, g in groups.items():
        classes.setdefault(g, set()).add(s)
    assert sorted(map(sorted, classes.values())) == [["a", "b", "c"], ["d"], ["e"], ["f", "g"], ["h"]]
    assert splits.keep_together(df.limit(0)).count() == 0
    now = spark.createDataFrame([("a", "train"), ("c", "test"), ("f", "train"), ("zz", "test")], "sample_id string, split_name string")
    assert sorted(r[0] for r in splits.broken_groups(splits.keep_together(df), now).collect()) == ["a", "b", "c"]


def test_current_splits(spark, rows):
    df = spark.createDataFrame([("a", "train", 1), ("a", "test", 2), ("a", "test", 2), ("b", "train", None), ("b", "test", None), ("c", None, 9), (None, "test", 1)], "sample_id string, split_name string, assigned_at int")
    assert rows(splits.current_splits(df)) == [("a", "test"), ("b", "train")]


@pytest.mark.parametrize("seed", range(12))
def test_closest_subset(seed):
    r = random.Random(seed)
    sizes = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(4)}
    flat = [s for s, c in sizes.items() for _ in range(c)]
    sums = {0}
    for s in flat:
        sums |= {t + s for t in sums}
    target = r.randrange(0, sum(flat) + 20)
    take = splits.closest_subset(sizes, target)
    total = sum(s * c for s, c in take.items())
    assert all(c <= sizes[s] for s, c in take.items()) and abs(total - target) == min(abs(t - target) for t in sums)


def test_closest_subset_in_bounded_memory():
    """About 10^9 samples in every possible number of group sizes: little memory, a miss smaller than the smallest group left."""
    import tracemalloc

    sizes = {s: 1 for s in range(2, 44_000)}
    n = sum(sizes)
    tracemalloc.start()
    take = splits.closest_subset(sizes, n // 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = sum(s * c for s, c in take.items())
    left = min(s for s in sizes if not take.get(s))
    assert n > 9 * 10**8 and abs(total - n // 20) < left and peak < 2**30 and all(take[s] <= sizes[s] for s in take)
    small = {s: 2 for s in range(3, 40)}
    assert sum(s * c for s, c in splits.closest_subset(small, 301, most=64).items()) in range(298, 305)


def test_closest_subset_is_the_same_with_little_memory():
    """The closest total, whatever the bytes for bit sets; also where it takes more than the smallest sizes and none is hit."""
    assert splits.closest_subset({10: 1, 7: 2}, 14, most=0) == {7: 2}
    r = random.Random(4)
    for k in range(60):
        sizes = {r.randrange(1, 60) * (1 + 29 * (k % 3)): r.randrange(1, 4) for _ in range(r.choice((1, 5, 24)))}
        sums = 1
        for s, c in sizes.items():
            for _ in range(c):
                sums |= sums << s
        sums = [t for t in range(sums.bit_length()) if sums >> t & 1]
        target = r.randrange(0, sums[-1] + 20)
        want = min(sums, key=lambda t: (abs(t - target), t))
        takes = [splits.closest_subset(sizes, target, most=most) for most in (128 << 20, 500, 0)]
        assert takes[0] == takes[1] == takes[2] and sum(s * c for s, c in takes[0].items()) == want
        assert all(0 < c <= sizes[s] for s, c in takes[0].items())


def test_assign_splits(spark):
    g = [(f"s{i}", "hot" if i < 100 else f"g{i // 3}") for i in range(300)]
    df = spark.createDataFrame(g, "sample_id string, group_id string")
    got = splits.assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert Counter(r.split for r in got) == {"train": 240, "validation": 30, "test": 30}
    assert len({(r.group_id, r.split) for r in got}) == len({r.group_id for r in got}) and len(got) == 300
    assert splits.assign_splits(df.limit(0), {"train": 0.8, "test": 0.2}).count() == 0


# 6, 7. Alike sets


def random_sets(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            base = set(r.choice(out))
            for _ in range(r.randrange(0, 8)):
                if len(base) > 1 and r.random() < 0.5:
                    base.discard(r.choice(sorted(base)))
                else:
                    base.add(r.randrange(300))
        else:
            base = {r.randrange(300) for _ in range(r.randrange(1, 30))}
        out.append(frozenset(base))
    return sorted(set(out), key=sorted)


@pytest.mark.parametrize("frequent", [1 << 17, 40, 0])
@pytest.mark.parametrize("join,block", [(rtree.RTree(0.6), 4096), (rtree.RTree(0.8), 4096), (cosine.Cosine(0.6), 4096), (rtree.RTree(0.6), 5), (cosine.Cosine(0.6), 5)])
def test_alike_is_exact(spark, join, block, frequent, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "FREQUENT_ROWS", frequent)
    sets = random_sets(250, 3)
    mark = lambda k: int(features.mix64(np.array([k]))[0] >> np.uint64(1))
    flags = [RNG.choice((1, 2, 3)) for _ in sets]
    df = spark.createDataFrame([(f"{i:04d}", sorted(mark(x) for x in s), f) for i, (s, f) in enumerate(zip(sets, flags))], "id string, runs array<long>, flag int")
    got = {(r.a, r.b) for r in similar.alike(df, join).collect()}
    t = getattr(join, "jaccard", None) or join.t
    want = {(f"{i:04d}", f"{j:04d}") for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t and (flags[i] & 1 and flags[j] & 2 or flags[j] & 1 and flags[i] & 2)}
    assert got == want and len(want) > 20


def test_long_lists_are_dealt_by_sides(spark, monkeypatch):
    """36 sets of one side and 4 of the other under one run: a row each, and one per block of the larger side for the 4."""
    monkeypatch.setattr(similar, "BLOCK", 5)
    df = spark.createDataFrame([(f"{i:02d}", [0, 1], 2 if i % 10 == 3 else 1) for i in range(40)], "id string, runs array<long>, flag int")
    rows, _, _ = similar.filed(df, cosine.Cosine(0.6))
    assert rows.count() == 36 + 4 * 8
    assert similar.alike(df, cosine.Cosine(0.6)).count() == 36 * 4


def test_counts_of_runs_are_exact(spark):
    sets = random_sets(120, 5)
    df = spark.createDataFrame([(f"{i}", sorted(s), 3) for i, s in enumerate(sets)], "id string, runs array<long>, flag int")
    want = Counter(x for s in sets for x in s)
    _, (runs, n), rare, most = similar.counted(df, 1 << 17)
    assert rare == 1 and dict(zip(runs.tolist(), n.tolist())) == {k: v for k, v in want.items() if v > 1} and most == max(want.values())
    out, table, rare, _ = similar.counted(df, 0)
    assert table is None and rare == 1
    for r in out.collect():
        assert {k: want[k] for k in sets[int(r.id)]} == dict(zip(r.runs, r.often))


def test_tree_prunes_whole_nodes():
    r = np.random.default_rng(2)
    families = r.poisson(1.0, (40, rtree.GROUPS))
    counts = np.concatenate([np.maximum(0, f + r.integers(-1, 2, (50, rtree.GROUPS)) * (r.random((50, rtree.GROUPS)) < 0.05)) for f in families]).astype(np.uint8)
    counts = counts[r.permutation(len(counts))]
    n = counts.sum(1).astype(np.int32)
    cols = {"n": n, "pos": np.zeros(len(n), np.int32), "counts": counts, "flag": np.full(len(n), 3, np.int32), **{c: np.zeros(len(n), np.int32) for c in ("i", "j", "side")}}
    seen = Counter()
    tree = rtree.RTree(0.8, seen)
    got = {tuple(sorted(p)) for s, t in tree.pairs(cols, np.array([len(n)])) for p in zip(s.tolist(), t.tolist())}
    x = np.minimum(counts[:, None], counts[None]).sum(2) >= tree.need(n[:, None].astype(float), n[None].astype(float))
    x &= np.minimum(n[:, None], n[None]) >= 0.8 * np.maximum(n[:, None], n[None]) - 1e-9
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(x, 1)))}
    assert seen["points"] < 0.5 * len(n) * (len(n) - 1) / 2 and sum(v for k, v in seen.items() if k.startswith("pruned")) > 100


def test_weights_decide(spark):
    """The bound of a pair holds for every alike pair, with weights far apart."""
    r = np.random.default_rng(4)
    c = cosine.Cosine(0.6)
    c.total = 1000
    for _ in range(300):
        a = set(r.integers(0, 60, 20).tolist())
        b = {x for x in a if r.random() < 0.8} | set(r.integers(0, 60, 3).tolist())
        square = {x: float(c.squares(np.array([x * x + 1.0]))[0]) for x in a | b}
        if len(a & b) / len(a | b) >= 0.6:
            k = c.common(np.array([len(a)]), np.array([len(b)])).astype(int)
            assert len(a & b) >= k[0] >= max(c.own_least(np.array([len(a), len(b)])))
            for s in (a, b):
                low = c.least(np.array([square[x] for x in sorted(s)]), np.array([len(s)]), k)[0]
                assert sum(square[x] for x in a & b) >= low - 1e-9


def test_run_sets():
    texts = ["abcdefg", "abc", "", "aaaaaaa", "abcdefgh"]
    h, n = features.run_sets(*features.text_codes(texts))
    assert n.tolist() == [4, 1, 0, 1, 5]
    parts = [set(x.tolist()) for x in np.split(h, np.cumsum(n)[:-1])]
    assert len(parts[0] & parts[4]) == 4 and not parts[1] & parts[0]


def brute_alike(items, t, size=4):
    runs = {k: {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1))} for k, v in items.items() if len(v)}
    return {(a, b) for a in runs for b in runs if a < b and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= t}


def make_texts(n=120):
    r = random.Random(8)
    out = {}
    for i in range(n):
        if out and r.random() < 0.6:
            t = list(r.choice(sorted(out.values())))
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice("abcdefgh")
        else:
            t = [r.choice("abcdefgh") for _ in range(r.randrange(1, 40))]
        out[f"s{i:03d}"] = "".join(t)
    return out


def test_near_duplicates(spark, rows):
    texts = make_texts()
    texts |= {"l1": "x" * 30_000 + "abcd", "l2": "X" * 30_000 + "ａbсd", "p1": "!?", "e1": ""}
    data = [(k, v) for k, v in texts.items()] + [("s000", texts["s000"]), ("n1", None), (None, "abcdef")]
    samples = with_clashes(spark.createDataFrame(data, "sample_id string, text string"))
    letters = {k: "".join(c for c in unicodedata.normalize("NFKC", v).lower().replace("с", "c") if c.isalnum()) for k, v in texts.items()}
    phones = {f"s{i:03d}": [RNG.choice(["t", "a", "n", "-"]) for _ in range(RNG.randrange(0, 12))] for i in range(40)}
    toks = [(k, i, "t​" if p == "t" and RNG.random() < 0.3 else p) for k, v in phones.items() for i, p in enumerate(v)]
    tokens = with_clashes(spark.createDataFrame(toks + toks[:9] + [(None, 1, "t"), ("s001", None, "t"), ("s001", 99, None)], "sample_id string, token_index long, phoneme string"))
    inv = spark.createDataFrame([("t", "consonant"), ("a", "vowel"), ("-", "silence"), (None, None)], "phoneme string, articulatory_type string")
    want = brute_alike(letters, 0.6) | brute_alike({k: [p for p in v if p != "-"] for k, v in phones.items()}, 0.8)
    got = rows(duplicates.near_duplicates(samples, tokens, inv))
    assert set(got) == want and len(got) == len(want) and ("l1", "l2") in want
    groups = {r.sample_id: r.group_id for r in duplicates.duplicate_groups(samples, tokens, inv).collect()}
    b = brute_groups(want)
    assert groups == {k: b.get(k, k) for k in {*texts, *phones, "n1"}}


def test_hot_copies_are_dealt_out(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "SPREAD", 3)
    samples = spark.createDataFrame([(f"s{i:02d}", "the same long text" if i % 3 else f"other text number {i} {i * i}") for i in range(40)], "sample_id string, text string")
    empty = spark.createDataFrame([], "sample_id string, token_index long, phoneme string")
    inv = spark.createDataFrame([], "phoneme string, articulatory_type string")
    got = rows(duplicates.near_duplicates(samples, empty, inv))
    same = [f"s{i:02d}" for i in range(40) if i % 3]
    assert {(a, b) for a in same for b in same if a < b} <= set(got) and len(got) == len(set(got))
    assert duplicates.near_duplicates(samples.limit(0), empty, inv).count() == 0


def test_split_overlaps(spark, rows):
    texts = make_texts(250)
    r = random.Random(4)
    side = {k: r.choice(["train", "train", "test", "validation", None]) for k in texts}
    samples = with_clashes(spark.createDataFrame([*texts.items(), ("n1", None), ("s000", texts["s000"])], "sample_id string, text string"))
    members = with_clashes(spark.createDataFrame([(k, v, 2) for k, v in side.items() if v] + [(k, "train", 1) for k in side if side[k]], "sample_id string, split_name string, assigned_at int"))
    want = {(a, b) for a, b in brute_alike(texts, 0.6) if side[a] and side[b] and (side[a] == "train") != (side[b] == "train")}
    out = duplicates.split_overlaps(samples, members)
    assert set(rows(out, "sample_a", "sample_b")) == want and out.count() == len(want) > 10
    origins = with_clashes(spark.createDataFrame([(k, "studio") for k in texts if k != "s001"], "sample_id string, source string"))
    report = duplicates.overlap_report(out, origins).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert duplicates.split_overlaps(samples.limit(0), members).count() == 0 and duplicates.overlap_report(out.limit(0), origins).count() == 0


# 8. Encoding with a public tokenizer

TEXTS = ["", None, "   ", "aaaaaaaa aaa", "<|endoftext|> hi", "Don't 'll", "\n\n x  y", "哈哈哈" * 40, "🎤𝕏", "\x00\x01", "word " * 20_000, "字" * 20_000] + ["".join(RNG.choice("ab \n'ls的é🎤1") for _ in range(RNG.randrange(60))) for _ in range(400)]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = with_clashes(spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)] + [(0, ""), (None, "ab")], "doc_id long, text string"))
    got = bpe.encode(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.ids == t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
    n = {r.doc_id: r.n_tokens for r in bpe.encode(df, only_count=True).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in got)
    assert bpe.encode(df.limit(0)).count() == 0


def test_small_blocks(spark, monkeypatch):
    m = bpe.load_merges(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    words = sorted({w for t in TEXTS if t for w in bpe.regex.findall(bpe.PATTERN, t)})
    whole = bpe.replay_words(words, m)
    df = spark.createDataFrame(list(enumerate(TEXTS[:40])), "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 7)
    assert all((a == b).all() for a, b in zip(whole, bpe.replay_words(words, m)))
    for chars, documents in ((1, 10), (10**6, 1), (50, 3)):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
        monkeypatch.setattr(bpe, "BLOCK_DOCUMENTS", documents)
        assert {r.doc_id: r.ids for r in bpe.encode(df).collect()} == ids


# 9. Mixing


def test_mix(spark):
    docs = [(i, "big" if i % 3 else "small", 1 + i % 17) for i in range(600)] + [(900, None, 5), (901, "unlisted", 5), (902, "big", 0), (903, "none", None)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = with_clashes(spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("none", 0.2, 3), ("big", 0.5, 1), (None, 0.1, 1), ("bad", None, 1), ("zero", 0.0, 1)], "source string, target_weight double, max_repeats int"))
    mixture, shares = mixing.mix(sized, targets)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big", "small", "none"} and s["none"].share == 0 and s["none"].documents == 0
    assert s["big"].share == pytest.approx(0.625, abs=0.01) and s["small"].share == pytest.approx(0.375, abs=0.01)
    rows = mixture.collect()
    assert all(1 <= r.repeats <= s[r.source].max_repeats for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    have = Counter()
    for r in rows:
        have[r.source] += r.repeats * r.n_tokens
    assert all(abs(have[k] - s[k].budget_tokens) <= 9 and have[k] == s[k].tokens for k in ("big", "small"))
    big, _ = mixing.mix(sized, targets, total=10**9)
    assert {r.source: r.m for r in big.groupBy("source").agg(F.min("repeats").alias("m")).collect()} == {"big": 1, "small": 2}
    empty, shares = mixing.mix(sized.limit(0), targets)
    assert empty.count() == 0 and {r.share for r in shares.collect()} == {0.0}
    assert mixing.mix(sized, targets.limit(0))[0].count() == 0


# 10. Wrong encodings

CLEAN = ["记者在录音室检查字幕，观众一起练习节目。", "The quiet editor from Esköcliff said “the window was narrow”.", "导演对晴帆桥说第十二页有新的窗户。", "Every reporter — near Rydé — checked the señal; §13, naïve Ørsk."]
WAYS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "koi8_r"), ("utf-8", "cp1251"), ("utf-8", "gb18030"), ("gb18030", "latin-1"), ("gb18030", "big5hkscs")]


def wrong(text, right, read):
    out = ""
    raw = text.encode(right)
    if read == "cp1252":
        return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
    return out + raw.decode(read, "replace")


def test_garbled(spark):
    docs, want, original = [], set(), {}
    for i in range(300):
        docs.append((i, " ".join(RNG.choice(CLEAN) for _ in range(3)) + f" {i}"))
    for k, (a, b) in enumerate(WAYS):
        for j, text in enumerate(CLEAN[:3]):
            i = 1000 + 10 * k + j
            t = wrong(text, a, b)
            docs.append((i, CLEAN[3] + " " + t if j else t))
            want.add(i)
            if "�" not in t:
                original[i] = (CLEAN[3] + " " if j else "") + text
    twice = wrong(wrong(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    docs += [(2000, twice), (2001, "ab�cd"), (3000, None), (3001, ""), (3002, "звук"), (3003, "Tһe mеlоԁу оf Мааrо"), (3004, "crème brûlée Ænigma ½ ±2 °C"), (3005, CLEAN[1] * 3000)]
    want |= {2000, 2001}
    original[2000] = CLEAN[0]
    docs += [(5000 + i, twice) for i in range(150)]  # a third of all rows is one garbled text
    want |= {5000 + i for i in range(150)}
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.restored for r in encoding.garbled(df).collect()}
    assert set(got) == want
    right = sum(got[i] == t for i, t in original.items())
    assert right >= 0.9 * len(original), [(got[i], t) for i, t in original.items() if got[i] != t]
    assert encoding.garbled(df.limit(0)).count() == 0


def test_garbled_however_frequent(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(CLEAN) for _ in range(2)) + f" {i}") for i in range(120)]
    docs += [(1000 + i, wrong(r.choice(CLEAN[:3]) + f" {i}", "utf-8", "cp1252")) for i in range(80)]
    docs = [(i, t) for i, t in docs if "�" not in t]
    got = {r.doc_id for r in encoding.garbled(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in docs if i >= 1000} and got


def test_every_lost_byte_marks(spark):
    docs = [(i, f"plain {i}") for i in range(20)] + [(100 + i, f"lost � byte {i}") for i in range(20)]
    got = {r.doc_id: r.restored for r in encoding.garbled(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs[20:])


def test_best_path_is_best():
    """Against all ways to label up to six stretches of two pairs, with lost bytes and other characters between them."""
    from itertools import combinations, product

    r = random.Random(2)
    model = encoding.Model(Counter())
    model.enter[:2], model.alone[:2], model.leave, model.stay = (-9.0, -11.0), (-12.5, -10.0), -2.5, -0.3
    lost = float(model.enter[encoding.LOST_STATE])
    for _ in range(60):
        text = "".join(r.choice("xxxxxxxé�") for _ in range(40))
        upto = np.cumsum([0.0] + [-8.0 if c == "é" else -20.0 if c == "�" else -2.0 for c in text]).tolist()
        us = sorted({encoding.Unit(s, s + r.randrange(1, 5), "y", r.uniform(2, 25), r.randrange(2)) for s in (r.randrange(0, 36) for _ in range(6))}, key=lambda u: (u.end, u.start))

        def worth(path, joined, single):
            """Of stretches in order; joined[k]: k goes on in the span of k - 1; single[k]: k is a span of one stretch by the second state."""
            total = 0.0
            for k, u in enumerate(path):
                if k and path[k - 1].end > u.start or single[k] and (joined[k] or k + 1 < len(path) and joined[k + 1]):
                    return -1e9
                total += u.gain
                if joined[k]:
                    v = path[k - 1]
                    gap = text[v.end : u.start]
                    if v.pair != u.pair or "é" in gap:
                        return -1e9
                    total += model.stay * (len(gap) + 1) + sum(lost + 20.0 for c in gap if c == "�")
                else:
                    total += model.alone[u.pair] if single[k] else model.enter[u.pair] + model.leave
            return total

        best = max((worth(c, (False, *j), s) for n in range(1, 5) for c in combinations(us, n) for j in product((False, True), repeat=n - 1) for s in product((False, True), repeat=n)), default=0)
        gain, path = encoding.best_path(text, us, upto, model)
        assert gain >= max(best, 0) - 1e-6 and (len(path) > 4 or gain == pytest.approx(max(best, 0)))


def test_no_text_is_passed_over():
    """The bound by which texts are chosen never hides one whose best path, over all stretches, is not all clean."""
    r = random.Random(6)
    texts = [" ".join(r.choice(CLEAN) for _ in range(3)) for _ in range(60)]
    texts += [CLEAN[3][:9] + wrong(r.choice(CLEAN)[: r.randrange(1, 9)], *r.choice(WAYS)) for _ in range(120)]
    counts = Counter()
    encoding.count(counts, texts, encoding.hardly_clean)
    model = encoding.Model(counts)
    batch = encoding.Batch(texts)
    found = encoding.Labels(model).search(texts)
    seen = encoding.observed(batch.codes, model).astype(float)
    whole = np.r_[0.0, np.cumsum(seen)]
    every = {}
    for p, start, length, code in batch.singles():
        for s, n, c, g in zip(start, length, code, encoding.gains(batch.codes, whole, start, length, code, model)):
            t = int(batch.owner[s])
            every.setdefault(t, []).append(encoding.Unit(int(s - batch.first[t]), int(s - batch.first[t] + n), chr(c), float(g), p))
    for t, text in enumerate(texts):
        upto = (whole[batch.first[t] : batch.first[t] + len(text) + 1] - whole[batch.first[t]]).tolist()
        us = every.get(t, []) + encoding.lost_units(text, upto)
        for p, (_, w) in enumerate(encoding.PAIRS):
            if w in encoding.MULTI:
                us += encoding.wide_units(text, p, upto, model)
        gain, _ = encoding.best_path(text, us, upto, model)
        assert gain == pytest.approx(found[t][0] if t in found else 0.0, abs=1e-3)
    assert 60 < len(found) < 150


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def some_texts(seed, n, lines=CLEAN):
    r = random.Random(seed)
    words = [w for c in lines for w in c.replace("，", "， ").split(" ")]
    return [" ".join(r.choice(words) for _ in range(12)) + f" {i}" for i in range(n)]


def test_a_third_garbled(spark):
    """300 texts of 1,000, all different, among them words without any character that is rare then."""
    texts = some_texts(1, 1000)
    docs = [(i, wrong(t, "utf-8", "cp1252") if i < 300 else t) for i, t in enumerate(texts)]
    want = {i: texts[i] for i, t in docs if t != texts[i]}
    got = {r.doc_id: r.restored for r in encoding.garbled(frame(spark, docs)).collect()}
    assert set(got) == set(want) and len(want) > 280 and sum(got[i] == t for i, t in want.items()) == len(want)


def test_lost_bytes_are_common(spark):
    texts = some_texts(2, 400)
    docs = [(i, t[:9] + "�" + t[9:] if i % 2 else t) for i, t in enumerate(texts)]
    assert {r.doc_id for r in encoding.garbled(frame(spark, docs)).collect()} == {i for i, _ in docs if i % 2}


@pytest.mark.parametrize("known", [False, True])
def test_other_right_encodings(spark, known):
    """Cyrillic read as cp1252 and Japanese and Korean as latin-1: found though the corpus has no text of these scripts; restored where it has."""
    russian = ["Привет, как твои дела сегодня", "Каждый студент читает старую книгу", "Вечером учитель проверяет словарь"]
    japanese = ["こんにちは、これは日本語のテストです", "きょうはとてもいい天気ですね", "先生はゆっくりとページをめくる"]
    korean = ["안녕하세요 저는 학생입니다", "선생님은 오늘도 책을 읽습니다"]
    docs = list(enumerate(some_texts(3, 300)))
    if known:
        docs += [(5000 + i, t) for i, t in enumerate(some_texts(5, 300, russian + japanese + korean))]
    want = {}
    for k in range(20):
        for base, text, right, read in ((1000, russian[k % 3], "cp1251", "cp1252"), (2000, japanese[k % 3], "cp932", "latin-1"), (3000, korean[k % 2], "cp949", "latin-1"), (4000, russian[k % 3], "koi8_r", "cp1252")):
            want[base + k] = f"{text} {k}"
            docs.append((base + k, wrong(want[base + k], right, read)))
    got = {r.doc_id: r.restored for r in encoding.garbled(frame(spark, docs)).collect()}
    assert set(got) == set(want)
    if known:
        assert sum(got[i] == t for i, t in want.items()) >= 0.9 * len(want), [(got[i], t) for i, t in want.items() if got[i] != t][:5]


def test_garbled_four_times(spark):
    text = "naïve café"
    for _ in range(4):
        text = wrong(text, "utf-8", "cp1252")
    docs = [*enumerate(some_texts(4, 200)), (900, text)]
    assert {r.doc_id: r.restored for r in encoding.garbled(frame(spark, docs)).collect()} == {900: "naïve café"}


def test_schemas():
    from lexiloom.llm import queries, sql

    assert set(sql.oracle_sql()) <= set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 5, 6, 7, 10)} | {"p8_ids"} <= set(queries.queries())


def test_problem_4_is_measured_by_its_percentiles():
    from lexiloom.llm import queries

    assert next(q for q in queries.queries() if q.startswith("p4_")) == "p4_percentiles"


def test_mixture_of_corpus_size(spark, tmp_path):
    from lexiloom.llm import queries

    docs = [(i, "big", "some words " * 20) for i in range(40)] + [(100, "small", "word")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r.source: r for r in queries.p9_corpus_shares(spark, str(tmp_path)).collect()}
    assert got["small"].most_repeats == 2 and got["small"].share < 0.1 < 0.9 < got["big"].share
    assert got["big"].tokens > got["big"].available_tokens * 0.4
