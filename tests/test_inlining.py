import json

from lexiloom.operators.inlining import DELIVERY_GRAPH, Edge, Element, SchemaGraph, delivered_tokens, delivery_tables, shred

SCHEMA = "raw_id long, payload string, channel string, sample_pos long"


def tokens(*ids):
    return [None if i is None else {"phoneme": i} for i in ids]


def test_tokens_of_all_shapes(spark, rows):
    a = {"sample_id": "a", "tokens": tokens("x", None, "y")}
    b = {"tokens": json.dumps(tokens("z"))}
    c = {"sample_id": None, "phrases": [{"words": [{"tokens": tokens("p")}, {"tokens": tokens("q", "r")}]}]}
    data = [
        (1, json.dumps(a), "c", 9), (1, json.dumps(a), "c", 9), (2, json.dumps({"samples": [b, None, c]}), None, 9), (3, json.dumps({"envelope": {"sample": a}}), "c", 9),
        (4, "{broken", "c", 9), (5, "", "c", 9), (6, None, None, None), (7, "   ", "c", 9), (8, json.dumps({"sample_id": "e"}), "c", 9), (9, json.dumps([a, b]), "c", 9), (None, json.dumps(b), "c", 9),
    ]
    got = rows(delivered_tokens(spark.createDataFrame(data, SCHEMA)))
    want = [(1, 1, "a", 1), (1, 1, "a", 3), (2, 1, "", 1), (2, 3, "", 1), (2, 3, "", 2), (2, 3, "", 3), (3, 1, "a", 1), (3, 1, "a", 3), (9, 1, "a", 1), (9, 1, "a", 3), (9, 2, "", 1), (None, 1, "", 1)]
    assert got == sorted(want, key=repr)
    assert delivered_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_keep_links(spark, rows):
    t = {"phoneme": "n", "boundary": {"word_start": "TRUE", "word_end": False}, "teacher_metadata": {"shape": "s", "alternatives": [{"viseme_id": 3, "weight": 0.5}, {"viseme_id": 4}]}}
    out = delivery_tables(spark.createDataFrame([(1, json.dumps({"sample_id": "a", "tokens": [t], "teacher_metadata": {"engine": {"name": "m"}}}), None, None)], SCHEMA))
    assert rows(out["sample"], "raw_id", "sample_pos", "sample_id", "engine_name") == [(1, 1, "a", "m")]
    assert rows(out["token"], "raw_id", "sample_pos", "token_pos", "boundary_word_start", "boundary_word_end", "teacher_shape") == [(1, 1, 1, True, False, "s")]
    assert rows(out["alternative"]) == [(1, 1, 1, 1, 3, 0.5), (1, 1, 1, 2, 4, None)]


def test_graph_classes():
    assert DELIVERY_GRAPH.tables() == {"delivery": "root", "sample": "repeated", "token": "repeated", "alternative": "repeated"}
    g = SchemaGraph("r", [Element("r"), Element("a"), Element("s")], [Edge("r", "a", "a"), Edge("r", "s", "s"), Edge("a", "s", "t")])
    assert g.tables() == {"r": "root", "s": "shared"}


def test_recursive_element(spark, rows):
    g = SchemaGraph("r", [Element("r"), Element("node", {"v": ("v", "bigint")})], [Edge("r", "node", "nodes[*]"), Edge("node", "node", "kids[*]")])
    deep = {"nodes": [{"v": 1, "kids": [{"v": 2, "kids": [{"v": 3}]}, {"v": 4}]}]}
    out = shred(spark.createDataFrame([(1, json.dumps(deep))], "id long, j string"), g, ["id"], "j")["node"]
    assert [(list(r.node_path), r.v) for r in sorted(out.collect(), key=lambda r: r.node_path)] == [([1], 1), ([1, 1], 2), ([1, 1, 1], 3), ([1, 2], 4)]


def test_long_payload(spark):
    big = json.dumps({"sample_id": "a", "text": "字" * 300_000, "tokens": tokens(*["x"] * 20_000)})
    assert delivered_tokens(spark.createDataFrame([(1, big, None, None)], SCHEMA)).count() == 20_000


def test_delivered_tokens_pass_through_shred(spark, rows, monkeypatch):
    from lexiloom.operators import inlining

    seen, real = [], inlining.shred
    monkeypatch.setattr(inlining, "shred", lambda *a, **k: seen.append(a) or real(*a, **k))
    raw = spark.createDataFrame([("a", '{"samples": [{"sample_id": "x", "tokens": [{}, null, {}]}, {"tokens": [{}]}]}'), ("b", '{"sample_id": "y", "tokens": [{}]}')], "raw_id string, payload string")
    assert rows(inlining.delivered_tokens(raw)) == [("a", 1, "x", 1), ("a", 1, "x", 3), ("a", 2, "", 1), ("b", 1, "y", 1)]
    assert len(seen) == 1


def test_shared_element_has_a_key_per_parent(spark, rows):
    from lexiloom.operators.inlining import analyse

    docs = [
        {"id": 7, "authors": [{"name": "A", "address": {"city": "X"}}, {"name": "B"}], "publishers": [{"label": "P", "address": {"city": "Y"}}], "parts": [{"no": 1, "parts": [{"no": 2, "parts": [{"no": 3}]}]}]},
        {"id": None, "authors": [], "one": {"deep": {"size": 1.5}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] + [(8, "{broken"), (9, None)], "k long, j string")
    g = analyse(df, "j")
    assert g.tables() == {"record": "root", "authors": "repeated", "publishers": "repeated", "address": "shared", "parts": "recursive"}
    out = shred(df, g, ["k"], "j")
    assert set(out) == set(g.tables()) and g.columns("record")["one_deep_size"] == ("one.deep.size", "double")
    assert rows(out["address"], "k", "authors_pos", "publishers_pos", "address_pos", "city") == sorted([(0, 1, None, 1, "X"), (0, None, 1, 1, "Y")], key=repr)
    assert rows(out["parts"], "parts_path", "no") == sorted([([1], 1), ([1, 1], 2), ([1, 1, 1], 3)], key=repr)
    assert rows(out["record"], "k", "id", "one_deep_size") == sorted([(0, 7, None), (1, None, 1.5)], key=repr)
    assert analyse(df.limit(0), "j").tables() == {"record": "root"}


def test_analysed_graph_gives_all_tokens(spark):
    from lexiloom.operators.inlining import analyse

    raw = spark.createDataFrame([(1, json.dumps({"tokens": tokens("x", None, "y")})), (2, json.dumps({"samples": [{"tokens": tokens("z")}, {"phrases": [{"words": [{"tokens": tokens("p", "q")}]}]}]}))], "k long, j string")
    out = shred(raw, analyse(raw, "j"), ["k"], "j")["tokens"]
    assert sorted((r.k, r.samples_pos, r.words_pos, r.tokens_pos, r.phoneme) for r in out.where("samples_pos is not null or words_pos is null").fillna(0).collect()) == [(1, 0, 0, 1, "x"), (1, 0, 0, 3, "y"), (2, 1, 0, 1, "z"), (2, 2, 1, 1, "p"), (2, 2, 1, 2, "q")]
