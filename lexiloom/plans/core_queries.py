"""Registered queries of the core, by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import batching, dedup, inlining, linguistic, metrics, nesting, profile, requests, score, split, validation, vocab
from ..storage import cut, table, tidy


def _tokens(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return profile.unique_tokens(table(spark, d, "tokens"), *columns)


ART = tuple(f"articulatory_{c}" for c in vocab.ARTICULATORY)
EDGES = tuple(f"boundary_{c}" for c in vocab.BOUNDARY)
RULE = ("language", "surface_tone", "stress", "syllable_role", *ART, *EDGES)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return inlining.delivered_tokens(table(spark, d, "raw_records"))


def p3_samples(spark: SparkSession, d: str) -> DataFrame:
    return inlining.delivery_tables(table(spark, d, "raw_records"))["sample"]


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return inlining.delivery_tables(table(spark, d, "raw_records"))["token"]


# Scans, nesting, joins


def scan_pruned(spark, d):
    """Column-pruned, filtered scan."""
    return table(spark, d, "tokens").select("sample_id", "token_index", "phoneme", "language", "viseme_id", "strength").where("language = 'zh' and strength >= 50 and strength <= 100").distinct()


def narrow_tokens(spark, d):
    t = _tokens(spark, d, "phoneme", "syllable_role", "viseme_id")
    return t.select("sample_id", "phoneme", F.coalesce("syllable_role", F.lit("other")).alias("syllable_role"), "viseme_id").distinct()


def nest_sequences(spark, d):
    s = dedup.sequences(table(spark, d, "tokens"))
    return s.select("sample_id", F.size("phonemes").cast("long").alias("n"), F.array_join("phonemes", " ").alias("phonemes"))


def p3_tables(spark, d):
    """Rows of each table that the schema graph analysed from the deliveries gives."""
    rows = table(spark, d, "raw_records").select("raw_id", "payload").distinct()
    out = inlining.shred(rows, inlining.analyse(rows, "payload"), ["raw_id"], "payload")
    return reduce(DataFrame.unionByName, [t.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("element"), "n") for name, t in sorted(out.items())])


def _ranked(spark, d):
    t = _tokens(spark, d, "phoneme", "language", "surface_tone", "viseme_id").select("sample_id", "token_index", "phoneme", "language", "surface_tone", "viseme_id")
    return t.withColumn("token_index", F.row_number().over(Window.partitionBy("sample_id").orderBy("token_index", "phoneme", "language", "surface_tone", "viseme_id")).cast("long"))


def renest_changes(spark, d):
    """Fields that differ after nesting tokens in which the tones of one class were blanked: those and no others."""
    t = _ranked(spark, d)
    spoiled = t.withColumn("surface_tone", F.when(F.coalesce(F.col("viseme_id") != 5, F.lit(True)), F.col("surface_tone")))
    return nesting.differences(t, nesting.flatten(nesting.nest(spoiled)).select(*t.columns), ["sample_id", "token_index"])


def renest_roundtrip(spark, d):
    """Fields that differ after nesting and flattening again: none."""
    t = _tokens(spark, d, "phoneme", "language", "strength", "syllable_role").select("sample_id", "token_index", "phoneme", "language", "strength", "syllable_role")
    ranked = t.withColumn("token_index", F.row_number().over(Window.partitionBy("sample_id").orderBy("token_index")).cast("long"))
    return nesting.differences(ranked, nesting.flatten(nesting.nest(ranked)).select(*ranked.columns), ["sample_id", "token_index"])


def samples_with_tokens(spark, d):
    """Every sample with its number of tokens, 0 for none."""
    n = nesting.nest(_tokens(spark, d, "phoneme").select("sample_id", "token_index", "phoneme"), table(spark, d, "samples"))
    return n.where("batch_id is not null").select("sample_id", "batch_id", F.size("tokens").cast("long").alias("tokens"))


def left_meta_join(spark, d):
    """Tokens per batch of their sample; null for tokens without one."""
    t = nesting.with_metadata(_tokens(spark, d, "phoneme"), table(spark, d, "samples"), ["batch_id"])
    return t.groupBy("batch_id").agg(F.count("*").alias("tokens"), F.count_distinct("sample_id").alias("samples"))


def sources_union(spark, d):
    """Several sources as one, by name."""
    a = table(spark, d, "samples").select("sample_id", F.lit("samples").alias("origin"))
    b = table(spark, d, "sample_origins").select(F.lit("origins").alias("origin"), "sample_id")
    return a.unionByName(b).groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"))


def echo_fields(spark, d):
    """Teacher fields of the request next to the prediction at the same position."""
    t = _tokens(spark, d, "phoneme", "teacher_word_index", "teacher_char_index")
    p = score.by_inventory(t, table(spark, d, "phoneme_inventory")).select("sample_id", "token_index", "predicted").distinct()
    return nesting.echo(t.select("sample_id", "token_index", "teacher_word_index", "teacher_char_index"), p, ["sample_id", "token_index"])


# Validation


def token_violations(spark, d):
    return validation.flat_violations(_tokens(spark, d, "phoneme", "language", "surface_tone", "stress", "viseme_id", "strength"))


def record_violations(spark, d):
    """Rules broken by the samples of all deliveries, with tokens from every path; a delivery without sample counts as one broken record."""
    rows = table(spark, d, "raw_records").select("raw_id", "payload").distinct()
    return validation.rule_counts(validation.violations(inlining.delivered_samples(rows), "sample", tokens="tokens"))


def revalidated_pair(spark, d):
    """Rules broken by the sentences of the flat tables, put together as records again."""
    t = _tokens(spark, d, *vocab.FIELDS, "viseme_id", "strength", "viseme_source", "strength_source").where("sample_id is not null")
    return validation.rule_counts(validation.violations(nesting.records(t, table(spark, d, "samples")), "value"))


def auto_ids(spark, d):
    """Ids of delivered samples, made from their place where they have none."""
    rows = table(spark, d, "raw_records").select("raw_id", "payload").distinct()
    s = inlining.delivery_tables(rows)["sample"]
    value = F.to_json(F.struct("sample_id"))
    return s.select("raw_id", "sample_pos", validation.auto_id(value, F.concat_ws(":", "raw_id", "sample_pos")).alias("sample_id"))


def service_requests(spark, d):
    """Entries of service requests, made from the teacher's columns, after normalisation."""
    t = _tokens(spark, d, "teacher_raw_phoneme", "teacher_word_index", "teacher_char_index").where("sample_id is not null")
    entry = F.to_json(F.struct(F.col("teacher_raw_phoneme").alias("ipa"), F.col("teacher_word_index").alias("wordIndex"), F.col("teacher_char_index").alias("charIndex")))
    sent = t.groupBy(F.col("sample_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("token_index", entry.alias("j")))).alias("v"))
    made = sent.select("request_id", F.concat(F.lit('{"visemes":['), F.array_join("v.j", ","), F.lit("]}")).alias("payload"))
    r = requests.request_rows(made)
    return r.groupBy("phoneme", "word_index", "char_index").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


def request_features(spark, d):
    """Features of requests with words: entries of the texts' characters."""
    c = linguistic.characters(table(spark, d, "samples").select("sample_id", "text").distinct())
    entry = F.to_json(F.struct(F.col("ch").alias("ipa"), F.col("ch").alias("word"), F.floor((F.col("pos") - 1) / 2).alias("wordIndex"), (F.col("pos") - 1).alias("charIndex")))
    sent = c.groupBy(F.col("sample_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("j")))).alias("v"))
    r = requests.request_rows(sent.select("request_id", F.concat(F.lit('{"visemes":['), F.array_join("v.j", ","), F.lit("]}")).alias("payload")))
    return requests.request_tokens(r).groupBy("language", "surface_tone", "word_start", "word_end", "phrase_start", "phrase_end", "boundary_type").agg(F.count("*").alias("n"))


def json_typed(spark, d):
    """Typed leaves of the generation metadata."""
    v = F.try_parse_json("generation")
    g = lambda p, t: F.try_variant_get(v, p, t)
    s = table(spark, d, "samples").select("sample_id", "generation").distinct()
    return s.select("sample_id", g("$.source", "string").alias("source"), g("$.worker", "bigint").alias("worker"), g("$.options.retry", "boolean").alias("retry"))


def categories(spark, d):
    """Counts of nullable categories after normalisation."""
    t = _tokens(spark, d, "syllable_role", "articulatory_height", "teacher_raw_phoneme")
    names = ("syllable_role", "articulatory_height", "teacher_raw_phoneme")
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), C.category(F.col(c)).alias("value")) for c in names])).alias("x")
    return t.select(x).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


# Profile


def frequencies(spark, d):
    return profile.frequencies(_tokens(spark, d, *profile.COUNTED))


def length_profile(spark, d):
    return _round(profile.lengths(_tokens(spark, d, "phoneme")), "mean", "p50", "p95")


def strength_profile(spark, d):
    t = _tokens(spark, d, "strength").where("strength between 0 and 100")
    return _round(profile.numeric_profile(t, "strength"), "mean", "std", "p05", "p50", "p95")


def class_means(spark, d):
    return _round(profile.class_means(_tokens(spark, d, "viseme_id", "strength").where("strength between 0 and 100"), "viseme_id", "strength"), "mean")


def boundary_counts(spark, d):
    return profile.boundary_counts(_tokens(spark, d, "phoneme", "boundary_phrase_end", "boundary_word_end", "strength_source"))


def unknown_rate(spark, d):
    return _round(profile.coverage(_tokens(spark, d, "phoneme"), table(spark, d, "phoneme_inventory")), "unknown_rate")


def top_unknown(spark, d):
    return profile.top_unknown(_tokens(spark, d, "phoneme"), table(spark, d, "phoneme_inventory"))


def missing_classes(spark, d):
    return profile.missing_classes(_tokens(spark, d, "viseme_id"))


def strength_histogram(spark, d):
    return profile.histogram(_tokens(spark, d, "viseme_id", "strength").where("strength between 0 and 100"), "strength", 0, 100, 20, ["viseme_id"])


def phrase_positions(spark, d):
    return profile.positions(_tokens(spark, d, *EDGES))


def manifest_check(spark, d):
    """Stated counts of the last split report against counts of its members."""
    report = table(spark, d, "split_report_v2").orderBy(F.desc("run_id")).limit(1).select("counts.*")
    m = table(spark, d, "split_members")
    last = m.groupBy("sample_id").agg(F.max(F.struct("assigned_at", "split_name")).alias("m")).select("m.split_name")
    actual = last.agg(*[F.count_if(F.col("split_name") == s).alias(s) for s in ("train", "validation", "test")])
    return profile.manifest_differences(report, actual)


# Vocabulary


def vocab_build(spark, d):
    return vocab.build_one(_tokens(spark, d, "phoneme"), "phoneme")


def vocab_all(spark, d):
    return vocab.build(_tokens(spark, d, *vocab.FIELDS))


def vocab_sizes(spark, d):
    return vocab.sizes(vocab.build(_tokens(spark, d, *vocab.FIELDS)))


def vocab_problems(spark, d):
    """Problems of a dictionary that was spoiled in five places; one that was not has none (tested)."""
    v = cut(vocab.build(_tokens(spark, d, *vocab.FIELDS)), "vocabulary")
    kept = v.where("not (field = 'language' and id = 1) and not (field = 'stress' and id = 2) and field <> 'syllable_role'")
    more = kept.where("field = 'phoneme' and id = 2").select("field", F.col("token"), F.col("id") + 1)
    return vocab.problems(kept.union(more).union(kept.where("field = 'stress'").select(F.lit("colour"), "token", "id")))


def encode_tokens(spark, d):
    t = cut(_tokens(spark, d, *vocab.FIELDS), "tokens")
    return vocab.encode(t, vocab.build(t))


def encode_inventory(spark, d):
    """Phonemes against the inventory: misses are 1."""
    v = vocab.build_one(table(spark, d, "phoneme_inventory"), "phoneme").select(F.lit("phoneme").alias("field"), "token", "id")
    return vocab.encode(_tokens(spark, d, "phoneme"), v, ("phoneme",))


# Duplicates and splits


def exact_groups(spark, d):
    """Signatures several samples have: size and first member."""
    s = dedup.signatures(table(spark, d, "samples"), cut(dedup.sequences(table(spark, d, "tokens")), "sequences"))
    return s.groupBy("signature").agg(F.count("*").alias("n"), F.min("sample_id").alias("first")).where("n > 1").select(F.md5("signature").alias("signature"), "n", "first")


def shingle_counts(spark, d):
    s = dedup.sequences(table(spark, d, "tokens"))
    return s.select("sample_id", F.size(dedup.shingles(F.col("phonemes"))).cast("long").alias("shingles"))


def _duplicates(spark, d, exact=True):
    return dedup.duplicate_groups(table(spark, d, "samples"), table(spark, d, "tokens"), exact=exact)


def near_pairs(spark, d):
    return _round(_duplicates(spark, d)["near"], "similarity")


def duplicate_groups(spark, d):
    return _duplicates(spark, d)["groups"]


def duplicate_summary(spark, d):
    """Counts of the sketch search."""
    return dedup.summary(_duplicates(spark, d, exact=False))


def kept_samples(spark, d):
    return split.keep_one(_duplicates(spark, d)["groups"])


def split_assign(spark, d):
    return split.assign(_duplicates(spark, d)["groups"])


def split_report(spark, d):
    return _round(split.split_report(split_assign(spark, d)), "ratio")


def split_leaks(spark, d):
    """Leaks of the split made here: none."""
    s = dedup.signatures(table(spark, d, "samples"), cut(dedup.sequences(table(spark, d, "tokens")), "sequences"))
    return split.leaks(cut(split_assign(spark, d), "assigned"), s)


def current_leaks(spark, d):
    """Leaks of the current splits: duplicate groups and signatures in several of them."""
    m = table(spark, d, "split_members").where("sample_id is not null and split_name is not null")
    now = m.groupBy("sample_id").agg(F.max(F.struct("assigned_at", "split_name")).alias("m")).select("sample_id", F.col("m.split_name").alias("split"))
    same = _duplicates(spark, d)
    s = dedup.signatures(table(spark, d, "samples"), same["sequences"])
    found = split.leaks(cut(same["groups"].join(now, "sample_id"), "assigned"), s)
    return found.select("kind", F.md5("key").alias("key"), "splits")


def contamination(spark, d):
    """Signatures whose samples lie in several of the current splits."""
    m = table(spark, d, "split_members").where("sample_id is not null and split_name is not null")
    now = m.groupBy("sample_id").agg(F.max(F.struct("assigned_at", "split_name")).alias("m")).select("sample_id", F.col("m.split_name").alias("split"))
    s = dedup.signatures(table(spark, d, "samples"), cut(dedup.sequences(table(spark, d, "tokens")), "sequences"))
    return s.join(now, "sample_id").groupBy("signature").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1").select(F.md5("signature").alias("signature"), "splits", "n")


def text_signatures(spark, d):
    s = table(spark, d, "samples").select("sample_id", "text").distinct()
    return s.select("sample_id", F.md5(C.text_signature(F.col("text"))).alias("signature"))


# Linguistic rules


def pseudo_strength(spark, d):
    return _round(linguistic.pseudo_strength(_tokens(spark, d, *RULE)).select("sample_id", "token_index", "pseudo_strength"), "pseudo_strength")


def segment_roles(spark, d):
    t = linguistic.syllable_roles(_tokens(spark, d, "phoneme", "teacher_word_index", "teacher_char_index"), ["sample_id", "teacher_word_index", "teacher_char_index"])
    return t.select("sample_id", "token_index", "role")


def nested_roles(spark, d):
    t = linguistic.nested_roles(_tokens(spark, d, "articulatory_type", "language", "teacher_word_index"), ["sample_id", "teacher_word_index"])
    return t.groupBy("language", "articulatory_type", "role").agg(F.count("*").alias("n"))


def articulation_of(spark, d):
    p = _tokens(spark, d, "phoneme").select("phoneme").distinct()
    return linguistic.with_articulation(p).select("phoneme", "a_type", "a_height", "a_place", "a_manner")


def word_edges(spark, d):
    t = linguistic.word_boundaries(_tokens(spark, d, "teacher_word_index"), "sample_id", "token_index", "teacher_word_index")
    return t.select("sample_id", "token_index", "starts_word", "ends_word")


def phrase_edges(spark, d):
    """Phrase boundaries, silence standing for punctuation."""
    t = _tokens(spark, d, "phoneme", "articulatory_type").withColumn("word", F.when(F.col("articulatory_type") == "silence", F.when(F.col("phoneme") == "∅", "。").otherwise("，")).otherwise("x"))
    return linguistic.phrase_boundaries(t, "sample_id", "token_index", "word").select("sample_id", "token_index", "ends_phrase", "starts_phrase", "boundary")


def occurrences(spark, d):
    return linguistic.occurrence(_tokens(spark, d, "teacher_char_index"), "sample_id", "token_index", "teacher_char_index").select("sample_id", "token_index", F.col("occurrence").cast("long").alias("occurrence"))


def _chars(spark, d):
    c = linguistic.characters(table(spark, d, "samples").select("sample_id", "text").distinct())
    tone = F.when(~C.is_han(F.col("ch")), None).when(F.col("ch") == "一", 1).when(F.col("ch") == "不", 4).otherwise(F.ascii("ch") % 4 + 1)
    return c.withColumn("tone", tone)


def surface_tones(spark, d):
    """Tone sandhi over the texts; the lexical tone is an input, here made from the code point."""
    return linguistic.surface_tones(_chars(spark, d)).where("tone is not null").select("sample_id", F.col("pos").cast("long").alias("pos"), F.col("surface").cast("long").alias("surface"))


def tone_sequences(spark, d):
    return linguistic.tone_sequences(linguistic.surface_tones(_chars(spark, d)))


# Batches


def _lengths(spark, d):
    return _tokens(spark, d, "phoneme").groupBy("sample_id").agg(F.count("*").alias("len"))


def length_buckets(spark, d):
    return _lengths(spark, d).groupBy(C.length_bucket(F.col("len")).alias("bucket")).agg(F.count("*").alias("n"))


def token_budget_batches(spark, d):
    b = batching.plan_batches(_lengths(spark, d), "sample_id", "len", 6000)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.max("len").alias("longest"), F.sum("len").alias("tokens"))


def padded_batches(spark, d):
    t = _tokens(spark, d, "phoneme", "viseme_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("token_index", F.coalesce("viseme_id", F.lit(batching.IGNORE)).alias("v")))).alias("t")).select("sample_id", F.col("t.v").alias("labels"), F.size("t").cast("long").alias("len"))
    b = batching.plan_batches(t, "sample_id", "len", 6000)
    return batching.batch_sizes(batching.pad_batches(b, "batch", {"labels": batching.IGNORE}), "batch", "labels")


def flattened_batches(spark, d):
    """Real places of padded batches in row-major order."""
    t = _tokens(spark, d, "phoneme", "viseme_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("token_index", F.coalesce("viseme_id", F.lit(batching.IGNORE)).alias("v")))).alias("t")).select("sample_id", F.col("t.v").alias("labels"), F.size("t").cast("long").alias("len"))
    b = batching.pad_batches(batching.plan_batches(t, "sample_id", "len", 6000), "batch", {"labels": batching.IGNORE})
    return batching.flatten_batches(b, "batch", "rank", "labels").groupBy("batch", "row").agg(F.count("*").alias("n"), F.sum("labels").alias("labels"), F.max("position").alias("last"))


def shuffled_batches(spark, d):
    """Batches in a seeded order of an epoch: as many, of the same rows."""
    b = batching.plan_batches(_lengths(spark, d), "sample_id", "len", 6000, seed=7, epoch=2)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).groupBy("n", "tokens").agg(F.count("*").alias("batches"))


def fixed_batches(spark, d):
    return batching.fixed_batches(_lengths(spark, d), "sample_id", 16).groupBy("batch").agg(F.count("*").alias("n"), F.sum("len").alias("tokens"))


# Metrics: the inventory's usual class against the label, the rule's strength against the measured one


def _scored(spark, d):
    t = linguistic.pseudo_strength(_tokens(spark, d, "phoneme", "viseme_id", "strength", "strength_source", *RULE), english_stress_only=True)
    t = score.by_inventory(t, table(spark, d, "phoneme_inventory"))
    return t.where("strength between 0 and 100 and viseme_id is not null and predicted is not null").withColumn("pseudo_strength", F.round("pseudo_strength", 4))


def confusion(spark, d):
    return metrics.confusion(_scored(spark, d), "viseme_id", "predicted", 18)


def class_prf(spark, d):
    return _round(metrics.per_class(confusion(spark, d)), "precision", "recall", "f1")


def overall_metrics(spark, d):
    m = metrics.overall(cut(confusion(spark, d), "confusion"))
    return _round(m, "accuracy", "macro_f1", "weighted_f1")


def regression_metrics(spark, d):
    return _round(metrics.errors(_scored(spark, d), F.col("strength"), F.col("pseudo_strength")), "mae", "rmse", "median")


def regression_by_class(spark, d):
    return _round(metrics.errors(_scored(spark, d), F.col("strength"), F.col("pseudo_strength"), ["viseme_id"]).select("viseme_id", "n", "mae"), "mae")


def slice_metrics(spark, d):
    return _round(metrics.slice_metrics(_scored(spark, d), "viseme_id", "predicted", "strength", "pseudo_strength"), "accuracy", "macro_f1", "mae")


def context_slices(spark, d):
    """Metrics by neighbours and by place in the sentence."""
    return _round(metrics.slice_metrics(_scored(spark, d), "viseme_id", "predicted", "strength", "pseudo_strength", metrics.with_context_slices), "accuracy", "macro_f1", "mae")


def merged_metrics(spark, d):
    """Metrics from states of two languages that were stored and merged."""
    s = cut(metrics.state(_scored(spark, d), "viseme_id", "predicted", "strength", "pseudo_strength", ["language"]), "states")
    parts = [s.where(F.col("language") == x).drop("language") for x in ("zh", "en")]
    rest = s.where("language is null or language not in ('zh', 'en')").drop("language")
    return _round(metrics.finalise(metrics.merge_states(*parts, rest), 18), "accuracy", "macro_f1", "weighted_f1", "mae", "rmse")


def masked_metrics(spark, d):
    """Quick metrics without silence."""
    return _round(metrics.masked(_scored(spark, d), F.col("articulatory_type") != "silence", "viseme_id", "predicted", "strength", "pseudo_strength"), "accuracy", "mae")


def acceptance_lines(spark, d):
    """Acceptance of the scored corpus, the Chinese part standing for the baseline."""
    m = merged_metrics(spark, d)
    s = metrics.state(_scored(spark, d).where("language = 'zh'"), "viseme_id", "predicted", "strength", "pseudo_strength")
    return metrics.acceptance(m, _round(metrics.finalise(metrics.merge_states(s), 18), "accuracy"))


def mean_cross_entropy(spark, d):
    """Cross entropy of one-hot-like scores with label smoothing."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.when(k == F.col("predicted"), 3.0).otherwise(0.5))
    return _scored(spark, d).agg(F.round(F.avg(metrics.cross_entropy(scores, F.col("viseme_id"), 0.1)), 6).alias("loss"))


def annotator_agreement(spark, d):
    """Agreement of two readings of the same tokens: the label and the inventory's class."""
    s = _scored(spark, d)
    a = s.select("sample_id", "token_index", F.lit("label").alias("who"), F.col("viseme_id").alias("c"), F.col("strength").alias("v"))
    b = s.select("sample_id", "token_index", F.lit("rule").alias("who"), F.col("predicted").alias("c"), F.col("pseudo_strength").alias("v"))
    return _round(metrics.agreement(a.union(b).distinct(), ["sample_id", "token_index"], "who", "c", "v"), "class_agreement", "mae")


def failure_topk(spark, d):
    t = _scored(spark, d).withColumn("error", F.round(F.abs(F.col("pseudo_strength") - F.col("strength")), 4))
    return metrics.failures(t, "viseme_id", "predicted", "error", ["sample_id", "token_index"]).select("sample_id", "token_index", "viseme_id", "predicted", "error")


def weighted_losses(spark, d):
    w = C.source_weight(F.col("strength_source"), {"pseudo_rule_b": 0.5, "human": 2.0})
    return _round(metrics.weighted_losses(_scored(spark, d), F.col("pseudo_strength") / 100 - F.col("strength") / 100, w, 0.1), "huber", "l1", "mse")


def composite_metric(spark, d):
    m = overall_metrics(spark, d).crossJoin(regression_metrics(spark, d))
    return m.select(F.round(metrics.composite(F.col("macro_f1"), F.col("mae")), 5).alias("composite"))


def calibration(spark, d):
    return _round(metrics.calibration(_scored(spark, d), "viseme_id", "pseudo_strength", "strength"), "slope", "intercept")


def gate_checks(spark, d):
    m = overall_metrics(spark, d).crossJoin(regression_metrics(spark, d).withColumnRenamed("median", "med"))
    s = m.select(F.lit(10).alias("global_step"), F.lit(False).alias("saw_non_finite_loss"), F.lit(0.5).alias("final_train_loss"), F.col("accuracy").alias("final_train_viseme_accuracy"), F.col("mae").alias("final_train_strength_mae"), F.struct(F.col("accuracy").alias("val_viseme_accuracy"), F.col("mae").alias("val_strength_mae")).alias("validation"))
    return metrics.gate(s)


# Training logs: events of a user stand for the steps of a run


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"), "value")


def log_windows(spark, d):
    return _round(metrics.log_windows(_log(spark, d), "step", "value", 5, ["run"], partial=True), "mean")


def full_log_windows(spark, d):
    return _round(metrics.log_windows(_log(spark, d), "step", "value", 5, ["run"]), "mean")


def row_functions(spark, d):
    """Row-level expressions over token columns: names of classes, tone digits, rounding, strength of a logit, softmax, best class, memory."""
    t = _tokens(spark, d, "phoneme", "viseme_id", "surface_tone", "strength").where("strength between 0 and 100")
    scores = F.array(F.col("strength") / 50, F.lit(1.0), F.col("surface_tone").cast("double"))
    x = t.select(
        "sample_id", "token_index", C.class_name(F.col("viseme_id"), [f"v{k}" for k in range(9)]).alias("name"), C.tone_digit(F.concat("phoneme", F.col("surface_tone").cast("string"))).cast("long").alias("digit"),
        C.round_even(F.col("strength")).alias("rounded"), F.round(C.strength_of(F.col("strength") / 25 - 2), 6).alias("squashed"), C.best_class(scores).cast("long").alias("best"),
        F.round(F.element_at(C.softmax(scores), 1), 6).alias("share"), C.activation_bytes(F.col("token_index"), 8, 2, 16, 4).alias("bytes"),
    )
    return x.distinct()


def word_kinds(spark, d):
    """Language and pause test of the texts' words."""
    w = table(spark, d, "samples").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.select(F.md5("word").alias("word"), C.word_language(F.col("word")).alias("language"), C.is_pause(F.col("word")).alias("pause"))


def best_so_far(spark, d):
    return metrics.running_best(_log(spark, d), "run", "step", "value").select("run", "step", "best", "improved", F.col("since").cast("long").alias("since"))


def early_stop(spark, d):
    return metrics.early_stop(metrics.running_best(_log(spark, d), "run", "step", "value"), "run", "step", 5)


def lr_schedule(spark, d):
    s = spark.range(1, 1001).select(F.col("id").alias("step"))
    return s.select("step", F.round(metrics.learning_rate(F.col("step"), 3e-4, 100, 1000), 12).alias("lr"))


def retention(spark, d):
    return metrics.newest(_log(spark, d), "run", "step", 3)


def run_islands(spark, d):
    """Runs of equal events of a user: gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", (F.row_number().over(w) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).alias("island"))
    return e.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n")).groupBy("event_type", "n").agg(F.count("*").alias("runs"))


def queries() -> dict:
    return {k: tidy(v) for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
