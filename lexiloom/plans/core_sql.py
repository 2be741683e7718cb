"""SQL of the core's queries, by name."""

from __future__ import annotations

from ..functions.columns import ALL_MARKS, MAJOR_MARKS, PHONEME_SPELLINGS, SILENT, articulation_rows
from ..operators import linguistic as L
from ..operators import vocab as V


def _text(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _case(column: str, table: dict, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_text(k) if isinstance(k, str) else k} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


T = "t AS (SELECT DISTINCT * FROM tokens)"
OK = "strength BETWEEN 0 AND 100 AND NOT isnan(strength)"
SEQ = "e AS (SELECT sample_id, token_index, min(phoneme) p FROM tokens WHERE sample_id IS NOT NULL AND token_index IS NOT NULL AND phoneme IS NOT NULL GROUP BY 1, 2), q AS (SELECT sample_id, list(p ORDER BY token_index) ps FROM e GROUP BY 1)"
SIG = SEQ + r""", x AS (SELECT sample_id, min(text) txt FROM samples GROUP BY 1),
g AS (SELECT q.sample_id, 'p:' || array_to_string(ps, ' ') signature FROM q UNION ALL
 SELECT q.sample_id, 't:' || s FROM q JOIN (SELECT sample_id, trim(regexp_replace(txt, '[\s\p{Z}]+', ' ', 'g')) s FROM x) USING (sample_id) WHERE s <> '')"""
NOW = "now AS (SELECT sample_id, max_by(split_name, (assigned_at, split_name)) split FROM split_members WHERE sample_id IS NOT NULL AND split_name IS NOT NULL GROUP BY 1)"


def _strength() -> str:
    yes = lambda c: f"coalesce(lower({c}) = 'true', false)"
    vowel = f"{_case('articulatory_height', L.HEIGHT_BASE, L.HEIGHT_ELSE)} + CASE WHEN {yes('articulatory_rounded')} THEN {L.ROUNDED_MORE} ELSE 0.0 END"
    consonant = f"{_case('articulatory_manner', L.MANNER_BASE, L.MANNER_ELSE)} + {_case('articulatory_place', L.PLACE_MORE, 0.0)}"
    s = f"(CASE articulatory_type WHEN 'vowel' THEN {vowel} WHEN 'consonant' THEN {consonant} ELSE {L.OTHER_BASE} END + {_case('syllable_role', L.ROLE_MORE, 0.0)})"
    s = f"({s} * {_case('surface_tone', L.TONE_TIMES, 1.0)} * STRESS + CASE WHEN {yes('boundary_word_start')} THEN {L.WORD_START_MORE} ELSE 0.0 END - CASE WHEN {yes('boundary_word_end')} THEN {L.WORD_END_LESS} ELSE 0.0 END) * CASE WHEN {yes('boundary_phrase_end')} THEN {L.PHRASE_END_TIMES} ELSE 1.0 END"
    s += f" + CASE WHEN articulatory_type = 'vowel' AND before_place = 'bilabial' THEN {L.NEIGHBOUR_MORE} ELSE 0.0 END + CASE WHEN articulatory_type = 'consonant' AND before_type = 'vowel' AND after_type = 'vowel' THEN {L.NEIGHBOUR_MORE} ELSE 0.0 END - CASE WHEN articulatory_manner = 'approximant' THEN {L.APPROXIMANT_LESS} ELSE 0.0 END"
    return f"CASE WHEN articulatory_type = 'silence' THEN 0.0 ELSE greatest(0.0, least(100.0, {s}))::DOUBLE END"


def _strengths(english_only: bool) -> str:
    stress = f"({_case('stress', L.STRESS_TIMES, 1.0)})"
    stress = f"CASE WHEN language = 'en' THEN {stress} ELSE 1.0 END" if english_only else stress
    inner = "SELECT *, lag(articulatory_type) OVER w before_type, lag(articulatory_place) OVER w before_place, lead(articulatory_type) OVER w after_type FROM t WINDOW w AS (PARTITION BY sample_id ORDER BY token_index)"
    # Decimal literals would be exact; doubles are wanted.
    import re

    text = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1::DOUBLE", _strength().replace("STRESS", stress))
    return f"p AS (SELECT *, {text} ps FROM ({inner}))"


SCORED = f"{T}, {_strengths(True)}, u AS (SELECT phoneme, min(default_viseme_id) predicted FROM phoneme_inventory WHERE phoneme IS NOT NULL GROUP BY 1), s AS (SELECT p.* EXCLUDE (ps), round(ps, 4) pseudo_strength, predicted FROM p JOIN u USING (phoneme) WHERE {OK} AND viseme_id IS NOT NULL AND predicted IS NOT NULL)"
MATRIX = SCORED + ", c AS (SELECT a.range target, b.range predicted, coalesce(n, 0) n FROM range(18) a CROSS JOIN range(18) b LEFT JOIN (SELECT viseme_id t, predicted p, count(*) n FROM s GROUP BY 1, 2) ON a.range = t AND b.range = p)"
PRF = MATRIX + """, k AS (SELECT a.range AS class, (SELECT sum(n) FROM c WHERE target = a.range)::BIGINT support, (SELECT sum(n) FROM c WHERE predicted = a.range)::BIGINT said, (SELECT sum(n) FROM c WHERE target = a.range AND predicted = a.range)::BIGINT hit FROM range(18) a),
 k2 AS (SELECT *, coalesce(hit::DOUBLE / nullif(said, 0), 0.0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0.0) AS recall FROM k), k3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) f1 FROM k2)"""
OVERALL = PRF + ", o AS (SELECT round(sum(hit)::DOUBLE / sum(support), 6) accuracy, round(avg(f1) FILTER (support > 0), 6) macro_f1, round(sum(f1 * support) / sum(support), 6) weighted_f1, sum(support)::BIGINT total FROM k3), r AS (SELECT count(*) n, round(avg(abs(pseudo_strength - strength)), 6) mae, round(sqrt(avg((pseudo_strength - strength) ** 2)), 6) rmse, round(quantile_cont(abs(pseudo_strength - strength), 0.5), 6) median FROM s)"
LEN = f"{T}, l AS (SELECT sample_id, count(*) len FROM t GROUP BY 1)"
BATCH = LEN + """, h AS (SELECT sample_id, len, row_number() OVER (ORDER BY len, sample_id) rk FROM l),
 b AS (WITH RECURSIVE z(batch, first, last) AS (
   SELECT 0::BIGINT, 1::BIGINT, (SELECT max(rk) FROM h WHERE h.len * rk <= 6000)
   UNION ALL SELECT batch + 1, last + 1, (SELECT max(rk) FROM h WHERE h.rk > z.last AND h.len * (h.rk - z.last) <= 6000) FROM z WHERE last < (SELECT max(rk) FROM h)) SELECT * FROM z)"""
LOG = "lg AS (SELECT user_id run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) step, value FROM events)"
BEST = LOG + ", z1 AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) bf FROM lg), z2 AS (SELECT *, bf IS NULL OR value > bf improved FROM z1), z3 AS (SELECT *, max(value) OVER w best, step - coalesce(max(CASE WHEN improved THEN step END) OVER w, 0) since FROM z2 WINDOW w AS (PARTITION BY run ORDER BY step))"
RANKED = f"{T}, rk AS (SELECT DISTINCT sample_id, token_index, phoneme, language, surface_tone, viseme_id FROM t), rn AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY token_index NULLS FIRST, phoneme NULLS FIRST, language NULLS FIRST, surface_tone NULLS FIRST, viseme_id NULLS FIRST) token_index, surface_tone, viseme_id FROM rk)"
SAMPLE = "CASE WHEN json_type(j, '$.samples') = 'ARRAY' THEN j->'$.samples' WHEN json_type(j, '$.envelope.sample') = 'OBJECT' THEN json_array(j->'$.envelope.sample') WHEN json_type(j) = 'ARRAY' THEN j ELSE json_array(j) END"
TOKENS = "CASE WHEN json_type(s, '$.tokens') = 'ARRAY' THEN (s->'$.tokens')::JSON[] WHEN json_type(s, '$.tokens') = 'VARCHAR' AND json_valid(s->>'$.tokens') THEN ((s->>'$.tokens')::JSON)::JSON[] ELSE []::JSON[] END"
DELIVERED = f"""r AS (SELECT DISTINCT raw_id, payload FROM raw_records WHERE json_valid(payload) AND trim(payload) <> ''),
 a AS (SELECT raw_id, ({SAMPLE})::JSON[] l FROM (SELECT raw_id, payload::JSON j FROM r)),
 b AS (SELECT raw_id, unnest(l) s, generate_subscripts(l, 1)::BIGINT sample_pos FROM a),
 c AS (SELECT raw_id, sample_pos, coalesce(s->>'$.sample_id', '') sample_id, s, list_concat({TOKENS}, coalesce(flatten(list_transform(json_extract(s, '$.phrases[*].words[*].tokens'), lambda y: CASE WHEN json_type(y) = 'ARRAY' THEN y::JSON[] ELSE []::JSON[] END)), []::JSON[])) k FROM b WHERE json_type(s) = 'OBJECT'),
 d AS (SELECT raw_id, sample_pos, sample_id, unnest(k) x, generate_subscripts(k, 1)::BIGINT token_index FROM c)"""


def _spelled(c: str) -> str:
    p = f"coalesce(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"
    bare = f"regexp_replace(translate({p}, 'ˈˌ', ''), '^([A-Za-z]+)[012]$', '\\1')"
    table = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in PHONEME_SPELLINGS.items()) + "}"
    return f"coalesce(nullif(coalesce({table}[{bare}], {bare}), ''), {p})"


SHINGLED = SEQ + f""", f AS (SELECT list_filter(ps, lambda x: x NOT IN ({", ".join(map(_text, SILENT))})) ps, min(sample_id) id FROM q GROUP BY q.ps),
 sh AS (SELECT id, list_distinct(CASE WHEN len(ps) <= 4 THEN [array_to_string(ps, ' ')] ELSE list_transform(range(1, len(ps) - 2), lambda i: array_to_string(ps[i:i + 3], ' ')) END) s FROM f),
 ex AS (SELECT id, len(s) n, unnest(s) h FROM sh),
 nr AS (SELECT a, b, similarity FROM (SELECT x.id a, y.id b, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) similarity FROM ex x JOIN ex y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2) WHERE similarity >= 0.8)"""
GROUPED = "RECURSIVE " + SHINGLED + ", " + SIG.removeprefix(SEQ + ", ") + """, st AS (SELECT f1 a, sample_id b FROM g JOIN (SELECT signature, min(sample_id) f1 FROM g GROUP BY 1) USING (signature) WHERE sample_id <> f1),
 ed AS (SELECT a, b FROM st UNION SELECT b, a FROM st UNION SELECT a, b FROM nr UNION SELECT b, a FROM nr),
 rc AS (SELECT sample_id x, sample_id y FROM q UNION SELECT rc.x, ed.b FROM rc JOIN ed ON rc.y = ed.a),
 gr AS (SELECT x sample_id, min(y) root FROM rc GROUP BY 1)"""


ARTICULATION = "art(ph, ty, he, ba, ro, pl, ma, vo, asp) AS (VALUES " + ", ".join("(" + ", ".join(_text(x) for x in r) + ")" for r in articulation_rows()) + ")"
HAN = "regexp_matches(ch, '^[\\x{4E00}-\\x{9FFF}]$')"
CHARS = f"""cs AS (SELECT sample_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1)::BIGINT pos FROM (SELECT DISTINCT sample_id, text FROM samples WHERE text <> '')),
 ct AS (SELECT *, CASE WHEN NOT {HAN} THEN NULL WHEN ch = '一' THEN 1 WHEN ch = '不' THEN 4 ELSE unicode(ch) % 4 + 1 END tone, {HAN} han, regexp_matches(ch, '^[\\s\\p{{Z}}{ALL_MARKS}]$') stop FROM cs),
 cp AS (SELECT *, sum(stop::INT) OVER (PARTITION BY sample_id ORDER BY pos) part FROM ct),
 cn AS (SELECT *, first_value(CASE WHEN han THEN (ch, tone) END IGNORE NULLS) OVER (PARTITION BY sample_id, part ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nx,
   last_value(CASE WHEN han THEN (ch, tone) END IGNORE NULLS) OVER (PARTITION BY sample_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pv FROM cp),
 s1 AS (SELECT *, CASE WHEN ch = '一' THEN CASE WHEN pv[1] = '第' THEN 1 WHEN nx[2] = 4 THEN 2 WHEN nx[2] IN (1, 2, 3) THEN 4 ELSE 1 END WHEN ch = '不' THEN CASE WHEN nx[2] = 4 THEN 2 ELSE 4 END ELSE tone END s FROM cn),
 s2 AS (SELECT *, CASE WHEN coalesce(han AND s = 3, false) AND coalesce(lead(coalesce(han AND s = 3, false)) OVER (PARTITION BY sample_id ORDER BY pos), false) THEN 2 ELSE s END surface FROM s1)"""


def _field(f: str) -> str:
    blank = lambda c: f"CASE WHEN lower(trim({c})) IN ('', '[na]') THEN NULL ELSE lower(trim({c})) END"
    if f == "phoneme":
        return f
    if f == "syllable_role":
        return f"coalesce({blank(f)}, 'other')"
    if f == "boundary_boundary_type":
        return f"coalesce({blank(f)}, 'none')"
    if f.startswith("boundary_"):
        return f"coalesce(lower({f}), 'false')"
    return f"coalesce({f}, 0)::VARCHAR" if f in ("surface_tone", "stress") else f"coalesce({blank(f)}, '[NA]')"


SEEDS = "seed(field, token, id) AS (VALUES " + ", ".join(f"({_text(f)}, {_text(t)}, {k})" for f in V.FIELDS for k, t in enumerate((V.PAD, V.UNK, *sorted(V.SEEDS.get(f, "").split())))) + ")"
LONG = "lo AS (" + " UNION ALL ".join(f"SELECT sample_id, token_index, {_text(f)} field, {_field(f)} token FROM t" for f in V.FIELDS) + ")"
VOCAB = f"""{T}, {SEEDS}, {LONG}, sn AS (SELECT field, token, min((sample_id, token_index)) f FROM lo WHERE token IS NOT NULL GROUP BY 1, 2),
 nw AS (SELECT field, token, (SELECT count(*) FROM seed WHERE seed.field = sn.field) + row_number() OVER (PARTITION BY field ORDER BY CASE WHEN field <> 'phoneme' THEN f END NULLS FIRST, token) - 1 id FROM sn WHERE (field, token) NOT IN (SELECT (field, token) FROM seed)),
 v AS (SELECT * FROM seed UNION ALL SELECT * FROM nw)"""


def oracle_sql() -> dict[str, str]:
    frequencies = " UNION ALL ".join(f"SELECT '{f}' field, {f}::VARCHAR value, count(*) n FROM t GROUP BY {f}" for f in ("viseme_id", "language", "surface_tone", "stress", "syllable_role", "boundary_boundary_type", "viseme_source", "strength_source"))
    silent = ", ".join(map(_text, SILENT))
    slices = {"language": "language", "surface_tone": "'tone_' || surface_tone", "stress": "'stress_' || stress", "syllable_role": "coalesce(syllable_role, 'other')", "phrase_position": "pos", "length_bucket": "bucket"}
    bucket = "CASE WHEN len BETWEEN 1 AND 8 THEN 'len_1_8' WHEN len BETWEEN 9 AND 16 THEN 'len_9_16' WHEN len BETWEEN 17 AND 32 THEN 'len_17_32' WHEN len BETWEEN 33 AND 64 THEN 'len_33_64' WHEN len BETWEEN 65 AND 128 THEN 'len_65_128' ELSE 'len_129_plus' END"
    position = "CASE WHEN boundary_phrase_start = 'true' THEN 'phrase_start' WHEN boundary_phrase_end = 'true' THEN 'phrase_end' WHEN boundary_word_start = 'true' THEN 'word_start' WHEN boundary_word_end = 'true' THEN 'word_end' ELSE 'word_internal' END"
    sl = SCORED + f", w AS (SELECT *, {position} pos, {bucket} bucket FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) len FROM s)), sl AS (" + " UNION ALL ".join(f"SELECT '{k}' slice, {v} AS key, viseme_id t, predicted p, abs(pseudo_strength - strength) e FROM w" for k, v in slices.items()) + "), sc AS (SELECT slice, key, c, count(*) FILTER (side = 0) support, count(*) FILTER (side = 1) said, count(*) FILTER (side = 0 AND hit) hit FROM (SELECT slice, key, t c, 0 side, t = p hit FROM sl UNION ALL SELECT slice, key, p, 1, false FROM sl) GROUP BY 1, 2, 3), sm AS (SELECT slice, key, avg(2.0::DOUBLE * hit / (support + said)) macro_f1 FROM sc WHERE support > 0 GROUP BY 1, 2)"
    err = "pseudo_strength / 100 - strength / 100"
    weight = "CASE lower(strength_source) WHEN 'pseudo_rule_b' THEN 0.5::DOUBLE WHEN 'human' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    encoded = ", ".join(f"coalesce((SELECT id FROM v WHERE field = '{f}' AND token = {_field(f)}), 1)::BIGINT \"{f}\"" for f in V.FIELDS)
    vowel = "ty = 'vowel'"
    roles = f"""{T}, {ARTICULATION}, y AS (SELECT t.*, coalesce(ty, 'unknown') ty, row_number() OVER (PARTITION BY sample_id, teacher_word_index, teacher_char_index ORDER BY token_index) k FROM t LEFT JOIN art ON art.ph = {_spelled('phoneme')}),
 z AS (SELECT *, min(CASE WHEN {vowel} THEN k END) OVER w f, max(CASE WHEN {vowel} THEN k END) OVER w l, bool_and(ty = 'silence') OVER w sil FROM y WINDOW w AS (PARTITION BY sample_id, teacher_word_index, teacher_char_index))
SELECT sample_id, token_index, CASE WHEN sample_id IS NULL OR teacher_word_index IS NULL OR teacher_char_index IS NULL THEN NULL WHEN sil THEN 'silence' WHEN f IS NULL THEN CASE WHEN k = 1 THEN 'onset' ELSE 'other' END WHEN k < f THEN 'onset' WHEN k <= l THEN 'nucleus' WHEN ty = 'consonant' THEN 'coda' ELSE 'other' END AS role FROM z"""
    marks = "CASE WHEN articulatory_type = 'silence' THEN CASE WHEN phoneme = '∅' THEN '。' ELSE '，' END ELSE 'x' END"
    assert "。" in MAJOR_MARKS and "，" in ALL_MARKS
    rules = [
        ("phoneme missing", "coalesce(trim(phoneme) = '', true)"), ("language not supported", "coalesce(lower(language) NOT IN ('zh', 'en'), true)"),
        ("Chinese tone out of range", "lower(language) = 'zh' AND coalesce(surface_tone NOT IN (1, 2, 3, 4, 5), true)"), ("Chinese stress", "lower(language) = 'zh' AND coalesce(stress <> 0, true)"),
        ("English tone", "lower(language) = 'en' AND coalesce(surface_tone <> 0, true)"), ("English stress out of range", "lower(language) = 'en' AND coalesce(stress NOT IN (0, 1, 2), true)"),
        ("viseme_id missing", "viseme_id IS NULL"), ("viseme_id out of range", "viseme_id NOT BETWEEN 0 AND 17"), ("strength missing", "strength IS NULL"), ("strength out of range", f"NOT ({OK})"),
    ]
    inv = "SELECT DISTINCT phoneme FROM phoneme_inventory"
    record_rules = [(n, c) for n, c in rules if n not in ("strength missing", "strength out of range")]
    record_rules += [("strength missing", "strength IS NULL"), ("strength is no number", "isnan(strength) OR isinf(strength)"), ("strength out of range", "NOT isnan(strength) AND NOT isinf(strength) AND strength NOT BETWEEN 0 AND 100")]
    big = lambda p: f"TRY_CAST(x->>'$.{p}' AS BIGINT)"
    flag = lambda p: f"CASE WHEN lower(trim(x->>'$.{p}')) IN ('true', 'false') THEN lower(trim(x->>'$.{p}')) = 'true' END"
    leaves = {c: f"x->>'$.{c}'" for c in ("phoneme", "language", "syllable_role")} | {c: big(c) for c in ("surface_tone", "stress")} | {f"articulatory_{c}": f"x->>'$.articulatory.{c}'" for c in ("type", "height", "backness", "place", "manner")}
    leaves |= {"articulatory_voiced": flag("articulatory.voiced")} | {f"boundary_{c}": flag(f"boundary.{c}") for c in ("word_start", "word_end", "phrase_start", "phrase_end")} | {"boundary_type": "x->>'$.boundary.boundary_type'"}
    leaves |= {"labels_viseme_id": big("labels.viseme_id"), "labels_strength": "TRY_CAST(x->>'$.labels.strength' AS DOUBLE)", "labels_viseme_source": "x->>'$.labels.viseme_source'", "labels_strength_source": "x->>'$.labels.strength_source'", "teacher_shape": "x->>'$.teacher_metadata.shape'"}
    p3_tokens = "raw_id, sample_pos, token_index token_pos, " + ", ".join(f"{v} AS {k}" for k, v in leaves.items())
    edge = lambda c, way: f"CASE WHEN {way}(1) OVER q IS NULL THEN 'edge' ELSE coalesce({way}({c}::VARCHAR) OVER q, 'none') END"
    context = {"type_before": edge("articulatory_type", "lag"), "type_after": edge("articulatory_type", "lead"), "tone_before": edge("surface_tone", "lag"), "sentence_third": "['start', 'middle', 'end'][(row_number() OVER q - 1) * 3 // count(*) OVER (PARTITION BY sample_id) + 1]"}
    w2 = ", w AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in context.items()) + " FROM s WINDOW q AS (PARTITION BY sample_id ORDER BY token_index))"
    cs = SCORED + w2 + ", sl AS (" + " UNION ALL ".join(f"SELECT '{k}' slice, {k} AS key, viseme_id t, predicted p, abs(pseudo_strength - strength) e FROM w" for k in context) + ")" + sl[sl.index(", sc AS ("):]
    return {
        "p3_found": f"WITH {DELIVERED} SELECT DISTINCT raw_id, sample_pos, sample_id, token_index FROM d WHERE json_type(x) = 'OBJECT'",
        "p3_samples": f"WITH {DELIVERED} SELECT raw_id, sample_pos, sample_id, s->>'$.schema_version' schema_version, s->>'$.text' AS text, s->>'$.normalized_text' normalized_text, s->>'$.teacher_metadata.engine.name' engine_name, (s->>'$.teacher_metadata.engine.version')::BIGINT engine_version FROM c",
        "p3_tokens": f"WITH {DELIVERED} SELECT {p3_tokens} FROM d WHERE json_type(x) = 'OBJECT'",
        "renest_changes": f"WITH {RANKED} SELECT sample_id, token_index, 'surface_tone' field, surface_tone::VARCHAR AS \"left\", NULL::VARCHAR AS \"right\" FROM rn WHERE viseme_id = 5 AND surface_tone IS NOT NULL",
        "near_pairs": f"WITH {SHINGLED} SELECT a, b, round(similarity, 6) similarity FROM nr",
        "duplicate_groups": f"WITH {GROUPED} SELECT sample_id, root FROM gr",
        "kept_samples": f"WITH {GROUPED} SELECT root, min(sample_id) sample_id FROM gr GROUP BY 1",
        "current_leaks": f"WITH {GROUPED}, {NOW} SELECT kind, md5(key) AS key, splits FROM (SELECT 'group' kind, root AS key, count(DISTINCT split) splits FROM gr JOIN now USING (sample_id) GROUP BY 2 UNION ALL SELECT 'signature', signature, count(DISTINCT split) FROM g JOIN gr USING (sample_id) JOIN now USING (sample_id) GROUP BY 2) WHERE splits > 1",
        "vocab_problems": f"WITH {VOCAB}, k AS (SELECT * FROM v WHERE NOT (field = 'language' AND id = 1) AND NOT (field = 'stress' AND id = 2) AND field <> 'syllable_role'), z AS (SELECT field, token, id FROM k UNION ALL SELECT field, token, id + 1 FROM k WHERE field = 'phoneme' AND id = 2 UNION ALL SELECT 'colour', token, id FROM k WHERE field = 'stress'), w AS (SELECT DISTINCT field FROM seed), p AS (SELECT coalesce(z.field, w.field) field, w.field IS NULL extra, count(z.token) n, count(DISTINCT z.token) ts, count(DISTINCT z.id) ids, max(z.id) top, coalesce(bool_or(z.token = '[PAD]' AND z.id = 0), false) pad, coalesce(bool_or(z.token = '[UNK]' AND z.id = 1), false) unk FROM z FULL JOIN w ON z.field = w.field GROUP BY 1, 2) SELECT field, unnest(list_filter([CASE WHEN n = 0 THEN 'missing field' END, CASE WHEN extra THEN 'extra field' END, CASE WHEN n > 0 AND NOT pad THEN 'no padding slot' END, CASE WHEN n > 0 AND NOT unk THEN 'no unknown slot' END, CASE WHEN ts < n THEN 'repeated token' END, CASE WHEN ids < n THEN 'repeated id' END, CASE WHEN top + 1 <> n THEN 'gap in ids' END], lambda x: x IS NOT NULL)) problem FROM p",
        "auto_ids": f"WITH {DELIVERED} SELECT DISTINCT raw_id, sample_pos, CASE WHEN sample_id = '' THEN raw_id || ':' || sample_pos || '#auto' ELSE sample_id END sample_id FROM c",
        "service_requests": f"WITH {T}, e1 AS (SELECT DISTINCT sample_id, token_index, teacher_raw_phoneme r, teacher_word_index w, teacher_char_index c FROM t WHERE sample_id IS NOT NULL), e2 AS (SELECT CASE WHEN r IS NULL OR r IN ('', '-') THEN '_' ELSE r END phoneme, coalesce(w, 0) word_index, coalesce(c, 0) char_index, row_number() OVER (PARTITION BY sample_id ORDER BY token_index) - 1 p FROM e1) SELECT phoneme, word_index, char_index, count(*) n, sum(p)::BIGINT positions FROM e2 GROUP BY 1, 2, 3",
        "request_features": f"WITH {CHARS}, a1 AS (SELECT sample_id, pos, (pos - 1) // 2 wi, CASE WHEN regexp_matches(ch, '^[\\s\\p{{Z}}{ALL_MARKS}\\x{{4E00}}-\\x{{9FFF}}]$') THEN 'zh' ELSE 'en' END AS language, stop, regexp_matches(ch, '^[{MAJOR_MARKS}]$') major FROM ct), a2 AS (SELECT language, CASE WHEN language = 'zh' THEN 5 ELSE 0 END surface_tone, coalesce(lag(wi) OVER w <> wi, true) word_start, coalesce(lead(wi) OVER w <> wi, true) word_end, coalesce(lag(stop) OVER w, false) phrase_start, stop OR lead(1) OVER w IS NULL phrase_end, CASE WHEN major THEN 'major' WHEN stop THEN 'minor' ELSE 'none' END boundary_type FROM a1 WINDOW w AS (PARTITION BY sample_id ORDER BY pos)) SELECT *, count(*) n FROM a2 GROUP BY ALL",
        "nested_roles": f"WITH {T}, y AS (SELECT DISTINCT sample_id, token_index, articulatory_type, language, teacher_word_index w FROM t), z AS (SELECT *, min(CASE WHEN articulatory_type = 'vowel' THEN token_index END) OVER (PARTITION BY sample_id, w) f, coalesce(lead(articulatory_type = 'vowel') OVER (PARTITION BY sample_id, w ORDER BY token_index), false) nx FROM y) SELECT language, articulatory_type, role, count(*) n FROM (SELECT *, CASE WHEN articulatory_type = 'silence' THEN 'silence' WHEN language = 'zh' THEN CASE WHEN f IS NULL OR token_index < f THEN 'onset' WHEN token_index = f THEN 'nucleus' ELSE 'coda' END WHEN articulatory_type = 'vowel' THEN 'nucleus' WHEN nx THEN 'onset' ELSE 'coda' END AS role FROM z) GROUP BY 1, 2, 3",
        "flattened_batches": f"WITH {BATCH}, tv AS (SELECT DISTINCT sample_id, token_index, phoneme, viseme_id FROM t), sv AS (SELECT sample_id, sum(coalesce(viseme_id, -100)) s FROM tv GROUP BY 1) SELECT batch, rk - b.first AS \"row\", len n, s::BIGINT labels, len - 1 AS \"last\" FROM b JOIN h ON rk BETWEEN b.first AND b.last JOIN sv USING (sample_id)",
        "shuffled_batches": f"WITH {BATCH} SELECT n, tokens, count(*) batches FROM (SELECT batch, count(*) n, sum(len)::BIGINT tokens FROM b JOIN h ON rk BETWEEN b.first AND b.last GROUP BY 1) GROUP BY 1, 2",
        "context_slices": f"WITH {cs} SELECT sl.slice, sl.key, count(*) tokens, round(avg((t = p)::INT), 6) accuracy, round(any_value(macro_f1), 6) macro_f1, round(avg(e), 6) mae FROM sl JOIN sm ON sl.slice = sm.slice AND sl.key IS NOT DISTINCT FROM sm.key GROUP BY 1, 2",
        "merged_metrics": f"WITH {OVERALL} SELECT accuracy, macro_f1, weighted_f1, total, mae, rmse FROM o, r",
        "masked_metrics": f"WITH {SCORED} SELECT round(avg((viseme_id = predicted)::INT), 6) accuracy, round(avg(abs(pseudo_strength - strength)), 6) mae FROM s WHERE articulatory_type <> 'silence'",
        "acceptance_lines": f"WITH {OVERALL}, z AS (SELECT round(avg((viseme_id = predicted)::INT), 6) before FROM s WHERE language = 'zh') SELECT unnest(['macro F1', 'strength error', 'no regression']) AS \"check\", unnest([macro_f1 >= 0.92, mae <= 8, accuracy >= before - 0.005 - 1e-12]) passed FROM o, r, z",
        "mean_cross_entropy": f"WITH {SCORED}, z AS (SELECT CASE WHEN predicted BETWEEN 0 AND 17 THEN exp(3.0) + 17 * exp(0.5) ELSE 18 * exp(0.5) END e, CASE WHEN predicted = viseme_id THEN 3.0 ELSE 0.5 END hit, CASE WHEN predicted BETWEEN 0 AND 17 THEN (3.0 + 17 * 0.5) / 18 ELSE 0.5 END m FROM s) SELECT round(avg(0.9 * (ln(e) - hit) + 0.1 * (ln(e) - m)), 6) loss FROM z",
        "annotator_agreement": f"WITH {SCORED}, z AS (SELECT DISTINCT sample_id, token_index, viseme_id, predicted, strength, pseudo_strength FROM s), a AS (SELECT DISTINCT sample_id, token_index, viseme_id c, strength v FROM z), b AS (SELECT DISTINCT sample_id, token_index, predicted c, pseudo_strength v FROM z) SELECT 'label' AS a, 'rule' AS b, count(*) n, round(avg((a.c = b.c)::INT), 6) class_agreement, round(avg(abs(a.v - b.v)), 6) mae FROM a JOIN b ON a.sample_id = b.sample_id AND a.token_index = b.token_index",
        "row_functions": f"WITH {T}, y AS (SELECT *, strength / 50 s1, 1.0::DOUBLE s2, surface_tone::DOUBLE s3 FROM t WHERE {OK}) SELECT DISTINCT sample_id, token_index, CASE WHEN viseme_id BETWEEN 0 AND 8 THEN 'v' || viseme_id ELSE '<unknown:' || viseme_id || '>' END AS name, TRY_CAST(nullif(regexp_extract(phoneme || surface_tone, '([1-5])$', 1), '') AS BIGINT) digit, strength_1 rounded, round(100 / (1 + exp(-(strength / 25 - 2))), 6) squashed, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 0 WHEN s2 >= s3 THEN 1 ELSE 2 END::BIGINT best, round(exp(s1) / (exp(s1) + exp(s2) + exp(s3)), 6) share, token_index * 2 * (6 * 8 + 2 * 16) * 4 bytes FROM (SELECT *, round(strength::DECIMAL(38, 18), 1)::DOUBLE strength_1 FROM y)",
        "word_kinds": f"SELECT md5(word) word, CASE WHEN regexp_matches(regexp_replace(word, '[\\s\\p{{Z}}{ALL_MARKS}]', '', 'g'), '^[\\x{{4E00}}-\\x{{9FFF}}]*$') THEN 'zh' ELSE 'en' END AS language, regexp_matches(word, '^[\\s\\p{{Z}}{ALL_MARKS}]*$') pause FROM (SELECT DISTINCT unnest(string_split(text, ' ')) word FROM samples WHERE text IS NOT NULL)",
        "scan_pruned": "SELECT DISTINCT sample_id, token_index, phoneme, language, viseme_id, strength FROM tokens WHERE language = 'zh' AND strength >= 50 AND strength <= 100",
        "narrow_tokens": "SELECT DISTINCT sample_id, phoneme, coalesce(syllable_role, 'other') syllable_role, viseme_id FROM tokens",
        "nest_sequences": f"WITH {SEQ} SELECT sample_id, len(ps)::BIGINT n, array_to_string(ps, ' ') phonemes FROM q",
        "samples_with_tokens": f"WITH {T}, k AS (SELECT sample_id, count(*) n FROM (SELECT DISTINCT sample_id, token_index, phoneme FROM t) GROUP BY 1), m AS (SELECT sample_id, max_by(batch_id, (ingested_at, batch_id)) batch_id FROM samples GROUP BY 1) SELECT sample_id, batch_id, coalesce(n, 0)::BIGINT tokens FROM m LEFT JOIN k USING (sample_id) WHERE batch_id IS NOT NULL",
        "left_meta_join": f"WITH {T}, m AS (SELECT sample_id, max_by(batch_id, (ingested_at, batch_id)) batch_id FROM samples GROUP BY 1) SELECT batch_id, count(*) tokens, count(DISTINCT sample_id) samples FROM t LEFT JOIN m USING (sample_id) GROUP BY 1",
        "sources_union": "SELECT origin, count(*) n, count(DISTINCT sample_id) ids FROM (SELECT sample_id, 'samples' origin FROM samples UNION ALL SELECT sample_id, 'origins' FROM sample_origins) GROUP BY 1",
        "echo_fields": "WITH u AS (SELECT phoneme, min(default_viseme_id) predicted FROM phoneme_inventory WHERE phoneme IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT sample_id, token_index, phoneme, teacher_word_index, teacher_char_index FROM tokens), p AS (SELECT DISTINCT sample_id, token_index, predicted FROM t LEFT JOIN u ON t.phoneme = u.phoneme) SELECT t.sample_id, t.token_index, teacher_word_index, teacher_char_index, predicted FROM t LEFT JOIN p ON t.sample_id = p.sample_id AND t.token_index = p.token_index",
        "token_violations": f"WITH {T} SELECT rule, count(*) n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule FROM t WHERE {c}" for n, c in rules) + ") GROUP BY 1",
        "revalidated_pair": f"WITH {T}, y AS (SELECT * FROM t WHERE sample_id IS NOT NULL), bad AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, sample_id FROM y WHERE {c}" for n, c in record_rules) + " UNION ALL SELECT 'too many tokens', sample_id FROM y GROUP BY sample_id HAVING count(*) > 256) SELECT rule, count(DISTINCT sample_id) records, count(*) times FROM bad GROUP BY 1",
        "json_typed": "SELECT sample_id, generation->>'$.source' AS source, (generation->>'$.worker')::BIGINT worker, (generation->>'$.options.retry')::BOOLEAN retry FROM (SELECT DISTINCT sample_id, CASE WHEN json_valid(generation) THEN generation::JSON END generation FROM samples)",
        "categories": f"WITH {T} SELECT field, value, count(*) n FROM (" + " UNION ALL ".join(f"SELECT '{c}' field, CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', '[na]') THEN '[NA]' ELSE lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) END AS value FROM t" for c in ("syllable_role", "articulatory_height", "teacher_raw_phoneme")) + ") GROUP BY 1, 2",
        "frequencies": f"WITH {T} {frequencies}",
        "length_profile": f"WITH {LEN} SELECT count(*) sentences, sum(len)::BIGINT tokens, min(len) shortest, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6) p50, round(quantile_cont(len, 0.95), 6) p95, max(len) longest FROM l",
        "strength_profile": f"WITH {T} SELECT count(*) n, round(avg(strength), 6) AS mean, round(stddev_pop(strength), 6) std, min(strength) low, round(quantile_cont(strength, 0.05), 6) p05, round(quantile_cont(strength, 0.5), 6) p50, round(quantile_cont(strength, 0.95), 6) p95, max(strength) high FROM t WHERE {OK}",
        "class_means": f"WITH {T} SELECT viseme_id, count(*) n, round(avg(strength), 6) AS mean FROM t WHERE {OK} AND viseme_id IS NOT NULL GROUP BY 1",
        "boundary_counts": f"WITH {T} SELECT count(*) tokens, count(*) FILTER (boundary_phrase_end = 'true') phrase_ends, count(*) FILTER (boundary_word_end = 'true') word_ends, count(*) FILTER (lower(strength_source) IN ('human', 'human_gold')) human, count(DISTINCT phoneme) phonemes FROM t",
        "unknown_rate": f"WITH {T}, k AS (SELECT count(*) tokens, count(*) FILTER (phoneme IS NULL OR phoneme NOT IN ({inv})) unknown FROM t) SELECT tokens, unknown, round(unknown::DOUBLE / nullif(tokens, 0), 6) unknown_rate FROM k",
        "top_unknown": f"WITH {T} SELECT phoneme, count(*) n FROM t WHERE phoneme NOT IN ({inv}) GROUP BY 1 ORDER BY n DESC, min((sample_id, token_index)), phoneme LIMIT 10",
        "missing_classes": f"WITH {T} SELECT range viseme_id FROM range(18) WHERE range NOT IN (SELECT viseme_id FROM t WHERE viseme_id IS NOT NULL)",
        "strength_histogram": f"WITH {T} SELECT viseme_id, CASE WHEN strength >= 100 THEN 21 ELSE floor(strength / 100 * 20)::BIGINT + 1 END bucket, count(*) n FROM t WHERE {OK} GROUP BY 1, 2",
        "phrase_positions": f"WITH {T} SELECT {position} phrase_position, count(*) n FROM t GROUP BY 1",
        "manifest_check": "WITH n AS (SELECT split_name, count(*) n FROM (SELECT sample_id, max_by(split_name, (assigned_at, split_name)) split_name FROM split_members GROUP BY 1) GROUP BY 1), r AS (SELECT counts FROM split_report_v2 ORDER BY run_id DESC LIMIT 1), f AS (SELECT 'train' field, counts.train::VARCHAR stated FROM r UNION ALL SELECT 'validation', counts.validation::VARCHAR FROM r UNION ALL SELECT 'test', counts.test::VARCHAR FROM r) SELECT field, stated, coalesce(n, 0)::VARCHAR actual FROM f LEFT JOIN n ON field = split_name WHERE stated IS DISTINCT FROM coalesce(n, 0)::VARCHAR",
        "vocab_build": "SELECT '[PAD]' AS token, 0::BIGINT id UNION ALL SELECT '[UNK]', 1 UNION ALL SELECT phoneme, row_number() OVER (ORDER BY phoneme) + 1 FROM (SELECT DISTINCT phoneme FROM tokens WHERE phoneme NOT IN ('[PAD]', '[UNK]'))",
        "vocab_all": f"WITH {VOCAB} SELECT field, token, id::BIGINT id FROM v",
        "vocab_sizes": f"WITH {VOCAB} SELECT field, count(*) n FROM v GROUP BY 1",
        "encode_tokens": f"WITH {VOCAB} SELECT sample_id, token_index, {encoded} FROM t",
        "encode_inventory": f"WITH {T}, v AS (SELECT phoneme, row_number() OVER (ORDER BY phoneme) + 1 id FROM ({inv})) SELECT sample_id, token_index, coalesce(v.id, 1)::BIGINT phoneme FROM t LEFT JOIN v USING (phoneme)",
        "exact_groups": f"WITH {SIG} SELECT md5(signature) signature, count(*) n, min(sample_id) AS \"first\" FROM g GROUP BY 1 HAVING count(*) > 1",
        "shingle_counts": f"WITH {SEQ}, f AS (SELECT sample_id, list_filter(ps, lambda x: x NOT IN ({silent})) ps FROM q) SELECT sample_id, CASE WHEN len(ps) <= 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(ps) - 2), lambda i: array_to_string(ps[i:i + 3], ' ')))) END::BIGINT shingles FROM f",
        "contamination": f"WITH {SIG}, {NOW} SELECT md5(signature) signature, count(DISTINCT split) splits, count(*) n FROM g JOIN now USING (sample_id) GROUP BY 1 HAVING count(DISTINCT split) > 1",
        "text_signatures": r"SELECT sample_id, md5(coalesce(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '')) signature FROM (SELECT DISTINCT sample_id, text FROM samples)",
        "pseudo_strength": f"WITH {T}, {_strengths(False)} SELECT sample_id, token_index, round(ps, 6) pseudo_strength FROM p",
        "segment_roles": f"WITH {roles}",
        "articulation_of": f"WITH {ARTICULATION} SELECT DISTINCT phoneme, coalesce(ty, 'unknown') a_type, he a_height, pl a_place, ma a_manner FROM tokens LEFT JOIN art ON art.ph = {_spelled('phoneme')}",
        "word_edges": f"WITH {T} SELECT sample_id, token_index, lag(1) OVER w IS NULL OR lag(teacher_word_index) OVER w IS DISTINCT FROM teacher_word_index starts_word, lead(1) OVER w IS NULL OR lead(teacher_word_index) OVER w IS DISTINCT FROM teacher_word_index ends_word FROM t WINDOW w AS (PARTITION BY sample_id ORDER BY token_index)",
        "phrase_edges": f"WITH {T}, y AS (SELECT *, {marks} wd FROM t) SELECT sample_id, token_index, wd <> 'x' OR lead(1) OVER w IS NULL ends_phrase, coalesce(lag(wd <> 'x') OVER w, false) starts_phrase, CASE wd WHEN '。' THEN 'major' WHEN '，' THEN 'minor' ELSE 'none' END boundary FROM y WINDOW w AS (PARTITION BY sample_id ORDER BY token_index)",
        "occurrences": f"WITH {T} SELECT sample_id, token_index, row_number() OVER (PARTITION BY sample_id, teacher_char_index ORDER BY token_index) - 1 occurrence FROM t",
        "surface_tones": f"WITH {CHARS} SELECT sample_id, pos, surface::BIGINT surface FROM s2 WHERE tone IS NOT NULL",
        "tone_sequences": f"WITH {CHARS} SELECT sample_id, string_agg(surface::VARCHAR, '' ORDER BY pos) surface, string_agg(tone::VARCHAR, '' ORDER BY pos) lexical FROM s2 WHERE han GROUP BY 1",
        "length_buckets": f"WITH {LEN} SELECT {bucket} bucket, count(*) n FROM l GROUP BY 1",
        "token_budget_batches": f"WITH {BATCH} SELECT batch, count(*) n, max(len) longest, sum(len)::BIGINT tokens FROM b JOIN h ON rk BETWEEN b.first AND b.last GROUP BY 1",
        "padded_batches": f"WITH {BATCH}, sv AS (SELECT sample_id, count(viseme_id) k FROM t GROUP BY 1) SELECT batch, count(*) AS \"rows\", sum(len)::BIGINT AS \"real\", (max(len) * count(*))::BIGINT padded, sum(k)::BIGINT supervised FROM b JOIN h ON rk BETWEEN b.first AND b.last JOIN sv USING (sample_id) GROUP BY 1",
        "fixed_batches": f"WITH {LEN} SELECT ((rk - 1) // 16)::BIGINT batch, count(*) n, sum(len)::BIGINT tokens FROM (SELECT len, row_number() OVER (ORDER BY sample_id) rk FROM l) GROUP BY 1",
        "confusion": f"WITH {MATRIX} SELECT target, predicted, n FROM c",
        "class_prf": f"WITH {PRF} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) f1, support FROM k3",
        "overall_metrics": f"WITH {OVERALL} SELECT * FROM o",
        "regression_metrics": f"WITH {OVERALL} SELECT * FROM r",
        "regression_by_class": f"WITH {SCORED} SELECT viseme_id, count(*) n, round(avg(abs(pseudo_strength - strength)), 6) mae FROM s GROUP BY 1",
        "slice_metrics": f"WITH {sl} SELECT sl.slice, sl.key, count(*) tokens, round(avg((t = p)::INT), 6) accuracy, round(any_value(macro_f1), 6) macro_f1, round(avg(e), 6) mae FROM sl JOIN sm ON sl.slice = sm.slice AND sl.key IS NOT DISTINCT FROM sm.key GROUP BY 1, 2",
        "failure_topk": f"WITH {SCORED} SELECT sample_id, token_index, viseme_id, predicted, error FROM (SELECT *, round(abs(pseudo_strength - strength), 4) error FROM s) WHERE viseme_id <> predicted OR error > 15 ORDER BY (viseme_id = predicted)::INT, error DESC, sample_id, token_index LIMIT 500",
        "weighted_losses": f"WITH {SCORED}, q AS (SELECT abs({err}) d, {weight} w FROM s) SELECT round(sum(w * CASE WHEN d < 0.1 THEN 0.5 * d * d / 0.1::DOUBLE ELSE d - 0.05 END) / sum(w), 6) huber, round(sum(w * d) / sum(w), 6) l1, round(sum(w * d * d) / sum(w), 6) mse FROM q",
        "composite_metric": f"WITH {OVERALL} SELECT round(macro_f1 - mae / 100, 5) composite FROM o, r",
        "calibration": f"WITH {SCORED} SELECT viseme_id, count(*) n, CASE WHEN min(pseudo_strength) < max(pseudo_strength) THEN round(regr_slope(strength, pseudo_strength), 6) END slope, CASE WHEN min(pseudo_strength) < max(pseudo_strength) THEN round(regr_intercept(strength, pseudo_strength), 6) END intercept FROM s GROUP BY 1",
        "gate_checks": f"WITH {OVERALL} SELECT unnest(['training ran', 'no NaN or Inf', 'train loss finite', 'train accuracy', 'train strength error', 'validation present', 'validation accuracy', 'validation strength error']) AS \"check\", unnest([true, true, true, accuracy >= 0.95, mae <= 5, true, accuracy >= 0.95, mae <= 5]) passed FROM o, r",
        "log_windows": f"WITH {LOG} SELECT run, ((step - 1) // 5)::BIGINT AS \"window\", count(*) steps, round(avg(value), 6) AS mean FROM lg GROUP BY 1, 2",
        "full_log_windows": f"WITH {LOG} SELECT * FROM (SELECT run, ((step - 1) // 5)::BIGINT AS \"window\", count(*) steps, round(avg(value), 6) AS mean FROM lg GROUP BY 1, 2) WHERE steps = 5 OR \"window\" = 0",
        "best_so_far": f"WITH {BEST} SELECT run, step, best, improved, since::BIGINT since FROM z3",
        "early_stop": f"WITH {BEST} SELECT run, min(step) step FROM z3 WHERE since >= 5 GROUP BY 1",
        "lr_schedule": "SELECT range step, round(3e-4 * CASE WHEN range < 100 THEN range / 100.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * least(1, (range - 100) / 900.0::DOUBLE)))) END, 12) lr FROM range(1, 1001)",
        "retention": f"WITH {LOG} SELECT run, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) r FROM lg) WHERE r <= 3",
        "run_islands": "SELECT event_type, n, count(*) runs FROM (SELECT user_id, event_type, count(*) n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) i FROM events) GROUP BY user_id, event_type, i) GROUP BY 1, 2",
    }
