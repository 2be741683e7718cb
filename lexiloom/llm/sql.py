"""SQL for those queries of this package that SQL can express, by name. The others are tested against brute force."""

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def oracle_sql() -> dict[str, str]:
    percentiles = ", ".join(f"round(quantile_cont(s.strength, {p / 100}), 6) p{p:02d}" for p in PERCENTS)
    once = "SELECT min({'language': language, 'viseme_id': viseme_id, 'strength': strength}) s FROM tokens WHERE strength BETWEEN 0 AND 100 AND NOT isnan(strength) GROUP BY sample_id, token_index"
    power = "CASE WHEN pow(2.0, floor(log2(x))) > x THEN floor(log2(x)) - 1 WHEN pow(2.0, floor(log2(x)) + 1) <= x THEN floor(log2(x)) + 1 ELSE floor(log2(x)) END"
    bucket = "CASE WHEN x = 0 THEN 0 ELSE ((e + 1023) * 4096 + floor((x / pow(2.0, e) - 1) * 4096))::BIGINT END"
    days = "SELECT sample_id, min(generated_at)::DATE AS day FROM samples WHERE sample_id IS NOT NULL GROUP BY 1"
    dated = f"d AS ({days}), o AS (SELECT u.*, day FROM ({once.replace('SELECT min', 'SELECT sample_id, min')}) u LEFT JOIN d USING (sample_id)), y AS (SELECT day, s.language AS language, s.viseme_id AS viseme_id, s.strength x FROM o), z AS (SELECT *, CASE WHEN x > 0 THEN {power} END e FROM y), b AS (SELECT *, {bucket} bucket FROM z)"
    ranked = "k AS (SELECT language, viseme_id, x, row_number() OVER (PARTITION BY language, viseme_id ORDER BY x) r, count(*) OVER (PARTITION BY language, viseme_id) n FROM b), p AS (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS percent), h AS (SELECT language, viseme_id, percent, n, x FROM k JOIN p ON r = greatest(1, ceil(n * percent / 100.0::DOUBLE))), f AS (SELECT *, CASE WHEN x > 0 THEN " + power + " END e FROM h)"
    low = "CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE pow(2.0, e) * (1 + floor((x / pow(2.0, e) - 1) * 4096) / 4096) END"
    high = f"CASE WHEN x = 0 THEN (pow(2.0, 40) - 1) * pow(2.0, -1074) ELSE {low} + (pow(2.0, e - 12) - pow(2.0, e - 52)) END"
    links = "SELECT sample_a a, sample_b b FROM match_pairs WHERE sample_a IS NOT NULL AND sample_b IS NOT NULL"
    return {
        "p2_found": f"WITH RECURSIVE e AS ({links} UNION SELECT b, a FROM ({links}) UNION SELECT a, a FROM ({links}) UNION SELECT b, b FROM ({links})), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a sample_id, min(b) group_id FROM r GROUP BY 1",
        "p4_partials": f"WITH {dated} SELECT day, language, viseme_id, bucket, count(*) n FROM b GROUP BY 1, 2, 3, 4",
        "p4_merged": f"WITH {dated}, {ranked} SELECT language, viseme_id, percent, n, {low} AS low, {high} AS high FROM f",
        "p4_percentiles": f"SELECT s.language AS language, s.viseme_id AS viseme_id, count(*) n, {percentiles} FROM ({once}) GROUP BY 1, 2",
    }
