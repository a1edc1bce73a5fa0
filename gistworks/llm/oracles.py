"""SQL of the pipeline operators for DuckDB, where SQL can express them."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_QUALITY = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT r, sum(least(8, coalesce(n - i, 8))) AS n_repeat_words
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM repeated) GROUP BY r
), f AS (
    SELECT d.r, doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS marks
    FROM d LEFT JOIN covered ON d.r = covered.r
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 2 * n_dup_lines > n_lines OR 100 * capitals > 30 * word_chars
        OR 100 * marks > 5 * word_chars OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM b"""

_MIXTURE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
    SELECT *, ([5, 2, 1])[((rank - 1) % 3)::INT + 1]::DOUBLE AS weight, 2 * source_size AS bound, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), o AS (
    SELECT *, total - coalesce(sum(bound) OVER (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy
    FROM w
), g AS (
    SELECT *, bound * heavy <= rest * weight AS atbound FROM o
), free AS (SELECT rest, heavy FROM g WHERE NOT atbound ORDER BY bound / weight, rank LIMIT 1),
t AS (
    SELECT source, source_size, rank,
        CASE WHEN atbound THEN bound::DOUBLE ELSE (SELECT rest FROM free) * weight / (SELECT heavy FROM free) END AS target
    FROM g
), p AS (
    SELECT d.*, source_size, target, rank, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_passes,
        size * 200 > source_size AS large
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (SELECT *, target - full_passes * source_size AS rest, row_number() OVER (PARTITION BY rank, large ORDER BY size DESC, key) AS nth FROM p),
l AS (SELECT rank, nth, size, rest, source_size FROM q WHERE large),
pk AS (
    SELECT rank, nth, size, size <= rest AS pick, CASE WHEN size <= rest THEN size ELSE 0 END AS filled FROM l WHERE nth = 1
    UNION ALL
    SELECT l.rank, l.nth, l.size, pk.filled + l.size <= l.rest, pk.filled + CASE WHEN pk.filled + l.size <= l.rest THEN l.size ELSE 0 END
    FROM pk JOIN l ON l.rank = pk.rank AND l.nth = pk.nth + 1
), h AS (
    SELECT l.rank, max(pk.filled) AS filled, max(CASE WHEN NOT pick THEN pk.nth END) AS spare, any_value(rest) - max(pk.filled) - (any_value(source_size) - sum(l.size)) AS open
    FROM l JOIN pk ON l.rank = pk.rank AND l.nth = pk.nth GROUP BY l.rank
), a AS (
    SELECT q.*, CASE WHEN q.large THEN pk.pick OR (q.nth = h.spare AND q.size < 2 * h.open)
        ELSE 2 * (sum(q.size) OVER (PARTITION BY q.rank, q.large ORDER BY q.key, q.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - q.size) + q.size
            < 2 * (q.rest - coalesce(h.filled, 0)) END AS more
    FROM q LEFT JOIN h ON q.rank = h.rank LEFT JOIN pk ON q.large AND q.rank = pk.rank AND q.nth = pk.nth
), b AS (
    SELECT *, CASE WHEN size > 0 THEN full_passes + CASE WHEN more THEN 1 ELSE 0 END ELSE 0 END AS passes FROM a
), c AS (
    SELECT *, sum(size * passes) OVER (PARTITION BY source) AS demand, ([-0.5, 0, 0.5])[((rank - 1) % 3)::INT + 1]::DOUBLE AS slope,
        sum(CASE WHEN passes > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS earlier
    FROM b
), e AS (SELECT *, CASE WHEN passes > 0 THEN (earlier + size / 2::DOUBLE) / demand END AS part FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * passes)::BIGINT AS taken,
    round(2 * part / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)), 9) AS position
FROM e"""

_PLAIN = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_CONTAMINATION = rf"""
WITH items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, {_PLAIN} AS w FROM benchmark),
patterns AS (
    SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS v
    FROM items WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM patterns),
d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
windows AS (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS v
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT r, i, windows.n, item FROM windows JOIN patterns USING (n, v)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

_LOWERED = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWERED} AS w FROM documents),
sh AS MATERIALIZED (
    SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
links AS MATERIALIZED (
    SELECT o.a, o.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS o FROM sh x JOIN sh y USING (s) WHERE x.r <> y.r GROUP BY ALL) o
    JOIN n x ON x.r = o.a JOIN n y ON y.r = o.b WHERE 100 * o.o >= 80 * (x.n + y.n - o.o)
), reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least USING (r)"""

_SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
    SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS v FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), again AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY v ORDER BY doc_id NULLS LAST, i) AS k FROM windows) WHERE k > 1),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM again),
kept AS (
    SELECT r, string_agg(w, ' ' ORDER BY j) AS text FROM (SELECT r, w[j] AS w, j FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d))
    ANTI JOIN gone USING (r, j) GROUP BY r
), removed AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)"""

_MANIFEST = """
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, source, doc_id::VARCHAR AS id, n_chars::VARCHAR AS n, lang, text,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda x, y: list_reduce(list_concat([xor(x, y)], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 2 = 0 AS hit
    FROM documents
), f AS (
    SELECT r, doc_id, source, coalesce(hit, false) AS hit,
        list_aggregate(list_transform([id, source, lang, n], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), 'string_agg', '') AS head,
        text, replace(text, chr(10), '') AS cut
    FROM d
), l AS (
    SELECT r, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        CASE WHEN hit THEN sha256(head || coalesce(strlen(cut)::VARCHAR || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) END AS now
    FROM f
), s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM documents)),
p AS MATERIALIZED (
    SELECT l.*, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, leaf) - 1 AS i FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
), low AS (
    SELECT t, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY t) AS n FROM p
    UNION ALL
    SELECT t, any_value(level) + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY t, i // 3
), subroots AS MATERIALIZED (SELECT t, node AS subroot FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, t AS i, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY i // 3
), nodes AS MATERIALIZED (
    SELECT t, level, i, node, n FROM low UNION ALL SELECT -1, level, i, node, n FROM high
), runs AS MATERIALIZED (SELECT t, level, i // 3 AS g, list(node ORDER BY i) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
walk AS (
    SELECT r, t, 0 AS level, i, now AS node, '' AS proof, t AS own, 0 AS k FROM p
    UNION ALL
    SELECT w.r, CASE WHEN run IS NULL THEN -1 ELSE w.t END, CASE WHEN run IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN run IS NULL THEN own ELSE w.i // 3 END,
        CASE WHEN run IS NULL THEN node ELSE sha256(array_to_string(run[:w.i % 3], '') || node || array_to_string(run[w.i % 3 + 2:], '')) END,
        CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(run[:w.i % 3], '') || array_to_string(run[w.i % 3 + 2:], '') END, own, k + 1
    FROM walk w LEFT JOIN runs ON runs.t = w.t AND runs.level = w.level AND runs.g = w.i // 3
    WHERE run IS NOT NULL OR w.t >= 0
), ends AS (SELECT r, arg_max(node, k) AS folded_root, arg_max(proof, k) AS proof FROM walk GROUP BY r),
top AS (SELECT node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN subroots USING (t) JOIN ends USING (r), top"""

_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
    SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS v FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)
), again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY v) AS c FROM windows) WHERE c > 1),
edges AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true) AS new FROM again),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM edges) GROUP BY r, g),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS done FROM runs),
cut AS (
    SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
    FROM pieces JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": _JACCARD,
    "op4_substring_dedup": _SUBSTRINGS,
    "op6_mixing_sources": _MIXTURE,
    "op7_benchmark_decontamination": _CONTAMINATION,
    "op10_quality_rules": _QUALITY,
    "op12_merkle_manifest": _MANIFEST,
    "op13_suffix_array_dedup": _REPEATS,
}
