"""The registered queries as SQL for DuckDB, built from shared CTEs. Written
independently of the Spark plans: relational where those use array columns."""

from __future__ import annotations

from gistworks.functions.stopwords import ENGLISH
from gistworks.plans.views import BROKEN_STOPS, CITATIONS

# The cleaning patterns, as plain loops.
WS = (
    r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
NAME = "(?:[A-Z][A-Za-z''`-]+)"
YEAR = "(?:19|20)[0-9][0-9](?:, p.? [0-9]+)?"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(x: str, pattern: str, replacement: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {replacement}, 'g')"


def et_al(x: str) -> str:
    held = sub(x, r"(et al) \. ([A-Z][a-z])", r"concat('\1', chr(57344), '. \2')")
    return f"replace({sub(held, r'(et al) \. ', r"'\1'")}, chr(57344), ' ')"


def whitespace(x: str) -> str:
    return sub(x, WS, "' '")


def stop_space(x: str) -> str:
    return sub(x, r"\.([A-Z][a-z])", r"'. \1'")


def author_year(x: str) -> str:
    more = f"(?:,? (?:(?:and |& )?{NAME}|(?:et al.?)))"
    return sub(x, rf"{NAME}{more}*(?:, *{YEAR}| *\({YEAR}\))")


def bracket_single(x: str) -> str:
    return sub(x, r"\[[0-9]+(?:-[0-9]+)?\]")


def bracket_list(x: str) -> str:
    return sub(x, r"\[[0-9]+(?:,\s*[0-9]+)+\]")


def citations(x: str) -> str:
    return bracket_list(bracket_single(author_year(x)))


def clean(x: str) -> str:
    return citations(stop_space(whitespace(et_al(x))))


def cut_sentences(x: str) -> str:
    marked = sub(x, r"""([.!?]["'')\]]*) (["''(\[]*[A-ZÀ-ÖØ-Þ0-9])""", r"concat('\1', chr(10), '\2')")
    undone = sub(marked, r"""(^|[^\p{L}\p{N}_])(e\.g|i\.e|Fig|et al|Dr|vs)\.(["'')\]]*)\n""", r"'\1\2.\3 '")
    return (
        f"list_filter(list_transform(string_split({undone}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"
    )


def sentences(x: str) -> str:
    return cut_sentences(whitespace(x))


def paragraph_sentences(x: str) -> str:
    lines = (
        f"list_transform(list_transform(string_split({x}, chr(10)), lambda l: trim(l)), lambda l: "
        f"CASE WHEN l = '' OR (l = upper(l) AND l <> lower(l)) THEN chr(10) ELSE {whitespace('l')} END)"
    )
    return cut_sentences(f"array_to_string({lines}, ' ')")


def words(x: str) -> str:
    return f"list_filter(string_split({sub(f'lower({x})', '[^a-z0-9]+', chr(39) + ' ' + chr(39))}, ' '), lambda w: w <> '')"


def lcs(a: str, b: str) -> str:
    """LCS length of two lists of words, exact for any length: bit vectors of
    60 bits per block, carries passed from block to block."""
    blocks = f"range((len({a}) + 59) // 60)"
    full = f"((1::BIGINT << least(60, len({a}) - 60 * w)) - 1)"
    masks = (
        f"list_transform(list_filter({b}, lambda t: list_contains({a}, t)), lambda t: list_transform({blocks}, lambda w: "
        f"list_sum(list_transform(range(60), lambda i: CASE WHEN {a}[w * 60 + i + 1] = t THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT))"
    )
    total = "(p[1] + (p[1] & p[2]) + c[1])"
    step = (
        f"list_reduce(list_transform({blocks}, lambda w: [v[w + 1], k[w + 1], {full}]), "
        f"lambda c, p: list_concat([({total} >> 60)], c[2:], [(({total} | xor(p[1], p[1] & p[2])) & p[3])]), [0::BIGINT])[2:]"
    )
    start = f"list_transform({blocks}, lambda w: {full})"
    return (
        f"(len({a}) - list_sum(list_transform(list_reduce({masks}, lambda v, k: {step}, {start}), "
        f"lambda x: bit_count(x))))::INTEGER"
    )


def f_measure(hits: str, m: str, n: str) -> str:
    return f"CASE WHEN {hits} = 0 THEN 0::DOUBLE ELSE 2::DOUBLE * {hits} / ({m} + {n}) END"


ARTICLES = r"""articles AS (
  SELECT doc_id AS id, regexp_replace(text, '^[^\n]*\n?', '') AS article,
         string_split(text, chr(10))[1] AS lay_summary, [lang, source] AS keywords,
         list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')[1]) AS headings
  FROM documents)"""
CITED = ARTICLES + f""",
cited AS (
  SELECT id, concat(article, {q(CITATIONS)}, CASE WHEN id % 4 = 0 THEN {q(BROKEN_STOPS)} ELSE '' END) AS article,
         lay_summary FROM articles)"""

SPLIT = CITED + f""",
split AS (
  SELECT id, {sentences(clean('article'))} AS s, {clean('lay_summary')} AS lay FROM cited),
art AS (
  SELECT id, i::INTEGER - 1 AS sent_idx, s[i] AS sentence, {words('s[i]')} AS w
  FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM split)),
whole AS (SELECT id, {words('lay')} AS w FROM split),
lays AS (
  SELECT id, i::INTEGER - 1 AS lay_idx, s[i] AS sentence, {words('s[i]')} AS w
  FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {sentences('lay')} AS s FROM split)))"""


def scored(name: str, right: str, extra: str, where: str = "true") -> str:
    """CTE ``name``: ROUGE-L F of article sentences with the rows of ``right``;
    the shorter side carries the bits."""
    return f"""{name}_pairs AS MATERIALIZED (
  SELECT art.id, art.sent_idx{extra}, len(art.w) AS m, len(r.w) AS n,
         CASE WHEN len(art.w) <= len(r.w) THEN art.w ELSE r.w END AS a,
         CASE WHEN len(art.w) <= len(r.w) THEN r.w ELSE art.w END AS b
  FROM art JOIN {right} r USING (id) WHERE {where}),
{name}_hits AS MATERIALIZED (
  SELECT id, sent_idx{extra.replace('r.', '')}, m, n, {lcs('a', 'b')} AS hits FROM {name}_pairs WHERE list_has_any(a, b)
  UNION ALL
  SELECT id, sent_idx{extra.replace('r.', '')}, m, n, 0 FROM {name}_pairs WHERE NOT list_has_any(a, b)),
{name} AS (SELECT id, sent_idx{extra.replace('r.', '')}, hits, {f_measure('hits', 'm', 'n')} AS score FROM {name}_hits)"""


WHOLE_SCORES = scored("ws", "whole", "")
PAIR_SCORES = scored("ps", "lays", ", r.lay_idx")
RANKED = WHOLE_SCORES + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, sent_idx)::INTEGER AS rank FROM ws)"""


def best(scores: str) -> str:
    return f"""best AS (
  SELECT id, lay_idx, sent_idx, score FROM {scores}
  QUALIFY row_number() OVER (PARTITION BY id, lay_idx ORDER BY score DESC, sent_idx) = 1)"""


SELECTED = f"""{SPLIT},
{RANKED},
{scored('ps', 'lays', ', r.lay_idx', 'r.lay_idx < 10')},
{best('ps')},
chosen AS (SELECT id, sent_idx FROM ranked WHERE rank <= 10 UNION SELECT id, sent_idx FROM best),
pseudo AS (
  SELECT c.id, coalesce(p.article, '') AS article, c.lay_summary FROM cited c LEFT JOIN (
    SELECT id, string_agg(sentence, ' ' ORDER BY sent_idx) AS article FROM chosen JOIN art USING (id, sent_idx)
    GROUP BY id) p USING (id))"""

ORACLES: dict[str, str] = {
    "rouge_pseudo_summary": f"WITH {SELECTED} SELECT id, article, lay_summary FROM pseudo",
    "rouge_selected": f"WITH {SELECTED} SELECT id, sent_idx, sentence FROM chosen JOIN art USING (id, sent_idx)",
    "rougeL_sentence_scores": f"WITH {SPLIT}, {WHOLE_SCORES} SELECT id, sent_idx, score FROM ws",
    "rouge_rank": f"WITH {SPLIT}, {RANKED} SELECT id, sent_idx, score, rank FROM ranked",
    "rouge_topk": f"WITH {SPLIT}, {RANKED} SELECT id, sent_idx, score, rank FROM ranked WHERE rank <= 10",
    "rougeL_pair_scores": f"WITH {SPLIT}, {PAIR_SCORES} SELECT id, sent_idx, lay_idx, score FROM ps WHERE score > 0",
    "best_match": f"WITH {SPLIT}, {PAIR_SCORES}, {best('ps')} SELECT id, lay_idx, sent_idx, score FROM best",
}


def article_column(expression: str) -> str:
    return f"WITH {CITED} SELECT id, {expression} AS article FROM cited"


ORACLES |= {
    "clean_et_al": article_column(et_al("article")),
    "clean_whitespace": article_column(whitespace("article")),
    "clean_stop_space": article_column(stop_space("article")),
    "strip_author_year": article_column(author_year("article")),
    "strip_bracket_single": article_column(bracket_single("article")),
    "strip_bracket_list": article_column(bracket_list("article")),
    "preprocess": article_column(clean("article")),
    "remove_abstract": article_column("array_to_string(string_split(article, chr(10))[2:], chr(10))"),
    "sentences": f"WITH {SPLIT} SELECT id, sent_idx, sentence FROM art",
    "naive_sentences": r"""SELECT id, i::INTEGER - 1 AS sent_idx, s[i] AS sentence FROM (
        SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (
          SELECT doc_id AS id, string_split(array_to_string(string_split(text, chr(10))[2:], '.'), '.') AS s FROM documents))""",
    "rouge_tokens": f"""WITH {ARTICLES} SELECT id, side, i::INTEGER - 1 AS pos, w[i] AS token FROM (
        SELECT id, side, w, unnest(range(1, len(w) + 1)) AS i FROM (
          SELECT id, 'lay_summary' AS side, {words('lay_summary')} AS w FROM articles
          UNION ALL SELECT id, 'article', {words('article')} FROM articles))""",
    "char_lengths": f"""WITH {ARTICLES} SELECT id, length(article)::INTEGER AS article_chars,
        length(lay_summary)::INTEGER AS summary_chars FROM articles""",
    "headings_joined": f"""WITH {ARTICLES} SELECT id, array_to_string(headings, ', ') AS headings,
        array_to_string(keywords, ', ') AS keywords FROM articles""",
    "prompt_build": f"""WITH {ARTICLES} SELECT id, concat('Simplify: ', article, ' TL;DR: ') AS prompt,
        string_split(concat('Simplify: ', article, ' TL;DR: ', lay_summary), ' TL;DR: ')[2] AS completion FROM articles""",
    "jsonl_roundtrip": f"""WITH {ARTICLES} SELECT id::VARCHAR AS id, article, lay_summary,
        array_to_string(headings, '|') AS headings, array_to_string(keywords, '|') AS keywords FROM articles""",
    "csv_roundtrip": """SELECT doc_id::VARCHAR AS id, 0 AS sent_idx, text AS sentence, quality AS label
        FROM documents JOIN labels USING (doc_id)""",
    "scan_limit": f"WITH {ARTICLES} SELECT id, article, lay_summary FROM articles ORDER BY id LIMIT 10",
    "point_lookup": "SELECT doc_id AS id, string_split(text, chr(10))[1] AS lay_summary FROM documents WHERE doc_id = 7",
}

DIALOGUES = """dialogues AS (
  SELECT concat(u.conv_id, '-', u.turn) AS id, u.text AS article, a.text AS lay_summary
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
ORACLES["multi_source_union"] = f"""WITH {ARTICLES}, {DIALOGUES}
  SELECT id::VARCHAR AS id, 'documents' AS corpus, 'train' AS split, article, lay_summary FROM articles
  UNION ALL SELECT id, 'dialogues', 'val', article, lay_summary FROM dialogues"""

PLAIN = f"""plain AS (SELECT id, {sentences(clean('article'))} AS s FROM articles)"""
PSEUDO_SPLIT = f"""{SELECTED},
{PLAIN},
pseudo_s AS (SELECT id, {sentences(clean('article'))} AS s FROM pseudo),
marked AS (
  SELECT art.id, sent_idx, sentence, list_contains(pseudo_s.s, sentence)::INTEGER AS label FROM art JOIN pseudo_s USING (id))"""
ORACLES |= {
    "pseudo_article_join": f"""WITH {SELECTED} SELECT p.id, p.article, p.lay_summary, c.article AS article_whole
        FROM pseudo p JOIN cited c USING (id)""",
    "binary_labels": f"WITH {PSEUDO_SPLIT} SELECT id, sent_idx, sentence, label FROM marked",
    "consistency_check": f"""WITH {PSEUDO_SPLIT} SELECT id, i::INTEGER - 1 AS sent_idx, t[i] AS sentence FROM (
        SELECT id, t, s, unnest(range(1, len(t) + 1)) AS i FROM (
          SELECT p.id, p.s AS t, a.s FROM pseudo_s p JOIN plain a USING (id)))
        WHERE NOT list_contains(s, t[i])""",
    "sentence_counts": f"""WITH {PSEUDO_SPLIT} SELECT p.id, len(p.s)::INTEGER AS pseudo_sentences,
        len(w.s)::INTEGER AS article_sentences FROM pseudo_s p JOIN split w USING (id)""",
    "label_counts": f"WITH {PSEUDO_SPLIT} SELECT label, count(*) AS rows FROM marked GROUP BY label",
    "class_encode": """SELECT vec_id, (label * 3)::VARCHAR AS label, (dense_rank() OVER (ORDER BY label))::INTEGER - 1 AS class_id
        FROM embeddings""",
    "head_fraction": """SELECT doc_id AS id, n_chars FROM documents
        QUALIFY row_number() OVER (ORDER BY doc_id) <= count(*) OVER () // 3""",
    "sample_n": "SELECT doc_id AS id, n_chars FROM documents ORDER BY md5(concat('42-', doc_id)) LIMIT 100",
    "balance_classes": """SELECT doc_id AS id, 1 - quality AS label FROM labels
        QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', doc_id)))
          <= count_if(quality = 0) OVER ()""",
    "stratified_split": """SELECT id, label, CASE WHEN r <= ceil(ceil(n * 0.2) / 2) THEN 'validation'
          WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT doc_id AS id, quality AS label, count(*) OVER (PARTITION BY quality) AS n,
          row_number() OVER (PARTITION BY quality ORDER BY md5(concat('42-', doc_id))) AS r FROM labels)""",
    "train_eval_split": """SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42-', id))) <= 20 THEN 'eval' ELSE 'train' END AS split
        FROM (SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 100)""",
}


def n_words(x: str) -> str:
    return f"len({words(x)})"


def histogram(values: str) -> str:
    """The last CTEs and the result: ten equal bins over ``v`` of a query."""
    return f"""v AS MATERIALIZED ({values}),
e AS (SELECT CASE WHEN max(v) = min(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN max(v) = min(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
b AS (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM v, e GROUP BY bin)
SELECT r.bin::INTEGER AS bin, round(lo + (hi - lo) / 10 * r.bin, 6) AS low, round(lo + (hi - lo) / 10 * (r.bin + 1), 6) AS high,
  coalesce(n, 0) AS rows FROM (SELECT unnest(range(10)) AS bin) r CROSS JOIN e LEFT JOIN b ON b.bin = r.bin"""


def word_list(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*')"


def readability(source: str, column: str, keys: str) -> str:
    """CTE ``readable``: the three scores of a text column."""
    return rf"""counted AS (
  SELECT {keys}, {column} AS t, list_transform({word_list(column)}, lambda w: greatest(1,
      len(regexp_extract_all(w, '[aeiouy]+')) - regexp_matches(w, '[^aeiouy]e$')::INTEGER)) AS y,
    length(regexp_replace({column}, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS letters, len({sentences(column)}) AS sents
  FROM {source}),
measured AS (
  SELECT {keys}, t, letters, sents, len(y)::DOUBLE AS w, list_sum(y) AS syll, len(list_filter(y, lambda s: s >= 3)) AS hard FROM counted),
readable AS (
  SELECT {keys}, t,
    CASE WHEN w > 0 AND sents > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * w / sents - 84.6::DOUBLE * syll / w, 6) END AS flesch_kincaid_reading_score,
    CASE WHEN w > 0 AND sents > 0 THEN round(4.71::DOUBLE * letters / w + 0.5::DOUBLE * w / sents - 21.43::DOUBLE, 6) END AS ari_score,
    CASE WHEN w > 0 AND sents > 0 THEN round(0.4::DOUBLE * (w / sents + 100.0::DOUBLE * hard / w), 6) END AS gunning_fog_score
  FROM measured)"""


SCORES = ("flesch_kincaid_reading_score", "ari_score", "gunning_fog_score")
EXTRACTIVE = "extractive AS (SELECT id, 'extractive' AS system, article AS candidate, lay_summary AS target FROM pseudo)"
TALK = f"""{DIALOGUES}, talk AS (
  SELECT id, 'question' AS system, article AS candidate, lay_summary AS target FROM dialogues
  UNION ALL SELECT id, 'reply', lay_summary, lay_summary FROM dialogues)"""


def rouge(source: str, orders: str = "12L") -> str:
    """CTE ``rouge``: hits and sizes of ROUGE-1, -2 and -L per pair."""
    parts = []
    for n in (1, 2):
        gram = "w[i]" if n == 1 else "concat(w[i], ' ', w[i + 1])"
        for side in ("c", "t"):
            parts.append(f"""{side}{n} AS (
  SELECT id, system, {gram} AS g, count(*) AS k FROM (
    SELECT id, system, {side} AS w, unnest(range(1, len({side}) + {2 - n})) AS i FROM pairs) GROUP BY ALL)""")
        parts.append(f"""h{n} AS (
  SELECT id, system, sum(least(c{n}.k, t{n}.k)) AS h FROM c{n} JOIN t{n} USING (id, system, g) GROUP BY ALL)""")
    lcs_hits = f"CASE WHEN list_has_any(c, t) THEN {lcs('a', 'b')} ELSE 0 END" if "L" in orders else "0"
    return f"""pairs AS MATERIALIZED (
  SELECT id, system, c, t, CASE WHEN len(c) <= len(t) THEN c ELSE t END AS a, CASE WHEN len(c) <= len(t) THEN t ELSE c END AS b
  FROM (SELECT id, system, {words('candidate')} AS c, {words('target')} AS t FROM {source})),
{', '.join(parts)},
rouge AS MATERIALIZED (
  SELECT p.id, p.system, len(c) AS c1, len(t) AS t1, greatest(len(c) - 1, 0) AS c2, greatest(len(t) - 1, 0) AS t2,
    coalesce(h1.h, 0) AS h1, coalesce(h2.h, 0) AS h2, {lcs_hits} AS hl
  FROM pairs p LEFT JOIN h1 USING (id, system) LEFT JOIN h2 USING (id, system))"""


def prf(h: str, c: str, t: str) -> str:
    return f"""CASE WHEN {c} = 0 THEN 0::DOUBLE ELSE {h}::DOUBLE / {c} END AS precision,
      CASE WHEN {t} = 0 THEN 0::DOUBLE ELSE {h}::DOUBLE / {t} END AS recall, {f_measure(h, c, t)} AS fmeasure"""


MEANS = f"""round(avg({f_measure('h1', 'c1', 't1')}), 6) AS rouge1_f, round(avg({f_measure('h2', 'c2', 't2')}), 6) AS rouge2_f,
    round(avg({f_measure('hl', 'c1', 't1')}), 6) AS rougeL_f"""
CONFUSION = """confusion AS (SELECT count_if(quality <> 0 AND toxic <> 0) AS tn, count_if(quality <> 0 AND toxic = 0) AS fp,
  count_if(quality = 0 AND toxic <> 0) AS fn, count_if(quality = 0 AND toxic = 0) AS tp FROM labels)"""

ORACLES |= {
    "keyword_counts": """SELECT keyword, count(*) AS articles FROM (SELECT unnest([lang, source]) AS keyword FROM documents)
        GROUP BY keyword""",
    "token_lengths": f"WITH {ARTICLES} SELECT id, {n_words('article')}::INTEGER AS tokens FROM articles",
    "avg_token_length": f"WITH {ARTICLES} SELECT round(avg({n_words('article')}), 6) AS avg_tokens FROM articles",
    "length_histogram": f"WITH {ARTICLES}, {histogram('SELECT ' + n_words('lay_summary') + '::DOUBLE AS v FROM articles')}",
    "article_length_histogram": f"WITH {ARTICLES}, {histogram('SELECT ' + n_words('article') + '::DOUBLE AS v FROM articles')}",
    "sentence_score_histogram": f"WITH {SPLIT}, {WHOLE_SCORES}, {histogram('SELECT score AS v FROM ws')}",
    "summary_length_quantiles": f"""WITH {ARTICLES}, n AS (SELECT len({sentences('lay_summary')}) AS n FROM articles)
        SELECT quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.75)::DOUBLE AS p75,
          quantile_cont(n, 0.9)::DOUBLE AS p90 FROM n""",
    "corpus_stats": f"""WITH {ARTICLES}, {readability('articles', 'article', 'id, lay_summary')}
        SELECT count(*) AS articles, round(avg(length(t)), 6) AS avg_article_chars, round(avg({n_words('t')}), 6) AS avg_article_tokens,
          round(avg({n_words('lay_summary')}), 6) AS avg_summary_tokens, round(avg(len({sentences('t')})), 6) AS avg_article_sentences,
          round(avg(flesch_kincaid_reading_score), 6) AS avg_reading_ease FROM readable""",
    "rouge2_macro": f"""WITH {SELECTED}, {EXTRACTIVE}, {rouge('extractive', '2')} SELECT round(avg(precision), 4) AS rouge2_precision,
        round(avg(recall), 4) AS rouge2_recall, round(avg(fmeasure), 4) AS rouge2_fmeasure
        FROM (SELECT {prf('h2', 'c2', 't2')} FROM rouge)""",
    "rouge_report": f"""WITH {TALK}, {rouge('talk')} SELECT system, {MEANS},
        (SELECT round(avg((candidate = target)::INTEGER), 6) FROM talk t WHERE t.system = rouge.system) AS accuracy
        FROM rouge GROUP BY system""",
    "confusion_matrix": f"WITH {CONFUSION} SELECT tn, fp, fn, tp FROM confusion",
    "binary_metrics": f"""WITH {CONFUSION}, r AS (SELECT coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
          coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM confusion)
        SELECT round(accuracy, 6) AS accuracy, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
          round(p, 6) AS precision, round(r, 6) AS recall FROM r""",
    "readability": f"WITH {ARTICLES}, {readability('articles', 'article', 'id')} SELECT id, {', '.join(SCORES)} FROM readable",
    "softmax_probs": """SELECT vec_id, i::INTEGER - 1 AS class_id, round(e[i] / list_sum(e), 6) AS p FROM (
        SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM (
          SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings))""",
    "argmax_label": "SELECT vec_id, list_position(embedding, list_max(embedding))::INTEGER - 1 AS class_id FROM embeddings",
    "threshold_topk": f"""WITH {SPLIT}, logits AS (
          SELECT id, sent_idx, sentence, ('0x' || md5(concat(id, '-', sent_idx))[1])::INTEGER / 4::DOUBLE - 2 AS k FROM art)
        SELECT id, sent_idx, sentence, round(exp(k - greatest(0, k)) / (exp(0 - greatest(0, k)) + exp(k - greatest(0, k))), 9) AS p1
        FROM logits WHERE p1 >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p1 DESC, sent_idx) <= 25""",
}

VOCABULARY = f"""{ARTICLES},
enc AS (SELECT id, lay_summary, {words('article')}[1:512] AS a, {words('lay_summary')}[1:128] AS l,
  {words('article')} AS aw, {words('lay_summary')} AS lw FROM articles),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token))::INTEGER + 1 AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(list_concat(aw, lw)) AS token FROM enc) GROUP BY token))"""


def ids(side: str) -> str:
    return f"""{side}_ids AS (
  SELECT id, list(coalesce(token_id, 1) ORDER BY i) AS v FROM (
    SELECT id, {side}[i] AS token, i FROM (SELECT id, {side}, unnest(range(1, len({side}) + 1)) AS i FROM enc))
  LEFT JOIN vocab USING (token) GROUP BY id)"""


INPUTS = f"""{VOCABULARY}, {ids('a')}, {ids('l')},
batch AS (SELECT enc.id, coalesce(a_ids.v, []) AS a, coalesce(l_ids.v, []) AS l
  FROM enc LEFT JOIN a_ids USING (id) LEFT JOIN l_ids USING (id))"""


def filled(x: str, length: str, value: str) -> str:
    return f"list_concat({x}, list_transform(range({length}), lambda j: {value}))"


ORACLES |= {
    "model_inputs": f"""WITH {INPUTS} SELECT id,
        CASE WHEN ('0x' || substr(md5(id::VARCHAR), 1, 4))::INTEGER % 5 = 0 THEN 'val' ELSE 'train' END AS split,
        array_to_string({filled('a', '512 - len(a)', '0')}, ' ') AS input_ids,
        array_to_string({filled('list_transform(a, lambda j: 1)', '512 - len(a)', '0')}, ' ') AS attention_mask,
        array_to_string({filled('[1]', '511', '0')}, ' ') AS global_attention_mask,
        array_to_string({filled('l', '128 - len(l)', '-100')}, ' ') AS labels FROM batch""",
    "label_mask": f"""WITH {INPUTS} SELECT id, i::INTEGER - 1 AS pos, CASE WHEN i <= len(l) THEN l[i] ELSE -100 END AS label
        FROM (SELECT id, l, unnest(range(1, 129)) AS i FROM batch)""",
    "decode_labels": f"""WITH {VOCABULARY} SELECT enc.id, coalesce(t.text, '') AS text FROM enc LEFT JOIN (
        SELECT id, string_agg(token, ' ' ORDER BY i) AS text FROM (
          SELECT id, l[i] AS token, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM enc))
        JOIN vocab USING (token) GROUP BY id) t USING (id)""",
}

def stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in ENGLISH) + "]"


def lexrank(stop: bool = True) -> str:
    """CTEs of LexRank over all sentence pairs, up to the transition table."""
    return f"{ARTICLES},\n{lexrank_core(stop)}"


def lexrank_core(stop: bool = True) -> str:
    kept = f"list_contains({stop_list()}, term)" if stop else "false"
    return rf"""lx AS (SELECT id, i::INTEGER - 1 AS sent_idx, s[i] AS sentence, len(s) AS n,
    list_filter(string_split_regex(lower(s[i]), '[^\p{{L}}\p{{N}}_''-]+'), lambda w: regexp_matches(w, '^\p{{L}}[\p{{L}}''-]*$')) AS w
  FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {paragraph_sentences('article')} AS s FROM articles))),
cnt AS (SELECT id, sent_idx, n, term, count(*) AS c FROM (SELECT id, sent_idx, n, unnest(w) AS term FROM lx)
  WHERE NOT {kept} GROUP BY ALL),
tf AS (SELECT *, c / max(c) OVER (PARTITION BY id, sent_idx)::DOUBLE AS tf, ln(n::DOUBLE / (1 + count(*) OVER (PARTITION BY id, term))) AS idf FROM cnt),
wt AS (SELECT id, sent_idx, term, w / norm AS w FROM (
  SELECT id, sent_idx, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id, sent_idx)) AS norm FROM tf) WHERE norm > 0),
sim AS MATERIALIZED (SELECT a.id, a.sent_idx AS i, b.sent_idx AS j, round(sum(a.w * b.w), 9) AS s
  FROM wt a JOIN wt b USING (id, term) GROUP BY ALL HAVING round(sum(a.w * b.w), 9) > 0.1),
deg AS (SELECT id, i, count(*) AS degree FROM sim GROUP BY ALL),
bag AS (SELECT l.id, l.sent_idx, min(l.sent_idx) OVER (PARTITION BY l.id, b) AS node, count(*) OVER (PARTITION BY l.id, b) AS m
  FROM (SELECT id, sent_idx, list_sort(list_filter(w, lambda term: NOT {kept})) AS b FROM lx) l)"""


def lexrank_rounds() -> str:
    """Power steps until all documents stand still; one that does leaves."""
    return """pw AS (
  SELECT id, sent_idx, 1 / n::DOUBLE AS s, false AS done FROM lx
  UNION ALL
  SELECT id, sent_idx, s, round(sqrt(sum((s - old) ** 2) OVER (PARTITION BY id)), 9) <= 0.1 FROM (
    SELECT p.id, p.sent_idx, p.s AS old, coalesce(sum(q.s / deg.degree), 0) AS s
    FROM pw p LEFT JOIN sim ON sim.id = p.id AND sim.j = p.sent_idx
      LEFT JOIN deg ON deg.id = p.id AND deg.i = sim.i LEFT JOIN pw q ON q.id = p.id AND q.sent_idx = sim.i
    WHERE NOT p.done GROUP BY ALL)),
lex_scores AS MATERIALIZED (SELECT id, sent_idx, round(s, 9) AS score FROM pw WHERE done),
lex_top AS (SELECT id, sent_idx, sentence, row_number() OVER (PARTITION BY id ORDER BY score DESC, sent_idx) AS rank
  FROM lex_scores JOIN lx USING (id, sent_idx))"""


NODES = """nodes AS (
  SELECT id, node, any_value(m) AS m, string_agg(sent_idx::VARCHAR, ' ' ORDER BY sent_idx) AS sents FROM bag GROUP BY id, node)"""
LEX_SUMMARIES = """lex_summaries AS (
  SELECT a.id, coalesce(t.article, '') AS article, a.lay_summary
  FROM articles a LEFT JOIN (SELECT id, string_agg(sentence, ' ' ORDER BY sent_idx) AS article FROM lex_top
    WHERE rank <= 25 GROUP BY id) t USING (id))"""

ORACLES |= {
    "lexrank_tf": f"WITH {lexrank()} SELECT id, sent_idx, term, round(tf, 6) AS tf FROM tf",
    "lexrank_idf": f"WITH {lexrank()} SELECT DISTINCT id, term, round(idf, 6) AS idf FROM tf",
    "lexrank_similarity": f"""WITH {lexrank()}, {NODES} SELECT id, i, j, a.m::INTEGER AS m_i, b.m::INTEGER AS m_j, round(s, 6) AS similarity,
        a.sents AS sents_i, b.sents AS sents_j
        FROM sim JOIN nodes a USING (id) JOIN nodes b USING (id) WHERE i < j AND a.node = i AND b.node = j""",
    "lexrank_edges": f"""WITH {lexrank()}, {NODES} SELECT id, i AS src, j AS dst, degree, round(a.m / degree::DOUBLE, 6) AS share,
        a.sents AS sents_src, b.sents AS sents_dst
        FROM sim JOIN deg USING (id, i) JOIN nodes a USING (id) JOIN nodes b USING (id) WHERE a.node = i AND b.node = j""",
    "lexrank_scores": f"WITH RECURSIVE {lexrank()}, {lexrank_rounds()} SELECT id, sent_idx, round(score, 6) AS score FROM lex_scores",
    "lexrank_summary": f"WITH RECURSIVE {lexrank()}, {lexrank_rounds()}, {LEX_SUMMARIES} SELECT id, article, lay_summary FROM lex_summaries",
    "lexrank_batch": f"""WITH RECURSIVE {lexrank(False)}, {lexrank_rounds()} SELECT id, sentence,
        (row_number() OVER (PARTITION BY id ORDER BY sent_idx))::INTEGER - 1 AS pos FROM lex_top WHERE rank <= 130""",
}

def background(edge: str) -> str:
    """CTEs of the background variant over all sentence pairs; ``edge`` is the
    condition on the rounded similarity ``s``. The smallest sentence spreads
    along the edges until no label of a document changes."""
    steps = """lb AS (
  SELECT id, sent_idx, sent_idx AS label, false AS still FROM nx
  UNION ALL
  SELECT id, sent_idx, low, NOT bool_or(low < label) OVER (PARTITION BY id) FROM (
    SELECT l.id, l.sent_idx, l.label, least(l.label, coalesce(min(q.label), l.label)) AS low FROM lb l
    LEFT JOIN e ON e.id = l.id AND e.j = l.sent_idx LEFT JOIN lb q ON q.id = e.id AND q.sent_idx = e.i
    WHERE NOT l.still GROUP BY l.id, l.sent_idx, l.label)),
labelled AS MATERIALIZED (SELECT id, sent_idx, label FROM lb WHERE still)"""
    return f"""{ARTICLES},
nx AS (SELECT id, i::INTEGER - 1 AS sent_idx, s[i] AS sentence, {words('s[i]')} AS w FROM (
  SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT id, string_split(array_to_string(string_split(article, chr(10))[2:], '.'), '.') AS s FROM articles))),
bg AS (SELECT list_distinct({words('lay_summary')}) AS w FROM articles WHERE len({words('lay_summary')}) > 0),
idf AS (SELECT term, ln((SELECT count(*) FROM bg)::DOUBLE / count(*)) AS idf FROM (SELECT unnest(w) AS term FROM bg) GROUP BY term),
cw AS (SELECT id, sent_idx, term, count(*) * coalesce(any_value(idf), ln((SELECT count(*) FROM bg)::DOUBLE + 1)) AS w
  FROM (SELECT id, sent_idx, unnest(w) AS term FROM nx) LEFT JOIN idf USING (term) GROUP BY ALL),
uw AS (SELECT id, sent_idx, term, w / norm AS w FROM (
  SELECT *, sqrt(sum(w ** 2) OVER (PARTITION BY id, sent_idx)) AS norm FROM cw) WHERE norm > 0 AND w <> 0),
sim AS MATERIALIZED (SELECT a.id, a.sent_idx AS i, b.sent_idx AS j, round(sum(a.w * b.w), 9) AS s, sum(a.w * b.w) AS exact
  FROM uw a JOIN uw b USING (id, term) GROUP BY ALL),
e AS (SELECT * FROM sim WHERE {edge}),
{steps},
dg AS (SELECT id, i AS sent_idx, count(*) AS degree, sum(exact) AS strength FROM e GROUP BY ALL)"""


def stationary(degree: str) -> str:
    return f"""bg_scores AS (
  SELECT id, sent_idx, coalesce(round({degree} * count({degree}) OVER c / sum({degree}) OVER c, 9), 1::DOUBLE) AS score
  FROM nx LEFT JOIN dg USING (id, sent_idx) JOIN labelled USING (id, sent_idx) WINDOW c AS (PARTITION BY id, label))"""


ORACLES |= {
    "lexrank_background": f"""WITH RECURSIVE {background('s >= 0.1')}, {stationary('degree')}
        SELECT id, sentence, r::INTEGER - 1 AS pos FROM (
          SELECT id, sentence, row_number() OVER (PARTITION BY id ORDER BY score DESC, sent_idx) AS r
          FROM bg_scores JOIN nx USING (id, sent_idx)) WHERE r <= 10""",
    "lexrank_continuous": f"""WITH RECURSIVE {background('true')}, {stationary('strength')}
        SELECT id, sent_idx, round(score, 6) AS score FROM bg_scores""",
}

BOTH = f"""RECURSIVE {SELECTED}, {EXTRACTIVE}, {lexrank_core()}, {lexrank_rounds()}, {LEX_SUMMARIES},
systems AS MATERIALIZED (
  SELECT * FROM extractive UNION ALL SELECT id, 'lexrank', article, lay_summary FROM lex_summaries)"""

ORACLES |= {
    "rouge1": f"WITH {BOTH}, {rouge('systems', '1')} SELECT id, system, {prf('h1', 'c1', 't1')} FROM rouge",
    "rouge2": f"WITH {BOTH}, {rouge('systems', '2')} SELECT id, system, {prf('h2', 'c2', 't2')} FROM rouge",
    "rougeL": f"WITH {BOTH}, {rouge('systems')} SELECT id, system, {prf('hl', 'c1', 't1')} FROM rouge",
    "rouge_by_system": f"""WITH {BOTH}, {rouge('systems')} SELECT system, {MEANS},
        (SELECT round(avg((candidate = target)::INTEGER), 6) FROM systems t WHERE t.system = rouge.system) AS accuracy
        FROM rouge GROUP BY system""",
    "exact_match": f"WITH {BOTH} SELECT round(avg((candidate = target)::INTEGER), 6) AS accuracy FROM systems",
    "readability_guarded": f"""WITH {BOTH}, shown AS (SELECT id, 'lay_summary' AS system, lay_summary AS candidate FROM articles
          UNION ALL SELECT id, system, candidate FROM systems), {readability('shown', 'candidate', 'id, system')}
        SELECT id, system, {', '.join(f"CASE WHEN len(string_split(t, ' ')) > 120 THEN coalesce({c}, 0) ELSE 0::DOUBLE END AS {c}" for c in SCORES)}
        FROM readable""",
    "readability_macro": f"""WITH {BOTH}, {readability('systems', 'candidate', 'id, system')}
        SELECT system, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SCORES)} FROM readable GROUP BY system""",
}

SMOOTHING, PENALTIES, STEPS = (1.0, 0.1), (0.1, 1.0, 10.0), 4


def _steps() -> str:
    """The steps of the logistic regressions, a set of CTEs for each."""
    ks = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(PENALTIES))
    out = [f"penalties AS (SELECT * FROM (VALUES {ks}) v(k, penalty))", "st0 AS (SELECT k, term, 0::DOUBLE AS w, 0::DOUBLE AS g FROM penalties, (SELECT term FROM seen UNION ALL SELECT ''))"]
    for t in range(STEPS):
        out.append(f"""er{t} AS MATERIALIZED (
  SELECT c.k, e.r, 1 / (1 + exp(-(c.w + coalesce(z, 0)))) - label AS err FROM ex e CROSS JOIN (SELECT k, w FROM st{t} WHERE term = '') c
  LEFT JOIN (SELECT k, r, sum(x * w) AS z FROM xs JOIN st{t} USING (term) GROUP BY k, r) m ON m.k = c.k AND m.r = e.r)""")
        out.append(f"""st{t + 1} AS MATERIALIZED (
  SELECT k, term, round(w - d / (sqrt(g + d * d) + 0.001), 9) AS w, g + d * d AS g FROM (
    SELECT k, term, w, g, round(s + CASE WHEN term = '' THEN 0 ELSE penalty * w END, 9) AS d FROM st{t} JOIN penalties USING (k) JOIN (
      SELECT k, term, sum(x * err) AS s FROM xs JOIN er{t} USING (r) GROUP BY k, term UNION ALL SELECT k, '', sum(err) FROM er{t} GROUP BY k) USING (k, term)))""")
    return ",\n".join(out)


LINEAR = f"""{PSEUDO_SPLIT},
balanced AS (SELECT *, md5(concat('42-', id, '-', sent_idx)) AS k FROM marked
  QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY k) <= count_if(label = 1) OVER ()),
parted AS MATERIALIZED (SELECT row_number() OVER () AS r, id, sent_idx, label, {words('sentence')} AS w, CASE WHEN r <= ceil(ceil(n * 0.2) / 2) THEN 'validation'
    WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY k) AS r FROM balanced)),
ex AS MATERIALIZED (SELECT r, label, w FROM parted WHERE split = 'train'),
xs AS MATERIALIZED (SELECT r, term, c / sqrt(sum(c * c) OVER (PARTITION BY r)) AS x FROM (
  SELECT r, term, count(*)::DOUBLE AS c FROM (SELECT r, unnest(w) AS term FROM ex) GROUP BY r, term)),
seen AS MATERIALIZED (SELECT term, count_if(label = 1) AS n1, count_if(label = 0) AS n0 FROM (
  SELECT label, unnest(w) AS term FROM ex) GROUP BY term),
{_steps()},
candidates AS MATERIALIZED (
  SELECT 'bayes' AS kind, s AS parameter, i AS nth, false AS unit, term,
    ln(n1 + s) - ln(sum(n1) OVER (PARTITION BY i) + s * count(*) OVER (PARTITION BY i)) - ln(n0 + s) + ln(sum(n0) OVER (PARTITION BY i) + s * count(*) OVER (PARTITION BY i)) AS w
  FROM seen, (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x in enumerate(SMOOTHING))}) v(i, s)
  UNION ALL SELECT 'bayes', s, i, false, '', ln(count_if(label = 1) + s) - ln(count_if(label = 0) + s)
  FROM ex, (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x in enumerate(SMOOTHING))}) v(i, s) GROUP BY s, i
  UNION ALL SELECT 'logistic', penalty, k + {len(SMOOTHING)}, true, term, w FROM st{STEPS} JOIN penalties USING (k)),
held AS (SELECT r, label, w FROM parted WHERE split = 'validation'),
tried AS MATERIALIZED (
  SELECT kind, parameter, nth, unit, avg(((m > 0)::INT = label)::INT) AS accuracy FROM (
    SELECT kind, parameter, c.nth, c.unit, label, c.w + coalesce(z, 0) AS m FROM held CROSS JOIN (SELECT * FROM candidates WHERE term = '') c
    LEFT JOIN (SELECT nth, r, sum(w * CASE WHEN unit THEN x ELSE n END) AS z FROM (
      SELECT r, term, n, n / sqrt(sum(n * n) OVER (PARTITION BY r)) AS x FROM (SELECT r, term, count(*)::DOUBLE AS n FROM (SELECT r, unnest(w) AS term FROM held) GROUP BY r, term))
      JOIN candidates USING (term) GROUP BY nth, r) z ON z.nth = c.nth AND z.r = held.r) GROUP BY ALL),
winner AS (SELECT * FROM tried ORDER BY accuracy DESC, nth LIMIT 1),
known AS MATERIALIZED (SELECT term, w AS d, unit FROM candidates JOIN (SELECT nth FROM winner) USING (nth))"""


def judged(source: str) -> str:
    """CTE ``judged``: the probability of class 1 of sentences with words ``w``."""
    return f"""judged AS (
  SELECT r.id, r.sent_idx, b.d + coalesce(z, 0) AS margin, round(1 / (1 + exp(-margin)), 9) AS p1
  FROM {source} r CROSS JOIN (SELECT d FROM known WHERE term = '') b LEFT JOIN (
    SELECT id, sent_idx, sum(d * CASE WHEN unit THEN x ELSE n END) AS z FROM (
      SELECT id, sent_idx, term, n, n / sqrt(sum(n * n) OVER (PARTITION BY id, sent_idx)) AS x FROM (
        SELECT id, sent_idx, term, count(*)::DOUBLE AS n FROM (SELECT id, sent_idx, unnest(w) AS term FROM {source}) GROUP BY ALL))
    JOIN known USING (term) GROUP BY id, sent_idx) m ON m.id = r.id AND m.sent_idx = r.sent_idx)"""


def chosen_sentences(top: int) -> str:
    return f"""{LINEAR}, {judged('art')},
taken AS (SELECT id, string_agg(sentence, ' ' ORDER BY sent_idx) AS summary FROM (
  SELECT j.id, j.sent_idx, sentence FROM judged j JOIN art USING (id, sent_idx) WHERE p1 >= 0.5
  QUALIFY row_number() OVER (PARTITION BY j.id ORDER BY p1 DESC, j.sent_idx) <= {top}) GROUP BY id)"""


ORACLES |= {
    "extractor_train": f"""WITH {LINEAR}, {judged("(SELECT * FROM parted WHERE split = 'test')")},
        confusion AS (SELECT count_if(label <> 0 AND margin > 0) AS tn, count_if(label <> 0 AND margin <= 0) AS fp,
          count_if(label = 0 AND margin > 0) AS fn, count_if(label = 0 AND margin <= 0) AS tp FROM judged JOIN parted USING (id, sent_idx)),
        r AS (SELECT coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
          coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM confusion)
        SELECT round(accuracy, 6) AS accuracy, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
          round(p, 6) AS precision, round(r, 6) AS recall, (SELECT kind FROM winner) AS kind, (SELECT parameter FROM winner) AS parameter FROM r""",
    "extractor_candidates": f"WITH {LINEAR} SELECT kind, parameter, round(accuracy, 6) AS accuracy, nth = (SELECT nth FROM winner) AS chosen FROM tried",
    "extractive_summary": f"WITH {chosen_sentences(25)} SELECT id, coalesce(summary, '') AS summary FROM cited LEFT JOIN taken USING (id)",
    "extractive_summary_clean": f"""WITH {chosen_sentences(10)} SELECT id, {citations("coalesce(summary, '')")} AS summary
        FROM cited LEFT JOIN taken USING (id)""",
}


# --- sentence boundaries learned from the corpus -----------------------------

_FIRST = r"""regexp_replace(tk, '^["''(\[]+', '')"""
_CORE = rf"""regexp_replace({_FIRST}, '["''\)\],;:]+$', '')"""


def _times_log(times: str, value: str) -> str:
    return f"CASE WHEN {times} = 0 THEN 0::DOUBLE ELSE ({times}) * ln({value}) END"


def _likelihood(a: str, b: str, both: str, n: str) -> str:
    """The log-likelihood ratio of two events that coincide ``both`` times."""
    p, rest = f"({b}) / ({n})", f"({n} - {a} - {b} + {both})"
    chance = " + ".join([_times_log(both, p), _times_log(f"({a} - {both})", f"1 - {p}"), _times_log(f"({b} - {both})", p), _times_log(rest, f"1 - {p}")])
    one, two = f"({both}) / ({a})", f"({b} - {both}) / ({n} - {a})"
    first = f"CASE WHEN {both} = {a} THEN 0 ELSE {_times_log(both, one)} + {_times_log(f'({a} - {both})', f'1 - {one}')} END"
    second = f"CASE WHEN {b} = {both} OR {rest} = 0 THEN 0 ELSE {_times_log(f'({b} - {both})', two)} + {_times_log(rest, f'1 - {two}')} END"
    return f"round(-2 * ({chance} - ({first}) - ({second})), 9)"


BOUNDARIES = CITED + rf""",
tk AS (SELECT r, id, unnest(t) AS tk, unnest(range(len(t))) AS i FROM (
  SELECT row_number() OVER () AS r, id, list_filter(string_split({whitespace('article')}, ' '), lambda w: w <> '') AS t FROM cited)),
cores AS (SELECT *, {_CORE} AS core, {_FIRST}[1] AS c, regexp_matches(tk, '[.!?]["'')\]]*$') AS final FROM tk),
typed AS (SELECT *, lower(regexp_replace(core, '[.!?]+$', '')) AS word, regexp_matches(core, '\.\.+$') AS dots FROM cores),
ds AS MATERIALIZED (
  SELECT r, id, i, tk, CASE WHEN regexp_matches(word, '^-?[.,]?[0-9][0-9,.-]*$') THEN '##number##' ELSE word END AS type,
         ends_with(core, '.') AND NOT dots AS stopped,
         CASE WHEN NOT final THEN '' WHEN dots THEN 'dots' WHEN ends_with(core, '.') THEN 'stop' ELSE 'mark' END AS e,
         CASE WHEN regexp_matches(c, '^\p{{Lu}}') THEN 'upper' WHEN regexp_matches(c, '^\p{{Ll}}') THEN 'lower' ELSE 'none' END AS cs
  FROM typed),
counts AS MATERIALIZED (SELECT type, count(*)::DOUBLE AS n, count(*) FILTER (WHERE stopped)::DOUBLE AS s FROM ds GROUP BY type),
tot AS (SELECT sum(n) AS aw, sum(s) AS st FROM counts),
abbr AS MATERIALIZED (
  SELECT type, score FROM (
    SELECT type, round(-2 * ({_times_log('s', 'st / aw')} + {_times_log('(n - s)', '1 - st / aw')} - s * ln(0.99) - (n - s) * ln(0.01))
           * exp(-k) * (length(type) - length(replace(type, '.', '')) + 1) * exp(-(n - s) * ln(k)), 9) AS score
    FROM (SELECT *, (length(replace(type, '.', '')))::DOUBLE AS k FROM counts), tot
    WHERE s > 0 AND regexp_matches(type, '\p{{L}}') AND type <> '##number##') WHERE score >= 0.3),
seq AS (SELECT *, lag(type) OVER o AS pt, lag(e) OVER o AS pe FROM ds WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (
  SELECT CASE WHEN pe <> '' THEN pt END AS before, CASE WHEN i = 0 THEN 'first' ELSE pe END AS e, type, cs, count(*) AS n FROM seq GROUP BY ALL),
judged AS MATERIALIZED (
  SELECT *, e = 'mark' OR (e = 'stop' AND NOT short) AS brk FROM (
    SELECT before, e, type, cs, n, e = 'stop' AND before IN (SELECT type FROM abbr) AS short,
           e = 'stop' AND (regexp_matches(before, '^\p{{L}}$') OR before = '##number##') AS single FROM pairs)),
totb AS (SELECT aw, (SELECT coalesce(sum(n), 0)::DOUBLE FROM judged WHERE brk) AS ab FROM tot),
starters AS MATERIALIZED (
  SELECT type FROM (
    SELECT type, sum(j.n)::DOUBLE AS hits, any_value(c.n) AS times FROM judged j JOIN counts c USING (type)
    WHERE brk AND NOT single AND regexp_matches(type, '^\p{{L}}+$') GROUP BY type), totb
  WHERE CASE WHEN hits > 1 AND times >= hits AND aw > ab AND aw * hits > ab * times THEN {_likelihood('ab', 'times', 'hits', 'aw')} >= 30 ELSE false END),
collocations AS MATERIALIZED (
  SELECT before, type FROM (
    SELECT before, j.type, sum(j.n)::DOUBLE AS hits, any_value(f.n) AS first, any_value(c.n) AS times
    FROM judged j JOIN counts f ON f.type = before JOIN counts c ON c.type = j.type
    WHERE single AND regexp_matches(j.type, '\p{{L}}|^##') GROUP BY before, j.type), tot
  WHERE CASE WHEN hits > 1 AND aw > first AND aw * hits > first * times THEN {_likelihood('first', 'times', 'hits', 'aw')} >= 7.88 ELSE false END),
spellings AS MATERIALIZED (
  SELECT type, bool_or(cs = 'upper' AND e = '') AS ui, bool_or(cs = 'lower' AND (e = 'first' OR (brk AND NOT single))) AS lf,
         bool_or(cs = 'lower') AS la, bool_or(cs = 'upper') AS ua FROM judged GROUP BY type),
ends AS (SELECT r, id, i, tk, type AS before, e, lead(type) OVER o AS type, lead(cs) OVER o AS cs FROM ds WINDOW o AS (PARTITION BY r ORDER BY i)),
weighed AS (
  SELECT x.*, e = 'stop' AND before IN (SELECT type FROM abbr) AS short,
         e = 'stop' AND (regexp_matches(before, '^\p{{L}}$') OR before = '##number##') AS single,
         EXISTS (SELECT 1 FROM collocations c WHERE c.before = x.before AND c.type = x.type) AS tied, x.type IN (SELECT type FROM starters) AS starts,
         coalesce(ui, false) AS ui, coalesce(lf, false) AS lf, coalesce(la, false) AS la, coalesce(ua, false) AS ua
  FROM ends x LEFT JOIN spellings p ON p.type = x.type WHERE e <> '' AND x.type IS NOT NULL),
hints AS (
  SELECT *, cs = 'upper' AND la AND NOT ui AS sure, single AND before <> '##number##' AS initial,
         NOT (cs = 'upper' AND la AND NOT ui) AND type <> '' AND NOT (cs = 'lower' AND (ua OR NOT lf)) AS unsure FROM weighed),
breaks AS (
  SELECT r, i, CASE WHEN e = 'mark' THEN true WHEN tied THEN false
    WHEN (short OR e = 'dots') AND NOT initial THEN sure OR (unsure AND cs = 'upper' AND starts)
    WHEN single AND NOT sure AND NOT unsure THEN false WHEN initial AND unsure AND cs = 'upper' AND NOT la THEN false
    ELSE e = 'stop' AND NOT short END AS brk
  FROM hints),
numbered AS (
  SELECT id, r, i, tk, coalesce(sum(brk::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS sent_idx
  FROM ds LEFT JOIN breaks USING (r, i))"""

ORACLES |= {
    "sentence_abbreviations": f"WITH {BOUNDARIES} SELECT type, round(score, 6) AS score FROM abbr",
    "sentence_starters": f"WITH {BOUNDARIES} SELECT type FROM starters",
    "sentences_trained": f"WITH {BOUNDARIES} SELECT id, sent_idx, string_agg(tk, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY id, r, sent_idx",
}

# The pieces of the public vocabulary.
PIECES = rf"""''s|''t|''re|''ve|''m|''ll|''d|[\p{{L}}]+|[\p{{N}}]|[^{WS[1:-2]}\p{{L}}\p{{N}}]+"""

ORACLES["subword_roundtrip"] = f"""WITH {ARTICLES}, sides AS (
  SELECT id, 'article' AS side, article AS t FROM articles UNION ALL SELECT id, 'lay_summary', lay_summary FROM articles)
SELECT id, side, array_to_string(regexp_extract_all(lower(coalesce(t, '')), '{PIECES}'), ' ') AS text FROM sides"""

# --- running figures, damaged lines, partitions, sketches ---------------------

ORACLES |= {
    "label_report": f"""WITH {PSEUDO_SPLIT}, j AS (
        SELECT w.id, w.s, p.s AS t, list_filter(p.s, lambda x: NOT list_contains(w.s, x)) AS lost FROM pseudo_s p JOIN split w USING (id))
      SELECT count(*) AS articles, sum(len(s))::BIGINT AS article_sentences, sum(len(t))::BIGINT AS pseudo_sentences, (SELECT sum(label)::BIGINT FROM marked) AS class_1,
        sum(len(lost))::BIGINT AS missing_sentences, count_if(len(lost) > 0)::BIGINT AS inconsistent_articles, max(len(s))::BIGINT AS longest FROM j""",
    "quarantine": f"""WITH {ARTICLES}, raw AS (SELECT id, article, id % 7 AS k, to_json({{'id': id::VARCHAR, 'article': article, 'lay_summary': lay_summary}}) AS line FROM articles),
      n AS (SELECT count_if(k NOT IN (1, 3, 4))::BIGINT AS all_good, count_if(k IN (1, 3, 4))::BIGINT AS all_bad FROM raw)
      SELECT 'good' AS part, id::VARCHAR AS id, length(article)::INTEGER AS size, all_good, all_bad FROM raw, n WHERE k NOT IN (1, 3, 4)
      UNION ALL SELECT 'bad', NULL, CASE k WHEN 1 THEN 12 WHEN 4 THEN 2 + length(id::VARCHAR) ELSE length(line::VARCHAR) + 15 END::INTEGER, all_good, all_bad FROM raw, n WHERE k IN (1, 3, 4)""",
    "partitioned_corpus": f"""WITH {ARTICLES}, {DIALOGUES},
      parts AS (SELECT *, CASE WHEN ('0x' || substr(md5(id::VARCHAR), 1, 4))::INTEGER % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM articles)
      SELECT id::VARCHAR AS id, 'documents' AS corpus, split, article, CASE WHEN split = 'val' THEN concat('again ', lay_summary) ELSE lay_summary END AS lay_summary FROM parts
      UNION ALL SELECT id, 'dialogues', 'val', article, lay_summary FROM dialogues""",
    "length_sketches": f"""WITH {ARTICLES} SELECT measure, (SELECT count(*) FROM articles) AS n, point::DOUBLE AS point, true AS within
      FROM (VALUES ('tokens'), ('summary_sentences')) m(measure), (VALUES (0.25), (0.5), (0.75), (0.9)) p(point)""",
}
