"""The queries on training data by name, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import canonical, cooccur, mixing, overlap, pairs, quality, tiling, words
from planloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.program_copies(table(spark, d, "programs"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return canonical.program_records(table(spark, d, "programs")).select("row_id", "n_copies")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.found_pairs(table(spark, d, "dataflow_plans"), table(spark, d, "composition_patterns"), table(spark, d, "sub_library"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("basket_kind", "sub_id_a", "sub_id_b")


def _lift(baskets: DataFrame) -> DataFrame:
    return cooccur.cooccurrence(baskets).select("item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def p4_pattern_lift(spark: SparkSession, d: str) -> DataFrame:
    return _lift(cooccur.pattern_baskets(table(spark, d, "composition_patterns"), table(spark, d, "sub_library")))


def p4_plan_lift(spark: SparkSession, d: str) -> DataFrame:
    return _lift(cooccur.plan_baskets(table(spark, d, "dataflow_plans"), table(spark, d, "sub_library")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "eval_results"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "eval_results"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, d, "eval_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "chat_messages"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_counts(table(spark, d, "chat_messages"))


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    return pairs.truncation_steps(table(spark, d, "chat_messages"))


def p5_shortened(spark: SparkSession, d: str) -> DataFrame:
    return pairs.shortened_answers(table(spark, d, "chat_messages"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.question_answers(table(spark, d, "chat_messages")).select("conv_id", "turn", "answered")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return tiling.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return tiling.leak_report(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p6_longest(spark: SparkSession, d: str) -> DataFrame:
    return tiling.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id", "longest")


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    s = quality.text_quality(table(spark, d, "documents"))
    shares = ("mean_word_length", "common_words", "duplicate_lines", "duplicate_paragraphs", "punctuated_lines")
    return s.select("doc_id", "n_words", "n_lines", *(F.round(c, 6).alias(c) for c in shares))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.rule_counts(table(spark, d, "documents"))


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    return quality.label_agreement(table(spark, d, "documents"), table(spark, d, "doc_labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p2_found, p2_counts, p2_classes, p3_found, p3_records, p4_found, p4_pattern_lift, p4_plan_lift, p5_found, p5_counts, p5_steps, p5_shortened, p5_pairs,
        p6_found, p6_longest, p6_report, p7_uses, p7_shares, p8_found, p8_stats, p8_counts, p8_rules, p8_labels,
    )
}

_BASKETS = """
    lib AS (SELECT upper(trim(sub_id)) AS k, min(sub_id) AS sub_id FROM sub_library WHERE sub_id IS NOT NULL GROUP BY 1),
    plan_b AS (SELECT plan_key AS b, any_value(calls) AS calls FROM dataflow_plans GROUP BY 1),
    pattern_b AS (SELECT pattern_id AS b, any_value(sub_ids) AS ids FROM composition_patterns GROUP BY 1),
    raw AS (
        SELECT 'plan' AS kind, b, unnest(calls).sub_id AS s FROM plan_b
        UNION ALL SELECT 'pattern', b, unnest(ids) FROM pattern_b
    ),
    items AS (SELECT DISTINCT kind, b, lib.sub_id AS i FROM raw JOIN lib ON upper(trim(s)) = lib.k),
    n AS (SELECT 'plan' AS kind, count(*) AS n FROM plan_b UNION ALL SELECT 'pattern', count(*) FROM pattern_b),
    one AS (SELECT kind, i, count(*) AS c FROM items GROUP BY 1, 2),
    two AS (
        SELECT x.kind, x.i AS a, y.i AS b, count(*) AS c FROM items x JOIN items y
        ON x.kind = y.kind AND x.b = y.b AND x.i < y.i GROUP BY 1, 2, 3
    )
"""

_NAME = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_EXPR = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}+\\-*/%().<>=!]+', '', 'g')"
_RECORDS = f"""
    j AS (
        SELECT row_id, slots, steps, try_cast(output AS JSON) AS o FROM programs WHERE row_id IS NOT NULL
    ),
    t AS (
        SELECT row_id, slots, steps, CASE WHEN slots IS NULL AND steps IS NULL AND o IS NOT NULL THEN json_transform(o,
            '{{"slots": [{{"name": "VARCHAR", "dtype": "VARCHAR"}}], "steps": [{{"op": "VARCHAR", "target": "VARCHAR", "expr": "VARCHAR", "inputs": ["VARCHAR"], "target_dtype": "VARCHAR"}}]}}') END AS o
        FROM j
    ),
    f AS (
        SELECT row_id,
            coalesce(list_transform(slots, lambda s: {_NAME.format("s.name")} || ':' || lower(coalesce(s.dtype, ''))),
                     list_transform(o.slots, lambda s: {_NAME.format("s.name")} || ':' || lower(coalesce(s.dtype, '')))) AS a,
            coalesce(list_transform(steps, lambda s: {{'op': lower(coalesce(s.op, '')), 't': {_NAME.format("s.target")}, 'e': {_EXPR.format("s.expr")},
                        'i': list_sort(list_transform(coalesce(s.inputs, []), lambda x: {_NAME.format("x")})), 'd': lower(coalesce(s.target_dtype, ''))}}),
                     list_transform(o.steps, lambda s: {{'op': lower(coalesce(s.op, '')), 't': {_NAME.format("s.target")}, 'e': {_EXPR.format("s.expr")},
                        'i': list_sort(list_transform(coalesce(s.inputs, []), lambda x: {_NAME.format("x")})), 'd': lower(coalesce(s.target_dtype, ''))}})) AS b
        FROM t WHERE slots IS NOT NULL OR steps IS NOT NULL OR o.slots IS NOT NULL OR o.steps IS NOT NULL
    ),
    k AS (SELECT row_id, CAST(list_sort(a) AS VARCHAR) || '|' || CAST(b AS VARCHAR) AS k FROM f),
    r AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS n_copies FROM k)
"""



_BLANKS = "\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_BARE = f"regexp_replace(x, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def _lift_sql(kind: str) -> str:
    return f"""
        WITH {_BASKETS}
        SELECT two.a AS item_a, two.b AS item_b, two.c AS n_both, x.c AS n_a, y.c AS n_b, n.n AS n_baskets, round(two.c * n.n / (x.c * y.c), 6) AS lift
        FROM two JOIN n USING (kind) JOIN one x ON x.kind = two.kind AND x.i = two.a JOIN one y ON y.kind = two.kind AND y.i = two.b
        WHERE two.kind = '{kind}'
    """


#: Words of a text as p2 takes them: separators within numbers dropped, lower case, letters and digits only. DuckDB has no
#: look-around, so separators are dropped again and again for groups that touch. Distances are those of texts with one byte a word.
_JOINED = "regexp_replace(regexp_replace({0}, '(\\d)[,''’  ٬](\\d{{3}})([^\\d]|$)', '\\1\\2\\3', 'g'), '(\\d)[,''’  ٬](\\d{{3}})([^\\d]|$)', '\\1\\2\\3', 'g')"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace({0}, '^(-?)0+(\\d)', '\\1\\2'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_OVERLAPS = f"""
    e AS (SELECT item_id, min({{'split': lower(trim(split)), 'source': source, 'problem': problem, 'answer': answer}}) AS r FROM eval_results
        WHERE item_id IS NOT NULL AND problem IS NOT NULL AND answer IS NOT NULL AND lower(trim(split)) IN ('train', 'dev', 'test') GROUP BY 1),
    j AS (SELECT item_id, r.split AS split, r.source AS source, {_JOINED.format("r.problem")} AS p, regexp_extract({_JOINED.format("r.answer")}, '(?:^|[^\\p{{L}}\\p{{N}}.])([-−]?\\d+(?:\\.\\d+)?)', 1) AS a FROM e),
    t AS (SELECT item_id, split, source, {_PLAIN.format("replace(a, '−', '-')")} AS answer, list_transform(regexp_extract_all(p, '\\d+(?:\\.\\d+)?'), lambda x: {_PLAIN.format("x")}) AS numbers, regexp_extract_all(lower(p), '[\\p{{L}}\\p{{N}}]+') AS w FROM j WHERE a <> ''),
    c AS (SELECT x.item_id AS train_id, y.item_id AS eval_id, y.split AS split, y.source AS source, x.w AS a, y.w AS b, list_distinct(list_concat(x.w, y.w)) AS v FROM t x JOIN t y ON x.answer = y.answer AND x.numbers = y.numbers AND x.split = 'train' AND y.split <> 'train'),
    d AS (SELECT train_id, eval_id, split, source, CAST(floor(0.2 * greatest(len(a), len(b)) + 1e-9) AS BIGINT) AS most, CASE WHEN a = b THEN 0 WHEN len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) > 0.2 * greatest(len(a), len(b)) THEN 1000000 WHEN len(v) <= 126 THEN
        levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(list_position(v, x) AS INT))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(list_position(v, x) AS INT))), '')) END AS n FROM c),
    pairs AS (SELECT train_id, eval_id, split, source FROM d WHERE n <= most)
"""

SQL: dict[str, str] = {
    "p2_found": f"WITH {_OVERLAPS} SELECT least(train_id, eval_id) AS item_id_a, greatest(train_id, eval_id) AS item_id_b FROM pairs",
    "p2_classes": f"""
        WITH {_OVERLAPS}, k AS (SELECT t.*, min(item_id) OVER (PARTITION BY answer, numbers, w, split = 'train') AS class_id FROM t),
        l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM pairs JOIN k x ON x.item_id = train_id JOIN k y ON y.item_id = eval_id),
        n AS (SELECT class_id, count(*) AS n_links FROM (SELECT a AS class_id FROM l UNION ALL SELECT b FROM l) GROUP BY 1)
        SELECT item_id, split, class_id, n_links FROM k JOIN n USING (class_id)
    """,
    "p2_counts": f"WITH {_OVERLAPS} SELECT split, coalesce(source, '') AS source, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_items FROM pairs GROUP BY 1, 2",
    "p3_records": f"WITH {_RECORDS} SELECT row_id, n_copies FROM r WHERE row_id = keep_id",
    "p3_found": f"WITH {_RECORDS} SELECT keep_id, row_id AS copy_id FROM r WHERE row_id <> keep_id",
    "p5_pairs": """
        WITH m AS (
            SELECT DISTINCT conv_id, turn, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user'
                WHEN lower(trim(role)) IN ('assistant', 'gpt', 'model') THEN 'assistant' END AS r
            FROM chat_messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL
        )
        SELECT u.conv_id, u.turn, a.conv_id IS NOT NULL AS answered
        FROM m u LEFT JOIN m a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.r = 'assistant' WHERE u.r = 'user'
    """,
    "p5_shortened": """
        WITH m AS (SELECT conv_id, turn, content, CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'prompter') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'gpt', 'model', 'bot', 'ai', 'chatbot') THEN 'assistant' END AS r FROM chat_messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        u AS (SELECT conv_id, turn, max(content) AS question FROM m WHERE r = 'user' GROUP BY 1, 2), a AS (SELECT conv_id, turn, max(content) AS answer FROM m WHERE r = 'assistant' GROUP BY 1, 2),
        t AS (SELECT DISTINCT md5(array_to_string(regexp_extract_all(lower(coalesce(question, '')), '[\\p{L}\\p{N}]+'), ' ')) AS q, rtrim(answer, chr(32) || chr(9) || chr(13) || chr(10)) AS text FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE answer IS NOT NULL),
        e AS (SELECT q, text, md5(text) AS id, length(text) AS n, regexp_matches(text, '\\p{L}$') AS letter, regexp_matches(text, '\\p{N}$') AS figure, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) >= 4 AS tells FROM t WHERE text <> ''),
        d AS (SELECT DISTINCT id, text, n, letter AND tells AS open FROM e)
        SELECT DISTINCT 'within' AS kind, '' AS q, x.id FROM d x JOIN d y ON y.n > x.n AND starts_with(y.text, x.text) WHERE x.open AND regexp_matches(y.text[x.n + 1], '[\\p{L}\\p{N}]')
        UNION ALL SELECT DISTINCT 'own', x.q, x.id FROM e x JOIN e y ON x.q = y.q AND y.n > x.n AND starts_with(y.text, x.text) WHERE NOT (x.figure AND regexp_matches(y.text[x.n + 1], '[\\p{L}\\p{N}]'))
    """,
    "p6_found": """
        WITH i AS (SELECT item_id, regexp_extract_all(lower(problem), '[\\p{L}\\p{N}]+') AS w FROM heldout_items),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """,
    "p6_longest": """
        WITH i AS (SELECT item_id, regexp_extract_all(lower(problem), '[\\p{L}\\p{N}]+') AS w FROM heldout_items),
        ig AS (SELECT item_id, j, array_to_string(w[j:j + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS j FROM i)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        dg AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
        runs AS (SELECT doc_id, item_id, p - j AS diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, p - j ORDER BY p) AS run FROM dg JOIN ig USING (g)),
        lengths AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM runs GROUP BY doc_id, item_id, diagonal, run)
        SELECT doc_id, item_id, max(n) AS longest FROM lengths GROUP BY 1, 2
    """,
    "p8_counts": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANKS}]')) AS lines, list_filter(list_transform(regexp_split_to_array(t, '\\n[{_BLANKS}]*\\n'), lambda x: {_BARE}), lambda x: x <> '') AS paragraphs,
            regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}]+)?') AS w FROM d)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 6) AS mean_word_length,
            round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({sorted(quality._COMMON)}, lower(x)))) / len(w) ELSE 0 END, 6) AS common_words,
            round(CASE WHEN len(lines) > 0 THEN 1 - len(list_distinct(list_transform(lines, lambda x: lower({_BARE})))) / len(lines) ELSE 0 END, 6) AS duplicate_lines,
            round(CASE WHEN len(paragraphs) > 0 THEN 1 - len(list_distinct(paragraphs)) / len(paragraphs) ELSE 0 END, 6) AS duplicate_paragraphs,
            round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?。！？…]["''”’)\\]»]*[{_BLANKS}]*$'))) / len(lines) ELSE 0 END, 6) AS punctuated_lines
        FROM l
    """,
    "p4_found": f"""
        WITH {_BASKETS}
        SELECT two.kind AS basket_kind, two.a AS sub_id_a, two.b AS sub_id_b
        FROM two JOIN n USING (kind) JOIN one x ON x.kind = two.kind AND x.i = two.a JOIN one y ON y.kind = two.kind AND y.i = two.b
        WHERE two.c >= 5 AND two.c >= 0.003 * n.n AND two.c * n.n >= 3 * x.c * y.c
    """,
    "p4_pattern_lift": _lift_sql("pattern"),
    "p4_plan_lift": _lift_sql("plan"),
}
