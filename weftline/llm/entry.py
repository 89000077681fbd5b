"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import conversations as conv
from weftline.llm import languages, leaks, mixing, overlap, pieces, pii, sampling, splits
from weftline.session import materialize, table


EVENT = ["tenant_id", "trace_id", "event_id"]


def _talk(spark, d):
    """Distinct texts of the events, written once: the languages, the sample and the texts themselves are all read from it."""
    return materialize(table(spark, d, "trace_events").filter("role IN ('user', 'assistant')").select(*EVENT, "language", "text").distinct(), "talk")[0]


def p2_found(spark, d):
    return languages.wrong_labels(languages.identify(_talk(spark, d), EVENT, min_letters=languages.MIN_LETTERS)).select(*EVENT).distinct()


def p2_languages(spark, d):
    found = languages.identify(_talk(spark, d), EVENT)
    return found.select(*EVENT, "language", F.col("found").alias("found_language"), "confidence", F.to_json("proportions").alias("proportions"))


def p2_segments(spark, d):
    """Every segment of every event with its language and confidence."""
    found = languages.identify(_talk(spark, d), EVENT)
    s = found.select(*EVENT, F.col("found").alias("event_language"), F.posexplode("segments").alias("segment_no", "s"))
    return s.select(*EVENT, "event_language", "segment_no", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.language").alias("segment_language"), F.col("s.confidence").alias("confidence"))


def _texts(spark, d):
    return table(spark, d, "trace_events").select(*EVENT, "text")


def p4_found(spark, d):
    return pii.find(_texts(spark, d), EVENT)


def p4_redacted(spark, d):
    return pii.redact(_texts(spark, d), EVENT)


def p4_terms(spark, d):
    """The disclosing terms of the corpus with their disclosure in bits."""
    return pii.disclosure(_texts(spark, d).distinct())


def p3_found(spark, d):
    p = overlap.overlaps(table(spark, d, "feedback_inputs"))
    return p.select(F.least("train_input", "eval_input").alias("input_id_a"), F.greatest("train_input", "eval_input").alias("input_id_b")).distinct()


def p3_report(spark, d):
    return overlap.overlap_report(table(spark, d, "feedback_inputs"))


def p5_sample(spark, d):
    return sampling.block_sample(table(spark, d, "feedback_inputs")).select("input_id", "seq")


def p6_found(spark, d):
    return splits.crossing_sessions(table(spark, d, "feedback_inputs"))


def p6_splits(spark, d):
    return splits.grouped_splits(table(spark, d, "feedback_inputs"), table(spark, d, "split_targets")).select("input_id", "component", "assigned_split")


def p6_components(spark, d):
    """The component of every session, named by its smallest session."""
    c, _ = materialize(splits.session_components(table(spark, d, "feedback_inputs")), "components")
    return c.join(c.groupBy("component").agg(F.min("session_id").alias("first_session")), "component").select("tenant_id", "session_id", "first_session")


def p6_shares(spark, d):
    t = table(spark, d, "split_targets")
    return splits.share_report(splits.grouped_splits(table(spark, d, "feedback_inputs"), t), t)


def p7_found(spark, d):
    return conv.verdicts(table(spark, d, "trace_events")).filter("broken OR empty OR unanswered").select("tenant_id", "trace_id")


def p7_verdicts(spark, d):
    return conv.verdicts(table(spark, d, "trace_events"))


def p7_conversations(spark, d):
    return conv.conversations(table(spark, d, "trace_events"))


def p8_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_report(spark, d):
    """Leaks by item: documents that hold it and the longest passage."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest_words").alias("longest_words"))


def p8_clean(spark, d):
    return leaks.clean(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark, d):
    t = table(spark, d, "mix_targets")
    return mixing.mix(mixing.sized(table(spark, d, "documents"), t), t)


def p9_shares(spark, d):
    t = table(spark, d, "mix_targets")
    return mixing.share_report(mixing.sized(table(spark, d, "documents"), t), t)


def p10_found(spark, d):
    return pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "size_limits")).select("doc_id").distinct()


def p10_pieces(spark, d):
    return pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "size_limits"))


_ALL = (p2_found, p2_languages, p2_segments, p4_found, p4_redacted, p4_terms, p3_found, p3_report, p5_sample, p6_found, p6_components, p6_splits, p6_shares, p7_found, p7_verdicts, p7_conversations, p8_found, p8_report, p8_clean, p9_mix, p9_shares, p10_found, p10_pieces)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_SPACE = "[^\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}]"
_VERDICTS = f"""WITH RECURSIVE k AS (SELECT tenant_id, trace_id, event_id, parent_id, branch_id, sequence, role, visibility, text, status, language, group_id, event_ts, min(received_ts) AS f
        FROM trace_events GROUP BY ALL),
n AS (SELECT tenant_id, trace_id, event_id, count(*) AS versions, min(parent_id) AS parent_id, arg_max(sequence, f) AS sequence, arg_max(role, f) AS role,
        arg_max(regexp_matches(coalesce(text, ''), '{_SPACE}'), f) AS said FROM k GROUP BY ALL),
j AS (SELECT n.*, p.event_id AS hit, p.sequence AS up FROM n LEFT JOIN n p ON p.tenant_id = n.tenant_id AND p.trace_id = n.trace_id AND p.event_id = n.parent_id),
u AS (SELECT tenant_id, trace_id, event_id, hit, role FROM j WHERE said AND role = 'assistant'
      UNION SELECT j.tenant_id, j.trace_id, j.event_id, j.hit, j.role FROM u JOIN j ON j.tenant_id = u.tenant_id AND j.trace_id = u.trace_id AND j.event_id = u.hit),
v AS (SELECT tenant_id, trace_id, bool_or(versions > 1 OR (parent_id IS NOT NULL AND (hit IS NULL OR NOT up < sequence))) AS broken,
        NOT bool_or(said AND role IN ('user', 'assistant')) AS empty,
        NOT broken AND bool_or(said AND role = 'user' AND (tenant_id, trace_id, event_id) NOT IN (SELECT (tenant_id, trace_id, event_id) FROM u)) AS unanswered FROM j GROUP BY ALL)
"""
_TURNS = """, q AS (SELECT DISTINCT tenant_id, trace_id, event_id, parent_id, branch_id, sequence, role, text, status FROM k JOIN v USING (tenant_id, trace_id) WHERE NOT broken AND NOT empty AND NOT unanswered),
o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, trace_id, parent_id ORDER BY sequence, event_id) AS child FROM q),
w AS (SELECT tenant_id, trace_id, event_id, event_id AS thread, sequence AS since, 0::BIGINT AS depth FROM o WHERE parent_id IS NULL
      UNION ALL SELECT o.tenant_id, o.trace_id, o.event_id, CASE WHEN child = 1 THEN w.thread ELSE o.event_id END, CASE WHEN child = 1 THEN w.since ELSE o.sequence END, w.depth + 1
      FROM w JOIN o ON o.tenant_id = w.tenant_id AND o.trace_id = w.trace_id AND o.parent_id = w.event_id)
SELECT tenant_id, trace_id, event_id, row_number() OVER (PARTITION BY tenant_id, trace_id ORDER BY since, thread, sequence, event_id) AS turn_no, thread, depth, parent_id, branch_id, sequence, role,
    CASE WHEN status IS DISTINCT FROM 'cancelled' THEN text END AS text, coalesce(status = 'cancelled', false) AS deleted, 1::BIGINT AS n_versions FROM o JOIN w USING (tenant_id, trace_id, event_id)"""
_COMPONENTS = """WITH RECURSIVE l AS (SELECT DISTINCT tenant_id, session_id, group_id FROM feedback_inputs),
g AS (SELECT tenant_id, group_id, min(session_id) AS hub FROM l WHERE group_id IS NOT NULL GROUP BY ALL),
e AS (SELECT l.tenant_id, l.session_id AS a, g.hub AS b FROM l JOIN g USING (tenant_id, group_id)),
s AS (SELECT tenant_id, a, b FROM e UNION SELECT tenant_id, b, a FROM e UNION SELECT tenant_id, session_id, session_id FROM l),
r AS (SELECT tenant_id, a AS session_id, b AS root FROM s UNION SELECT r.tenant_id, s.a, r.root FROM r JOIN s ON s.tenant_id = r.tenant_id AND s.b = r.session_id),
c AS (SELECT tenant_id, session_id, min(root) AS component FROM r GROUP BY ALL)
"""
# fixed values: what folding changes in these tables (full-width forms, blanks, numero and ordinal signs, sharp s)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NARROWED = f"replace(replace(lower(translate(text, '{_WIDE}' || chr(12288) || chr(160) || chr(8195), '{_NARROW}' || '   ')), chr(8470), 'no'), chr(186), 'o')"
_OVERLAP = f"""WITH f AS (SELECT DISTINCT input_id, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side, trim(regexp_replace(replace({_NARROWED}, chr(223), 'ss'), '\\s+', ' ', 'g')) AS folded
        FROM feedback_inputs WHERE split IN ('train', 'calibration', 'test') AND input_id IS NOT NULL),
t AS (SELECT folded, side, list_distinct([substr(folded, i, 5) for i in range(1, length(folded) - 3)]) AS grams FROM (SELECT DISTINCT folded, side FROM f WHERE length(folded) >= 40)),
g AS (SELECT folded, side, len(grams) AS k, unnest(grams) AS g FROM t),
c AS (SELECT a.folded AS train_text, b.folded AS eval_text, a.k AS x, b.k AS y, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.side = 'train' AND b.side = 'eval' GROUP BY ALL),
p AS (SELECT DISTINCT a.input_id AS train_input, b.input_id AS eval_input, train_text = eval_text AS same FROM c JOIN f a ON a.folded = train_text AND a.side = 'train' JOIN f b ON b.folded = eval_text AND b.side = 'eval'
      WHERE n / (x + y - n) >= 0.7 AND a.input_id <> b.input_id)
"""
_INFO = """, i AS (SELECT DISTINCT input_id, split, source_dataset FROM feedback_inputs WHERE split IS NOT NULL)
SELECT e.split, e.source_dataset, t.source_dataset AS train_source_dataset, count(DISTINCT eval_input) AS n_eval, count(DISTINCT train_input) AS n_train, count(*) AS n_pairs, count(*) FILTER (same) AS n_exact
FROM (SELECT train_input, eval_input, bool_or(same) AS same FROM p GROUP BY ALL) JOIN i e ON e.input_id = eval_input AND e.split <> 'train' JOIN i t ON t.input_id = train_input AND t.split = 'train' GROUP BY ALL"""
_HIDDEN = "[\\x{AD}\\x{180E}\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FEFF}]"
_LEAKS = f"""WITH w AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'i', item_id, text FROM eval_items),
x AS (SELECT kind, id, regexp_extract_all({_NARROWED.replace('translate(text', f"translate(regexp_replace(text, '{_HIDDEN}', '', 'g')")}, '[\\p{{L}}\\p{{N}}]+') AS ws FROM w WHERE text IS NOT NULL),
g AS (SELECT kind, id, unnest([array_to_string(ws[i : i + 11], ' ') for i in range(1, len(ws) - 10)]) AS gram, unnest(range(12, len(ws) + 1)) AS pos FROM x WHERE len(ws) >= 12),
h AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.pos FROM g d JOIN g i ON d.gram = i.gram AND d.kind = 'd' AND i.kind = 'i'),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS run FROM h),
l AS (SELECT doc_id, item_id, max(n) + 11 AS longest_words FROM (SELECT doc_id, item_id, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL)
"""
_SAMPLE = """WITH f AS (SELECT input_id, row_number() OVER (ORDER BY min(ingested_ts), input_id) - 1 AS seq FROM feedback_inputs GROUP BY input_id),
b AS (SELECT DISTINCT seq // 100 AS b FROM f),
w AS (SELECT b, p, row_number() OVER (PARTITION BY b ORDER BY md5('sample-v1:' || b || ':' || p), p) AS rn FROM b, range(100) t(p))
SELECT input_id, seq FROM f JOIN w ON w.b = f.seq // 100 AND w.p = f.seq % 100 WHERE rn <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _OVERLAP + "SELECT DISTINCT least(train_input, eval_input) AS input_id_a, greatest(train_input, eval_input) AS input_id_b FROM p",
        "p3_report": _OVERLAP + _INFO,
        "p8_found": _LEAKS + "SELECT doc_id, item_id FROM l",
        "p8_report": _LEAKS + "SELECT item_id, count(*) AS n_docs, max(longest_words)::INT AS longest_words FROM l GROUP BY ALL",
        "p5_sample": _SAMPLE,
        "p6_found": _COMPONENTS
        + """, x AS (SELECT tenant_id, component FROM c JOIN feedback_inputs USING (tenant_id, session_id) WHERE split IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1)
        SELECT tenant_id, session_id FROM c JOIN x USING (tenant_id, component)""",
        "p6_components": _COMPONENTS + "SELECT tenant_id, session_id, component AS first_session FROM c",
        "p7_found": _VERDICTS + "SELECT tenant_id, trace_id FROM v WHERE broken OR empty OR unanswered",
        "p7_verdicts": _VERDICTS + "SELECT * FROM v",
        "p7_conversations": _VERDICTS.rstrip() + _TURNS,
    }
