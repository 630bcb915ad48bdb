"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillspark.llm import quality_rules as quality


def _op2() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for line in quality.STOP_WORDS for w in line.split()}))
    tests = []
    for r in quality.RULES:
        lo = f"{r.measure} < {r.least}" if r.least != float("-inf") else "false"
        hi = f"{r.measure} > {r.most}" if r.most != float("inf") else "false"
        tests.append(f"NOT (({lo} OR {hi}) AND n_words >= {r.min_words})")
    return f"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT k, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
    win AS (SELECT k, i, w[i:i+4] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)),
    dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
    cover AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY k),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
                 length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                 coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
                 len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
          FROM s LEFT JOIN cover USING (k)),
    r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
                 n_stop / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
                 n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
                 (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {' AND '.join(tests)} AS kept FROM r"""


_OP3 = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
    e AS (SELECT *, replace(regexp_replace(replace(text, '\', '\\'), '<(/turn>|next/>)', '<\\\1', 'g'), '##', '#\#') AS esc,
                 lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(esc) + CASE WHEN prev = role THEN 7 ELSE 14 + length(url_encode(role)) END)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


_OP5 = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    sound AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
              AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
    n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN n ON n.x = vec_id"""


ORACLES = {
    "op2_quality_rules": _op2(),
    "op3_chat_format": _OP3,
    "op5_embedding_dedup": _OP5,
}
