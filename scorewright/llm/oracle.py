"""DuckDB SQL for the operators whose results SQL can express, each over whole tables."""

from __future__ import annotations

from scorewright.llm.quality import BOILERPLATE

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

WARC = """
    WITH d AS (SELECT page_id, sha1(coalesce(html, '')) AS x, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    b AS (SELECT *, array_to_string(list_transform(string_split_regex(x, ''), lambda c: CASE WHEN c = '' THEN '' ELSE lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0') END), '') AS bits, min(page_id) OVER (PARTITION BY x) AS first FROM d)
    SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (list_sum(list_transform(range(5), lambda j: substr(bits, (5 * k + j + 1)::BIGINT, 1)::INTEGER * (1 << (4 - j)::INTEGER))))::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

_BOILER = ", ".join("'" + p + "'" for p in BOILERPLATE)
_LINE_WORDS = _WORDS.format("x")
QUALITY = rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
    l AS (SELECT doc_id, text, w, list_filter(string_split(text, chr(10)), lambda x: len({_LINE_WORDS}) > 0) AS lines FROM t),
    g AS (SELECT *, list_filter(lines, lambda x: length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) <= 0.4 * len({_LINE_WORDS})
        AND NOT (length(regexp_replace(x, '[^|»›•·]', '', 'g')) >= 3 AND length(regexp_replace(x, '[^|»›•·]', '', 'g')) > 0.25 * len({_LINE_WORDS}))
        AND len(regexp_extract_all(x, '(?:!!|\?\?)(?:[\x20\x09-\x0D]|$)')) <= 0.3 * len({_LINE_WORDS})
        AND len(list_filter([{_BOILER}], lambda p: contains(lower(x), p))) = 0) AS good FROM l),
    o AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
    m AS (SELECT doc_id, win FROM o GROUP BY ALL HAVING count(*) > 1),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM o JOIN m USING (doc_id, win)) GROUP BY 1),
    c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(list_sum(list_transform(good, lambda x: len({_LINE_WORDS}))), 0) AS kept_words FROM g LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - kept_words <= 0.5 * n_words AS kept FROM b"""

NEAR_DUPLICATES = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
    c AS (SELECT id, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.id = vec_id"""

REPEATS = rf"""
    WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    o AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
    m AS (SELECT win, min(doc_id) AS first FROM o GROUP BY 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM o JOIN m USING (win) WHERE first < doc_id),
    u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN g USING (doc_id, p) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

EXACT = """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""

AUDIT = rf"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
    f AS (SELECT part, doc_id, len(w) < 200 AS "A", 100 * len(list_distinct(w)) < 50 * len(w) AS "B", 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS "C",
        regexp_matches(text, '[#$%&*|]') AS "D", doc_id > min(doc_id) OVER (PARTITION BY text) AS "E" FROM t),
    d AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, concat(CASE WHEN "A" THEN 'A' END, CASE WHEN "B" THEN 'B' END, CASE WHEN "C" THEN 'C' END, CASE WHEN "D" THEN 'D' END, CASE WHEN "E" THEN 'E' END) AS fails
        FROM f LEFT JOIN labels USING (doc_id)),
    g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic FROM d GROUP BY ALL),
    o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
    s AS (SELECT filter_order, i::INTEGER AS step, filter_order[i] AS filter, filter_order[1:i - 1] AS earlier FROM o, range(1, 6) r(i) WHERE length(filter_order) = 5),
    x AS (SELECT *, contains(fails, filter) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM g, s),
    m AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = filter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
    SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM m"""

FILL_IN_MIDDLE = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
    h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b, ('0x' || x[17:24])::BIGINT % 100 AS c, ('0x' || x[25:32])::BIGINT % 100 AS d FROM t),
    f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
        substr(text, 1, least(a, b)) AS p, substr(text, least(a, b) + 1, abs(a - b)) AS m, substr(text, greatest(a, b) + 1) AS s FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""
