"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
    FROM range(2) AS r(k)
),
formatted AS (
    SELECT *,
        '<|im_start|>'
        || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')
        || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS segment
    FROM turns
),
spoken AS (
    SELECT conv_id,
        count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, segment)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length(segment))::BIGINT AS formatted_chars
    FROM formatted
    GROUP BY conv_id
)
SELECT *, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM spoken
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LEAKS = rf"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
items AS (
    SELECT item_id::VARCHAR AS item_id, words, least(10, len(words)) AS size
    FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
    WHERE len(words) > 0
),
item_windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[k + 1 : k + size], ' ') AS phrase
    FROM items, unnest(range(0, len(words) - size + 1)) AS r(k)
),
text_windows AS (
    SELECT doc_id, k, size, array_to_string(words[k + 1 : k + size], ' ') AS phrase
    FROM texts, (SELECT DISTINCT size FROM items) AS sizes, unnest(range(0, len(words) - size + 1)) AS r(k)
),
found AS (SELECT doc_id, item_id, k, size FROM text_windows JOIN item_windows USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM found, unnest(range(0, size)) AS r(j) GROUP BY doc_id),
ids AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(item_ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_LINES = r"""
WITH texts AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
windows AS (
    SELECT doc_id, k, array_to_string(words[k + 1 : k + 8], ' ') AS phrase
    FROM texts, unnest(range(0, len(words) - 7)) AS r(k)
),
again AS (SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, phrase) > 1),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM again, range(0, 8) AS r(j) GROUP BY doc_id),
lines AS (
    SELECT doc_id, source, text, line,
        lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS norm,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
duplicates AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source AS host, count(DISTINCT text) AS n FROM texts GROUP BY source),
frequent AS (
    SELECT source AS host, norm
    FROM (SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY ALL) AS l
    JOIN hosts ON host IS NOT DISTINCT FROM source
    WHERE l.n > 3 AND l.n > 0.05 * hosts.n
),
removed AS (
    SELECT doc_id, sum(n) AS n FROM lines JOIN frequent ON host IS NOT DISTINCT FROM source AND lines.norm = frequent.norm
    GROUP BY doc_id
),
counts AS (
    SELECT texts.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(duplicates.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        coalesce(removed.n, 0) AS n_removed
    FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN duplicates USING (doc_id) LEFT JOIN removed USING (doc_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT * EXCLUDE (n_removed), NOT base_failed AND n_words - n_removed >= 20 AND n_removed <= 0.5 * n_words AS kept FROM judged
"""

# A walk over the rows of a conversation that keeps the cheapest (cost, audit) per state, without heaps or blocks.
_REPAIR = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END) ORDER BY b) AS crc
    FROM range(256) AS r(b)
),
kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind
    FROM conversations, crc_table
),
damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0)
),
placed AS (
    SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
    FROM damaged
),
rows AS MATERIALIZED (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
        WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(c) OVER (PARTITION BY conv_id ORDER BY k) || c AS pair
    FROM placed
),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- n0 to n3: the cheapest way to each state of the pattern, as a cost of nine digits and the audit; least ignores NULL.
walk(conv_id, k, n0, n1, n2, n3) AS (
    SELECT conv_id, 0, '000000000', NULL::VARCHAR, '000000002I', '000000004II' FROM ids
    UNION ALL
    SELECT conv_id, k, d0, d1, u2, least(d3, printf('%09d', left(u2, 9)::INT + 2) || substr(u2, 10) || 'I') AS n3
    FROM (
        SELECT *, least(d2, printf('%09d', left(d0, 9)::INT + 2) || substr(d0, 10) || 'I', printf('%09d', left(d1, 9)::INT + 2) || substr(d1, 10) || 'I',
            printf('%09d', left(d3, 9)::INT + 2) || substr(d3, 10) || 'I') AS u2
        FROM (
            SELECT w.conv_id, rows.k,
                printf('%09d', left(n0, 9)::INT + 3) || substr(n0, 10) || 'D' AS d0,
                least(printf('%09d', left(n1, 9)::INT + 3) || substr(n1, 10) || 'D',
                    CASE WHEN open AND c = 's' THEN printf('%09d', left(n0, 9)::INT + more) || substr(n0, 10) || 'K' END) AS d1,
                least(printf('%09d', left(n2, 9)::INT + 3) || substr(n2, 10) || 'D',
                    CASE WHEN open THEN least(
                        printf('%09d', left(n0, 9)::INT + more + CASE c WHEN 'u' THEN 0 ELSE 2 END) || substr(n0, 10) || CASE c WHEN 'u' THEN 'K' ELSE 'R' END,
                        printf('%09d', left(n1, 9)::INT + more + CASE c WHEN 'u' THEN 0 ELSE 2 END) || substr(n1, 10) || CASE c WHEN 'u' THEN 'K' ELSE 'R' END,
                        printf('%09d', left(n3, 9)::INT + more + CASE c WHEN 'u' THEN 0 ELSE 2 END) || substr(n3, 10) || CASE c WHEN 'u' THEN 'K' ELSE 'R' END) END) AS d2,
                least(printf('%09d', left(n3, 9)::INT + 3) || substr(n3, 10) || 'D',
                    CASE WHEN open THEN printf('%09d', left(n2, 9)::INT + more + CASE c WHEN 'a' THEN 0 ELSE 2 END) || substr(n2, 10)
                        || CASE c WHEN 'a' THEN 'K' ELSE 'R' END END) AS d3
            FROM walk AS w
            JOIN (SELECT *, fault IN ('', 'truncated') AS open, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS more FROM rows) AS rows
                ON rows.conv_id IS NOT DISTINCT FROM w.conv_id AND rows.k = w.k + 1
        )
    )
),
solved AS MATERIALIZED (
    SELECT conv_id, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit
    FROM (SELECT conv_id, least(n0, n3) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1)
),
edits AS (
    SELECT conv_id, p, edit, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS place
    FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS edit FROM solved WHERE audit <> '')
    WINDOW w AS (PARTITION BY conv_id ORDER BY p)
),
made AS (
    SELECT e.conv_id, p, edit, place - coalesce(max((place = 1 AND edit = 'K' AND c = 's')::INT) OVER (PARTITION BY e.conv_id), 0) AS place, role, text
    FROM edits AS e LEFT JOIN rows ON rows.conv_id IS NOT DISTINCT FROM e.conv_id AND rows.k = e.k AND edit <> 'I'
    WHERE edit <> 'D'
),
repaired AS (
    SELECT conv_id, string_agg(
        CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said
    FROM made GROUP BY conv_id
),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id
)
SELECT solved.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM solved
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM solved.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM solved.conv_id
"""

_RANKED = rf"""
WITH texts AS (
    SELECT d, doc_id, terms, len(terms) AS n
    FROM (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
    WHERE len(terms) > 0
),
items AS (
    SELECT i, item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM texts),
postings AS (
    SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM texts) WHERE term IN (SELECT term FROM items) GROUP BY ALL
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term
),
scored AS (
    SELECT i, item_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
    FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN texts USING (d), corpus
    GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN texts USING (d) WHERE score > 0)
WHERE rank <= 10
"""

SQL: dict[str, str] = {
    "op1_chat_format": _CHAT,
    "op5_decontaminate": _LEAKS,
    "op6_line_quality": _LINES,
    "op11_repair_turns": _REPAIR,
    "op13_ranked_search": _RANKED,
}
