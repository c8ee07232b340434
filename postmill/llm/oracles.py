"""SQL of the queries that need a checksum or a search, for engines that have neither."""

from __future__ import annotations

#: The 256 remainders of the reflected polynomial of CRC-32, made by its rule.
CRC_TABLE = """
        crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, by the column t of `crc_table`."""
    digits = f"hex(encode({text}))"
    byte = ("((strpos('0123456789ABCDEF', substr(" + digits + ", 2 * b + 1, 1)) - 1) * 16"
            " + strpos('0123456789ABCDEF', substr(" + digits + ", 2 * b + 2, 1)) - 1)::BIGINT")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda b: {byte})),"
            f" lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)")


#: Weights and the draw of `op11_importance_resampling`.
IMPORTANCE = f"""
        WITH {CRC_TABLE.strip()},
        texts AS (
            SELECT TRUE AS corpus, row_number() OVER () AS r, doc_id, text FROM documents
            UNION ALL SELECT FALSE, NULL, NULL, text FROM benchmark),
        w AS (SELECT corpus, r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
        f AS (SELECT corpus, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM w),
        n AS (SELECT corpus, r, f, count(*) AS n FROM f GROUP BY ALL),
        d AS (SELECT DISTINCT f FROM n),
        c AS (SELECT f, {crc32_sql('f')} % 10000 AS b FROM d, crc_table),
        k AS (SELECT b, coalesce(sum(n) FILTER (WHERE corpus), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT corpus), 0)::DOUBLE AS t
            FROM n JOIN c USING (f) GROUP BY b),
        a AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
        g AS (SELECT b, floor(1000 * ln((k.t + 1) * (a.s + 10000) / ((k.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM k, a),
        x AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN c USING (f) JOIN g USING (b)
            WHERE corpus GROUP BY r),
        y AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                    / 4294967296::DOUBLE)))::BIGINT AS score
            FROM w LEFT JOIN x ON x.r = w.r WHERE corpus),
        z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS all_able FROM y)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * all_able // 100 THEN place END AS rank FROM z"""

#: `op12_conversation_repair` as a search over rows and states; a value is a padded cost and its audit.
CONVERSATIONS = f"""
        WITH RECURSIVE {CRC_TABLE.strip()},
        o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
            FROM conversations, crc_table),
        h AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM o WHERE kind <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM h),
        e AS (SELECT *, CASE WHEN text !~ '(?s).*[^\\x20\\x09-\\x0D].*' THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN right(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't'
                ELSE '' END AS fault,
                left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM p),
        k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
                count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
                count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM e GROUP BY conv_id),
        step(q, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        put(q, r, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
            (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
        moves AS (
            SELECT conv_id, i, q.q, q.q AS r, 2 AS cost, 'D' AS edit FROM e, range(4) q(q)
            UNION ALL SELECT conv_id, i, q, r, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K' FROM e JOIN step USING (c) WHERE fault IN ('', 't')
            UNION ALL SELECT conv_id, i, q, r, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R' FROM e JOIN step ON step.c <> e.c AND step.c IN ('u', 'a')
                WHERE fault IN ('', 't')),
        best AS (
            SELECT k.conv_id, 0::BIGINT AS i, put.r AS q, printf('%012d', cost) || edits AS v FROM k, put WHERE q = 0
            UNION ALL
            SELECT m.conv_id, m.i, put.r, min(printf('%012d', left(v, 12)::BIGINT + m.cost + put.cost) || substr(v, 13) || edit || edits)
            FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 AND m.q = b.q JOIN put ON put.q = m.r
            GROUP BY m.conv_id, m.i, put.r),
        won AS (SELECT b.conv_id, left(min(v), 12)::BIGINT AS cost, substr(min(v), 13) AS audit
            FROM best b JOIN k ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = k.n WHERE q IN (0, 3) GROUP BY b.conv_id),
        letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS j,
                len(replace(audit, 'D', '')) % 2 AS odd FROM won WHERE audit <> ''),
        placed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w - 1 AS spot
            FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        lines AS (SELECT l.conv_id, j, CASE WHEN edit = 'K' THEN role WHEN (spot - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
                || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
            FROM placed l LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.i = l.i WHERE edit <> 'D'),
        left_over AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS rest FROM lines GROUP BY conv_id),
        every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
            sha256(coalesce(rest, '')) AS repaired_sha256
        FROM every LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM every.conv_id
            LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM every.conv_id
            LEFT JOIN left_over ON left_over.conv_id IS NOT DISTINCT FROM every.conv_id"""
