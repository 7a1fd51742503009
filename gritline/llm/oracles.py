"""The SQL of the queries that SQL can express."""

from __future__ import annotations

# DuckDB has no crc32: its table of byte steps, and a reduction over the bytes of a string.
BYTE_TABLE = """byte_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
)"""

EXACT_COPIES = """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
               sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """

TOP_K = """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """

RESAMPLED = f"""
WITH {BYTE_TABLE}, words AS (
    SELECT 'd' AS side, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS found FROM documents
    UNION ALL
    SELECT 'b', NULL, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), numbered AS (
    SELECT side, doc_id, found, row_number() OVER () AS place FROM words
), singles AS (
    SELECT side, place, unnest(found) AS word FROM numbered
), spelled AS (
    SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM singles)
), coded AS (
    SELECT word, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
    FROM spelled, byte_table
), hits AS (
    SELECT place, side, bucket, count(*) AS n FROM singles JOIN coded USING (word) GROUP BY ALL
), sums AS (
    SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM hits GROUP BY bucket
), totals AS (
    SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM sums
), gained AS (
    SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000))
        / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals
), weighed AS (
    SELECT place, sum(n * gain)::BIGINT AS weight FROM hits JOIN gained USING (bucket) GROUP BY place
), scored AS (
    SELECT doc_id, len(found)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
               + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM numbered LEFT JOIN weighed USING (place) WHERE side = 'd'
), placed AS (
    SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
           count(*) FILTER (n_features >= 20) OVER () AS fitting
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fitting // 100 THEN place END AS rank FROM placed
"""

REPAIRED = f"""
WITH RECURSIVE {BYTE_TABLE}, named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), picked AS (
    SELECT * EXCLUDE (name), xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) % 20 AS pick
    FROM named, byte_table
), damaged AS (
    SELECT conv_id, turn, copy, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
           CASE pick WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM picked, (VALUES (0), (1)) AS c(copy) WHERE pick <> 0 AND (copy = 0 OR pick = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place
    FROM damaged
), judged AS (
    SELECT conv_id, turn, place, role, text, substr(role, 1, 1) AS initial,
           CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated'
                ELSE 'sound' END AS fault,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
    FROM placed
), told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
    FROM judged GROUP BY conv_id
), inserting(state, letters, reached) AS (
    VALUES ('0', '', '0'), ('0', 'I', 'u'), ('0', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'),
           ('u', '', 'u'), ('u', 'I', 'a'), ('a', '', 'a'), ('a', 'I', 'u')
), search(conv_id, place, state, best) AS (
    SELECT conv_id, 0::BIGINT, '0', {{'cost': 0::BIGINT, 'audit': ''}} FROM told
    UNION ALL
    SELECT conv_id, place, state, min({{'cost': cost, 'audit': audit}}) FROM (
        SELECT s.conv_id, j.place, CASE e.edit WHEN 'D' THEN i.reached WHEN 'K' THEN j.initial
                   ELSE CASE i.reached WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
               s.best.cost + 3 * length(i.letters) + CASE e.edit WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END
                   + CASE WHEN j.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost,
               s.best.audit || i.letters || e.edit AS audit
        FROM search s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.place = s.place + 1
        JOIN inserting i ON i.state = s.state, (VALUES ('D'), ('K'), ('R')) AS e(edit)
        WHERE e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R'
            OR i.reached || j.initial IN ('0s', '0u', 'su', 'ua', 'au'))
    ) GROUP BY conv_id, place, state
), solved AS (
    SELECT t.conv_id, min({{'cost': s.best.cost + 3 * length(i.letters), 'audit': s.best.audit || i.letters}}) AS best
    FROM told t JOIN search s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.place = t.n
    JOIN inserting i ON i.state = s.state WHERE i.reached IN ('0', 'a') GROUP BY t.conv_id
), letters AS (
    SELECT conv_id, spot, substr(best.audit, spot, 1) AS edit,
           length(translate(substr(best.audit, 1, spot), 'I', '')) AS place
    FROM solved, unnest(range(1, length(best.audit) + 1)) AS r(spot)
), stay AS (
    SELECT l.conv_id, edit, coalesce(j.role, '') AS role, coalesce(j.text, '') AS text, initial,
           row_number() OVER (PARTITION BY l.conv_id ORDER BY spot) AS nth
    FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.place = l.place AND edit <> 'I'
    WHERE edit <> 'D'
), shifted AS (
    SELECT *, nth - max(CASE WHEN nth = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS seat
    FROM stay
), mended AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN seat % 2 = 1 THEN 'user' ELSE 'assistant' END
               || ':' || text, chr(10) ORDER BY nth) AS lines FROM shifted GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": EXACT_COPIES,
    "op5_topk": TOP_K,
    "op11_resample": RESAMPLED,
    "op13_conversations": REPAIRED,
}
