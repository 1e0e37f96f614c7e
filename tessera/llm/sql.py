"""SQL twins of the registered queries, where SQL can express them."""

from __future__ import annotations

EXACT = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS original,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(original) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(original) DESC, doc_id) AS kept,
       sha256(plain) AS text_sha256
FROM d
"""


AUDIT = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
    FROM documents
), said AS (
    SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(said.toxic, 0) AS toxic,
           (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS mask
    FROM w LEFT JOIN said ON said.doc_id = w.doc_id
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
    SELECT '' AS filter_order, 0 AS step, 0 AS used, 0 AS bit, 0 AS before, []::INT[] AS bits
    UNION ALL
    SELECT filter_order || letter, step + 1, used | letters.bit, letters.bit, used, list_append(bits, letters.bit) FROM o, letters WHERE used & letters.bit = 0
), full_orders AS (SELECT filter_order, unnest(bits) AS bit, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o WHERE step = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM full_orders)
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
FROM c, steps GROUP BY part, filter_order, step, bit, before
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT, "op13_filter_audit": AUDIT}
