"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations


def mixing_sql(share: float = 0.8, rounds: int = 40, max_copies: float = 4.0) -> str:
    """Raking unrolled round by round, the scale by cumulative sums over cells in order of the scales at which they are full.

    Three draws: with at most `max_copies` of a document, with any number (target), with one at most (once)."""
    dims = {"source": 0.5, "lang": 0.7, "topic": 0.8}
    cte = [r"""items AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
 CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
  WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'marks' WHEN regexp_matches(text, '[0-9]{4}') THEN 'figures' ELSE 'prose' END AS topic,
 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)""",
           "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM items GROUP BY ALL HAVING sum(tokens) > 0)",
           "r0 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM cells)"]
    for d, power in dims.items():
        cte.append(f"t_{d} AS (SELECT {d}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target FROM cells GROUP BY {d})")
    at = 0
    for _ in range(rounds):
        for d in dims:
            cte.append(f"r{at + 1} AS MATERIALIZED (SELECT r{at}.* REPLACE (w * target / sum(w) OVER (PARTITION BY {d}) AS w) FROM r{at} JOIN t_{d} USING ({d}))")
            at += 1
    cte.append(f"""goal AS (SELECT {share} * sum(tokens) AS g FROM cells)""")
    for x, cap in (("", max_copies), ("_once", 1.0)):
        cte.append(f"""sorted{x} AS (SELECT *, {cap} * sum(tokens) OVER o AS filled, 1 - sum(w) OVER o AS open_w, {cap} * tokens / w AS point,
 lead({cap} * tokens / w, 1, 1e300) OVER (ORDER BY tokens / w, source, lang, topic) AS next_point FROM r{at}
 WINDOW o AS (ORDER BY tokens / w, source, lang, topic ROWS UNBOUNDED PRECEDING))""")
        cte.append(f"""scale{x} AS (SELECT min(s) AS s{x} FROM (SELECT g AS s FROM goal WHERE g <= (SELECT min(point) FROM sorted{x})
 UNION ALL SELECT (g - filled) / open_w FROM sorted{x}, goal WHERE open_w > 1e-12 AND (g - filled) / open_w >= point AND (g - filled) / open_w < next_point))""")
    cte.append(f"""rated AS (SELECT source, lang, topic, w, least({max_copies}, s * w / tokens) AS rate, g * w / tokens AS target_rate,
 least(1.0, s_once * w / tokens) AS once_rate FROM r{at}, goal, scale, scale_once)""")
    draws = ",\n".join(f""" round(coalesce({d}rate, CASE WHEN items.tokens > 0 THEN 0.0 ELSE 1.0 END), 6) AS {d}rate,
 CAST(floor(coalesce({d}rate, 1.0)) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) / 4294967296.0
  < coalesce({d}rate, 1.0) - floor(coalesce({d}rate, 1.0)) THEN 1 ELSE 0 END AS INTEGER) AS {d}copies""" for d in ("", "target_", "once_"))
    return "WITH " + ",\n".join(cte) + f"""
SELECT doc_id, source, lang, topic, items.tokens AS tokens, round(coalesce(w, 0), 6) AS weight,
{draws}
FROM items LEFT JOIN rated USING (source, lang, topic)"""


def near_vectors_sql(threshold: float = 0.95) -> str:
    """All pairs by brute force, components by reachability."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
r(p, q) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.p, l.q FROM r JOIN l ON l.p = r.q),
c AS (SELECT p, min(q) AS component_id FROM r GROUP BY p), n AS (SELECT p, count(*) AS n FROM l GROUP BY p)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept FROM v JOIN c ON c.p = vec_id LEFT JOIN n ON n.p = vec_id"""


def archives_sql() -> str:
    """What a lossless archive gives back: sizes, SHA-1 in base32 (eight letters for each ten hex digits), first pages of equal payloads."""
    letter = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || x[10 * (i // 8) + 1:10 * (i // 8) + 10] AS UBIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1]"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages), d AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {letter}), '') AS payload_digest,
 CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM d"""
