"""The operators' results as DuckDB SQL, over the same tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH line AS (
  SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS d, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, {_LOWER.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS k FROM line),
hot AS (SELECT k, max(d) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT d) >= 3),
judged AS (SELECT l.*, h.k IS NOT NULL AND l.d <> h.keeper AS gone FROM keyed l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (
  SELECT item_id, list_slice(w, i, least(i + 9, len(w))) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
spot AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM spot JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_METRICS = ("m_symbols", "m_dup_lines", "m_repeats", "m_upper", "m_word_len")

OP4 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
gram AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM gram GROUP BY doc_id, g HAVING count(*) >= 2),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM gram JOIN twice USING (doc_id, g)) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         len(l) AS n_text_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS m_symbols,
         n_dup_lines * 1000 // greatest(n_text_lines, 1) AS m_dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS m_repeats,
         n_upper * 1000 // greatest(word_chars, 1) AS m_upper,
         word_chars * 100 // greatest(n_words, 1) AS m_word_len FROM c),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE n_words > 0" for m in _METRICS)}),
sketch AS (
  SELECT lang, source, metric, v - v % (CASE WHEN length(bin(v)) > 6 THEN 1 << (length(bin(v)) - 6) ELSE 1 END) AS bucket, count(*) AS n
  FROM v GROUP BY ALL),
crp AS (SELECT metric, bucket, sum(n) / sum(sum(n)) OVER (PARTITION BY metric) AS share FROM sketch GROUP BY metric, bucket),
lng AS (SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY lang, metric, bucket),
mix AS (
  SELECT z.lang, z.metric, c.bucket, (coalesce(lng.n, 0) + 100 * c.share) / (z.docs + 100) AS part
  FROM (SELECT lang, metric, sum(n) AS docs FROM lng GROUP BY lang, metric) z JOIN crp c USING (metric)
  LEFT JOIN lng ON lng.lang IS NOT DISTINCT FROM z.lang AND lng.metric = z.metric AND lng.bucket = c.bucket),
bl AS (
  SELECT g.lang, g.source, g.metric, mix.bucket, 100 * mix.part + coalesce(s.n, 0) AS w
  FROM (SELECT DISTINCT lang, source, metric FROM sketch) g
  JOIN mix ON mix.lang IS NOT DISTINCT FROM g.lang AND mix.metric = g.metric
  LEFT JOIN sketch s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.metric = g.metric AND s.bucket = mix.bucket),
up AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, metric) AS al, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto FROM bl),
cuts AS (
  SELECT lang, source, metric, floor(q90 + 5 * (q90 - q50 + mean) + 1e-6) AS cut FROM (
    SELECT lang, source, metric, min(bucket) FILTER (upto >= 0.5 * al - 1e-6) AS q50, min(bucket) FILTER (upto >= 0.9 * al - 1e-6) AS q90,
           sum(bucket * w) / max(al) AS mean FROM up GROUP BY lang, source, metric)),
wide AS (
  SELECT lang, source, {", ".join(f"max(cut) FILTER (metric = '{m}') AS cut_{m}" for m in _METRICS)} FROM cuts GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({m} <= cut_{m}, true)" for m in _METRICS)} AS kept
FROM m LEFT JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang AND m.source IS NOT DISTINCT FROM wide.source
"""


def _mixing(share: float, power: float, iterations: int, rounds: int) -> str:
    from marginalia.llm.mixing import TOPICS, topic_words

    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x, of in topic_words().items() if of == t)}))) AS n_{t}" for t in TOPICS)
    most = f"greatest({', '.join(f'n_{t}' for t in TOPICS)})"
    named = " ".join(f"WHEN {most} > 0 AND n_{t} = {most} THEN '{t}'" for t in sorted(TOPICS))
    without = lambda marks: f"length(text) - length(regexp_replace(text, '[{marks}]+', '', 'g'))"
    parts = [rf"""
word AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hit AS (SELECT *, {hits} FROM word),
docs AS MATERIALIZED (
  SELECT doc_id, source, lang, len(w) AS n_tokens,
         CASE WHEN len(w) = 0 THEN 'empty' {named}
              WHEN ({without("|")}) * 50 > length(text) THEN 'table'
              WHEN ({without("#*$%&<>{}=;")}) * 20 > length(text) THEN 'symbols'
              WHEN ({without("0-9")}) * 10 > length(text) THEN 'figures' ELSE 'general' END AS topic
  FROM hit),
cell AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL)"""]
    for m in ("source", "lang", "topic"):
        parts.append(
            f"t_{m} AS MATERIALIZED (SELECT {m} AS v, power(t, {power}) / sum(power(t, {power})) OVER () AS target "
            f"FROM (SELECT {m}, sum(tokens) AS t FROM cell GROUP BY {m} HAVING sum(tokens) > 0))"
        )
    now = "(SELECT *, tokens::DOUBLE AS weight FROM cell WHERE tokens > 0)"
    for i in range(iterations):
        for m in ("source", "lang", "topic"):
            parts.append(
                f"w_{i}_{m} AS MATERIALIZED (SELECT source, lang, topic, tokens, "
                f"weight * (target / sum(weight) OVER (PARTITION BY {m})) AS weight FROM {now} x JOIN t_{m} t ON x.{m} IS NOT DISTINCT FROM t.v)"
            )
            now = f"w_{i}_{m}"
    parts.append(f"k_0 AS MATERIALIZED (SELECT {share} * sum(tokens) AS wanted, {share} * sum(tokens) AS scale FROM {now})")
    for r in range(1, rounds + 1):
        parts.append(
            f"k_{r} AS MATERIALIZED (SELECT wanted, CASE WHEN rest > 0 THEN (wanted - done) / rest ELSE scale END AS scale FROM ("
            f"SELECT any_value(wanted) AS wanted, any_value(scale) AS scale, "
            f"sum(CASE WHEN weight * scale >= tokens THEN tokens ELSE 0 END) AS done, "
            f"sum(CASE WHEN weight * scale >= tokens THEN 0.0::DOUBLE ELSE weight END) AS rest FROM {now}, k_{r - 1}))"
        )
    parts.append(f"p AS (SELECT w.*, least(1.0::DOUBLE, weight * scale / tokens) AS p FROM {now} w, k_{rounds})")
    return f"""
WITH {", ".join(parts)}
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(weight, 0.0), 9) AS weight,
       round(CASE WHEN n_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END, 9) AS p,
       ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0
         < CASE WHEN n_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END AS kept
FROM docs d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang
  AND d.topic IS NOT DISTINCT FROM p.topic
"""


OP9 = _mixing(0.5, 0.5, 100, 12)
