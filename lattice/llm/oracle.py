"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_RULE_NAMES = ("short", "repetition", "symbols", "duplicate_lines", "word_length")
_QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM w WHERE len(words) > 2),
grams AS (SELECT doc_id, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS g FROM windows),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
rules AS (SELECT host, unnest(['short', 'repetition', 'symbols', 'duplicate_lines', 'word_length']) AS rule,
            unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars, 2 * n_dup_lines > n_lines,
                    word_chars < 2 * n_words OR word_chars > 15 * n_words]) AS failed FROM m),
hosts AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INT)) AS DOUBLE) AS f FROM rules GROUP BY ALL),
means AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS total, count(*) AS h FROM hosts GROUP BY rule),
spread AS (SELECT rule, mean, sum(n * (f / n - mean) ** 2) / any_value(total) - mean * (1 - mean) * any_value(h) / any_value(total) AS between_hosts
           FROM hosts JOIN means USING (rule) GROUP BY rule, mean),
prior AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM spread),
limits AS (SELECT rule, mean, k, least(greatest(mean + 3.0 * sqrt(mean * (1 - mean) / (k + 1)), 0.2), 0.5) AS bound FROM prior),
rated AS (SELECT host, rule, n, f, (f + mean * k) / (n + k) AS rate, bound FROM hosts JOIN limits USING (rule)),
verdict AS (SELECT host, CAST(any_value(n) AS BIGINT) AS host_docs, max(CAST(rate > bound AS INT)) = 1 AS host_rejected,
    {", ".join(f"CAST(max(f) FILTER (rule = '{r}') AS BIGINT) AS fails_{r}, round(max(rate) FILTER (rule = '{r}'), 6) AS rate_{r}, round(max(bound) FILTER (rule = '{r}'), 6) AS limit_{r}" for r in _RULE_NAMES)}
  FROM rated GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_rejected AS kept, verdict.* FROM m JOIN verdict USING (host)
"""

_TRIM = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_LINES = rf"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
totals AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT host, unnest(list_distinct(list_transform(ls, lambda x: {_TRIM}))) AS line FROM p),
boiler AS (SELECT host, list(line) AS bad FROM (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL) JOIN totals USING (host)
           WHERE n >= 2 AND n / total > 0.1 GROUP BY host),
j AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), {_TRIM})) AS kept FROM p LEFT JOIN boiler USING (host))
SELECT doc_id, CAST(len(list_filter(ls, lambda x: {_TRIM} <> '')) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM j
"""

_REST = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^?#]*)', 1)"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p in (("example.org", "/en/1"), ("example.org", "/es/"), ("com", "/fr/"), ("com", "/de/"), ("org", "/"))
)
_URLS = rf"""
WITH r AS (SELECT page_id, translate(regexp_extract({_REST}, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract({_REST}, '(?s)^[^/]*(/.*)$', 1) AS path FROM pages),
f AS (SELECT *, CASE {_FITS} END AS rule FROM r)
SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


_SHARDS = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
c AS (SELECT row, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda a, b: xor(a // 256, step[xor(a % 256, b) + 1])), 4294967295) AS text_crc32 FROM d, crc),
u AS (SELECT row, k, 1.0 / -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || k), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE)) AS score FROM d, range(25) t(k)),
b AS (SELECT row, arg_max(k, score) FILTER (k < 24) AS shard, arg_max(k, score) AS grown_shard FROM u GROUP BY row),
s AS (SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, CAST(shard AS INT) AS shard, CAST(grown_shard AS INT) AS grown_shard FROM d JOIN c USING (row) JOIN b USING (row))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind, regex, group and least characters of each rule of the scan, for DuckDB's regexes.
_RULES = (
    ("assign", rf"""({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("github", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", "-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
)


def _found(k: int, kind: str, regex: str, group: int, least: int) -> str:
    """Matches of a rule with their places: the pieces between matches and the matches themselves add up."""
    quoted = regex.replace("'", "''")
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, a, a + length(m) AS b FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(1, len(ms) + 1),
      lambda i: list_sum(list_transform(ps[:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda p: length(p))), 0))) AS a
    FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, regexp_extract_all(text, '{quoted}', {group}) AS gs, regexp_split_to_array(text, '{quoted}') AS ps FROM d WHERE regexp_matches(text, '{quoted}'))) WHERE length(g) >= {least}"""


_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(_found(k, *r) for k, r in enumerate(_RULES))}),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""


def _mixing(keep: float, temper: dict[str, float], lift: float, rounds: int) -> str:
    """Raking unrolled: one CTE for each margin of each round."""
    margins, steps, last = list(temper), [], "r0"
    for k in range(1, rounds * len(margins) + 1):
        m = margins[(k - 1) % len(margins)]
        steps.append(f"r{k} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN whole > 0 THEN weight * t_{m} / whole ELSE 0 END AS weight) FROM (SELECT * EXCLUDE (whole), sum(weight) OVER (PARTITION BY {m}) AS whole FROM {last}))")
        last = f"r{k}"
    targets = ",\n".join(
        f"""h_{m} AS (SELECT {m}, sum(tokens) AS held FROM cells GROUP BY {m} HAVING sum(tokens) > 0),
c_{m} AS (SELECT {m}, {lift} * held / (SELECT sum(held) FROM h_{m}) AS most, least(pow(held, {e}) / (SELECT sum(pow(held, {e})) FROM h_{m}), {lift} * held / (SELECT sum(held) FROM h_{m})) AS share FROM h_{m}),
g_{m} AS MATERIALIZED (SELECT {m}, share + (most - share) * (SELECT coalesce((1 - sum(share)) / nullif(sum(most - share), 0), 0) FROM c_{m}) AS t_{m} FROM c_{m})"""
        for m, e in temper.items()
    )
    joins = " ".join(f"LEFT JOIN g_{m} USING ({m})" for m in margins)
    columns = ", ".join(f"coalesce(t_{m}, 0) AS t_{m}" for m in margins)
    residuals = ", ".join(f"(SELECT max(abs(w - t)) FROM (SELECT sum(weight) AS w, max(t_{m}) AS t FROM {last} GROUP BY {m})) AS residual_{m}" for m in margins)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
             CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!! ') THEN 'loud' WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{{3}}') THEN 'markup' ELSE 'prose' END AS topic,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
{targets},
r0 AS MATERIALIZED (SELECT source, lang, topic, tokens, {columns}, tokens / (SELECT sum(tokens) FROM cells) AS weight, 0.0 AS whole FROM cells {joins}),
{", ".join(steps)},
a AS (SELECT least({keep} * sum(tokens), min(tokens / weight) FILTER (weight > 0)) AS total, {residuals} FROM {last}),
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight * total / tokens ELSE 0 END AS probability, a.* FROM {last}, a)
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability, round(total, 3) AS total, {", ".join(f"round(residual_{m}, 7) AS residual_{m}" for m in margins)}
FROM d JOIN p USING (source, lang, topic)
WHERE CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < probability
"""


ORACLE: dict[str, str] = {"op5_quality_rules": _QUALITY, "op6_rendezvous_sharding": _SHARDS, "op10_secret_scans": _SECRETS, "op7_line_dedup": _LINES, "op8_source_mixing": _mixing(0.6, {"source": 0.5, "lang": 0.7, "topic": 0.7}, 1.25, 48), "op9_url_filters": _URLS}
