"""The results of the registered queries in SQL, over the same tables, where SQL can express them.

Without SQL: the scorer and the language model are fitted, packing is greedy, fingerprints need XXH64, spans of personal
data need matches of patterns with their places, and repairs of conversations a search over states. These are tested against
plain versions.
"""

from __future__ import annotations

import re

from . import fill_middle, licences, line_rules, mixing, passages, url_filter

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = r"[\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _line_rules() -> str:
    phrases = " OR ".join(f"contains(lower(l), {_quoted(p)})" for p in line_rules.BOILERPLATE)
    # The same characters as RE2 writes them.
    ends = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", line_rules.SENTENCE_ENDS).replace(r"\p{Is", r"\p{")
    fails = rf"""(len(regexp_extract_all(l, '[\x{{7C}}\x{{B7}}\x{{BB}}]|[#*$%&<>=~^!?]{{2,}}')) * {line_rules.CHARACTERS_PER_SIGN}
            >= greatest(length(l), 1)
        OR (length(l) >= {line_rules.LEAST_CAPITALS} AND NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '\p{{Lu}}')
            AND 2 * len(regexp_extract_all(l, '\p{{Lu}}')) > len(regexp_extract_all(l, '\p{{L}}')))
        OR (length(l) >= {line_rules.LONG_LINE} AND NOT regexp_matches(l, '{ends}'))
        OR (length(l) <= {line_rules.SHORT_LINE} AND ({phrases})))"""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
    g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
          FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
    again AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p
              FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM g) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM again GROUP BY rid),
    l AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
    ll AS (SELECT rid, count(*) - count(DISTINCT l) AS dup,
                  coalesce(sum(length(regexp_replace(l, '{BLANK}', '', 'g'))) FILTER (WHERE {fails}), 0) AS lost
           FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
    c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                 coalesce(lost, 0)::BIGINT AS lost_chars
          FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN ll USING (rid)),
    b AS (SELECT *, n_words < {line_rules.MIN_WORDS}
                 OR 100 * n_repeat_words > {line_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c)
    SELECT *, NOT base_failed AND 100 * lost_chars <= {line_rules.MAX_LOST_PERCENT} * word_chars AS kept FROM b"""


def _decontamination() -> str:
    words = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM (
                   SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, ws, least(len(ws), 10) AS k FROM (
              SELECT item_id, {words} AS ws FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark))
          WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS t
           FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
    dw AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS t
           FROM (SELECT rid, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS i
                 FROM d, (SELECT DISTINCT k FROM bw))),
    h AS (SELECT rid, i, k, item FROM dw JOIN bw USING (k, t)),
    n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
    m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""


def _mixing() -> str:
    weights = "[" + ", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS) + "]"
    return rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')) AS key
               FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, source_size * {mixing.MOST}::DOUBLE AS cap,
                 {weights}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
                 row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
    f AS (SELECT *, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER before, 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS rate
          FROM r WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT *, (SELECT rate FROM f WHERE cap > rate * weight ORDER BY cap / weight, place LIMIT 1) AS open_rate FROM f),
    t AS (SELECT source, source_size, CASE WHEN cap <= rate * weight THEN cap ELSE open_rate * weight END AS target FROM o),
    p AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
    SELECT doc_id, size, source_size, round(target, 6) AS target,
           (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken FROM e"""


def _urls() -> str:
    rules = sorted(url_filter.RULES, key=lambda rule: -len(rule[1] + rule[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", v, h + p) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {fit} THEN '{name}'" for fit, _, name in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {fit} THEN '{verdict}'" for fit, verdict, _ in fits) + " END"
    return rf"""
    WITH a AS (SELECT page_id, coalesce(url, '') AS url,
                      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
    q AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
                 AND NOT regexp_matches(x, '^(?:{"|".join(url_filter.TRACKING)})(?:=|$)'))) AS kept FROM h),
    c AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN
                 regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM q),
    listed AS (SELECT DISTINCT canonical FROM c
               WHERE regexp_matches(host, '(^|\.)({"|".join(url_filter.LISTED_LABELS)})'))
    SELECT page_id, host, path, {rule} AS rule, l.canonical IS NOT NULL AS listed,
           coalesce({said}, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM c LEFT JOIN listed l USING (canonical)"""


def _licences() -> str:
    known = " ".join(f"WHEN {_quoted(t)} THEN '{name}'" for name, texts in licences.SENTENCES.items() for t in texts)
    notices = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{name}'" for name, p in reversed(licences.NOTICES.items()))
    steps, rest = [], "ids"
    for i, (licence, kind, parts) in enumerate(licences.RULES):
        wanted = "".join(f" {part} " for part in parts)
        steps.append(f"r{i} AS (SELECT * REPLACE (CASE WHEN contains(rest, '{wanted}') THEN list_append(found, '{licence} {kind}') "
                     f"ELSE found END AS found, replace(rest, '{wanted}', ' | ') AS rest) FROM {rest})")
        rest = f"r{i}"
    strictest = " ".join(f"WHEN list_contains(classes, '{c}') THEN '{c}'" for c in licences.CLASSES)
    return rf"""
    WITH s AS (SELECT doc_id, list_transform(regexp_split_to_array(
                   regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[\x0A\x0D]+'),
                   lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS sentences FROM documents),
    i AS (SELECT doc_id, list_filter(list_transform(sentences, lambda x: coalesce(
                   CASE x {known} END, CASE {notices} END)), lambda x: x IS NOT NULL) AS names FROM s),
    ids AS (SELECT doc_id, names, []::VARCHAR[] AS found,
                   array_to_string(list_transform(names, lambda x: ' ' || x || ' '), '') AS rest FROM i),
    {", ".join(steps)},
    u AS (SELECT doc_id, names, list_filter(found, lambda x, k: list_position(found, x) = k) AS pairs FROM {rest}),
    v AS (SELECT doc_id, names, list_transform(pairs, lambda x: string_split(x, ' ')[1]) AS names_found,
                 list_transform(pairs, lambda x: string_split(x, ' ')[2]) AS classes FROM u)
    SELECT doc_id, len(names)::BIGINT AS n_sentences, array_to_string(names, ',') AS identifiers,
           array_to_string(names_found, ',') AS licences, CASE {strictest} ELSE 'none' END AS class FROM v"""


def _fill_middle() -> str:
    prefix, suffix, middle = fill_middle.MARKERS
    h = [f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT" for i in range(4)]
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
               FROM documents),
    k AS (SELECT doc_id, t, length(t) AS n, {h[0]} % (length(t) + 1) AS a, {h[1]} % (length(t) + 1) AS b,
                 CASE WHEN t = '' OR contains(t, '{prefix}') OR contains(t, '{suffix}') OR contains(t, '{middle}')
                           OR {h[2]} % 100 >= {fill_middle.PLAIN_FROM} THEN 'plain'
                      WHEN {h[3]} % 100 < {fill_middle.SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
    c AS (SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
                 substr(t, greatest(a, b) + 1) AS s FROM k)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{prefix}' || p || '{suffix}' || s || '{middle}' || m
                  ELSE '{suffix}' || s || '{prefix}' || p || '{middle}' || m END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM c"""


def _passages() -> str:
    last = passages.WINDOW - 1
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                      substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 16) AS digest
               FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    w AS (SELECT rid, doc_id, digest, i, array_to_string(ws[i:i + {last}], ' ') AS t
          FROM (SELECT *, unnest(range(1, len(ws) - {last - 1})) AS i FROM d WHERE len(ws) > {last})),
    f AS (SELECT *, first(struct_pack(doc_id, digest, i) ORDER BY doc_id NULLS LAST, digest < '8', digest, i)
                 OVER (PARTITION BY t) AS owner FROM w),
    g AS (SELECT DISTINCT rid, unnest(range(i, i + {last + 1})) AS p FROM f
          WHERE owner IS DISTINCT FROM struct_pack(doc_id, digest, i)),
    n AS (SELECT rid, count(*) AS n, list(p) AS gone FROM g GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
           sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
                  ELSE array_to_string(list_filter(ws, lambda x, k: NOT list_contains(gone, k)), ' ') END) AS kept_sha256
    FROM d LEFT JOIN n USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_bloom_filter": _urls(),
        "op3_benchmark_windows": _decontamination(),
        "op6_source_mixing": _mixing(),
        "op9_line_rules": _line_rules(),
        "op10_license_sentences": _licences(),
        "op12_fill_middle": _fill_middle(),
        "op13_difference_cover": _passages(),
    }
