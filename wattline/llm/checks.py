"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from wattline.llm import filter_audit as audit, mixing as mix, quality_rules as rules, vector_codes as codes

WORD = "[^\\x20\\x09-\\x0D]+"


def quality_rules() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (SELECT r, source, t, len(regexp_extract_all(x, '{WORD}')) AS n,
                 trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h
          FROM (SELECT r, source, t, unnest(l) AS x FROM w)),
often AS (SELECT source, h FROM lines WHERE n <= {rules.MAX_LINE_WORDS} GROUP BY source, h HAVING count(DISTINCT t) > {rules.MAX_DOCUMENTS}),
gone AS (SELECT r, sum(n)::BIGINT AS n FROM lines JOIN often ON lines.source IS NOT DISTINCT FROM often.source AND lines.h = often.h
         WHERE n <= {rules.MAX_LINE_WORDS} GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {rules.MIN_KEPT} * n_words AS kept
FROM f"""


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _shuffled(start: str, source: str, turn: str, size: str, table: str, carry: str) -> str:
    """Swap-or-not rounds as nested selects; the result is column ``x`` beside the carried ones."""
    sql = f"SELECT {carry}, {start} AS x FROM {table}"
    for i in range(mix.ROUNDS):
        key = f"{source} || '|' || {turn} || '|{i}'"
        sql = f"SELECT {carry}, x, ((({_number(key)} - x) % {size}) + {size}) % {size} AS y, {key} AS key FROM ({sql})"
        sql = f"SELECT {carry}, CASE WHEN substr(md5(key || '|' || greatest(x, y)), 1, 1) < '8' THEN y ELSE x END AS x FROM ({sql})"
    return sql


def mixing() -> str:
    weights = ", ".join(map(str, mix.WEIGHTS))
    pick = _shuffled("j", "s", "turn", "blocks", "(SELECT *, unnest(range(blocks)) AS j, least(passes, 1) AS one FROM turns WHERE blocks > 0)", "s, turn, blocks, passes, rest, short, j")
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || coalesce(text, '')) AS digest FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM d GROUP BY source),
weighed AS (SELECT *, ([{weights}])[(s % {len(mix.WEIGHTS)} + 1)::INT]::BIGINT AS weight FROM per),
level AS (SELECT *, ({mix.VOLUME}::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum({mix.MOST} * source_size) OVER o, 0)::BIGINT)
                 / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT)::DOUBLE AS level
          FROM weighed WINDOW o AS (ORDER BY {mix.MOST} * source_size / weight::DOUBLE, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(level, ({mix.MOST} * source_size / weight::DOUBLE, s)) AS free FROM level WHERE level * weight < {mix.MOST} * source_size),
goal AS (SELECT *, CASE WHEN level * weight >= {mix.MOST} * source_size THEN ({mix.MOST} * source_size)::DOUBLE ELSE free * weight END AS target FROM level, free),
cut AS (SELECT *, floor(target + 0.5)::BIGINT AS words, ceil(source_size / {mix.BLOCK}::DOUBLE)::BIGINT AS blocks FROM goal),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest,
                blocks * {mix.BLOCK} - source_size AS short FROM cut),
turns AS (SELECT *, unnest(range(passes + 1)) AS turn FROM plan),
perm AS ({pick}),
run AS (SELECT s, turn, x AS block, passes, rest, {mix.BLOCK} - CASE WHEN x = blocks - 1 THEN short ELSE 0 END AS n,
               coalesce(sum({mix.BLOCK} - CASE WHEN x = blocks - 1 THEN short ELSE 0 END) OVER (PARTITION BY s, turn ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM perm),
mix AS (SELECT s, block, CASE WHEN turn < passes THEN n ELSE greatest(0, least(n, rest - before)) END AS taken FROM run),
placed AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.s, row_number() OVER () AS r,
                  coalesce(sum(d.size) OVER (PARTITION BY p.s ORDER BY d.digest, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
got AS (SELECT r, sum(greatest(0, least(start + size, block * {mix.BLOCK} + taken) - greatest(start, block * {mix.BLOCK})))::BIGINT AS taken
        FROM placed JOIN mix ON placed.s = mix.s AND block BETWEEN start // {mix.BLOCK} AND (start + size - 1) // {mix.BLOCK} GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN got USING (r)"""


def filter_audit() -> str:
    letters = ", ".join(f"({i}, '{f}')" for i, f in enumerate(audit.FILTERS))
    apart = " AND ".join(f"f{i}.i <> f{j}.i" for i in range(5) for j in range(i))
    places = " UNION ALL ".join(
        f"SELECT {' || '.join(f'f{i}.f' for i in range(5))} AS filter_order, {s + 1} AS step, 1 << f{s}.i AS bit, {' + '.join(['0'] + [f'(1 << f{i}.i)' for i in range(s)])} AS before "
        f"FROM l f0, l f1, l f2, l f3, l f4 WHERE {apart}"
        for s in range(5)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, good, toxic, CASE WHEN len(w) < {audit.MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {audit.MIN_DISTINCT} * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.MAX_CAPITALS} * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '{audit.SYMBOLS}') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN marks USING (doc_id)),
l AS (SELECT * FROM (VALUES {letters}) AS v(i, f)),
steps AS ({places})
SELECT part, filter_order, step, count(*) FILTER (mask & (bit | before) = 0)::BIGINT AS kept, count(*) FILTER (mask & bit <> 0 AND mask & before = 0)::BIGINT AS removed,
       count(*) FILTER (mask & bit <> 0 AND mask & before <> 0)::BIGINT AS redundant, count(*) FILTER (mask = bit)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & bit <> 0 THEN 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM m, steps GROUP BY part, filter_order, step"""


def vector_codes() -> str:
    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT r, p, min(e) AS e, min(d) AS d FROM (
    SELECT *, min(d) OVER (PARTITION BY r, p) AS least FROM (SELECT r, v.p, e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN b{i} b ON v.p = b.p AND v.j = b.j GROUP BY r, v.p, e)) WHERE d = least GROUP BY r, p)"""

    def moved(i: int) -> str:
        return f"""b{i} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(floor(sum(x2)::DOUBLE / count(x2))::BIGINT, any_value(b.x)) AS x FROM b{i - 1} b
    LEFT JOIN (SELECT a.p, a.e, v.j, v.x AS x2 FROM a{i - 1} a JOIN v ON a.r = v.r AND a.p = v.p) s ON b.p = s.p AND b.e = s.e AND b.j = s.j GROUP BY b.p, b.e, b.j)"""

    rounds = ",\n".join(f"{assigned(i)},\n{moved(i + 1)}" for i in range(codes.ROUNDS))
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT (max(len(embedding)) + {codes.PARTS - 1}) // {codes.PARTS} AS w FROM k),
v AS MATERIALIZED (SELECT r, n // w AS p, n % w AS j, floor({codes.SCALE} * coalesce(embedding[n + 1], 0)::DOUBLE)::BIGINT AS x
                   FROM (SELECT r, embedding, w, unnest(range(w * {codes.PARTS})) AS n FROM k, wide)),
b0 AS MATERIALIZED (SELECT p, e, j, x FROM v JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM k) USING (r) WHERE e < {codes.ENTRIES}),
{rounds},
{assigned(codes.ROUNDS)},
c AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY r),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), s"""
