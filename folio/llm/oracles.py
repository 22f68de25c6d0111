"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

from folio.llm import mixing, sharding
from folio.llm.queries import LIST_LOG


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def sharding_sql() -> str:
    n, m = len(sharding.SHARDS), sharding.TABLE_SIZE
    names = ", ".join(f"({k}, '{s}')" for k, s in enumerate(sharding.SHARDS))
    return f"""
WITH RECURSIVE shards(k, name) AS (VALUES {names}),
seed AS (SELECT k, name, {_hash("name || ':offset'")} % {m} AS start, {_hash("name || ':skip'")} % {m - 1} + 1 AS skip FROM shards),
fill(turn, slot, taken) AS (
  SELECT 0, start, list_transform(range({m}), lambda x: x = start) FROM seed WHERE k = 0
  UNION ALL
  SELECT turn, slot, list_transform(taken, lambda t, i: t OR i = slot + 1) FROM (
    SELECT f.turn + 1 AS turn, f.taken, list_filter(list_transform(range({m}), lambda j: (s.start + j * s.skip) % {m}), lambda x: NOT f.taken[x + 1])[1] AS slot
    FROM fill f JOIN seed s ON s.k = (f.turn + 1) % {n} WHERE f.turn < {m - 1})
),
owner AS (SELECT slot, name AS shard FROM fill JOIN shards ON k = turn % {n}),
placed AS (SELECT doc_id, {_hash("coalesce(doc_id::VARCHAR, '')")} % {m} AS slot FROM documents)
SELECT doc_id, slot::INTEGER AS slot, shard FROM placed JOIN owner USING (slot)
"""


def mixing_sql() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    return rf"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}:' || coalesce(text, '')) AS digest FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, digest, doc_id, text) AS rank FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{weights}][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(mixing.WEIGHTS)}] AS weight,
    source_size * {float(mixing.MAX_EPOCHS)}::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
times AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM targets),
parts AS (
  SELECT *, floor(times) AS whole, times - floor(times) AS part, ('0x' || substr(md5(coalesce(source, '') || ':{mixing.SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift FROM times),
tried AS (
  SELECT p.source, k, abs(sum(r.size * (floor(r.rank * p.part + (k + p.shift) / {float(mixing.STARTS)}::DOUBLE) - floor((r.rank - 1) * p.part + (k + p.shift) / {float(mixing.STARTS)}::DOUBLE)))
    - any_value(p.part) * any_value(p.source_size)) AS miss
  FROM ranked r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source, range({mixing.STARTS}) t(k) GROUP BY p.source, k),
best AS (SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1),
taken AS (
  SELECT r.doc_id, r.size, p.source_size, p.target,
    (p.whole + floor(r.rank * p.part + (b.k + p.shift) / {float(mixing.STARTS)}::DOUBLE) - floor((r.rank - 1) * p.part + (b.k + p.shift) / {float(mixing.STARTS)}::DOUBLE))::INTEGER AS copies
  FROM ranked r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source JOIN best b ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
"""


def url_filter_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e} 00:00:00')" for a, b, c, d, e in LIST_LOG)
    return rf"""
WITH log(list, effect, pattern, action, day) AS (VALUES {rows}),
spans AS (
  SELECT list, effect, pattern, split_part(pattern, '/', 1) AS host,
    CASE WHEN strpos(pattern, '/') > 0 THEN substr(pattern, strpos(pattern, '/')) ELSE '/' END AS path, action, day AS since,
    lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM log),
pages_at AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_hours((page_id * 7 % 8784)::INTEGER) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]*)', 1)) AS host,
    coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages),
hits AS (
  SELECT p.page_id, s.list, s.pattern, s.effect = 'block' AS blocks,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.host) + length(s.path) DESC, s.effect = 'block' DESC, s.list DESC, s.pattern DESC) AS r
  FROM pages_at p JOIN spans s ON (p.host = s.host OR p.host LIKE '%.' || s.host) AND starts_with(p.path, s.path)
    AND s.action = 'add' AND s.since <= p.fetched_at AND (s.until IS NULL OR p.fetched_at < s.until))
SELECT p.page_id, p.url, p.fetched_at, p.host, h.list AS matched_list, h.pattern AS matched_pattern, NOT coalesce(h.blocks, false) AS kept
FROM pages_at p LEFT JOIN hits h ON h.page_id = p.page_id AND h.r = 1
"""


def decontamination_sql() -> str:
    """Every alignment that has three words in a row in common is compared.

    Of 9 to 16 words of which four fifths agree, three in a row do: the others
    are too few to part the rest into shorter runs. Shorter items are looked
    for as they are.
    """

    def words(name: str, key: str, least: int = 3) -> str:
        spaced = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
        return f"SELECT {key}, w, row_number() OVER () AS r FROM (SELECT {key}, string_split({spaced}, ' ') AS w FROM {name} WHERE {spaced} <> '') WHERE len(w) >= {least}"

    def runs(name: str) -> str:
        return f"SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS run FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM {name})"

    return rf"""
WITH d AS ({words("documents", "doc_id")}), b AS (SELECT * FROM ({words("benchmark", "item_id")}) WHERE len(w) >= 9),
ds AS ({words("documents", "doc_id", 1)}), bs AS (SELECT * FROM ({words("benchmark", "item_id", 1)}) WHERE len(w) < 9),
short AS (
  SELECT DISTINCT ds.doc_id, bs.item_id, len(bs.w) AS n FROM bs JOIN ds ON contains(' ' || array_to_string(ds.w, ' ') || ' ', ' ' || array_to_string(bs.w, ' ') || ' ')),
dr AS ({runs("d")}), br AS ({runs("b")}),
aligned AS (SELECT DISTINCT dr.r AS dr, br.r AS br, dr.i - br.i AS shift FROM dr JOIN br USING (run)),
same AS (
  SELECT doc_id, item_id, least(len(b.w), 16) AS compared, list_transform(range(len(b.w)), lambda j: CASE WHEN shift + j >= 0 AND d.w[shift + j + 1] = b.w[j + 1] THEN 1 ELSE 0 END) AS s
  FROM aligned JOIN d ON d.r = dr JOIN b ON b.r = br),
scored AS (SELECT doc_id, item_id, compared, list_max(list_transform(range(len(s) - compared + 1), lambda i: list_sum(s[i + 1 : i + compared]))) AS agreeing FROM same)
SELECT doc_id, item_id, max(agreeing)::BIGINT AS agreeing, max(compared)::BIGINT AS compared
FROM (SELECT doc_id, item_id, agreeing, compared FROM scored WHERE 5 * agreeing >= 4 * compared UNION ALL SELECT doc_id, item_id, n, n FROM short) GROUP BY doc_id, item_id
"""


def substring_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, r, i, array_to_string(w[i + 1 : i + 13], ' ') AS run FROM (SELECT doc_id, r, w, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT run, min(doc_id) AS least FROM starts GROUP BY run),
gone AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM starts JOIN least USING (run) WHERE least < coalesce(doc_id, 9223372036854775807::HUGEINT + 1)) GROUP BY r),
kept AS (SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE [x FOR x, i IN w IF NOT list_contains(gone, i - 1)] END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def search_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({words}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY term),
scores AS (
  SELECT item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN weights USING (term) JOIN n USING (r), whole GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


ORACLES = {
    "op2_sharding": sharding_sql(),
    "op6_source_mix": mixing_sql(),
    "op7_url_filter": url_filter_sql(),
    "op10_decontamination": decontamination_sql(),
    "op11_substring_dedup": substring_sql(),
    "op13_lexical_search": search_sql(),
}
