"""DuckDB SQL for the corpus queries that SQL can express; each is the query's definition, not its method."""

from .decontaminate import LONG, MASKS, short_masks
from .quality_rules import LEAST_STRENGTH, MARGIN, MOST_STRENGTH, SURE
from .url_filter import HOST_RULES, MIN_CONFIDENCE, MIN_SUPPORT

BLANKS = r"[\x20\x09-\x0D]"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}+'), lambda x: x <> '')"


def windows(window: int) -> str:
    """op6: words covered by a window that a document of smaller id has too."""
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN low USING (s), (SELECT unnest(range(0, {window})) AS k) WHERE doc_id > low),
k AS (SELECT p.doc_id, count(cut.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (cut.i IS NULL) AS kept FROM p LEFT JOIN cut ON cut.doc_id = p.doc_id AND cut.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def quality() -> str:
    """op7: measures, and hosts by the beta prior."""
    return f"""WITH d AS (SELECT doc_id, source, {WORDS} AS w, coalesce(text, '') AS x FROM documents),
l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
often AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN often USING (doc_id, s), (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, length(regexp_replace(x, '{BLANKS}', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(again.n, 0) AS n_repeat_words FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > 0.2 * n_words OR n_dup_lines > 0.5 * n_lines AS failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS bad FROM f GROUP BY source),
t AS (SELECT sum(n) AS n, sum(bad) / sum(n) AS mean, count(*) AS hosts, sum(n * n) AS squares FROM h),
s AS (SELECT t.*, mean * (1 - mean) AS chance, (SELECT sum(h.n * power(h.bad / h.n - t.mean, 2)) FROM h) AS spread FROM t),
y AS (SELECT *, CASE WHEN hosts > 1 AND n > hosts THEN (spread - chance * (hosts - 1)) / (n - squares / n) ELSE 0 END AS beyond FROM s),
z AS (SELECT mean, CASE WHEN beyond > 0 THEN least(greatest(chance / beyond - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) ELSE {MOST_STRENGTH} END AS strength FROM y),
r AS (SELECT source, n, mean, strength, (bad + mean * strength) / (n + strength) AS shrunk FROM h, z),
v AS (SELECT source, mean, shrunk, shrunk - {SURE} * sqrt(shrunk * (1 - shrunk) / (n + strength + 1)) AS low FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT low > mean + {MARGIN} AS kept, round(shrunk, 6) AS shrunk_rate, round(low, 6) AS least_rate
FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source"""


def seeds(window: int = 20, min_share: float = 0.8) -> str:
    """op10: seeds as joined words, and the aligned comparison."""
    masks = ", ".join([f"({n}, '{m}')" for n in range(1, LONG) for m in short_masks(n)] + [f"({LONG}, '{m}')" for m in MASKS])
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    seed = "mask || ':' || array_to_string(list_filter(list_slice(w, i + 1, i + length(mask)), lambda x, k: mask[k] = '1'), ' ')"
    return f"""WITH docs AS (SELECT doc_id, {words} AS w FROM documents), items AS (SELECT item_id, {words} AS w FROM benchmark),
masks AS (SELECT n, mask FROM (VALUES {masks}) v(n, mask) WHERE n IN (SELECT least({LONG}, len(w)) FROM items)),
test AS (SELECT DISTINCT item_id, i AS item_at, {seed} AS seed FROM (SELECT item_id, w, mask, unnest(range(0, len(w) - length(mask) + 1)) AS i FROM items JOIN masks ON n = least({LONG}, len(w)))),
train AS (SELECT doc_id, i AS place, {seed} AS seed FROM (SELECT doc_id, w, mask, unnest(range(0, len(w) - length(mask) + 1)) AS i FROM docs, masks WHERE len(w) >= length(mask))),
hits AS (SELECT doc_id, item_id, place - item_at AS shift, count(*) AS n_seeds FROM train JOIN test USING (seed) GROUP BY ALL),
cut AS (SELECT h.*, len(items.w) AS n_item, list_slice(items.w, greatest(-shift, 0) + 1, len(items.w)) AS iw, list_slice(docs.w, greatest(shift, 0) + 1, greatest(shift, 0) + len(items.w)) AS dw FROM hits h JOIN items USING (item_id) JOIN docs USING (doc_id)),
same AS (SELECT *, least({window}, n_item) AS compared, least(len(iw), len(dw)) AS n, list_transform(range(1, least(len(iw), len(dw)) + 1), lambda k: CASE WHEN iw[k] = dw[k] THEN 1 ELSE 0 END) AS same FROM cut),
best AS (SELECT *, list_max(list_transform(range(1, n - compared + 2), lambda i: list_sum(list_slice(same, i, i + compared - 1)))) AS matched FROM same WHERE n >= compared),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, n_seeds DESC, shift) AS k FROM best WHERE matched >= {min_share} * compared)
SELECT doc_id, item_id, shift, n_seeds, CAST(matched AS BIGINT) AS matched, compared FROM k WHERE k = 1"""


def url_rules() -> str:
    """op2: every combination of a bad URL's tokens is counted."""
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    fits = []
    for verdict, rule in sorted(HOST_RULES, key=lambda x: -len(x[1])):
        of, _, rest = rule.partition("/")
        fits.append((f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{rest}')", rule, verdict))
    case = lambda k, other: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + f" ELSE {other} END"
    return f"""WITH u AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
t AS (SELECT *, list_sort(list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
 list_transform(flatten(list_transform(list_filter(string_split(host, '.'), lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: 'w:' || x),
 list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
 list_transform(string_split(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '&'), lambda x: 'q:' || split_part(x, '=', 1))), lambda x: length(x) > 2))) AS tokens FROM u),
own AS (SELECT tokens, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS bad FROM t JOIN labels ON doc_id = page_id WHERE len(tokens) > 0),
part AS (SELECT list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS rule FROM (SELECT tokens, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS mask FROM own WHERE bad)),
often AS (SELECT rule, count(*) AS support FROM part GROUP BY rule HAVING count(*) >= {MIN_SUPPORT}),
sure AS (SELECT rule FROM often JOIN own ON list_has_all(tokens, rule) GROUP BY rule, support HAVING support >= {MIN_CONFIDENCE} * count(*)),
less AS (SELECT s.rule FROM sure s WHERE NOT EXISTS (SELECT 1 FROM sure p WHERE len(p.rule) < len(s.rule) AND len(p.rule) IN (1, len(s.rule) - 1) AND list_has_all(s.rule, p.rule))),
hit AS (SELECT page_id, count(*) AS n FROM t JOIN less ON list_has_all(tokens, rule) GROUP BY page_id)
SELECT t.page_id, host, path, {case(1, 'NULL')} AS rule, {case(2, "CASE WHEN n > 0 THEN 'block' ELSE 'allow' END")} AS verdict, coalesce(n, 0) AS n_mined FROM t LEFT JOIN hit ON hit.page_id = t.page_id"""


def archives() -> str:
    """op11: base32 takes four digits from each five of the hexadecimal digest."""
    digit = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)"
    base32 = f"array_to_string(list_transform(range(0, 8), lambda k: {' || '.join(map(digit, (15, 10, 5, 0)))}), '')"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), d AS (SELECT page_id, strlen(x) AS n, sha1(x) AS h, max(page_id) OVER (PARTITION BY x) AS top FROM p)
SELECT page_id, n AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM d"""


def clusters(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """op12: every vector against every centroid, each round."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: isfinite(y))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, x FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT r, c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} c),
a{i} AS MATERIALIZED (SELECT r, cluster, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT cluster, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, {dim + 1})) AS i FROM a{i} JOIN v USING (r)) GROUP BY ALL),
m{i} AS (SELECT cluster, list({floor} ORDER BY i) AS x FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = a.cluster"""


def search(k: int = 50) -> str:
    """op13: every document's score for every item."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS w FROM documents), i AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
t AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), t),
x AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS x FROM tf JOIN df USING (term), t),
s AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM x JOIN i USING (term) GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_association_rules": url_rules(), "op6_window_doubling": windows(13), "op7_quality_host_rules": quality(), "op10_spaced_seeds": seeds(), "op11_warc_zstandard": archives(), "op12_exponion_clusters": clusters(), "op13_threshold_seeded_search": search()}
