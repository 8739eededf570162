"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

KNN = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + 2 * length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, html FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, k, array_to_string(words[k : k + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM w)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM later),
pos AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
n AS (SELECT item_id, words, least(len(words), 10) AS size FROM i WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[k : k + size - 1], ' ') AS win
  FROM (SELECT item_id, size, words, unnest(range(1, len(words) - size + 2)) AS k FROM n)),
sizes AS (SELECT DISTINCT size FROM n),
doc_windows AS (
  SELECT doc_id, size, k, array_to_string(words[k : k + size - 1], ' ') AS win
  FROM (SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS k FROM w, sizes WHERE len(words) >= size)),
found AS (SELECT d.doc_id, d.k, d.size, i.item_id FROM doc_windows d JOIN item_windows i USING (size, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

HASH_TREE = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, key, n + 8 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, t),
w AS (SELECT *, row_number() OVER () AS r FROM c),
root AS (SELECT r, p, -ln((CAST('0x' || substr(md5(key || '|' || p), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / weight AS d
  FROM w, (VALUES ('region0', 8.0), ('region1', 8.0), ('region2', 8.0), ('grown24', 1.0)) v(p, weight)),
reg AS (SELECT r, arg_min(p, d) FILTER (p <> 'grown24') AS region, arg_min(p, d) AS grown FROM root GROUP BY r),
rack AS (SELECT r, any_value(region) AS region, arg_min(k, -ln((CAST('0x' || substr(md5(key || '|' || region || '/rack' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)) AS k
  FROM w JOIN reg USING (r), (SELECT unnest([0, 1]) AS k) GROUP BY r),
leaf AS (SELECT r, arg_min(s, -ln((CAST('0x' || substr(md5(key || '|' || region || '/rack' || rack.k || '/' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)) AS shard
  FROM w JOIN rack USING (r), (SELECT unnest(range(24)) AS s) WHERE s // 8 = CAST(substr(region, 7) AS INTEGER) AND s // 4 % 2 = rack.k GROUP BY r)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(CASE WHEN grown = 'grown24' THEN 24 ELSE shard END AS INTEGER) AS grown_shard
FROM w JOIN reg USING (r) JOIN leaf USING (r)
"""

def _merkle(levels: int = 8, group_levels: int = 4) -> str:
    """The manifest's SQL, for trees of up to 8 ** ``levels`` leaves and 8 ** ``group_levels`` groups."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def up(name: str, count: int) -> str:
        out = "".join(f"{name}{k + 1} AS (SELECT tree, p // 8 AS p, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY p)) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, p // 8, n),\n" for k in range(count))
        return out + f"{name}top AS ({' UNION ALL '.join(f'SELECT tree, d FROM {name}{k} WHERE n = 1' for k in range(count + 1))}),\n"

    def folded(name: str, count: int, key: str) -> str:
        out = ""
        for k in range(count):
            out += f"{name}run{k} AS (SELECT tree, p // 8 AS r, list(d ORDER BY p) AS ds FROM {name}{k} WHERE n > 1 GROUP BY tree, p // 8),\n"
            step = "CASE WHEN ds IS NULL THEN fold ELSE sha256(array_to_string(ds[1:p % 8] || [fold] || ds[p % 8 + 2:], '')) END"
            out += f"{name}path{k + 1} AS (SELECT {key}, x.tree, p // 8 AS p, {step} AS fold, path || coalesce(array_to_string(ds[1:p % 8] || ds[p % 8 + 2:], ''), '') AS path FROM {name}path{k} x LEFT JOIN {name}run{k} y ON x.tree = y.tree AND x.p // 8 = y.r),\n"
        return out

    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR))) AS hx, strlen(CAST(doc_id AS VARCHAR)) AS len FROM documents),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(len), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM h, t),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS d, crc, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other FROM c),
x0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM l),
{up("x", levels)}
g0 AS (SELECT '' AS tree, xtop.tree AS name, d, row_number() OVER (ORDER BY xtop.tree) - 1 AS p, count(*) OVER () AS n FROM xtop),
{up("g", group_levels)}
xpath0 AS (SELECT doc_id, d AS leaf, tree, p, CASE WHEN coalesce(crc % 3 = 0, false) THEN other ELSE d END AS fold, '' AS path FROM x0),
{folded("x", levels, "doc_id, leaf")}
gpath0 AS (SELECT doc_id, leaf, name, g0.d AS subroot, g0.tree, g0.p, fold, path FROM xpath{levels} x JOIN g0 ON x.tree = g0.name),
{folded("g", group_levels, "doc_id, leaf, name, subroot")}
r AS (SELECT doc_id, leaf, subroot, gtop.d AS root, sha256(path) AS proof_sha256, fold AS folded_root FROM gpath{group_levels}, gtop)
SELECT *, folded_root = root AS verified FROM r
"""

COLLOCATIONS = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, w[k : k + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY lang, m, g HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_g AS (SELECT lang, g[k : k + j - 1] AS g, max(f) AS longer
  FROM (SELECT lang, g, f, m, j, unnest(range(1, m - j + 2)) AS k FROM f, (SELECT unnest([2, 3]) AS j) WHERE m > j) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inner_g USING (lang, g) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


ORACLE: dict[str, str] = {
    "op1_voronoi_knn": KNN,
    "op2_chat_format": CHAT,
    "op3_warc": WARC,
    "op6_substring_dedup": SUBSTRINGS,
    "op9_hash_tree": HASH_TREE,
    "op10_decontaminate": DECONTAMINATE,
    "op11_merkle": _merkle(),
    "op12_collocations": COLLOCATIONS,
}
