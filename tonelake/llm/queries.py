"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op7
from .decontamination import op3
from .embedding_dedup import op8
from .hard_negatives import op13
from .lm_scoring import op12
from .mixing import op4
from .ngram_join import op9
from .secrets import op6, secrets_base
from .sharding import op1
from .spelling import op11
from .token_counts import op10
from .toxicity import op2
from .warc import op5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1,
    "op2_toxicity": op2,
    "op3_decontamination": op3,
    "op4_mixing": op4,
    "op5_warc": op5,
    "op6_secrets": op6,
    "op7_chat": op7,
    "op8_embedding_dedup": op8,
    "op9_ngram_jaccard_join": op9,
    "op10_token_counts": op10,
    "op11_spelling": op11,
    "op12_lm_scoring": op12,
    "op13_hard_negatives": op13,
    "secrets_base": secrets_base,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT *, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, i * 5 + 1, 5) AS INTEGER)) AS parts FROM d)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to FROM b"""

_CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|unk>|pad>|/?SYS>>|/?INST\])', '\1\\\2\3', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(24 + length(role) + length(body)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

_COMPONENTS = "reach AS (SELECT id AS node, id AS root FROM nodes UNION SELECT y, root FROM reach JOIN links ON x = node)"

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), nodes AS (SELECT id FROM v),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
links AS (SELECT a.id AS x, b.id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.id != b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98), {_COMPONENTS},
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE x = node) AS n_links, component_id, node = component_id AS kept FROM c"""

_SHINGLES = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
nodes AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
g AS (SELECT id, len(s) AS n, unnest(s) AS s FROM nodes), p AS (SELECT a.id AS x, b.id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id != b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (n - c)), {_COMPONENTS}, r AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM nodes JOIN r ON node = id"""

_CRC_TABLE = "list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

# The capacity by binary search, a greedy step at a time; the least ends that leave room for the shards after; the cuts.
_SHARDS = f"""WITH RECURSIVE d AS (SELECT doc_id, text, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, chr(0))) AS digest, hex(encode(coalesce(text, ''))) AS h FROM documents), c AS (SELECT {_CRC_TABLE} AS crc),
g AS (SELECT digest, sum(size) AS size FROM d GROUP BY digest), p AS (SELECT digest, size, CAST(sum(size) OVER (ORDER BY digest) AS BIGINT) AS prefix FROM g), t AS (SELECT max(prefix) AS total, CAST(max(size) AS BIGINT) AS largest FROM p), b AS (SELECT prefix FROM p UNION ALL SELECT 0),
s AS (SELECT greatest(-(-total // 16), largest) AS low, -(-total // 16) + largest AS high, 0 AS k, 0::BIGINT AS place FROM t UNION ALL
SELECT CASE WHEN ended AND nxt < total THEN mid + 1 ELSE low END, CASE WHEN ended AND nxt >= total THEN mid ELSE high END, CASE WHEN ended THEN 0 ELSE k + 1 END, CASE WHEN ended THEN 0 ELSE nxt END
FROM (SELECT *, nxt >= total OR nxt = place OR k = 15 AS ended FROM (SELECT low, high, k, place, total, (low + high) // 2 AS mid, max(prefix) FILTER (prefix <= place + (low + high) // 2) AS nxt FROM s, t, b WHERE low < high GROUP BY low, high, k, place, total))),
cap AS (SELECT min(low) AS cap FROM s WHERE low = high), l AS (SELECT 15 AS k, total AS v FROM t UNION ALL SELECT k - 1, min(prefix) FILTER (prefix >= greatest(0, v - cap)) FROM l, cap, b WHERE k > 0 GROUP BY k, v),
x AS (SELECT -1 AS k, 0::BIGINT AS place UNION ALL SELECT k + 1, greatest(place, v, least(CASE WHEN goal - below <= above - goal THEN below ELSE above END, top)) FROM (SELECT x.k, place, l.v, place + (total - place) // (15 - x.k) AS goal, max(prefix) FILTER (prefix <= place + (total - place) // (15 - x.k)) AS below,
min(prefix) FILTER (prefix >= place + (total - place) // (15 - x.k)) AS above, max(prefix) FILTER (prefix <= place + cap) AS top FROM x JOIN l ON l.k = x.k + 1, t, cap, b WHERE x.k < 14 GROUP BY x.k, place, l.v, total)),
o AS (SELECT d.*, (SELECT CAST(count(*) AS INTEGER) FROM x WHERE x.k >= 0 AND x.place < p.prefix) AS shard FROM d JOIN p USING (digest))
SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(h) // 2), lambda i: CAST(CAST('0x' || h[2 * i + 1:2 * i + 2] AS INTEGER) AS BIGINT))), lambda a, v: xor(a >> 8, crc[xor(a, v) % 256 + 1])), 4294967295) END AS text_crc32, 'bytes' AS law, shard,
row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, digest) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o, c"""

_NAMES = "|".join("".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_FOUND = {
    "assign": (rf"(?s)(.*?)((?:{_NAMES})[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+))".replace("'", "''"), 8),
    "access": (r"(?s)(.*?)((AKIA[A-Z0-9]+))", 16),
    "hex": (r"(?s)(.*?)(([0-9a-f]+))", 32),
}
_KIND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, '{name}' AS name, {least} AS least, regexp_extract_all(t, '{pattern}', 1) AS gaps, regexp_extract_all(t, '{pattern}', 2) AS hits, regexp_extract_all(t, '{pattern}', 3) AS vals FROM d" for k, (name, (pattern, least)) in enumerate(_FOUND.items())
)
# A match ends where the gaps and matches up to it end.
_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_KIND}), x AS (SELECT doc_id, kind, name, least, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(vals) AS val, generate_subscripts(hits, 1) AS i FROM m),
e AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM x), k AS (SELECT *, e - length(hit) AS s FROM e WHERE length(val) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind), '')) AS base_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""

_SPELLING = rf"""WITH RECURSIVE c AS (SELECT {_CRC_TABLE} AS crc), r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM g),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(x) // 2), lambda i: CAST(CAST('0x' || x[2 * i + 1:2 * i + 2] AS INTEGER) AS BIGINT))), lambda a, v: xor(a >> 8, crc[xor(a, v) % 256 + 1])), 4294967295) AS h FROM b, c),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3), k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w), v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM k),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.v = b.v AND a.word != b.word UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.v = b.word),
f AS (SELECT w.word, w.n, count(other) AS n_near, max(m) AS form_n FROM w LEFT JOIN p ON w.word = p.word GROUP BY w.word, w.n), o AS (SELECT f.word, f.n, n_near, CASE WHEN form_n >= 2 * f.n THEN form_n END AS form_n, CASE WHEN form_n >= 2 * f.n THEN min(other) FILTER (m = form_n) END AS form FROM f LEFT JOIN p ON f.word = p.word GROUP BY f.word, f.n, n_near, form_n),
s AS (SELECT word, word AS place, 0 AS k FROM o UNION ALL SELECT s.word, o.form, k + 1 FROM s JOIN o ON s.place = o.word WHERE o.form IS NOT NULL), e AS (SELECT word, max_by(place, k) AS root FROM s GROUP BY word)
SELECT o.word, form, root, n, n_near, form_n FROM o JOIN e ON o.word = e.word"""

_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.s DESC, x.b) AS INTEGER) AS rank, x.b AS negative_id, p.s AS positive_score, x.s AS negative_score
FROM p JOIN s x ON p.a = x.a AND NOT x.same AND 50 * p.s <= 100 * x.s AND 100 * x.s <= 95 * p.s QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {"op1_sharding": _SHARDS, "secrets_base": _SECRETS, "op5_warc": _WARC, "op7_chat": _CHAT, "op8_embedding_dedup": _VECTORS, "op9_ngram_jaccard_join": _SHINGLES, "op11_spelling": _SPELLING, "op13_hard_negatives": _NEGATIVES}
