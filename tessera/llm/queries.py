"""The registered queries: each operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import infill, langid, mixing, neighbours, packing, secrets, simhash, substrings, suffixes, topk, trie, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"), with_recall=True)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), rules, urls.listed_urls(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.splice_heads(trie.ordered_turns(_table(spark, sf_dir, "conversations"))))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_substrings": op6_substrings,
    "op7_topk": op7_topk,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_trie": op11_trie,
    "op12_suffixes": op12_suffixes,
    "op13_infill": op13_infill,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
_HOSTS = ", ".join(f"('{h}')" for h in urls.LISTED_HOSTS)
_LANGUAGES = ", ".join(f"('{x}')" for x in urls.LISTED_LANGUAGES)

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
    "op6_substrings": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT s.doc_id, s.i, md5(array_to_string(d.w[s.i:s.i + 49], ' ')) AS h FROM s JOIN d USING (doc_id)),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
v AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS p FROM k JOIN m USING (h) WHERE m.least < k.doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM v GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g.gone IS NULL THEN array_to_string(d.w, ' ') ELSE array_to_string(list_filter(d.w, lambda x, i: NOT list_contains(g.gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES}), hosts(h) AS (VALUES {_HOSTS}), langs(g) AS (VALUES {_LANGUAGES}),
listed AS (SELECT h || '/' || g || '/' || n AS u FROM hosts CROSS JOIN langs CROSS JOIN range({urls.LISTED_PAGES}) r(n)),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
a AS (SELECT DISTINCT host, path FROM p),
c AS (SELECT host, path, regexp_replace(host, ':(80|443)$', '') || regexp_replace(array_to_string(list_transform(string_split(path, '%'),
  lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9A-Fa-f][0-9A-Fa-f]') THEN upper(x[1:2]) || x[3:] ELSE x END), '%'), '/$', '') AS u FROM a),
fits AS (SELECT host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rh || rp DESC) AS k
  FROM a JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, fits.rule AS rule, coalesce(fits.rv, CASE WHEN listed.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN c ON c.host = p.host AND c.path = p.path LEFT JOIN listed ON listed.u = c.u LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path AND fits.k = 1""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
q AS (SELECT source, source_size, w, source_size * 2.0::DOUBLE AS stop, source_size * 2.0::DOUBLE / w AS ratio FROM r),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE - coalesce(sum(stop) OVER b, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER b, 0)) AS level
  FROM q WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level <= ratio THEN (SELECT max(level) FROM l WHERE level <= ratio) * w ELSE stop END AS target FROM l),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS prev FROM d),
e AS (SELECT c.doc_id, c.size, c.prev, t.source_size, t.target, floor(t.target)::BIGINT AS budget, CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - prev)))::BIGINT AS taken FROM e""",
    "op11_trie": """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY i) AS t FROM o GROUP BY c),
z AS (SELECT generate_series AS n FROM generate_series(0, 255)),
z1 AS (SELECT n, CASE WHEN n & 1 = 1 THEN xor(3988292384, n >> 1) ELSE n >> 1 END AS v FROM z), z2 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z1),
z3 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z2), z4 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z3),
z5 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z4), z6 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z5),
z7 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z6), z8 AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM z7),
crc AS (SELECT list(v ORDER BY n) AS v FROM z8),
g AS (SELECT w.c, w.t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(w.c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(crc.v[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h FROM w, crc),
r AS (SELECT g.c, list_concat(coalesce(b.t, [])[1:g.h], g.t[g.h + 1:]) AS t FROM g LEFT JOIN w b ON b.c = g.c - g.c % 100),
p AS (SELECT c, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
k AS (SELECT c, size, depth, md5(coalesce(array_to_string(list_transform(t[1:depth], lambda x: len(x.role) || ':' || x.role || len(x.text) || ':' || x.text), ''), '')) AS id, CASE WHEN depth > 0 THEN length(t[depth].text) ELSE 0 END AS chars FROM p),
m AS (SELECT id, depth, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars, string_agg(CASE WHEN size = depth THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM k GROUP BY id, depth),
x AS (SELECT k.c, k.depth, m.conv_id FROM k JOIN m USING (id, depth)),
f AS (SELECT m.*, x.conv_id AS parent FROM m LEFT JOIN x ON x.c = m.conv_id AND x.depth = m.depth - 1),
q AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY parent, depth),
s AS (SELECT x.conv_id, x.depth, sum((f.n - 1) * f.chars) AS saved, count(*) FILTER (q.n_children IS NULL) AS leaves
  FROM f JOIN x ON x.c = f.conv_id AND x.depth <= f.depth LEFT JOIN q ON q.conv_id = f.conv_id AND q.depth = f.depth GROUP BY x.conv_id, x.depth)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n::BIGINT AS n_convs, coalesce(q.n_children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (conv_id, depth) LEFT JOIN q USING (conv_id, depth)""",
    "op12_suffixes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, x, unnest(range(0, n - 399, 2000)) AS o FROM d WHERE n >= 400),
s AS (SELECT doc_id, o, substr(x, 2 * o + 1, 4798) AS y, least(2000, n - 399 - o) AS m FROM c),
u AS (SELECT doc_id, unnest(list_transform(range(0, m), lambda j: struct_pack(i := o + j, h := md5(substr(y, 2 * j + 1, 800))))) AS w FROM s),
k AS (SELECT doc_id, w.i AS i, w.h AS h FROM u),
m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
v AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS first FROM k JOIN m USING (h)),
g AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM v),
r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, span),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r),
f AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(f.n_removed, 0)::BIGINT AS n_removed, coalesce(f.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(f.kept, '') || substr(d.x, 2 * coalesce(f.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)""",
    "op13_infill": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
}
