"""The registered queries of the training-data operators, and their SQL where it can say the same."""
from pyspark.sql import functions as F

from ..session import reuse
from . import lexical, whitening, word_bpe
from .ann import nearest
from .bpe import round_trip
from .common import prepared, table
from .exact_dedup import exact_groups
from .fixity import audit, page_records
from .licenses import license_notices
from .mixing import mixture
from .near_dedup import near_groups
from .quality import quality_scores
from .token_scan import document_spans
from .tool_calls import TOOLS, calls_in, link_calls

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return put


@query("op1_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t""")
def op1(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op2_separator_scan", r"""
WITH d AS (SELECT doc_id, 'shard-' || CAST(doc_id // 4096 AS VARCHAR) AS file, md5(coalesce(text, '')) AS digest,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
           FROM documents)
SELECT doc_id, file, row_number() OVER w - 1 AS ordinal,
       CAST(coalesce(sum(n_tokens + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n_tokens
FROM d WINDOW w AS (PARTITION BY file ORDER BY doc_id, digest)""")
def op2(spark, sf_dir):
    return document_spans(table(spark, sf_dir, "documents"))


@query("op3_bag_minhash")
def op3(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


@query("op4_tool_call_linking")
def op4(spark, sf_dir):
    return link_calls(*calls_in(table(spark, sf_dir, "conversations")), TOOLS)


@query("op5_license_classifier")
def op5(spark, sf_dir):
    return license_notices(table(spark, sf_dir, "documents"))


@query("op6_kmeans_tree_ann")
def op6(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def replicas(pages):
    """Two replicas of the pages' archive; the second lost, cut, altered or gained some records, by page id."""
    cut = lambda r: F.substring(r, F.lit(1), (F.octet_length(r) / 2).cast("int"))
    altered = lambda r: F.concat(F.substring(r, F.lit(1), F.octet_length(r) - 5), F.lit("#####").cast("binary"))
    r = reuse(page_records(pages, {"cut": lambda r: F.sha2(cut(r), 256), "altered": lambda r: F.sha2(altered(r), 256)}))
    p = F.col("page_id")
    b = r.where(p.isNull() | (p % 211 != 5)).select(
        "file", "offset", "page_id", F.when(p % 307 == 9, F.floor(F.col("length") / 2)).otherwise(F.col("length")).alias("length"),
        F.when(p % 307 == 9, F.col("cut")).when(p % 97 == 13, F.col("altered")).otherwise(F.col("digest")).alias("digest"))
    gained = r.where(p % 401 == 11).select("file", (F.col("offset") + 1).alias("offset"), "page_id", "length", "digest")
    return r, b.unionByName(gained)


@query("op7_merkle_fixity", r"""
WITH rec AS (SELECT page_id, 'seg-' || CAST(page_id // 1000 AS VARCHAR) AS file, encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13)
  || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS rec FROM pages),
a AS (SELECT page_id, file, rec, octet_length(rec) AS length, sha256(rec) AS digest,
  CAST(coalesce(sum(octet_length(rec)) OVER (PARTITION BY file ORDER BY page_id, md5(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM rec),
b AS (SELECT page_id, file, "offset", CASE WHEN page_id % 307 = 9 THEN length // 2 ELSE length END AS length,
  CASE WHEN page_id % 307 = 9 THEN sha256(rec[1:length // 2]) WHEN page_id % 97 = 13 THEN sha256(rec[1:length - 5] || '#####'::BLOB) ELSE digest END AS digest
  FROM a WHERE page_id % 211 <> 5
  UNION ALL SELECT page_id, file, "offset" + 1, length, digest FROM a WHERE page_id % 401 = 11)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset",
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.length <> b.length THEN 'length' ELSE 'content' END AS kind,
  a.length AS length_a, a.digest AS digest_a, b.length AS length_b, b.digest AS digest_b
FROM a FULL JOIN b ON a.file = b.file AND a."offset" = b."offset" WHERE a.digest IS DISTINCT FROM b.digest OR a.length IS DISTINCT FROM b.length""")
def op7(spark, sf_dir):
    return audit(*replicas(table(spark, sf_dir, "pages")))


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


@query("op9_quality_bradley_terry")
def op9(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def seats_sql(table, keys, votes, seats, order):
    """Highest quotients written out: every seat a row might win, ranked within its group."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT * EXCLUDE (k, place_) FROM (SELECT t.*, k, row_number() OVER ({part} ORDER BY {votes} / (2 * k - 1) DESC, {order}) AS place_
   FROM {table} t, unnest(range(1, CAST(ceil({seats} * {votes} / greatest(sum_votes, 1e-9)) AS BIGINT) + 3)) u(k) WHERE {votes} > 0) WHERE place_ <= {seats}"""


@query("op10_sainte_lague_mix", rf"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS src, md5(coalesce(text, '')) AS text_key,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT *, md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR), text_key)) AS place FROM d),
s AS (SELECT src, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, ceil(count(*) / 1500.0) AS shards FROM p GROUP BY src),
w AS (SELECT *, 2.0 * source_size AS cap, sum(source_size) OVER () * 1.5 AS budget, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS wt FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER o AS rk FROM w WINDOW o AS (ORDER BY cap / wt, source NULLS LAST)),
t AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, rk) FROM l WHERE level <= cap / wt), 'inf'::DOUBLE) * wt)::DOUBLE AS target FROM w),
u AS (SELECT *, CAST(greatest(1, least(16, floor(coalesce(min(target) FILTER (target > 0) OVER (), 0) / 32))) AS BIGINT) AS block FROM t),
v AS (SELECT *, target / block AS votes, sum(target / block) OVER () AS sum_votes, CAST(round(sum(target / block) OVER ()) AS BIGINT) AS seats FROM u),
sq AS (SELECT src, count(*) AS source_quota FROM ({seats_sql("v", "", "votes", "seats", "src")}) GROUP BY src),
pl AS (SELECT p.*, u.source_size, u.target, u.block, CAST('0x' || substr(place, 1, 8) AS BIGINT) % CAST(shards AS BIGINT) AS shard FROM p JOIN u USING (src)),
sh AS (SELECT src, shard, sum(size) AS shard_size, ceil(sum(size) * 1.0 / any_value(block)) AS blocks FROM pl GROUP BY src, shard),
sv AS (SELECT sh.*, blocks AS votes, sum(blocks) OVER (PARTITION BY src) AS sum_votes,
  least(coalesce(source_quota, 0), 2 * sum(blocks) OVER (PARTITION BY src)) AS seats FROM sh LEFT JOIN sq USING (src)),
q AS (SELECT src, shard, count(*) AS quota FROM ({seats_sql("sv", "src", "votes", "seats", "shard")}) GROUP BY src, shard),
b AS (SELECT src, shard, shard_size, CAST(blocks AS BIGINT) AS blocks, CAST(coalesce(quota, 0) AS BIGINT) AS quota,
  CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('mix-1:' || src || ':' || shard), 1, 8) AS BIGINT) % CAST(blocks AS BIGINT) ELSE 0 END AS first FROM sh LEFT JOIN q USING (src, shard)),
r AS (SELECT *, sum(size) OVER (PARTITION BY src, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS hi, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS passes,
  CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS extra FROM pl JOIN b USING (src, shard)),
c AS (SELECT *, hi - size AS lo, greatest(0, first + extra - blocks) * block AS head, least(shard_size, (first + extra) * block) AS tail FROM r)
SELECT doc_id, source, size, source_size, target, CAST(passes * size + greatest(0, least(head, hi) - lo) + greatest(0, least(tail, hi) - greatest(first * block, lo)) AS BIGINT) AS taken FROM c""")
def op10(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op11_rank_array_bpe")
def op11(spark, sf_dir):
    return word_bpe.round_trip(table(spark, sf_dir, "documents"))


def terms_sql(table, id_col):
    return (f"SELECT {id_col}, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            rf"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM {table}")


@query("op12_term_pipeline_search", rf"""
WITH d AS ({terms_sql("documents", "doc_id")}), q AS ({terms_sql("benchmark", "item_id")}),
post AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
ask AS (SELECT row, term, count(*) AS times FROM (SELECT row, unnest(terms) AS term FROM q) GROUP BY row, term),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM post, total GROUP BY term),
m AS (SELECT row, doc_id, 100 - 75 + ((75 * len(terms) * n) // l) AS m FROM d, total WHERE len(terms) > 0),
s AS (SELECT ask.row AS item, post.row AS row, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM ask JOIN post USING (term) JOIN w USING (term) JOIN m ON m.row = post.row GROUP BY ask.row, post.row)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, s.row) AS INTEGER) AS rank, doc_id, score
  FROM s JOIN m ON m.row = s.row JOIN q ON q.row = s.item WHERE score > 0) WHERE rank <= 10""")
def op12(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_qdwh_whitening")
def op13(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))
