"""The opN_ queries (and their SQL where SQL can express them).

Each applies its operator, with production parameters, to its whole table and
derives the contract's columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.llm import ann, fingerprint, hardneg, langid, lexical, linededup, minhash, mixing, packing, pieces, tokencount, toxicity, warc
from lodgelens.llm.shared import shared_dir, text_mod, written
from lodgelens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return put


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), seq_len=2048, end_id=1)


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_tokencount")
def op3_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    end = 49407  # the tokenizer's end-of-text id, which no text encodes to
    placed = written(tokencount.write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end), "token-places")
    counted = tokencount.count_tokens(spark, folder, end) if not placed.isEmpty() else None
    if counted is None:
        return placed.selectExpr("doc_id", "file", "ordinal", "ordinal AS start", "ordinal AS n_tokens")
    return counted.join(placed.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


@query("op7_pieces")
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op4_linededup", oracle="""
WITH r AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM documents),
v AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM r),
a AS (SELECT *, (sum((w > 0)::INT) OVER (PARTITION BY doc_id ORDER BY j))::BIGINT AS i FROM v),
l AS (SELECT doc_id, i, line, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM a WHERE w > 0),
fw AS (SELECT x.doc_id, x.i AS s, min(y.i) AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + 49 AND y.c - x.c + x.w >= 50 GROUP BY ALL),
bw AS (SELECT y.doc_id, max(x.i) AS s, y.i AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND x.i BETWEEN y.i - 49 AND y.i AND y.c - x.c + x.w >= 50 GROUP BY y.doc_id, y.i),
win AS (SELECT * FROM fw UNION SELECT doc_id, s, e FROM bw),
ls AS (SELECT doc_id, list(line ORDER BY i) AS lines FROM l GROUP BY doc_id),
t AS (SELECT doc_id, s, e, array_to_string(lines[s:e], chr(10)) AS body FROM win JOIN ls USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS n FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM o WHERE n > 1),
k AS (SELECT a.doc_id, a.j, a.line, gone.i IS NOT NULL AS del FROM a LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.i = gone.i)
SELECT doc_id, count(*) AS n_lines, sum(del::INT)::BIGINT AS deleted_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT del), '')) AS kept_sha256
FROM k GROUP BY doc_id""")
def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents"), min_words=50)
    return kept.select("doc_id", F.greatest(F.col("__lines"), F.lit(1)).cast("long").alias("n_lines"), F.col("__deleted").cast("long").alias("deleted_lines"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), lambda i: text_mod(i, 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(train))
    return scored.select("doc_id", (text_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op6_minhash", oracle="""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k
      FROM (SELECT e.* FROM e JOIN f USING (g)) x JOIN (SELECT e.* FROM e JOIN f USING (g)) y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, d.b FROM r JOIN d ON r.y = d.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


@query("op9_langid")
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(text_mod(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model).select("doc_id", (text_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "share")


@query("op8_warc", oracle="""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warc.round_trip(pages, min_bytes=100)
    if back is None:
        return spark.createDataFrame([], f"page_id {kind.simpleString()}, payload_bytes long, payload_digest string, "
                                         f"record_type string, refers_to {kind.simpleString()}")
    return back.select(F.col("page_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").try_cast(kind).alias("refers_to"))


@query("op10_fingerprint")
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents")).drop("edits")


@query("op11_lexical", oracle="""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT r, doc_id, count(*) AS terms FROM t GROUP BY r, doc_id),
g AS (SELECT count(*) AS docs, sum(terms)::BIGINT AS words FROM n),
m AS (SELECT r, doc_id, 100 - 50 + (50 * terms * docs) // words AS m FROM n, g),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""")
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, n_docs, table(spark, sf_dir, "benchmark"), k=50)


@query("op12_hardneg", oracle="""
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INT AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3""")
def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved, positives=5, negatives=3, low=50, high=95)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op13_mixing", oracle="""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS w, sum(z) OVER () AS total, coalesce(sum(z) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
c AS (SELECT *, w * (150 * total - 200 * coalesce(sum(z) OVER o, 0)) >= 200 * z * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS capped
      FROM w WINDOW o AS (ORDER BY z::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (150 * total - 200 * coalesce(sum(z) FILTER (WHERE capped) OVER (), 0))::DOUBLE / (100 * sum(w) FILTER (WHERE NOT capped) OVER ())::DOUBLE AS level FROM c),
t AS (SELECT source, place, z, before, total, CASE WHEN capped THEN 2.0::DOUBLE * z ELSE level * w END AS target FROM l),
k AS (SELECT doc_id, size, substr(md5('13-' || coalesce(doc_id::VARCHAR, 'null') || '-' || size), 1, 16) AS key, t.* FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, row_number() OVER (ORDER BY place, key, doc_id, size) AS i,
        coalesce(sum(size) OVER (ORDER BY place, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - before AS c FROM k),
r AS (SELECT *, c + z * copy AS a, c + z * copy + size AS b, floor(target) AS f FROM q, (VALUES (0), (1)) v(copy)),
h AS (SELECT * EXCLUDE (a, b), CASE part WHEN 2 THEN f ELSE a END AS a, CASE part WHEN 1 THEN f ELSE b END AS b
      FROM (SELECT r.*, x.part FROM r JOIN (VALUES (0), (1), (2)) x(part) ON (a < f AND f < b) = (x.part > 0))),
m AS (SELECT *, (b - a)::BIGINT AS words, sum(b - a) OVER (ORDER BY CASE WHEN target > 0 THEN b / target ELSE 0 END, place, b, i, part) - (b - a) AS pos FROM h)
SELECT doc_id, size, z AS source_size, target, sum(least(words, greatest(total * 150 // 100 - pos, 0)))::BIGINT AS taken
FROM m GROUP BY i, doc_id, size, z, target""")
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken_words(table(spark, sf_dir, "documents"), weights=(3, 1, 2), percent=150, repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
