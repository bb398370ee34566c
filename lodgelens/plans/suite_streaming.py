"""Registered queries: streaming jobs (T1-T4); each result must equal the
batch computation, so the oracle is the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.plans.registry import query
from lodgelens.plans.suite_text import _CLEAN_SQL, _TOK_SQL
from lodgelens.streaming import jobs as J

_DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_EMB_SCHEMA = "vec_id long, embedding array<float>, label int"
_ORD_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string")


def _src(sf, name):
    # a glob, so the file stream source picks up new files of the same table
    return f"{sf.rstrip('/')}/{name}*.parquet"


@query("stream_ingest", f"SELECT doc_id, source, {_CLEAN_SQL.format(c='text')} AS clean FROM documents WHERE lang = 'en'")
def stream_ingest(spark, sf):
    """Incremental language filter + clean into a Parquet sink."""
    return J.stream_ingest(spark, _src(sf, "documents"), _DOC_SCHEMA)


@query("stream_avg_embedding", """
WITH l AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS mean, count(*) AS n_docs FROM l GROUP BY label, pos
""")
def stream_avg_embedding(spark, sf):
    """Running sums per listing and position."""
    r = J.stream_avg_embedding(spark, _src(sf, "embeddings"), _EMB_SCHEMA)
    return r.withColumn("mean", F.round("mean", 9))


@query("stream_vocabulary", f"""
WITH d AS (SELECT doc_id, list_distinct({_TOK_SQL.format(c=_CLEAN_SQL.format(c='text'))}) AS t FROM documents
           WHERE lang = 'en')
SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY term
""")
def stream_vocabulary(spark, sf):
    """Running document frequencies."""
    return J.stream_vocabulary(spark, _src(sf, "documents"), _DOC_SCHEMA)


@query("stream_review_volume", """
SELECT make_timestamp(CAST(floor(epoch_us(o_orderdate) / 604800000000) AS BIGINT) * 604800000000) AS window_start,
       count(*) AS n
FROM orders GROUP BY 1
""")
def stream_review_volume(spark, sf):
    """T4: reviews per 7-day event-time window with a watermark."""
    return J.stream_review_volume(spark, _src(sf, "orders"), _ORD_SCHEMA)
