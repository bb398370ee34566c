"""Registered queries: vectors, topic assignment and topic analysis
(A19/V2, V3-V6, V10-V14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.operators import ranks
from lodgelens.operators import relational as R
from lodgelens.operators import topics as TP
from lodgelens.plans import oracle_views as V
from lodgelens.plans.listing_tables import listing_base
from lodgelens.plans.registry import query
from lodgelens.sources import catalog
from lodgelens.sources.tables import table

V.register("emb_topics", """
SELECT vec_id, label, CAST(CASE WHEN label >= 6 THEN -1 ELSE label END AS INTEGER) AS topic,
       CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings
""")
V.register("emb_centroids", """
WITH l AS (SELECT topic, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM emb_topics
           WHERE topic <> -1),
m AS (SELECT topic, pos, avg(v) AS m FROM l GROUP BY ALL)
SELECT topic, list(m ORDER BY pos) AS centroid FROM m GROUP BY topic
""")
V.register("emb_sims", """
SELECT e.vec_id, e.topic AS old_topic, c.topic AS t,
       list_dot_product(e.embedding, c.centroid) / (sqrt(list_dot_product(e.embedding, e.embedding))
                                                   * sqrt(list_dot_product(c.centroid, c.centroid))) AS sim
FROM emb_topics e JOIN emb_centroids c ON true
""")


def emb_topics(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.when(F.col("label") >= 6, F.lit(-1)).otherwise(F.col("label"))
                    .cast("int").alias("topic"), "embedding")


@query("avg_embedding", """
WITH l AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS mean, count(*) AS n_docs FROM l GROUP BY label, pos
""")
def avg_embedding(spark, sf):
    """Element-wise mean embedding per listing (listing = label)."""
    m = R.vector_mean(table(spark, sf, "embeddings"), "label", "embedding")
    return m.select("label", "n_docs", F.posexplode("mean_vec").alias("pos", "mean")).select(
        "label", (F.col("pos") + 1).alias("pos"), F.round("mean", 9).alias("mean"), "n_docs")


@query("reassign_outliers", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, t) AS rn FROM emb_sims)
SELECT vec_id, old_topic, CASE WHEN old_topic = -1 THEN t ELSE old_topic END AS topic,
       CASE WHEN old_topic = -1 THEN round(sim, 9) END AS similarity
FROM r WHERE rn = 1
""")
def reassign_outliers(spark, sf):
    """V6: outliers to the most similar topic centroid."""
    r = TP.reassign_outliers(emb_topics(spark, sf), "vec_id", "topic", "embedding")
    return r.withColumn("similarity", F.round("similarity", 9))


@query("topic_probs", """
WITH m AS (SELECT vec_id, max(sim) AS mx FROM emb_sims GROUP BY vec_id),
d AS (SELECT s.vec_id, sum(exp(s.sim - m.mx)) AS den FROM emb_sims s JOIN m ON s.vec_id = m.vec_id GROUP BY s.vec_id)
SELECT s.vec_id, s.t AS topic, round(exp(s.sim - m.mx) / d.den, 9) AS prob
FROM emb_sims s JOIN m ON s.vec_id = m.vec_id JOIN d ON s.vec_id = d.vec_id
""")
def topic_probs(spark, sf):
    """Soft topic probabilities (softmax of cosine to centroids)."""
    p = TP.topic_probabilities(emb_topics(spark, sf), "vec_id", "topic", "embedding")
    return p.withColumn("prob", F.round("prob", 9))


@query("topic_info", """
WITH c AS (SELECT topic, count(*) AS count FROM emb_topics GROUP BY topic),
r AS (SELECT e.topic, e.vec_id, list_dot_product(e.embedding, c.centroid)
             / (sqrt(list_dot_product(e.embedding, e.embedding)) * sqrt(list_dot_product(c.centroid, c.centroid))) AS sim
      FROM emb_topics e JOIN emb_centroids c ON e.topic = c.topic),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, vec_id) AS rank FROM r),
rep AS (SELECT topic, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS representative FROM k WHERE rank <= 3
        GROUP BY topic)
SELECT c.topic, c.count, rep.representative FROM c LEFT JOIN rep ON c.topic = rep.topic
""")
def topic_info(spark, sf):
    """Size of every topic (-1 included) and its 3 most central members."""
    e = emb_topics(spark, sf)
    counts = e.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    reps = TP.representatives(e, "vec_id", "topic", "embedding", 3)
    rep = reps.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))),
                                                             lambda s: s["vec_id"].cast("string")), ",")
                                    .alias("representative"))
    return counts.join(rep, "topic", "left")


V.register("topic_terms", """
WITH e AS (SELECT m.topic, unnest(t.toks) AS term FROM txt_tokens t JOIN emb_topics m ON t.review_id = m.vec_id),
tf AS (SELECT topic, term, count(*) AS tf FROM e GROUP BY ALL),
f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term),
a AS (SELECT avg(w) AS A FROM (SELECT topic, sum(tf) AS w FROM tf GROUP BY topic)),
w AS (SELECT tf.topic, tf.term, tf.tf * ln(1 + a.A / f.f) AS weight FROM tf JOIN f ON tf.term = f.term, a)
SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w QUALIFY rank <= 10
""")


@query("topic_table", """
WITH c AS (SELECT topic, count(*) AS count FROM emb_topics GROUP BY topic),
k AS (SELECT e.topic, e.vec_id, row_number() OVER (PARTITION BY e.topic ORDER BY list_dot_product(e.embedding, c.centroid)
        / (sqrt(list_dot_product(e.embedding, e.embedding)) * sqrt(list_dot_product(c.centroid, c.centroid))) DESC, e.vec_id) AS rank
      FROM emb_topics e JOIN emb_centroids c ON e.topic = c.topic),
rep AS (SELECT topic, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS representative FROM k WHERE rank <= 3 GROUP BY topic),
w AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS words, string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS first4
      FROM topic_terms GROUP BY topic)
SELECT c.topic, c.count, concat_ws('_', CAST(c.topic AS VARCHAR), w.first4) AS name, w.words, rep.representative
FROM c LEFT JOIN w ON c.topic = w.topic LEFT JOIN rep ON c.topic = rep.topic
""")
def topic_table(spark, sf):
    """Topic table with count, name, words and representatives; a
    comment's topic is that of the vector with its id."""
    from lodgelens.operators import text as T
    from lodgelens.plans.suite_text import doc_terms
    e = emb_topics(spark, sf)
    counts = e.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    dt = doc_terms(spark, sf).join(e.select(F.col("vec_id").alias("review_id"), "topic"), "review_id")
    return TP.topic_table(counts, T.ctfidf(dt, "topic", 10), TP.representatives(e, "vec_id", "topic", "embedding", 3), "topic", "vec_id")


@query("outlier_share", """
SELECT CAST(count_if(topic = -1) AS BIGINT) AS n_outliers, count(*) AS n,
       round(count_if(topic = -1) * 100E0 / count(*), 6) AS pct_outliers FROM emb_topics
""")
def outlier_share(spark, sf):
    """V12."""
    e = emb_topics(spark, sf)
    return e.agg(F.count_if(F.col("topic") == -1).alias("n_outliers"), F.count(F.lit(1)).alias("n")).withColumn(
        "pct_outliers", F.round(F.col("n_outliers") * 100.0 / F.col("n"), 6))


_TOPICS = [-1, 0, 1, 2, 3]
_TN = {-1: "p_outlier", 0: "p0", 1: "p1", 2: "p2", 3: "p3"}

V.register("topic_mix_v", """
WITH c AS (SELECT listing_id, topic, count(*) AS n FROM fx_comment_topics GROUP BY ALL),
t AS (SELECT listing_id, sum(n) AS n FROM c GROUP BY listing_id),
m AS (SELECT listing_id, arg_max(topic, n * 100 - topic) AS dominant_topic FROM c GROUP BY listing_id)
SELECT t.listing_id, t.n AS num_comments, m.dominant_topic, """ + ", ".join(
    f"coalesce((SELECT c.n FROM c WHERE c.listing_id = t.listing_id AND c.topic = {k}), 0) / t.n AS {_TN[k]}"
    for k in _TOPICS) + """
FROM t JOIN m ON t.listing_id = m.listing_id
""")


def topic_mix_df(spark, sf):
    ct = catalog.fx_comment_topics(spark, sf)
    p = R.pivot_counts(ct, "listing_id", "topic", _TOPICS)
    n = ct.groupBy("listing_id").agg(F.count(F.lit(1)).alias("num_comments"))
    mode = R.mode_per_key(ct, "listing_id", "topic", "dominant_topic")
    j = p.join(n, "listing_id").join(mode, "listing_id")
    return j.select("listing_id", "num_comments", "dominant_topic",
                    *[(F.col(str(k)) / F.col("num_comments")).alias(_TN[k]) for k in _TOPICS])


@query("topic_mix", "SELECT listing_id, CAST(num_comments AS BIGINT) AS num_comments, dominant_topic, "
       + ", ".join(f"round({_TN[k]}, 9) AS {_TN[k]}" for k in _TOPICS) + " FROM topic_mix_v")
def topic_mix(spark, sf):
    """Comment-topic proportions per listing (-1 included), dominant topic, n."""
    return topic_mix_df(spark, sf).select("listing_id", "num_comments", "dominant_topic",
                                          *[F.round(_TN[k], 9).alias(_TN[k]) for k in _TOPICS])


def _topic_listings(spark, sf):
    m = topic_mix_df(spark, sf).filter(F.col("dominant_topic") != -1)
    lb = listing_base(spark, sf)
    return lb.join(m, lb.id == m.listing_id)


@query("topic_price", """
SELECT m.dominant_topic, count(*) AS n, quantile_cont(l.price_numeric, 0.5) AS median_price
FROM listing_base l JOIN topic_mix_v m ON l.id = m.listing_id WHERE m.dominant_topic <> -1 GROUP BY m.dominant_topic
""")
def topic_price(spark, sf):
    """Price by dominant topic (outliers excluded)."""
    return R.median_and_count(_topic_listings(spark, sf), "dominant_topic", "price_numeric", "median_price", "n")


_SC = ["review_scores_rating", "review_scores_cleanliness", "review_scores_location"]


@query("topic_scores", "SELECT m.dominant_topic, " + ", ".join(f"round(avg(l.{c}), 9) AS {c}" for c in _SC)
       + " FROM listing_base l JOIN topic_mix_v m ON l.id = m.listing_id WHERE m.dominant_topic <> -1 "
       "GROUP BY m.dominant_topic")
def topic_scores(spark, sf):
    """Mean review scores by dominant topic."""
    return R.group_agg(_topic_listings(spark, sf), "dominant_topic",
                       *[F.round(F.avg(c), 9).alias(c) for c in _SC])


_BOROS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_BN = ["africa", "america", "asia", "europe", "middle_east"]


@query("topic_borough", "SELECT m.dominant_topic, " + ", ".join(
    f"round(count(*) FILTER (WHERE l.borough = '{b}') / count(*), 9) AS {n}" for b, n in zip(_BOROS, _BN))
    + " FROM listing_base l JOIN topic_mix_v m ON l.id = m.listing_id WHERE m.dominant_topic <> -1 "
    "GROUP BY m.dominant_topic")
def topic_borough(spark, sf):
    """Topic x borough, row-normalised."""
    t = _topic_listings(spark, sf).withColumn("b", F.lower(F.regexp_replace("borough", " ", "_")))
    ct = R.crosstab_share(t, "dominant_topic", "b", _BN)
    return ct.select("dominant_topic", *[F.round(n, 9).alias(n) for n in _BN])


@query("topic_correlation", " UNION ALL ".join(
    f"SELECT CAST({a} AS INTEGER) AS topic_a, CAST({b} AS INTEGER) AS topic_b, round(corr(p{a}, p{b}), 6) AS r FROM topic_mix_v"
    for a in range(4) for b in range(a + 1, 4)))
def topic_correlation(spark, sf):
    """Which topics occur together: correlation of topic shares over listings."""
    ct = catalog.fx_comment_topics(spark, sf)
    n = ct.groupBy("listing_id").agg(F.count(F.lit(1)).alias("_n"))
    shares = ct.groupBy("listing_id", "topic").agg(F.count(F.lit(1)).alias("n")).join(n, "listing_id").select(
        "listing_id", "topic", (F.col("n") / F.col("_n")).alias("share"))
    r = TP.topic_correlations(shares, "listing_id", "topic", "share").where("topic_a >= 0 AND topic_b <= 3")
    return r.select(F.col("topic_a").cast("int").alias("topic_a"), F.col("topic_b").cast("int").alias("topic_b"), F.round("r", 6).alias("r"))


_ROOMS = {"entire_home": "Entire home/apt", "hotel_room": "Hotel room", "private_room": "Private room", "shared_room": "Shared room"}


@query("topic_room", "SELECT m.dominant_topic, " + ", ".join(
    f"round(count(*) FILTER (WHERE l.room_type = '{r}') / count(*) FILTER (WHERE l.room_type IN ({', '.join(repr(x) for x in _ROOMS.values())})), 9) AS {n}"
    for n, r in _ROOMS.items())
    + " FROM listing_base l JOIN topic_mix_v m ON l.id = m.listing_id WHERE m.dominant_topic <> -1 GROUP BY m.dominant_topic")
def topic_room(spark, sf):
    """Topic x room type, row-normalised."""
    ct = R.crosstab_share(_topic_listings(spark, sf), "dominant_topic", "room_type", list(_ROOMS.values()))
    return ct.select("dominant_topic", *[F.round(F.col(f"`{r}`"), 9).alias(n) for n, r in _ROOMS.items()])


@query("topic_confidence", """
WITH w AS (SELECT listing_id, greatest(p0, p1, p2, p3) AS top_prob,
                  (p0 > 0.05)::INTEGER + (p1 > 0.05)::INTEGER + (p2 > 0.05)::INTEGER + (p3 > 0.05)::INTEGER AS n_above,
                  p0 + p1 + p2 + p3 AS mass
           FROM topic_mix_v WHERE dominant_topic <> -1)
SELECT count(*) AS n, round(min(top_prob), 9) AS min_top_prob, round(max(top_prob), 9) AS max_top_prob,
       round(avg(top_prob), 9) AS mean_top_prob, round(quantile_cont(top_prob, 0.5), 9) AS median_top_prob,
       round(avg(CAST(mass > 0.8 AS INTEGER)), 9) AS share_mass_above_80, round(avg(n_above), 9) AS mean_topics_above_5pct
FROM w
""")
def topic_confidence(spark, sf):
    """Confidence of the dominant topic, probability mass, diversity."""
    from lodgelens.functions import scalar as S
    cols = ["p0", "p1", "p2", "p3"]
    m = topic_mix_df(spark, sf).filter(F.col("dominant_topic") != -1).select(
        F.greatest(*cols).alias("top_prob"), S.row_count_above(cols, 0.05).alias("n_above"),
        S.row_sum(cols).alias("mass"))
    mid = ranks.medians(m, {"_mid": F.col("top_prob")})
    all_ = m.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("top_prob"), 9).alias("min_top_prob"),
                 F.round(F.max("top_prob"), 9).alias("max_top_prob"), F.round(F.avg("top_prob"), 9).alias("mean_top_prob"),
                 F.round(F.avg((F.col("mass") > 0.8).cast("int")), 9).alias("share_mass_above_80"),
                 F.round(F.avg("n_above"), 9).alias("mean_topics_above_5pct"))
    return all_.crossJoin(F.broadcast(mid)).withColumn("median_top_prob", F.round("_mid", 9)).drop("_mid")


@query("reduce_dims")
def reduce_dims(spark, sf):
    """V3: unit-normalised embeddings reduced to 5 dimensions by PCA
    (rows-only: eigenvector signs are arbitrary)."""
    r = TP.reduce_dims(table(spark, sf, "embeddings"), "embedding", 5)
    return r.select("vec_id", "label", "reduced")


@query("density_clusters")
def density_clusters(spark, sf):
    """V4: DBSCAN over the PCA-reduced embeddings (rows-only; checked
    against a brute-force numpy DBSCAN in tests)."""
    r = TP.reduce_dims(table(spark, sf, "embeddings"), "embedding", 5)
    return TP.density_clusters(r, "vec_id", "reduced", eps=0.35, min_samples=5, min_cluster_size=10)


@query("density_clusters_raw", """
WITH RECURSIVE x AS (SELECT vec_id AS id, CAST(embedding[1:3] AS DOUBLE[]) AS v FROM embeddings),
nb AS (SELECT a.id, b.id AS jd FROM x a JOIN x b ON list_sum([(a.v[k] - b.v[k]) * (a.v[k] - b.v[k]) FOR k IN [1, 2, 3]]) <= 0.06 * 0.06::DOUBLE),
core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= 6),
e AS (SELECT id, jd FROM nb WHERE id IN (SELECT id FROM core) AND jd IN (SELECT id FROM core)),
r(id, lab) AS (SELECT id, id FROM core UNION SELECT e.jd, r.lab FROM r JOIN e ON r.id = e.id),
c AS (SELECT id, min(lab) AS lab FROM r GROUP BY id),
l AS (SELECT id, lab FROM c UNION ALL
      SELECT nb.id, min(c.lab) FROM nb JOIN c ON nb.jd = c.id WHERE nb.id NOT IN (SELECT id FROM core) GROUP BY nb.id),
k AS (SELECT lab, CAST(row_number() OVER (ORDER BY min(id)) - 1 AS INTEGER) AS cluster FROM l GROUP BY lab HAVING count(*) >= 10)
SELECT x.id AS vec_id, coalesce(k.cluster, -1) AS cluster FROM x LEFT JOIN l USING (id) LEFT JOIN k USING (lab)
""")
def density_clusters_raw(spark, sf):
    """V4: DBSCAN over the first three vector components, which SQL can follow."""
    v = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("v"))
    return TP.density_clusters(v, "vec_id", "v", eps=0.06, min_samples=6, min_cluster_size=10)


def in_half(id_col, seed):
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(2)) == 0


@query("fit_sample_assign_all")
def fit_sample_assign_all(spark, sf):
    """V5: clusters fitted on a seeded half of the vectors (drawn row by row
    from a hash of the id), then every vector (all rows) assigned to the most
    similar cluster centroid."""
    r = TP.reduce_dims(table(spark, sf, "embeddings"), "embedding", 5)
    sample = r.filter(in_half("vec_id", 42))
    cl = TP.density_clusters(sample, "vec_id", "reduced", eps=0.35, min_samples=5, min_cluster_size=10)
    fitted = sample.join(cl, "vec_id").withColumnRenamed("cluster", "topic")
    cents = TP.centroids(fitted, "topic", "reduced")
    s = TP.similarities(r, "reduced", cents, "topic")
    best = F.aggregate("_sims", F.struct(F.lit(-1).alias("t"), F.lit(-2.0).alias("sim")),
                       lambda acc, x: F.when(x["sim"] > acc["sim"], x).otherwise(acc))
    return s.select("vec_id", best["t"].alias("topic"))
