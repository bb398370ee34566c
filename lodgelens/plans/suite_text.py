"""Registered queries: text jobs (X1-X12, X17, X18), vague-review removal
(P15), sentiment segments and determinants (X8, E9), ordered concatenation
(A20, A21) and class-based TF-IDF (V7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import ranks
from lodgelens.operators import relational as R
from lodgelens.operators import text as T
from lodgelens.plans import oracle_views as V
from lodgelens.plans.registry import query
from lodgelens.sources import catalog
from lodgelens.sources.tables import spread, table

_STOPS_SQL = "[" + ", ".join(f"'{s}'" for s in T.CUSTOM_STOPS) + "]"
_CLEAN_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), "
              "'http\\S+|www\\.\\S+', '', 'g'), '<.*?>', '', 'g'), '[^a-z\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))")
_TOK_SQL = ("list_filter(regexp_extract_all(lower({c}), '[a-z]+'), "
            "lambda t: length(t) >= 3 AND NOT list_contains(" + _STOPS_SQL + ", t))")
_BIGRAM_SQL = "list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"

V.register("txt_clean", f"""
SELECT review_id, listing_id, language, {_CLEAN_SQL.format(c='comments')} AS clean FROM fx_comments
""")
V.register("txt_tokens", f"""
SELECT review_id, listing_id, language, {_TOK_SQL.format(c='clean')} AS toks FROM txt_clean
""")
V.register("txt_vocab", """
WITH d AS (SELECT * FROM txt_tokens WHERE language = 'en' AND len(toks) > 0),
e AS (SELECT review_id, unnest(toks) AS term FROM d),
p AS (SELECT review_id, term, count(*) AS n FROM e GROUP BY ALL)
SELECT term, count(*) AS df, sum(n) AS cf FROM p GROUP BY term
HAVING count(*) >= 5 AND count(*) <= (SELECT count(*) FROM d) * 0.5
""")
_LEX_SQL = ("CASE length(term) % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.4 WHEN 2 THEN -0.3 WHEN 3 THEN -0.7 "
            "ELSE 0.1 END")
V.register("txt_lexicon", f"SELECT term AS word, CAST({_LEX_SQL} AS DOUBLE) AS polarity FROM txt_vocab")


def cleaned(spark, sf):
    return spread(catalog.fx_comments(spark, sf)).select("review_id", "listing_id", "language",
                                                 T.clean_text("comments").alias("clean"))


def cleaned_en(spark, sf):
    """The cleaned English comments, written once per application."""
    from lodgelens.plans.materialize import materialized
    return materialized(spark, "clean_en", sf, lambda: cleaned(spark, sf).filter(F.col("language") == "en"))


def tokenised(spark, sf):
    """The tokens, written once per application: most jobs read them twice or more."""
    from lodgelens.plans.materialize import materialized
    return materialized(spark, "tokens", sf, lambda: cleaned(spark, sf).select("review_id", "listing_id", "language", T.tokens("clean").alias("toks")))


def doc_terms(spark, sf):
    """The shared (review, listing, language, term, n) table, written once
    per application and reused by vocabulary, TF-IDF and coherence jobs."""
    from lodgelens.plans.materialize import materialized
    return materialized(spark, "doc_terms", sf, lambda: T.doc_terms(
        tokenised(spark, sf), "review_id", "toks", ["listing_id", "language"]))


def vocab(spark, sf, dt=None):
    dt = doc_terms(spark, sf) if dt is None else dt
    return T.vocabulary_from(dt.filter(F.col("language") == "en"), "review_id", 5, 0.5)


def lexicon(spark, sf):
    """Fixture lexicon by rule over the English vocabulary."""
    L = F.length("term") % 5
    pol = F.when(L == 0, 0.8).when(L == 1, 0.4).when(L == 2, -0.3).when(L == 3, -0.7).otherwise(0.1)
    return vocab(spark, sf).select(F.col("term").alias("word"), pol.cast("double").alias("polarity"))


@query("clean_text", f"SELECT review_id, {_CLEAN_SQL.format(c='comments')} AS clean FROM fx_comments")
def clean_text(spark, sf):
    """X1."""
    return cleaned(spark, sf).select("review_id", "clean")


@query("normalise_ws", """
SELECT review_id, trim(regexp_replace(lower(coalesce(comments, '')), '\\s+', ' ', 'g')) AS text FROM fx_comments
WHERE trim(regexp_replace(lower(coalesce(comments, '')), '\\s+', ' ', 'g')) <> ''
""")
def normalise_ws(spark, sf):
    """Light clean, empty documents dropped."""
    c = catalog.fx_comments(spark, sf).select("review_id", T.normalise_ws("comments").alias("text"))
    return c.filter(F.col("text") != "")


@query("language_filter", "SELECT review_id, listing_id FROM fx_comments WHERE language = 'de'")
def language_filter(spark, sf):
    """X4."""
    return catalog.fx_comments(spark, sf).filter(F.col("language") == "de").select("review_id", "listing_id")


@query("drop_vague", "SELECT review_id, clean FROM txt_clean WHERE NOT coalesce(trim(clean) IN ("
       + ", ".join(f"'{p}'" for p in T.VAGUE_PATTERNS) + "), false)")
def drop_vague(spark, sf):
    """P15."""
    return R.drop_matching(cleaned(spark, sf).select("review_id", "clean"), "clean", T.VAGUE_PATTERNS)


@query("tokenize", """
SELECT review_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM txt_tokens
""")
def tokenize(spark, sf):
    """Alphabetic tokens, length >= 3, stop words removed."""
    t = tokenised(spark, sf)
    return t.select("review_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query("vocabulary", "SELECT term, df, CAST(cf AS BIGINT) AS cf FROM txt_vocab")
def vocabulary(spark, sf):
    """English vocabulary pruned by document frequency (>= 5 docs, <= 50 %)."""
    return vocab(spark, sf)


@query("bag_of_words", """
WITH e AS (SELECT review_id, unnest(toks) AS term FROM txt_tokens WHERE language = 'en')
SELECT review_id, term, count(*) AS count FROM e WHERE term IN (SELECT term FROM txt_vocab) GROUP BY ALL
""")
def bag_of_words(spark, sf):
    """X10."""
    dt = doc_terms(spark, sf)
    return T.bag_of_words_from(dt.filter(F.col("language") == "en"), "review_id", vocab(spark, sf, dt))


@query("ngram_counts", f"""
WITH d AS (SELECT review_id, list_concat(toks, CASE WHEN len(toks) >= 2 THEN {_BIGRAM_SQL.format(t='toks')}
                                                 ELSE []::VARCHAR[] END) AS g
           FROM txt_tokens WHERE language = 'en' AND len(toks) > 0),
e AS (SELECT review_id, unnest(g) AS term FROM d),
p AS (SELECT review_id, term, count(*) AS n FROM e GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM p GROUP BY term
HAVING count(*) >= 5 AND count(*) <= (SELECT count(*) FROM d) * 0.5
""")
def ngram_counts(spark, sf):
    """X11: unigrams + bigrams, min 5 documents, max 50 % of documents."""
    t = tokenised(spark, sf).filter(F.col("language") == "en")
    d = t.select("review_id", T.ngrams_1_2(F.col("toks")).alias("g"))
    return T.vocabulary_from(T.doc_terms(d, "review_id", "g"), "review_id", 5, 0.5, t.where(F.size("toks") > 0))


# Word lists as tables.  The fixture derives them by rule from the English
# vocabulary: lemmas drop a final s, ed or ing, parts of speech follow the
# length, names end in n, and the most frequent words stand for the generic list.
_LEMMA_SQL = "regexp_replace(term, '(ing|ed|s)$', '')"
V.register("txt_lemmas", f"""
SELECT term AS form, CASE WHEN length({_LEMMA_SQL}) >= 2 THEN {_LEMMA_SQL} ELSE term END AS lemma,
       CASE length(term) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' ELSE 'DET' END AS pos FROM txt_vocab
""")
V.register("txt_stops", "SELECT 'custom' AS list, unnest(" + _STOPS_SQL + """) AS word
UNION ALL SELECT 'names', term FROM txt_vocab WHERE length(term) = 5 AND term LIKE '%n'
UNION ALL SELECT 'generic', term FROM (SELECT term FROM txt_vocab ORDER BY cf DESC, term LIMIT 25)
""")
V.register("txt_raw", """
SELECT review_id, language, regexp_extract_all(clean, '[a-z]+') AS toks FROM txt_clean
""")
KEEP_POS = ["NOUN", "VERB", "ADJ"]


def lemma_table(spark, sf):
    """Fixture (form, lemma, pos) by rule over the English vocabulary."""
    cut = F.regexp_replace("term", "(ing|ed|s)$", "")
    n = F.length("term") % 4
    pos = F.when(n == 0, "NOUN").when(n == 1, "VERB").when(n == 2, "ADJ").otherwise("DET")
    return vocab(spark, sf).select(F.col("term").alias("form"), F.when(F.length(cut) >= 2, cut).otherwise(F.col("term")).alias("lemma"), pos.alias("pos"))


def stop_lists(spark, sf):
    """Fixture stop lists: the project's own, names and generic words."""
    v = vocab(spark, sf)
    return {"custom": spark.createDataFrame([(w,) for w in T.CUSTOM_STOPS], "word string"),
            "names": v.where("length(term) = 5 AND term LIKE '%n'").select(F.col("term").alias("word")),
            "generic": v.orderBy(F.desc("cf"), "term").limit(25).select(F.col("term").alias("word"))}


@query("tokenize_lemmas", """
WITH e AS (SELECT review_id, unnest(toks) AS form, generate_subscripts(toks, 1) AS p FROM txt_raw),
j AS (SELECT e.review_id, e.form, e.p, coalesce(l.lemma, e.form) AS lemma, l.pos FROM e LEFT JOIN txt_lemmas l ON e.form = l.form),
k AS (SELECT * FROM j WHERE (pos IS NULL OR pos IN ('NOUN', 'VERB', 'ADJ')) AND length(lemma) >= 3
      AND form NOT IN (SELECT word FROM txt_stops) AND lemma NOT IN (SELECT word FROM txt_stops))
SELECT r.review_id, CAST(count(k.lemma) AS INTEGER) AS n_tokens, coalesce(string_agg(k.lemma, ' ' ORDER BY k.p), '') AS tokens
FROM txt_raw r LEFT JOIN k ON r.review_id = k.review_id GROUP BY r.review_id
""")
def tokenize_lemmas(spark, sf):
    """Lemmas of the kept parts of speech without the three lists' words."""
    t = T.normalise_tokens(cleaned(spark, sf), "review_id", "clean", T.union_stops(*stop_lists(spark, sf).values()),
                           lemma_table(spark, sf), KEEP_POS)
    return t.select("review_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


_STOP_SETS = {"names": "list = 'names'", "generic": "list = 'generic'", "union": "true"}


@query("ngram_counts_stops", "\nUNION ALL\n".join(f"""
SELECT '{n}' AS stops, term, df, cf FROM (
  WITH s AS (SELECT list(word) AS ws FROM txt_stops WHERE {w}),
  t AS (SELECT review_id, [x FOR x IN toks IF length(x) >= 3 AND NOT list_contains(ws, x)] AS toks FROM txt_raw, s WHERE language = 'en'),
  d AS (SELECT review_id, list_concat(toks, CASE WHEN len(toks) >= 2 THEN {_BIGRAM_SQL.format(t='toks')} ELSE []::VARCHAR[] END) AS g FROM t WHERE len(toks) > 0),
  e AS (SELECT review_id, unnest(g) AS term FROM d),
  p AS (SELECT review_id, term, count(*) AS n FROM e GROUP BY ALL)
  SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM p GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= (SELECT count(*) FROM d) * 0.5)""" for n, w in _STOP_SETS.items()))
def ngram_counts_stops(spark, sf):
    """X11 with the name list, the generic list and the union of all three."""
    lists = stop_lists(spark, sf)
    sets = {"names": lists["names"], "generic": lists["generic"], "union": T.union_stops(*lists.values())}
    en = cleaned_en(spark, sf)
    out = []
    for name, stops in sets.items():
        t = T.normalise_tokens(en, "review_id", "clean", stops)
        counts = T.ngram_vocabulary(t, "review_id", "toks", 5, 0.5)
        out.append(counts.select(F.lit(name).alias("stops"), "term", "df", "cf"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("token_docs", """
WITH o AS (SELECT listing_id, review_id, toks FROM txt_tokens),
a AS (SELECT listing_id, flatten(list(toks ORDER BY review_id)) AS t FROM o GROUP BY listing_id)
SELECT listing_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM a
""")
def token_docs(spark, sf):
    """All tokens of a listing in review order, one document per listing."""
    n = tokenised(spark, sf).groupBy("listing_id").agg(F.sum(F.size("toks")).cast("int").alias("n_tokens"))
    d = R.chunks_digest(token_doc_chunks(spark, sf), "listing_id").withColumnRenamed("listing_id", "_id")
    return n.join(d, F.col("listing_id").eqNullSafe(F.col("_id"))).drop("_id")


@query("token_doc_chunks")
def token_doc_chunks(spark, sf):
    """The documents themselves, in ordered chunks of bounded size."""
    t = tokenised(spark, sf).select("listing_id", "review_id",
                                    F.when(F.size("toks") > 0, F.array_join("toks", " ")).alias("text"))
    return R.concat_chunks(t, "listing_id", "review_id", "text", " ")


@query("concat_docs", """
SELECT listing_id, count(*) AS n_docs, md5(string_agg(comments, ' ' ORDER BY review_id)) AS digest
FROM fx_comments GROUP BY listing_id
""")
def concat_docs(spark, sf):
    """Whole texts of a listing concatenated in order."""
    n = catalog.fx_comments(spark, sf).groupBy("listing_id").agg(F.count(F.lit(1)).alias("n_docs"))
    d = R.chunks_digest(concat_doc_chunks(spark, sf), "listing_id").withColumnRenamed("listing_id", "_id")
    return n.join(d, F.col("listing_id").eqNullSafe(F.col("_id"))).drop("_id")


@query("concat_doc_chunks")
def concat_doc_chunks(spark, sf):
    """The documents themselves, in ordered chunks of bounded size."""
    return R.concat_chunks(catalog.fx_comments(spark, sf), "listing_id", "review_id", "comments", " ")


@query("first_n_docs", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY review_id) AS rn FROM fx_comments)
SELECT listing_id, md5(string_agg(comments, ' ' ORDER BY review_id)) AS digest FROM r WHERE rn <= 5 GROUP BY listing_id
""")
def first_n_docs(spark, sf):
    """The first 5 texts of each listing."""
    d = R.concat_in_order(catalog.fx_comments(spark, sf), "listing_id", "review_id", "comments", " ", first_n=5)
    return d.select("listing_id", F.md5("doc").alias("digest"))


_TRI_SQL = """
WITH d AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) || ' ' AS t
           FROM documents),
x AS (SELECT doc_id, lang, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM d),
tri AS (SELECT doc_id, lang, substr(t, i, 3) AS tri FROM x),
lab AS (SELECT * FROM tri WHERE lang IS NOT NULL AND doc_id IN
        (SELECT doc_id FROM documents WHERE lang IS NOT NULL AND length(trim(text)) > 0)),
c AS (SELECT lang, tri, count(*) AS c FROM lab GROUP BY ALL),
pl AS (SELECT l.lang, sum(c) AS n_lang FROM c l GROUP BY l.lang),
v AS (SELECT count(DISTINCT tri) AS v FROM c),
dc AS (SELECT lang, count(*) AS d FROM documents WHERE lang IS NOT NULL AND length(trim(text)) > 0 GROUP BY lang),
prof AS (SELECT c.lang, c.tri, ln((c.c + 1) / (pl.n_lang + v.v)) - ln(1 / (pl.n_lang + v.v)) AS gain,
                ln(1 / (pl.n_lang + v.v)) AS unseen, ln(dc.d / (SELECT sum(d) FROM dc)) AS lp
         FROM c JOIN pl ON c.lang = pl.lang JOIN dc ON dc.lang = c.lang, v),
per AS (SELECT doc_id, tri, count(*) AS n FROM tri GROUP BY ALL),
nt AS (SELECT doc_id, sum(n) AS n_tri FROM per GROUP BY doc_id),
consts AS (SELECT lang, first(unseen) AS unseen, first(lp) AS lp FROM prof GROUP BY lang),
seen AS (SELECT per.doc_id, prof.lang, sum(per.n * prof.gain) AS g FROM per JOIN prof ON per.tri = prof.tri GROUP BY ALL),
sc AS (SELECT seen.doc_id, seen.lang, consts.lp + nt.n_tri * consts.unseen + seen.g AS score
       FROM seen JOIN consts ON seen.lang = consts.lang JOIN nt ON nt.doc_id = seen.doc_id),
best AS (SELECT doc_id, arg_min(lang, -score) AS language FROM sc GROUP BY doc_id)
"""


@query("detect_language", _TRI_SQL + """
SELECT d.doc_id, d.lang, CASE WHEN length(trim(regexp_replace(lower(coalesce(d.text, '')), '\\s+', ' ', 'g'))) = 0
       THEN 'unknown' ELSE coalesce(best.language, 'unknown') END AS language
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id
""")
def detect_language(spark, sf):
    """Character-trigram naive Bayes trained on the labelled documents,
    applied to every document."""
    docs = spread(table(spark, sf, "documents"))
    pred = T.detect_languages(docs, "doc_id", "text", "lang")
    return docs.select("doc_id", "lang").join(pred, "doc_id")


_HELD = "('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 4 = 0"


@query("detect_language_heldout", _TRI_SQL.replace("WHERE lang IS NOT NULL", f"WHERE lang IS NOT NULL AND NOT ({_HELD})") + f"""
SELECT d.doc_id, {_HELD} AS held_out, d.lang, CASE WHEN length(trim(regexp_replace(lower(coalesce(d.text, '')), '\\s+', ' ', 'g'))) = 0
       THEN 'unknown' ELSE coalesce(best.language, 'unknown') END AS language
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id
""".replace("d.doc_id, ('0x' || substr(md5(CAST(doc_id", "d.doc_id, ('0x' || substr(md5(CAST(d.doc_id"))
def detect_language_heldout(spark, sf):
    """X3 with the tags of a quarter of the documents (by a digest of the id)
    hidden from training, so that their predictions are honest."""
    docs = spread(table(spark, sf, "documents"))
    held = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("long") % 4 == 0
    pred = T.detect_languages(docs, "doc_id", "text", "lang", train=~held)
    return docs.select("doc_id", held.alias("held_out"), "lang").join(pred, "doc_id")


def sentiment(spark, sf):
    c = cleaned_en(spark, sf)
    s = T.sentiment_scores(c, "review_id", "clean", lexicon(spark, sf))
    return c.join(s, "review_id")


_SENT_SQL = """
WITH c AS (SELECT * FROM txt_clean WHERE language = 'en'),
tk AS (SELECT review_id, list_filter(string_split(clean, ' '), lambda t: t <> '') AS t FROM c),
ex AS (SELECT review_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS pos, t FROM tk),
ex2 AS (SELECT review_id, word, CASE WHEN pos > 1 THEN t[pos - 1] END AS prev FROM ex),
hit AS (SELECT ex2.review_id, greatest(-1.0, least(1.0, l.polarity *
          CASE WHEN prev IN ('not', 'never', 'no', 'nothing', 'hardly') THEN -0.5
               ELSE coalesce(CASE prev WHEN 'very' THEN 1.3 WHEN 'really' THEN 1.3 WHEN 'extremely' THEN 1.5
                                       WHEN 'so' THEN 1.2 WHEN 'too' THEN 1.2 END, 1.0) END)) AS a
        FROM ex2 JOIN txt_lexicon l ON ex2.word = l.word),
s AS (SELECT review_id, avg(a) AS s FROM hit GROUP BY review_id)
SELECT c.review_id, c.listing_id, c.clean, coalesce(s.s, 0.0) AS sentiment_score
FROM c LEFT JOIN s ON c.review_id = s.review_id
"""
V.register("txt_sentiment", _SENT_SQL)


@query("sentiment_score", "SELECT review_id, round(sentiment_score, 9) AS sentiment_score, "
       "CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative' ELSE 'neutral' END "
       "AS sentiment_label FROM txt_sentiment")
def sentiment_score(spark, sf):
    """X7 + F18."""
    s = sentiment(spark, sf)
    return s.select("review_id", F.round("sentiment_score", 9).alias("sentiment_score"),
                    S.sentiment_label("sentiment_score").alias("sentiment_label"))


def listing_sentiment(spark, sf):
    s = R.drop_matching(sentiment(spark, sf), "clean", T.VAGUE_PATTERNS).withColumn(
        "label", S.sentiment_label("sentiment_score"))
    g = R.group_agg(s, "listing_id", F.avg("sentiment_score").alias("mean_sentiment"),
                    F.count("sentiment_score").alias("num_reviews"),
                    F.avg((F.col("label") == "positive").cast("int")).alias("positive_ratio"),
                    F.avg((F.col("label") == "negative").cast("int")).alias("negative_ratio"),
                    F.avg((F.col("label") == "neutral").cast("int")).alias("neutral_ratio"))
    mid = ranks.medians(s, {"median_sentiment": F.col("sentiment_score")}, "listing_id")
    return g.join(mid, "listing_id", "left").withColumn("segment", S.segment_listing("positive_ratio"))


V.register("txt_listing_sentiment", """
WITH s AS (SELECT *, CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative'
                          ELSE 'neutral' END AS label FROM txt_sentiment
           WHERE NOT coalesce(trim(clean) IN ('good', 'very good', 'nice', 'ok', 'okay', 'fine', 'great',
                                              'not bad', 'not so good', 'excellent', 'wonderful'), false))
SELECT listing_id, avg(sentiment_score) AS mean_sentiment, quantile_cont(sentiment_score, 0.5) AS median_sentiment,
       count(sentiment_score) AS num_reviews, avg(CAST(label = 'positive' AS INTEGER)) AS positive_ratio,
       avg(CAST(label = 'negative' AS INTEGER)) AS negative_ratio, avg(CAST(label = 'neutral' AS INTEGER)) AS neutral_ratio,
       CASE WHEN avg(CAST(label = 'positive' AS INTEGER)) >= 0.9 THEN 'satisfactory'
            WHEN avg(CAST(label = 'positive' AS INTEGER)) >= 0.5 THEN 'moderate' ELSE 'dissatisfactory' END AS segment
FROM s WHERE listing_id IS NOT NULL GROUP BY listing_id
""")

_LS_COLS = ["mean_sentiment", "median_sentiment", "positive_ratio", "negative_ratio", "neutral_ratio"]


@query("sentiment_segments", "SELECT listing_id, num_reviews, segment, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in _LS_COLS) + " FROM txt_listing_sentiment")
def sentiment_segments(spark, sf):
    """Per-listing sentiment aggregates and segment."""
    g = listing_sentiment(spark, sf)
    return g.select("listing_id", "num_reviews", "segment", *[F.round(c, 9).alias(c) for c in _LS_COLS])


_DET_ROOM = "CASE room_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.ROOM_TYPE_DETERMINANT_MAP.items()) + " END"


@query("listing_determinants", f"""
WITH d AS (SELECT id AS listing_key, avg(review_scores_cleanliness) AS cleaning_score,
                  avg(review_scores_communication) AS communication_score, avg(review_scores_location) AS location_score,
                  max(coalesce(CASE WHEN json_valid(amenities) THEN CAST(json_array_length(amenities) AS INTEGER) END, 0)) AS amenities,
                  quantile_cont({_DET_ROOM}, 0.5) AS room_type,
                  quantile_cont(CASE instant_bookable WHEN 't' THEN 1 WHEN 'f' THEN 0 END, 0.5) AS instant_bookable,
                  avg(TRY_CAST(trim(replace(host_response_rate, '%', '')) AS DOUBLE) / 100E0) AS response_rate
           FROM fx_listings GROUP BY id)
SELECT s.listing_id, round(d.cleaning_score, 9) AS cleaning_score, round(d.communication_score, 9) AS communication_score,
       round(d.location_score, 9) AS location_score, d.amenities, d.room_type, d.instant_bookable,
       round(d.response_rate, 9) AS response_rate, s.num_reviews, round(s.positive_ratio, 9) AS positive_ratio, s.segment
FROM d JOIN txt_listing_sentiment s ON d.listing_key = CAST(regexp_extract(s.listing_id, '[0-9]+', 0) AS BIGINT)
""")
def listing_determinants(spark, sf):
    """Seven determinants per listing joined to its sentiment segment."""
    lst = catalog.fx_listings(spark, sf)
    d = lst.groupBy(F.col("id").alias("listing_key")).agg(
        F.avg("review_scores_cleanliness").alias("cleaning_score"),
        F.avg("review_scores_communication").alias("communication_score"),
        F.avg("review_scores_location").alias("location_score"),
        F.max(S.json_array_len("amenities")).alias("amenities"),
        F.median(S.lookup("room_type", S.ROOM_TYPE_DETERMINANT_MAP)).alias("room_type"),
        F.median(S.tf_map("instant_bookable")).alias("instant_bookable"),
        F.avg(S.parse_percent("host_response_rate")).alias("response_rate"))
    s = listing_sentiment(spark, sf).withColumn(
        "listing_key", F.regexp_extract("listing_id", "[0-9]+", 0).cast("long"))
    j = d.join(s, "listing_key")
    return j.select("listing_id", *[F.round(c, 9).alias(c) for c in ("cleaning_score", "communication_score",
                                                                      "location_score")],
                    "amenities", "room_type", "instant_bookable", F.round("response_rate", 9).alias("response_rate"),
                    "num_reviews", F.round("positive_ratio", 9).alias("positive_ratio"), "segment")


# ---------------------------------------------------------- class TF-IDF

V.register("txt_ctfidf", """
WITH e AS (SELECT language AS cls, unnest(toks) AS term FROM txt_tokens),
tf AS (SELECT cls, term, count(*) AS tf FROM e GROUP BY ALL),
f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term),
a AS (SELECT avg(w) AS A FROM (SELECT cls, sum(tf) AS w FROM tf GROUP BY cls)),
w AS (SELECT tf.cls, tf.term, tf.tf * ln(1 + a.A / f.f) AS weight FROM tf JOIN f ON tf.term = f.term, a),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY weight DESC, term) AS rank FROM w)
SELECT cls, term, CAST(rank AS INTEGER) AS rank, weight FROM r WHERE rank <= 10
""")


def ctfidf_table(spark, sf, dt=None):
    dt = doc_terms(spark, sf) if dt is None else dt
    return T.ctfidf(dt.withColumnRenamed("language", "cls"), "cls", 10)


@query("ctfidf_words", "SELECT cls, term, rank, round(weight, 9) AS weight FROM txt_ctfidf")
def ctfidf_words(spark, sf):
    """V7: top 10 words per class (class = the comment's language tag)."""
    return ctfidf_table(spark, sf).withColumn("weight", F.round("weight", 9))


@query("listing_word_weights", """
WITH c AS (SELECT listing_id, language AS cls, count(*) AS n FROM fx_comments GROUP BY ALL),
s AS (SELECT listing_id, cls, n / sum(n) OVER (PARTITION BY listing_id) AS share FROM c),
t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY share DESC, cls) AS r FROM s)
       WHERE r <= 3),
w AS (SELECT t3.listing_id, k.term, sum(t3.share / k.rank) AS weight FROM t3 JOIN txt_ctfidf k ON t3.cls = k.cls
      GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY weight DESC, term) AS rn FROM w)
SELECT listing_id, term, round(weight, 9) AS weight FROM r WHERE rn <= 30
""")
def listing_word_weights(spark, sf):
    """Word weights of a listing from its top 3 classes: sum of
    share x 1/(rank+1) (rank from 0), top 30 words."""
    c = catalog.fx_comments(spark, sf).groupBy("listing_id", F.col("language").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"))
    s = R.share_of_group(c, "listing_id", "n")
    t3 = R.top_per_group(s, "listing_id", [F.desc("share"), F.asc("cls")], 3, "r")
    k = ctfidf_table(spark, sf)
    w = t3.join(k, "cls").groupBy("listing_id", "term").agg(F.sum(F.col("share") / F.col("rank")).alias("weight"))
    top = R.top_per_group(w, "listing_id", [F.desc("weight"), F.asc("term")], 30, "rn")
    return top.select("listing_id", "term", F.round("weight", 9).alias("weight"))


@query("topic_coherence", """
WITH docs AS (SELECT review_id, list_distinct(toks) AS t FROM txt_tokens),
n AS (SELECT count(*) AS n FROM docs),
words AS (SELECT DISTINCT term FROM txt_ctfidf),
dw AS (SELECT review_id, term FROM (SELECT review_id, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM words)),
p1 AS (SELECT term, count(*) AS d1 FROM dw GROUP BY term),
pairs AS (SELECT a.cls, a.term AS w1, b.term AS w2 FROM txt_ctfidf a JOIN txt_ctfidf b ON a.cls = b.cls AND a.term < b.term),
co AS (SELECT x.term AS w1, y.term AS w2, count(*) AS d12 FROM dw x JOIN dw y ON x.review_id = y.review_id AND x.term < y.term
       GROUP BY ALL),
j AS (SELECT pairs.cls, coalesce(co.d12, 0) / n.n AS p12, a.d1 / n.n AS pa, b.d1 / n.n AS pb
      FROM pairs LEFT JOIN co ON pairs.w1 = co.w1 AND pairs.w2 = co.w2 JOIN p1 a ON a.term = pairs.w1
      JOIN p1 b ON b.term = pairs.w2, n)
SELECT cls, round(avg(CASE WHEN p12 = 0 THEN -1.0 WHEN p12 = 1 THEN 1.0 ELSE ln(p12 / (pa * pb)) / (-ln(p12)) END), 9)
       AS coherence, count(*) AS n_pairs
FROM j GROUP BY cls
""")
def topic_coherence(spark, sf):
    """Document-level NPMI coherence of each class's top words."""
    dt = doc_terms(spark, sf)
    n_docs = catalog.fx_comments(spark, sf).agg(F.count(F.lit(1)))
    co = T.npmi_coherence(dt, "review_id", n_docs, ctfidf_table(spark, sf, dt), "cls")
    return co.withColumn("coherence", F.round("coherence", 9))


@query("topic_coherence_cv", """
WITH d AS (SELECT review_id, toks, len(toks) AS n FROM txt_tokens WHERE len(toks) > 0),
a AS (SELECT sum(greatest(n - 109, 1))::DOUBLE AS total FROM d),
o AS (SELECT review_id, n, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS p FROM d),
h AS (SELECT * FROM o WHERE term IN (SELECT term FROM txt_ctfidf)),
w AS (SELECT DISTINCT review_id, term, unnest(range(greatest(p - 109, 0), least(p, greatest(n - 110, 0)) + 1)) AS s FROM h),
c1 AS (SELECT term, count(*) AS n FROM w GROUP BY term),
wt AS (SELECT w.*, k.cls FROM w JOIN txt_ctfidf k USING (term)),
c2 AS (SELECT x.cls, x.term AS wi, y.term AS wj, count(*) AS n FROM wt x JOIN wt y ON x.cls = y.cls AND x.review_id = y.review_id AND x.s = y.s GROUP BY ALL),
g AS (SELECT x.cls, x.term AS wi, y.term AS wj, coalesce(c2.n, 0) / a.total + 1e-12 AS pij, i.n / a.total AS pi, j.n / a.total AS pj
      FROM txt_ctfidf x JOIN txt_ctfidf y ON x.cls = y.cls LEFT JOIN c2 ON c2.cls = x.cls AND c2.wi = x.term AND c2.wj = y.term
      JOIN c1 i ON i.term = x.term JOIN c1 j ON j.term = y.term, a),
v AS (SELECT cls, wi, wj, CASE WHEN pij < 1 THEN ln(pij / (pi * pj)) / -ln(pij) ELSE 1.0 END AS v FROM g),
t AS (SELECT cls, wj, sum(v) AS w FROM v GROUP BY cls, wj),
s AS (SELECT v.cls, v.wi, sum(v * w) / sqrt(sum(v * v) * sum(w * w)) AS cos FROM v JOIN t ON v.cls = t.cls AND v.wj = t.wj GROUP BY v.cls, v.wi)
SELECT cls, round(avg(cos), 6) AS coherence, count(*) AS n_words FROM s GROUP BY cls
""")
def topic_coherence_cv(spark, sf):
    """Window-based c_v coherence of each class's top words."""
    co = T.cv_coherence(tokenised(spark, sf), "review_id", "toks", ctfidf_table(spark, sf), "cls")
    return co.withColumn("coherence", F.round("coherence", 6))


@query("listing_sentiment", "SELECT listing_id, num_reviews, segment, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in _LS_COLS) + " FROM txt_listing_sentiment")
def listing_sentiment_q(spark, sf):
    """Named per-listing sentiment aggregates with label ratios."""
    return sentiment_segments(spark, sf)


@query("determinants", f"""
SELECT id AS listing_id, round(avg(review_scores_cleanliness), 9) AS cleaning_score,
       round(avg(review_scores_communication), 9) AS communication_score,
       round(avg(review_scores_location), 9) AS location_score,
       max(coalesce(CASE WHEN json_valid(amenities) THEN CAST(json_array_length(amenities) AS INTEGER) END, 0)) AS amenities,
       quantile_cont({_DET_ROOM}, 0.5) AS room_type,
       quantile_cont(CASE instant_bookable WHEN 't' THEN 1 WHEN 'f' THEN 0 END, 0.5) AS instant_bookable,
       round(avg(TRY_CAST(trim(replace(host_response_rate, '%', '')) AS DOUBLE) / 100E0), 9) AS response_rate
FROM fx_listings GROUP BY id
""")
def determinants(spark, sf):
    """Mixed mean / max / median aggregate per listing."""
    lst = catalog.fx_listings(spark, sf)
    return lst.groupBy(F.col("id").alias("listing_id")).agg(
        F.round(F.avg("review_scores_cleanliness"), 9).alias("cleaning_score"),
        F.round(F.avg("review_scores_communication"), 9).alias("communication_score"),
        F.round(F.avg("review_scores_location"), 9).alias("location_score"),
        F.max(S.json_array_len("amenities")).alias("amenities"),
        F.median(S.lookup("room_type", S.ROOM_TYPE_DETERMINANT_MAP)).alias("room_type"),
        F.median(S.tf_map("instant_bookable")).alias("instant_bookable"),
        F.round(F.avg(S.parse_percent("host_response_rate")), 9).alias("response_rate"))


_SEL_LISTINGS = ["src1", "src3", "src7", "src99"]
_RATIOS = ["positive_ratio", "negative_ratio", "neutral_ratio"]


@query("sentiment_breakdown", "WITH sel AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _SEL_LISTINGS)
       + ") t(listing_id)),\nj AS (SELECT sel.listing_id, s.listing_id IS NULL AS no_data, " + ", ".join(
           f"coalesce(s.{c}, 0.0) AS {c}" for c in _RATIOS)
       + " FROM sel LEFT JOIN txt_listing_sentiment s ON sel.listing_id = s.listing_id)\n" + " UNION ALL ".join(
           f"SELECT listing_id, no_data, '{c}' AS ratio, round({c}, 9) AS value FROM j" for c in _RATIOS))
def sentiment_breakdown(spark, sf):
    """Q21: sentiment ratios of selected listings, long form; listings with no
    reviews are kept with zeros and flagged (J5)."""
    sel = spark.createDataFrame([(x,) for x in _SEL_LISTINGS], "listing_id string")
    ls = listing_sentiment(spark, sf).select("listing_id", *_RATIOS).withColumn("_has", F.lit(True))
    j = sel.join(ls, "listing_id", "left").select(
        "listing_id", F.col("_has").isNull().alias("no_data"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _RATIOS])
    return j.unpivot(["listing_id", "no_data"], _RATIOS, "ratio", "value").withColumn("value", F.round("value", 9))
