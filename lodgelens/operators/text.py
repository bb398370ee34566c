"""Text jobs over review comments.

Everything is built-in Spark SQL expressions over arrays (``split``,
``filter``, ``transform``) plus ``explode``/``groupBy``: no per-row Python.
Per-document work (n-grams, negation context) is array-local, so no window
over a document is needed; corpus statistics (document frequencies,
language profiles, co-occurrence) are partial aggregates.

Re-aimed parts (the original used external libraries):
* language tags (X3): multinomial naive Bayes over character trigrams
  trained from labelled rows, Laplace smoothing (Cavnar & Trenkle 1994);
* polarity (X7): a lexicon scoring job - the lexicon is an input table of
  (word, polarity); negators flip and damp (x -0.5), intensifiers scale the
  next word, the document score is the mean over matched words, clipped to
  [-1, 1], 0 when nothing matches;
* lemma and part of speech: an optional caller-supplied (form, lemma, pos) table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Must equal the original project's lists.
# ---------------------------------------------------------------------------
CUSTOM_STOPS = [
    "airbnb", "host", "hosts", "guest", "guests", "stay", "stayed", "staying",
    "place", "apartment", "room", "house", "home", "listing", "rental",
    "bed", "bedroom", "bathroom", "kitchen", "building",
    "brooklyn", "manhattan", "queens", "bronx", "york", "nyc", "city",
    "street", "avenue", "block", "neighborhood", "area",
    "great", "nice", "good", "beautiful", "lovely", "amazing", "wonderful",
    "perfect", "excellent", "awesome", "fantastic", "love", "loved",
    "recommend", "recommended", "definitely", "highly", "enjoy", "enjoyed",
    "get", "got", "make", "made", "take", "took", "come", "came", "going",
    "would", "could", "also", "really", "very", "much", "well", "just",
    "even", "back", "still", "right", "thing", "time", "day", "night",
    "david", "michael", "john", "alex", "chris", "mark", "james", "mary",
    "sarah", "lisa", "anna", "mike", "dan", "tom", "joe", "bob",
]
VAGUE_PATTERNS = ["good", "very good", "nice", "ok", "okay", "fine", "great",
                  "not bad", "not so good", "excellent", "wonderful"]
# ---------------------------------------------------------------------------
NEGATORS = ["not", "never", "no", "nothing", "hardly"]
INTENSIFIERS = {"very": 1.3, "really": 1.3, "extremely": 1.5, "so": 1.2, "too": 1.2}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(c) -> Column:
    """Null -> '', lower, strip URLs and tags, keep [a-z whitespace '],
    collapse whitespace, trim.

    A run of characters that are not kept ends as one space, so one pattern
    does both; texts without a URL or tag skip those patterns.  Each step is
    bound once by a one-element array."""
    def without(t, words: list[str], pattern: str) -> Column:
        has = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
        return F.when(has, F.regexp_replace(t, pattern, "")).otherwise(t)
    t = F.array(F.lower(F.coalesce(_c(c), F.lit(""))))
    t = F.transform(t, lambda x: without(x, ["http", "www."], r"http\S+|www\.\S+"))
    t = F.transform(t, lambda x: without(x, ["<"], r"<.*?>"))
    return F.trim(F.regexp_replace(t[0], r"[^a-z']+", " "))


def normalise_ws(c) -> Column:
    """Lower, collapse whitespace, trim; null -> ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"\s+", " "))


def tokens(c, stops: list[str] | None = None, min_len: int = 3) -> Column:
    """Alphabetic lower-case tokens of length >= min_len not in the stop
    list (a bounded constant, looked up as a hash set).  The pattern leaves
    shorter runs of letters out, so no token is made only to be dropped."""
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit(f"[a-z]{{{max(1, min_len)},}}"), 0)
    listed = list(CUSTOM_STOPS if stops is None else stops)
    return F.filter(found, lambda t: ~t.isin(listed)) if listed else found


def explode_terms(arr, alias: str = "term"):
    """Rows for the elements of an array column, without the inferred
    ``size(arr) > 0`` filter that Catalyst adds under a plain ``explode``
    (that filter would re-run the whole tokeniser a second time): an outer
    explode keeps empty arrays as one null row, dropped right after."""
    return F.explode_outer(arr).alias(alias)


MAX_LIST_ROWS = 500_000  # word-list rows sent to every task; longer lists are shuffled to the tokens


def _word_list(df: DataFrame) -> DataFrame:
    """A word list, computed once, with a broadcast hint only when its counted
    size allows."""
    from lodgelens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= MAX_LIST_ROWS else df


def _by_doc(df: DataFrame, doc: str) -> DataFrame:
    """Rows dealt by document before they are exploded, so that grouping a
    document's words shuffles its text once and not a row per word."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)


def union_stops(*lists: DataFrame) -> DataFrame:
    """One stop list (word) from several."""
    return reduce(lambda a, b: a.unionByName(b), [x.select(F.lower("word").alias("word")) for x in lists]).distinct()


def normalise_tokens(df: DataFrame, doc: str, text, stops: DataFrame | None = None, lemmas: DataFrame | None = None,
                     keep_pos: list[str] | None = None, min_len: int = 3, out: str = "toks") -> DataFrame:
    """X5/X6 with word lists as tables: (doc, tokens in order).

    ``lemmas`` holds (form, lemma, pos), one row per form; a form that it lacks
    is its own lemma and of any part of speech.  A token stays when its part of
    speech is in ``keep_pos``, neither its form nor its lemma is in ``stops``
    (word) and its lemma has ``min_len`` letters.  Texts without such tokens
    give an empty array.  Tokens meet the lists in joins; a list is broadcast
    only when its counted size allows."""
    raw = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z]+"), 0)
    df = _by_doc(df.select(doc, raw.alias("_raw")), doc)
    long = df.select(doc, F.posexplode_outer("_raw").alias("_p", "form"))
    if lemmas is not None:
        long = long.join(_word_list(lemmas.select("form", "lemma", "pos")), "form", "left")
        long = long.withColumn("lemma", F.lower(F.coalesce("lemma", "form")))
        if keep_pos is not None:
            long = long.where(F.col("form").isNull() | F.col("pos").isNull() | F.col("pos").isin(keep_pos))
    else:
        long = long.withColumn("lemma", F.col("form"))
    if stops is not None:
        listed = _word_list(stops.select(F.lower("word").alias("_w")).distinct())
        for c in ("form", "lemma") if lemmas is not None else ("form",):
            long = long.join(listed, F.col(c) == F.col("_w"), "left_anti")
    kept = long.where(F.length("lemma") >= min_len).groupBy(doc).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "lemma"))), lambda x: x["lemma"]).alias(out))
    return df.select(doc).join(kept, doc, "left").select(doc, F.coalesce(F.col(out), F.array().cast("array<string>")).alias(out))


def bigrams(tok: Column) -> Column:
    """Consecutive token pairs joined by a space.

    ``zip_with`` of the array and its tail reads the token array twice per
    row; indexing it per element inside a lambda would re-evaluate the whole
    tokeniser for every element once Catalyst inlines the projection.
    """
    pairs = F.zip_with(tok, F.slice(tok, 2, F.greatest(F.size(tok), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda x: x.isNotNull())


def ngrams_1_2(tok: Column) -> Column:
    """X11: unigrams and bigrams (bigrams only when there are 2+ tokens)."""
    return F.concat(tok, F.when(F.size(tok) >= 2, bigrams(tok)).otherwise(F.array().cast("array<string>")))


def doc_terms(df: DataFrame, doc: str, terms: str, keys: list[str] | None = None) -> DataFrame:
    """(doc, keys..., term, n): one row per distinct term of a document.

    Build it once per corpus: vocabulary, bag of words, class TF-IDF and
    coherence all derive from it, so the tokeniser runs once and the shuffle
    is shared (Spark reuses the identical exchange); at scale write it to the
    shared folder and reuse the table.
    """
    keys = list(keys or [])
    rows = _by_doc(df.select(doc, *keys, _c(terms).alias("_terms")), doc)
    ex = rows.select(doc, *keys, explode_terms("_terms")).filter(F.col("term").isNotNull())
    return ex.groupBy(doc, *keys, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_from(dt: DataFrame, doc: str, no_below: int, no_above: float, docs: DataFrame | None = None) -> DataFrame:
    """Terms in at least ``no_below`` documents and at most a share
    ``no_above`` of the documents that have terms.  ``docs``: the ids of those
    documents, where they are cheaper to read than ``dt``."""
    n_docs = (dt if docs is None else docs).select(doc).distinct().agg(F.count(F.lit(1)).alias("_nd"))
    dfreq = dt.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    return dfreq.crossJoin(F.broadcast(n_docs)).filter(
        (F.col("df") >= no_below) & (F.col("df") <= F.col("_nd") * no_above)).drop("_nd")


def ngram_vocabulary(tok: DataFrame, doc: str, toks: str, no_below: int, no_above: float) -> DataFrame:
    """X9 over the 1- and 2-grams (X11) of a table of token arrays, in one pass.

    The table should be grouped by document already, as ``normalise_tokens``
    leaves it: then no n-gram is shuffled but in the counts of terms.  The
    empty word stands for the document itself, so its frequency is the number
    of documents that have terms and the tokens are made once; that number is
    taken from both columns of the counts, for Spark to read the same shuffle."""
    if not no_above < 1:
        raise ValueError("no_above must be below 1")  # it leaves out the empty word
    grams = F.when(F.size(toks) > 0, F.concat(ngrams_1_2(F.col(toks)), F.array(F.lit(""))))
    dt = tok.select(doc, explode_terms(grams)).filter(F.col("term").isNotNull()).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))
    counts = dt.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    n_docs = counts.agg(F.max(F.when(F.col("term") == "", F.least("df", "cf"))).alias("_nd"))
    return counts.crossJoin(F.broadcast(n_docs)).filter((F.col("df") >= no_below) & (F.col("df") <= F.col("_nd") * no_above)).drop("_nd")


def bag_of_words_from(dt: DataFrame, doc: str, vocab: DataFrame) -> DataFrame:
    """(doc, term, count) over the vocabulary; empty documents drop out."""
    return dt.join(_word_list(vocab.select("term")), "term", "left_semi").select(doc, "term", F.col("n").alias("count"))


def char_trigrams(c) -> Column:
    """Character trigrams of the lower-cased, space-padded, whitespace-collapsed
    text: every overlapping 3-character window, found in one regex pass (a
    zero-width look-ahead captures the window at each position)."""
    t = F.concat(F.lit(" "), normalise_ws(c), F.lit(" "))
    return F.regexp_extract_all(t, F.lit("(?s)(?=(.{3}))"), 1)


def trigram_rows(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """(cols, tri): a row per trigram of each text."""
    return df.select(*cols, explode_terms(char_trigrams(text), "tri")).filter(F.col("tri").isNotNull())


def language_profiles(labelled: DataFrame, lang: str, text: str) -> DataFrame:
    """X3 training: Laplace-smoothed log P(trigram | language) (as the gain
    over the unseen floor), the floor itself and the log prior.  Trigrams are
    counted per language within each task before anything is shuffled."""
    labelled = labelled.filter(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    counts = trigram_rows(labelled, [lang], text).groupBy(lang, "tri").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    per_lang = counts.groupBy(lang).agg(F.sum("c").alias("n_lang"))
    vocab = counts.agg(F.count_distinct("tri").alias("v"))
    dcount = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("d"))
    tot = dcount.agg(F.sum("d").alias("dt"))
    pl = (per_lang.join(dcount, lang).crossJoin(F.broadcast(vocab)).crossJoin(F.broadcast(tot))
          .select(lang, "n_lang", "v", F.log(F.col("d") / F.col("dt")).alias("log_prior")))
    return counts.join(pl, lang).select(
        lang, "tri", (F.log((F.col("c") + 1) / (F.col("n_lang") + F.col("v")))
                      - F.log(1 / (F.col("n_lang") + F.col("v")))).alias("gain"),
        F.log(1 / (F.col("n_lang") + F.col("v"))).alias("unseen"), "log_prior")


def score_languages(docs: DataFrame, doc: str, text: str, profiles: DataFrame, lang: str = "lang", out: str = "language") -> DataFrame:
    """X3 scoring: per document, the language with the highest
    log prior + sum of trigram log-probabilities (unseen trigrams get the
    smoothed floor); only languages sharing at least one trigram with the
    document compete; documents with none -> 'unknown'.  Ties -> smallest
    language.

    The profile has one row per trigram with a gain per language (the language
    list is the label set, bounded metadata) and is sent to the texts when its
    counted size allows; gains are then looked up and summed where the text
    is, and only one row of sums per document is shuffled.
    """
    consts = sorted((r[lang], r["unseen"], r["lp"]) for r in
                    profiles.groupBy(lang).agg(F.first("unseen").alias("unseen"), F.first("log_prior").alias("lp")).collect())
    if not consts:
        return docs.select(doc, F.lit("unknown").alias(out))
    langs = [c[0] for c in consts]
    wide = profiles.groupBy("tri").pivot(lang, langs).agg(F.first("gain")).checkpoint()
    j = trigram_rows(docs, [doc], text).join(_word_list(wide), "tri", "left")
    aggs = [F.count(F.lit(1)).alias("_ntri")]
    for i, l in enumerate(langs):
        aggs += [F.sum(F.col(f"`{l}`")).alias(f"_g{i}"), F.count(F.col(f"`{l}`")).alias(f"_c{i}")]
    g = j.groupBy(doc).agg(*aggs)
    cands = F.array(*[F.when(F.col(f"_c{i}") > 0, F.struct(
        (-(F.lit(lp) + F.col("_ntri") * F.lit(unseen) + F.col(f"_g{i}"))).alias("neg"),
        F.lit(l).alias("l"))) for i, (l, unseen, lp) in enumerate(consts)])
    best = g.select(doc, F.array_sort(F.array_compact(cands))[0]["l"].alias(out))
    return docs.select(doc).join(best, doc, "left").select(doc, F.coalesce(F.col(out), F.lit("unknown")).alias(out))


def detect_languages(docs: DataFrame, doc: str, text: str, lang: str = "lang", out: str = "language",
                     train: Column | None = None) -> DataFrame:
    """X3 end to end: train on the labelled rows (those for which ``train``
    holds, if given), score every row."""
    from lodgelens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(docs.sparkSession)
    labelled = docs if train is None else docs.filter(train)
    prof = language_profiles(labelled, lang, text).checkpoint()
    return score_languages(docs, doc, text, prof, lang, out)


def sentiment_scores(df: DataFrame, doc: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Lexicon polarity per document in [-1, 1]; empty -> 0.

    Each word is paired with the one before it inside the array, so a row
    carries two words and never the text; the lexicon join is an equi-join on
    the word, the mean is a partial aggregate.
    """
    toks = F.filter(F.split(_c(text), " "), lambda t: t != "")
    shifted = F.concat(F.array(F.lit(None).cast("string")), toks)
    pairs = F.zip_with(toks, shifted, lambda w, p: F.struct(w.alias("word"), p.alias("prev")))
    ex = df.select(doc, F.explode_outer(pairs).alias("_x")).select(doc, "_x.word", "_x.prev").filter(F.col("word").isNotNull())
    inten = F.create_map(*[F.lit(x) for kv in INTENSIFIERS.items() for x in kv])
    hit = ex.join(_word_list(lexicon.select(F.col("word"), F.col("polarity"))), "word")
    adj = F.col("polarity") * F.when(F.col("prev").isin(NEGATORS), F.lit(-0.5)).otherwise(
        F.coalesce(inten[F.col("prev")], F.lit(1.0)))
    score = hit.groupBy(doc).agg(F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), adj))).alias("s"))
    return df.select(doc).join(score, doc, "left").select(doc, F.coalesce("s", F.lit(0.0)).alias("sentiment_score"))


def ctfidf(dt: DataFrame, cls: str, top: int = 10) -> DataFrame:
    """V7: class-based TF-IDF from a doc-term table carrying a class key:
    weight = tf(t, c) * log(1 + A / f(t)), A the average number of terms per
    class, f(t) the term's total frequency (Grootendorst 2022); top words per
    class (ties by word)."""
    tf = dt.groupBy(cls, "term").agg(F.sum("n").alias("tf"))
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    a = tf.groupBy(cls).agg(F.sum("tf").alias("w")).agg(F.avg("w").alias("A"))
    w = tf.join(f, "term").crossJoin(F.broadcast(a)).withColumn(
        "weight", F.col("tf") * F.log(1 + F.col("A") / F.col("f")))
    from lodgelens.operators.relational import top_per_group
    return top_per_group(w.select(cls, "term", "weight"), cls, [F.desc("weight"), F.asc("term")], top).select(
        cls, "term", F.col("rank").cast("int").alias("rank"), "weight")


def npmi_coherence(dt: DataFrame, doc: str, n_docs: DataFrame, topic_words: DataFrame, topic: str) -> DataFrame:
    """X18 (document variant): mean NPMI over pairs of a topic's top words,
    probabilities from document co-occurrence (``n_docs``: 1-row count of all
    documents).  Only (doc, word) rows for top words are kept, so the
    per-document self-join is bounded by the top-word set, not by the
    document."""
    n = n_docs.toDF("_n")
    words = topic_words.select("term").distinct()
    dw = dt.select(doc, "term").distinct().join(F.broadcast(words), "term", "left_semi")
    p1 = dw.groupBy("term").agg(F.count(F.lit(1)).alias("d1"))
    tw = topic_words.select(topic, "term")
    pairs = tw.alias("a").join(tw.alias("b"), (F.col(f"a.{topic}") == F.col(f"b.{topic}"))
                               & (F.col("a.term") < F.col("b.term"))).select(
        F.col(f"a.{topic}").alias(topic), F.col("a.term").alias("w1"), F.col("b.term").alias("w2"))
    co = dw.alias("x").join(dw.alias("y"), (F.col(f"x.{doc}") == F.col(f"y.{doc}"))
                            & (F.col("x.term") < F.col("y.term"))).select(
        F.col("x.term").alias("w1"), F.col("y.term").alias("w2"))
    co = co.join(pairs.select("w1", "w2").distinct(), ["w1", "w2"], "left_semi").groupBy("w1", "w2").agg(
        F.count(F.lit(1)).alias("d12"))
    j = (pairs.join(co, ["w1", "w2"], "left").join(p1.withColumnRenamed("term", "w1").withColumnRenamed("d1", "c1"), "w1")
         .join(p1.withColumnRenamed("term", "w2").withColumnRenamed("d1", "c2"), "w2").crossJoin(F.broadcast(n)))
    p12 = F.coalesce(F.col("d12"), F.lit(0)) / F.col("_n")
    pa, pb = F.col("c1") / F.col("_n"), F.col("c2") / F.col("_n")
    npmi = F.when(p12 == 0, F.lit(-1.0)).when(p12 == 1, F.lit(1.0)).otherwise(
        F.log(p12 / (pa * pb)) / (-F.log(p12)))
    return j.groupBy(topic).agg(F.avg(npmi).alias("coherence"), F.count(F.lit(1)).alias("n_pairs"))


def window_islands(df: DataFrame, doc: str, tok_col: str, words: DataFrame, window: int, block: int = 1024) -> DataFrame:
    """(doc, block, term, lo, hi): the starts of sliding windows that hold a
    term, as disjoint ranges, for the terms of ``words``.

    A document of n tokens has max(1, n - window + 1) windows; an occurrence
    at p lies in those starting from p - window + 1 to p.  Overlapping ranges
    are merged, then cut at multiples of ``block`` starts, so that a long
    document's ranges meet few others.  Nothing is stored per window."""
    long = df.select(doc, F.size(tok_col).alias("_n"), F.posexplode_outer(tok_col).alias("_p", "term")).where(F.col("term").isNotNull())
    hits = long.join(_word_list(words.select("term").distinct()), "term", "left_semi")
    last = F.greatest(F.col("_n") - window, F.lit(0))
    spans = hits.select(doc, "term", F.greatest(F.col("_p") - window + 1, F.lit(0)).alias("_s"), F.least(F.col("_p"), last).alias("_e"))
    order = Window.partitionBy(doc, "term").orderBy("_s", "_e")  # one document's occurrences of one term
    fresh = F.col("_s") > F.coalesce(F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1))
    marked = spans.withColumn("_i", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(doc, "term", "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    cut = merged.withColumn("block", F.explode(F.sequence(F.floor(F.col("_s") / block), F.floor(F.col("_e") / block))))
    return cut.select(doc, "block", "term", F.greatest("_s", F.col("block") * block).alias("lo"),
                      F.least("_e", (F.col("block") + 1) * block - 1).alias("hi"))


def cv_coherence(df: DataFrame, doc: str, tok_col: str, topic_words: DataFrame, topic: str, window: int = 110, eps: float = 1e-12) -> DataFrame:
    """X18 (c_v, Roeder et al. 2015): per topic the mean cosine between each
    top word's context vector and the topic's.  A word's context vector holds
    its NPMI with every top word of the topic, the topic's is the sum of them;
    probabilities are shares of boolean sliding windows over the whole corpus.

    Windows are counted as ranges (``window_islands``) that meet only within
    the same document, block and topic; everything after the counts is as
    small as the topic-word table."""
    from lodgelens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    words = topic_words.select(F.col(topic).alias("_t"), "term").checkpoint()
    total = df.where(F.size(tok_col) > 0).agg(F.sum(F.greatest(F.size(tok_col) - window + 1, F.lit(1))).cast("double").alias("_all"))
    spans = window_islands(df, doc, tok_col, words, window).checkpoint()  # read by singles and pairs
    single = spans.groupBy("term").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("_n"))
    own = spans.join(_word_list(words), "term")
    a, b = own.alias("a"), own.alias("b")
    overlap = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo") + 1
    met = a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.block") == F.col("b.block")) & (F.col("a._t") == F.col("b._t"))
                 & (F.col("a.term") < F.col("b.term"))).where(overlap > 0)
    both = met.groupBy(F.col("a._t").alias("_t"), F.col("a.term").alias("wi"), F.col("b.term").alias("wj")).agg(F.sum(overlap).alias("_nij"))
    both = both.unionByName(both.select("_t", F.col("wj").alias("wi"), F.col("wi").alias("wj"), "_nij"))
    both = both.unionByName(words.join(single, "term").select("_t", F.col("term").alias("wi"), F.col("term").alias("wj"), F.col("_n").alias("_nij")))
    x, y = words.alias("x"), words.alias("y")
    cells = x.join(y, F.col("x._t") == F.col("y._t")).select(F.col("x._t").alias("_t"), F.col("x.term").alias("wi"), F.col("y.term").alias("wj"))
    cells = cells.join(both, ["_t", "wi", "wj"], "left")
    for w, n in (("wi", "_ni"), ("wj", "_nj")):
        cells = cells.join(single.select(F.col("term").alias(w), F.col("_n").alias(n)), w)
    cells = cells.crossJoin(F.broadcast(total))
    pij = F.coalesce(F.col("_nij"), F.lit(0)) / F.col("_all") + eps
    npmi = F.log(pij / (F.col("_ni") / F.col("_all") * F.col("_nj") / F.col("_all"))) / -F.log(pij)
    cells = cells.select("_t", "wi", "wj", F.when(pij < 1, npmi).otherwise(F.lit(1.0)).alias("v"))
    whole = cells.groupBy("_t", "wj").agg(F.sum("v").alias("w"))
    cos = cells.join(whole, ["_t", "wj"]).groupBy("_t", "wi").agg(
        (F.sum(F.col("v") * F.col("w")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("w") * F.col("w")))).alias("cos"))
    return cos.groupBy(F.col("_t").alias(topic)).agg(F.avg("cos").alias("coherence"), F.count(F.lit(1)).alias("n_words"))


def hashed_vectors(dt: DataFrame, doc: str, dims: int = 64) -> DataFrame:
    """V1: (doc, pos, value), the non-zero cells of document vectors of
    ``dims`` dimensions: every term's weight (count x inverse document
    frequency) is added to one dimension with one sign, both from a digest of
    the term.  The projection keeps inner products on average, needs no
    vocabulary and no dense row of the vocabulary's width."""
    n = dt.select(doc).distinct().agg(F.count(F.lit(1)).cast("double").alias("_docs"))
    digest = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(F.md5("term"), 9, 1), 16, 10).cast("int") < 8, F.lit(1.0)).otherwise(F.lit(-1.0))
    # most words are in one document only: they need no table, so the others' is short enough to send
    often = dt.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    found = dt.join(_word_list(often), "term", "left").crossJoin(F.broadcast(n))
    found = found.select(doc, "n", (digest % dims).cast("int").alias("pos"), sign.alias("_sign"),
                         F.log((F.col("_docs") + 1) / (F.coalesce("_df", F.lit(1)) + 1)).alias("_idf"))
    return found.groupBy(doc, "pos").agg(F.sum(F.col("n") * F.col("_idf") * F.col("_sign")).alias("value"))


def dense_vectors(cells: DataFrame, doc: str, dims: int, out: str = "vector") -> DataFrame:
    """(doc, array<double>) from (doc, pos, value) cells, as V2 to V10 take them."""
    m = cells.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_m"))
    return m.select(doc, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias(out))
