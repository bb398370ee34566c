"""Toxicity by weak supervision.

1. Voters: words and word beginnings (patterns such as ``\\bstem\\w*``) that
   are far commoner in texts labelled toxic than in others.
2. Label model: a generative model of the votes. Each voter has a rate of
   firing on toxic and on other texts (its accuracy), estimated by
   expectation maximisation with the true class hidden; the given label is
   one more voter. Voters whose votes stay correlated given the class (a stem
   and its word forms) share their weight.
3. A logistic regression on term features is trained on the label model's
   posteriors and scores every whole text.

All three are fitted on a bounded sample: about ``fit_rows`` labelled texts
of each label, chosen by a hash of the text; model size is bounded by
``max_terms`` features and ``max_voters`` voters.

Defined cases: a null or empty text scores as a text without any term;
labels that are null are left out, conflicting labels of repeated rows count
each; without labelled rows of both kinds every score is the share of toxic
ones (0 without any); an empty table gives no rows; other columns are ignored
(``score``) or kept (``with_score``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.shared import text_batches, written

STEMS = (3, 4, 5, 6)  # letters of a word beginning
SIGNS = "\n\t\r.,;:!?\"'()[]{}<>*/-–—…«»“”¿¡"
CHARS = 1_000_000


def plain(text: str | None) -> str:
    """Lower-cased text with signs as blanks."""
    text = (text or "").lower()
    for s in SIGNS:
        if s in text:
            text = text.replace(s, " ")
    return text


def word_terms(word: str) -> list[str]:
    """A word and its beginnings; the word ends in ``$`` to tell it from a beginning."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            seen.update({t for w in set(plain(text).split()) for t in word_terms(w)})
            if len(seen) > 400_000:
                yield pd.DataFrame(list(seen.items()), columns=["term", "n"])
                seen = Counter()
    yield pd.DataFrame(list(seen.items()), columns=["term", "n"])


@dataclass
class TermIndex:
    """Which of the model's terms each text holds."""
    terms: list[str]
    at: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.at = {t: k for k, t in enumerate(self.terms)}

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) numbers, each pair once, ordered by text."""
        lists = pc.split_pattern(pa.array([plain(t) for t in texts], type=pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        known = {k: f for k, w in enumerate(words) if w and (f := [self.at[t] for t in word_terms(w) if t in self.at])}
        flag = np.zeros(len(words) + 1, dtype=bool)
        flag[list(known)] = True
        codes = coded.indices.to_numpy()
        place = np.flatnonzero(flag[codes])
        text = np.searchsorted(lists.offsets.to_numpy()[1:], place, side="right")
        found = {(t, f) for t, k in zip(text.tolist(), codes[place].tolist()) for f in known[k]}
        both = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


@dataclass
class ToxicityModel:
    index: TermIndex
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.index.terms) and len(texts):
            text, term = self.index.pairs(texts)
            np.add.at(z, text, self.weights[term])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 30, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 votes, and each voter's log odds;
    the true class is hidden.

    The given label is one more voter, of unknown accuracy on either class.
    Expectation maximisation estimates every voter's firing rates per class;
    after each pass the correlations that remain between voters given the
    class set how much of its log odds each voter keeps."""
    m = votes.shape[1]
    post = np.where(given == 1, 0.95, 0.02)
    keep = np.ones(m)
    for _ in range(passes):
        for _ in range(rounds):
            prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
            on = np.clip((votes.T @ post + 0.1) / (post.sum() + 0.2), 1e-5, 1 - 1e-5)
            off = np.clip((votes.T @ (1 - post) + 0.001) / ((1 - post).sum() + 0.2), 1e-6, 1 - 1e-5)
            on = np.maximum(on, off)  # voters are chosen to fire rather for class 1
            right1 = np.clip((given * post).sum() / post.sum(), 0.6, 0.999)
            right0 = np.clip(((1 - given) * (1 - post)).sum() / (1 - post).sum(), 0.6, 0.999)
            yes, no = np.log(on / off) * keep, np.log((1 - on) / (1 - off)) * keep
            z = (np.log(prior / (1 - prior)) + votes @ yes + (1 - votes) @ no
                 + np.where(given == 1, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0)))
            post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        rest = votes - (post[:, None] * on + (1 - post[:, None]) * off)
        spread = np.sqrt((rest ** 2).sum(axis=0)) + 1e-9
        tied = np.clip((rest.T @ rest) / np.outer(spread, spread), 0, 1)
        tied[tied < 0.1] = 0  # noise of the estimate
        np.fill_diagonal(tied, 1)
        keep = 1 / tied.sum(axis=1)
    return post, yes


def logistic(n: int, m: int, text: np.ndarray, term: np.ndarray, target: np.ndarray, start: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression on 0/1 features with soft targets (Adam steps), from ``start``."""
    w, b = start.copy(), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    m1, m2, c1, c2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.full(n, b) + np.bincount(text, weights=w[term], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g, gb = np.bincount(term, weights=err[text], minlength=m) / n + ridge * w, err.mean()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w = w - 0.1 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-9)
        b = b - 0.1 * (c1 / fix1) / (np.sqrt(c2 / fix2) + 1e-9)
    return w, b


def fit(train: DataFrame, fit_rows: int = 10_000, max_terms: int = 4000, max_voters: int = 96) -> ToxicityModel:
    """Learn from rows (text, toxic)."""
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    have = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    if not n1 or not n0:
        base = n1 / max(1, n1 + n0)
        return ToxicityModel(TermIndex([]), np.zeros(0), float(np.log((base + 1e-9) / (1 - base + 1e-9))))
    draw = F.pmod(F.xxhash64("text", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = written(rows.where(draw < F.when(F.col("toxic") == 1, min(1.0, fit_rows / n1)).otherwise(min(1.0, fit_rows / n0))), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    s1, s0 = sizes.get(1, 0), sizes.get(0, 0)
    terms = (sample.where("toxic = 1").select("text").mapInPandas(_counts, "term string, n long")
             .groupBy("term").agg(F.sum("n").alias("n1")).where(F.col("n1") >= max(3, s1 // 500))
             .orderBy(F.desc("n1"), "term").limit(50_000).toPandas())
    common = TermIndex(terms["term"].tolist())

    def in_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, term = common.pairs(pdf["text"].tolist())
            k, n = np.unique(term, return_counts=True)
            yield pd.DataFrame({"k": k, "n": n})

    others = np.zeros(len(terms))
    for r in sample.where("toxic = 0").select("text").mapInPandas(in_others, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        others[r["k"]] = r["n"]
    hits = terms["n1"].to_numpy(dtype=float)
    p1, p0 = (hits + 0.5) / (s1 + 1), (others + 0.5) / (s0 + 1)
    odds = np.log(p1 / p0)
    weight = odds * np.sqrt(hits)  # strength times evidence
    chosen = [k for k in np.argsort(-weight, kind="stable") if odds[k] >= 1.5][:max_terms]
    index = TermIndex([common.terms[k] for k in chosen])
    m = len(index.terms)

    def in_sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, term = index.pairs(pdf["text"].tolist())
            cut = np.searchsorted(text, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"terms": [term[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])], "toxic": pdf["toxic"]})

    # at most about 2 x fit_rows lists of term numbers
    drawn = sample.select("text", "toxic").mapInPandas(in_sample, "terms array<long>, toxic int").collect()
    lists, given = [r["terms"] for r in drawn], np.array([r["toxic"] for r in drawn], dtype=float)
    n = len(lists)
    text = np.repeat(np.arange(n), [len(x) for x in lists])
    term = np.array([t for x in lists for t in x], dtype=np.int64)
    votes = np.zeros((n, min(m, max_voters)))
    votes[text[term < votes.shape[1]], term[term < votes.shape[1]]] = 1
    post, start = np.full(n, s1 / max(1, n)), np.zeros(m)
    if m:
        post, start[:votes.shape[1]] = label_model(votes, given)
    w, b = logistic(n, m, text, term, post, start)
    return ToxicityModel(index, w, b)


def training_rows(docs: DataFrame, labels: DataFrame, keep, rows: int = 20_000) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents of each label for which ``keep`` (on doc_id) holds.

    The ids are drawn before the join, so the side sent to all tasks has a
    bounded size (2 x rows ids and labels) and texts are not shuffled."""
    wanted = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(keep(F.col("__id")))
    have = {r["toxic"]: r["n"] for r in wanted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("__id", F.lit("toxic-rows")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.when(F.col("toxic") == 1, min(1.0, rows / max(1, have.get(1, 0)))).otherwise(min(1.0, rows / max(1, have.get(0, 0))))
    drawn = wanted.where(draw < part)
    return docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(drawn), "__id").select("text", "toxic")


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        whole, out, lo, n = texts.tolist(), [], 0, 0
        for k, t in enumerate(whole):
            n += len(t or "")
            if n >= CHARS or k == len(whole) - 1:
                out.append(held.value.scores(whole[lo:k + 1]))
                lo, n = k + 1, 0
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(out_col, score(F.col(text_col).cast("string")))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every row."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    s = with_score(rows, model, "__text", "__s")
    return s.select(F.col("__id").alias(id_col), F.col("__s").alias("score"), (F.col("__s") >= 0.5).cast("int").alias("predicted"))
