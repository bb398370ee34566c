"""Language identification with bit-sliced Bloom filters of letter n-grams.

Each language has a Bloom filter of the n-grams typical of it. The filters
are sliced by bit: one table whose entry at a slot is a mask with a bit per
language, so AND-ing the entries of an n-gram's slots gives all languages
that contain it. A text's hits per language are counted (popcounts of the
masks by bit), corrected for the filter's false positive rate (fill to the
power of the number of hashes), and the language with most hits wins; ties go
to the first in alphabetical order.

Fitting uses a bounded sample: about ``fit_rows`` labelled texts per
language, chosen by a hash of the text. An n-gram belongs to a language when
it makes up at least ``share`` of the largest relative frequency that any
language gives it and occurs ``min_count`` times.

Defined cases: texts that are null or have no letter are ``und`` with score
0; training rows with null text or language are left out; without any
training row every text is ``und``; rows are handled one by one, so repeated
rows and ids give repeated results; an empty table gives no rows; other
columns are ignored (``predict``) or kept (``with_language``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.shared import text_batches, written

SIZES = (3, 4)  # letters of an n-gram, blanks at word ends included
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHARS = 500_000  # of text handled at once in a task

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with runs of other characters as one
    blank, a blank at both ends of each text and a 0 behind it; and the place
    of each text's 0."""
    joined = "\0".join(texts).lower() + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letter_table()[cps]
    end = cps == 0
    if int(end.sum()) != len(texts):  # a text holds the separator itself
        return letter_stream([t.replace("\0", " ") for t in texts])
    c = np.where(is_letter, cps, np.uint32(32))
    follows = np.concatenate([[False], is_letter[:-1]])  # a letter stands before
    keep = is_letter | follows | end
    out = c[keep].astype(np.uint64)
    ends = end[keep]
    # a text's last character gives "blank" and its end falls on the same entry: widen it to " \0 "
    first = np.concatenate([[True], ends[:-1]]) & ~ends
    reps = 1 + first.astype(np.int64) + ends
    at = np.cumsum(reps) - 1
    wide = np.repeat(out, reps)
    wide[at[first] - 1] = 32
    wide[at[ends] - 1] = 32
    wide[at[ends]] = 0
    return wide, at[ends]


def ngrams(stream: np.ndarray, size: int) -> np.ndarray:
    """Hash of the n-gram at each place, 0 where it reaches over a text's end."""
    n = max(0, len(stream) - size + 1)
    h, over = np.full(n, np.uint64(size)), np.zeros(n, dtype=bool)
    for k in range(size):
        part = stream[k:k + n]
        h = h * np.uint64(1_000_003) + part
        over |= part == 0
    h[over] = 0
    return h


def slots(h: np.ndarray, mix: int, bits: int) -> np.ndarray:
    x = h * np.uint64(mix)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= CHARS:
            yield lo, k + 1
            lo, n = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            texts = group["text"].tolist()
            for lo, hi in _batches(texts):
                stream, _ = letter_stream(texts[lo:hi])
                for size in SIZES:
                    h = ngrams(stream, size)
                    keys, n = np.unique(h[h != 0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})


@dataclass
class LanguageModel:
    languages: list[str]
    masks: np.ndarray  # a bit per language at each slot
    bits: int
    false_hits: np.ndarray  # per language

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected hits per text and language, n-grams per text, whether there is a letter."""
        stream, ends = letter_stream(texts)
        begins = np.concatenate([[0], ends[:-1] + 1])
        has = np.add.reduceat((stream > 32).astype(np.int64), begins) > 0
        raw, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for size in SIZES:
            h = ngrams(stream, size)
            ok = h != 0
            mask = self.masks[slots(h, HASHES[0], self.bits)]
            for mix in HASHES[1:]:
                mask = mask & self.masks[slots(h, mix, self.bits)]
            mask[~ok] = 0
            fill = len(stream) - len(h)
            pad = lambda a: np.concatenate([a, np.zeros(fill, dtype=a.dtype)])
            total += np.add.reduceat(pad(ok).astype(np.int64), begins)
            mask = pad(mask)
            for k in range(len(self.languages)):
                raw[:, k] += np.add.reduceat(((mask >> mask.dtype.type(k)) & mask.dtype.type(1)).astype(np.int32), begins)
        fixed = np.maximum(0, (raw - total[:, None] * self.false_hits) / (1 - self.false_hits))
        return fixed, total, has


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = 3000, share: float = 0.25,
        min_count: int = 5, bits: int = 20) -> LanguageModel | None:
    """Learn from labelled texts; None without any. ``2**bits`` slots bound the
    table that is collected and sent to the tasks; at most 64 languages."""
    rows = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(sizes) > 64:
        raise ValueError(f"{len(sizes)} languages; the masks hold 64")
    if not sizes:
        return None
    languages = sorted(sizes)
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, fit_rows / sizes[k]))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    grams = (rows.where(draw < part).mapInPandas(_counted, "lang string, gram long, n long")
             .groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    by_gram = grams.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    counts = written_counts(by_gram, languages)
    totals = counts.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]).first()
    rel = [F.col(f"n{k}") / F.lit(float(totals[k] or 1)) for k in range(len(languages))]
    top = F.greatest(*rel) if len(rel) > 1 else rel[0]
    mask = sum((F.when((F.col(f"n{k}") >= min_count) & (rel[k] >= share * top), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
                for k in range(1, len(languages))),
               F.when((F.col("n0") >= min_count) & (rel[0] >= share * top), F.lit(1)).otherwise(F.lit(0)).cast("long"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf["gram"].to_numpy().view(np.uint64)
            for mix in HASHES:
                yield pd.DataFrame({"slot": slots(h, mix, bits), "mask": pdf["mask"]})

    table = (counts.select("gram", mask.alias("mask")).where("mask != 0").mapInPandas(placed, "slot long, mask long")
             .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas())
    kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= n)
    masks = np.zeros(1 << bits, dtype=kind)
    masks[table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64).astype(kind)
    fill = np.array([((masks >> kind(k)) & kind(1)).mean() for k in range(len(languages))])
    return LanguageModel(languages, masks, bits, np.minimum(fill ** len(HASHES), 0.99))


def written_counts(by_gram: DataFrame, languages: list[str]) -> DataFrame:
    """One row per n-gram with a count column per language."""
    return written(by_gram.select("gram", *[F.coalesce(F.col("by")[k], F.lit(0)).cast("long").alias(f"n{i}")
                                            for i, k in enumerate(languages)]), "langid-counts")


def decide(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score (the winner's part of all languages' hits) and the
    winner's hits as a share of the text's n-grams."""
    lang, score, share = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score, share
    whole = [t or "" for t in texts]
    for lo, hi in _batches(whole):
        fixed, total, has = model.hits(whole[lo:hi])
        best, sums = fixed.argmax(axis=1), fixed.sum(axis=1)
        for k in np.flatnonzero(has).tolist():
            top = fixed[k, best[k]]
            lang[lo + k] = model.languages[best[k]]
            score[lo + k] = float(top / sums[k]) if sums[k] > 0 else 0.0
            share[lo + k] = float(min(1.0, top / total[k])) if total[k] else 0.0
    return lang, score, share


def with_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang, score, share)."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, share double")
    def tag(texts: pd.Series) -> pd.DataFrame:
        lang, score, share = decide(held.value, texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score, "share": share})

    return docs.withColumn(out_col, tag(F.col(text_col).cast("string")))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, share for every row."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    tagged = with_language(rows, model, "__text", "__t")
    return tagged.select(F.col("__id").alias(id_col), F.col("__t.lang").alias("lang_pred"), F.col("__t.score").alias("score"),
                         F.col("__t.share").alias("share"))
