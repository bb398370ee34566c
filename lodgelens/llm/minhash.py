"""MinHash near-duplicates: one-permutation hashing with optimal densification,
banded buckets and star-shaped candidate edges.

A text's set holds its distinct shingles of ``words`` words. The hash range
is cut into bins; the smallest hash of each bin is the sketch, and an empty
bin copies the first filled one in its own fixed random order of bins
(optimal densification). Bands of ``rows`` bins are the bucket keys.

Texts with equal sets form one class first, so copies never meet in a bucket.
In a bucket every class is joined to one centre only (the class with most
copies), so a bucket of n classes gives n - 1 candidate edges. Edges are
confirmed on full sets. Classes of a bucket that its centre doesn't reach may
still be linked to others in there; such links are found exactly, by the
classes' differences from the centre (``unreached_links``). The number of
bands follows from ``percent`` (``bands_for``): 25 of 5 bins at 0.85 and 37 at
0.80, so that a pair just at the limit shares no band with a chance of about
4e-7 in both cases.

Defined cases: a null text, an empty one or one without words has an empty
set and is linked with nothing; fewer words than a shingle are one shingle;
repeated rows are one class, so each row of a repeated id gets the same
answer; null ids get answers too (their component is the smallest id in it);
an empty table gives no rows; other columns are ignored (``near_duplicates``)
or kept (``keep_first``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.shared import components, text_batches, written

CACHE_WORDS = 200_000
PARITY = 16  # longs of a set's parity bits, a power of two
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
               0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int):
        if words > len(_P):
            raise ValueError(f"shingles of at most {len(_P)} words")
        self.words, self.cache = words, {}

    def sets(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII blanks only
        if not found:
            return np.zeros(0, dtype=np.uint64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        h = [cache.get(w) for w in found]
        if None in h:
            for k, w in enumerate(found):
                if h[k] is None:
                    h[k] = cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(h, dtype=np.uint64)
        size = min(self.words, len(h))
        n = len(h) - size + 1
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out += h[k:k + n] * _P[k]
        return np.unique(mixed(out))


def bands_for(percent: int, rows: int, miss: float = 4.4e-7) -> int:
    """The least number of bands with which a pair at ``percent`` / 100 shares
    none with a chance of at most ``miss``."""
    apart = 1 - (percent / 100) ** rows  # chance that one band differs
    return math.ceil(math.log(miss) / math.log(apart)) if apart > 0 else 1


def donors(bins: int) -> np.ndarray:
    """Each bin's own fixed random order of all bins (its first is itself)."""
    order = np.random.default_rng(20240601).random((bins, bins)).argsort(axis=1)
    at = order.argsort(axis=1)[np.arange(bins), np.arange(bins)]
    order[np.arange(bins), at], order[:, 0] = order[:, 0].copy(), np.arange(bins)
    return order


def band_keys(shingles: np.ndarray, bands: int, rows: int, order: np.ndarray) -> np.ndarray:
    """Keys of a non-empty sorted set."""
    bins = bands * rows
    at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # ascending, as the hashes are
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    filled = np.zeros(bins, dtype=bool)
    value = np.zeros(bins, dtype=np.uint64)
    filled[at[first].astype(np.int64)] = True
    value[at[first].astype(np.int64)] = shingles[first]
    if not filled.all():
        value = value[order[np.arange(bins), filled[order].argmax(axis=1)]]
    key = np.arange(bands, dtype=np.uint64)
    for part in value.reshape(bands, rows).T:
        key = mixed(key * _P[0] + part)
    return key.view(np.int64)


def _sketched(words: int, bands: int, rows: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler, order = Shingler(words), donors(bands * rows)
    for pdf in batches:
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            s = shingler.sets(text)
            out.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None,
                        band_keys(s, bands, rows, order) if len(s) else None))
        yield pd.DataFrame(out, columns=["doc_id", "n", "cls", "bands"])


def _sets(words: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler(words)
    for pdf in batches:
        whole = [shingler.sets(t) for t in pdf["text"]]
        yield pd.DataFrame({"cls": [xxhash.xxh3_128_digest(s.tobytes()) for s in whole], "shingles": [s.tobytes() for s in whole]})


def _confirmed(percent: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for a, b in zip(pdf["sa"], pdf["sb"]):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pdf.loc[ok, ["a", "b"]]


def class_sets(needed: DataFrame, docs: DataFrame, reps: DataFrame, words: int, name: str) -> DataFrame:
    """(cls, shingles) of the ``needed`` classes, made again from one document
    of each, so only their texts move."""
    ids = reps.join(needed, "cls").select("doc_id").distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    return written(texts.mapInPandas(lambda it: _sets(words, it), "cls binary, shingles binary").dropDuplicates(["cls"])
                   .join(needed, "cls", "left_semi"), f"{name}-sets")


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs of classes whose full sets are alike enough; sizes alone rule out pairs first."""
    known = reps.select("cls", "n")
    near = (pairs.join(known.withColumnsRenamed({"cls": "a", "n": "na"}), "a").join(known.withColumnsRenamed({"cls": "b", "n": "nb"}), "b")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b"))
    full = (near.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b"))
    return written(full.select("a", "b", "sa", "sb").mapInPandas(lambda it: _confirmed(percent, it), "a binary, b binary"), f"{name}-links")


def _differences(percent: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for centre, cls, own, hub in zip(pdf["centre"], pdf["cls"], pdf["s"], pdf["sh"]):
            x, y = np.frombuffer(own, dtype=np.uint64), np.frombuffer(hub, dtype=np.uint64)
            diff = np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)])
            most = (100 - percent) * (len(x) + 100 * len(x) // percent) // (100 + percent)  # shingles that x and a set linked to it may differ in
            odd = np.bincount((x & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
            out.append((centre, cls, len(x), len(diff), diff[:most + 1].view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)))
        yield pd.DataFrame(out, columns=["centre", "cls", "n", "d", "first", "parity"])


def differences(edges: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """(centre, cls, n, d, first, parity): how many shingles only one of the two
    has, and the first of them, those of ``cls`` in front of those of the
    centre, each part in ascending order. Bit k of ``parity`` is whether the
    set has an odd number of shingles that hash to k: two sets differ in at
    least as many shingles as their parities differ in bits."""
    full = (edges.join(sets.withColumnsRenamed({"shingles": "s"}), "cls")
            .join(sets.select(F.col("cls").alias("centre"), F.col("shingles").alias("sh")), "centre"))
    return written(full.select("centre", "cls", "s", "sh").mapInPandas(
        lambda it: _differences(percent, it), "centre binary, cls binary, n long, d long, first array<long>, parity array<long>"), f"{name}-differences")


def meeting(left: DataFrame, right: DataFrame, also: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that meet under a shingle
    and may be linked: it stands early enough in both, and the parities differ
    in few enough bits. No linked pair whose first common shingle it is fails."""
    gap = F.expr(f"({100 - percent} * (n + n2)) div {100 + percent}")
    placed = (2 * F.col("pos") <= F.col("d") - F.col("d2") + gap) & (2 * F.col("pos2") <= F.col("d2") - F.col("d") + gap)
    bits = sum((F.bit_count(F.col("parity")[k].bitwiseXOR(F.col("parity2")[k])) for k in range(1, PARITY)), F.bit_count(F.col("parity")[0].bitwiseXOR(F.col("parity2")[0])))
    pairs = left.join(right, (left["centre"] == right["centre"]) & (left["shingle"] == right["shingle"]) & also & (F.col("root") != F.col("root2"))
                      & placed & (bits <= gap))
    return pairs.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def merged_roots(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``roots`` (node, root) after further links (a, b) between roots."""
    joined = written(components(links, "a", "b", name).select(F.col("node").alias("root"), F.col("root").alias("top")), f"{name}-joined")
    nodes = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    single = joined.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti")
    return written(nodes.unionByName(single), f"{name}-roots")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnsRenamed({"node": "cls"}), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def several_roots(rows: DataFrame) -> DataFrame:
    """Rows of those (centre, shingle) buckets that hold more than one component."""
    some = rows.groupBy("centre", "shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("centre", "shingle")
    return rows.join(some, ["centre", "shingle"], "left_semi")


def unreached_links(members: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``roots`` after the links between classes of a bucket that its centre doesn't reach.

    Let D be a class's difference from the centre, or from any other set that
    stands for it. If a isn't linked to the
    centre, then any b of the bucket linked to a has a shingle of D(a) in D(b),
    and the first common one stands within the first few of both (prefix
    filter, exact: at most as many shingles may stand before it as the
    threshold lets the two sets differ on that side). So classes meet only
    under such a shingle, first each with one hub, then those still in
    different components with each other; full sets confirm their links."""
    near = rooted(members.where("size > 2 and cls != centre").select("centre", "cls").distinct(), roots)
    hubs = rooted(near.select(F.col("centre").alias("cls")).distinct(), roots).select(F.col("cls").alias("centre"), F.col("root").alias("centre_root"))
    # centres of one component are alike: the one with most classes stands for them all, so that a class meets a component once, not once a bucket
    met = near.join(hubs, "centre")
    popular = met.groupBy("centre_root", "centre").agg(F.count("*").alias("met")).groupBy("centre_root").agg(F.max_by("centre", F.struct("met", "centre")).alias("hub"))
    near = written(met.join(popular, "centre_root").where("cls != hub").select(F.col("hub").alias("centre"), "cls", "root", "centre_root").distinct(), "minhash-unreached")
    odd = near.where("root != centre_root").select("centre").distinct()
    diffs = differences(near.join(odd, "centre", "left_semi").select("centre", "cls"), sets, percent, "minhash-cross")
    keyed = diffs.select("centre", "cls", "n", "d", "parity", F.posexplode("first").alias("pos", "shingle"))
    keyed = written(several_roots(rooted(keyed, roots)), "minhash-shingles")
    for step in ("hub", "cross"):
        right = keyed.select("centre", "shingle", *[F.col(c).alias(f"{c}2") for c in ("cls", "root", "n", "pos", "d", "parity")])
        if step == "hub":  # the class with the fewest differences from the centre
            best = F.min(F.struct("d2", "cls2", "root2", "n2", "pos2", "parity2")).alias("h")
            pairs = meeting(keyed, right.groupBy("centre", "shingle").agg(best).select("centre", "shingle", "h.*"), F.lit(True), percent)
        else:
            pairs = meeting(keyed, right, F.col("cls") < F.col("cls2"), percent)
        links = confirmed(pairs, classes, sets, percent, f"minhash-{step}")
        if not links.isEmpty():
            ends = rooted(links.withColumnRenamed("a", "cls"), roots).select(F.col("root").alias("x"), F.col("b").alias("cls"))
            roots = merged_roots(roots, rooted(ends, roots).select(F.col("x").alias("a"), F.col("root").alias("b")), f"minhash-{step}")
            if step == "hub":
                keyed = written(several_roots(rooted(keyed.drop("root"), roots)), "minhash-left")
    return roots


def class_components(docs: DataFrame, percent: int, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every row, and (cls, root) of the linked classes."""
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = written(docs.mapInPandas(lambda it: _sketched(words, bands, rows, it), f"doc_id {kind}, n long, cls binary, bands array<long>"), "minhash-sketches")
    classes = written(sketches.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    keyed = classes.select("cls", "copies", F.explode("bands").alias("key"))
    best = F.max(F.struct("copies", "cls")).alias("best")
    shared = keyed.groupBy("key").agg(best, F.count("*").alias("size")).where("size > 1").select("key", F.col("best.cls").alias("centre"), "size")
    members = written(keyed.select("cls", "key").join(shared, "key"), "minhash-members")
    star = members.where("cls != centre").select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    sets = class_sets(members.select("cls").distinct(), docs, classes, words, "minhash")
    links = confirmed(star, classes, sets, percent, "minhash-star")
    roots = written(components(links, "a", "b", "minhash-star"), "minhash-roots")
    return sketches.drop("bands"), unreached_links(members, classes, sets, roots, percent)


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, bands: int | None = None, rows: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id of the component), kept
    (id = component_id), for texts linked at ``percent`` / 100 or more."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grouped = grouped_rows(own, percent, words, bands or bands_for(percent, rows), rows)
    least = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped_rows(own: DataFrame, percent: int, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, root) of every row; the root is null for empty sets."""
    sketched, roots = class_components(own, percent, words, bands, rows)
    return sketched.join(roots.withColumnsRenamed({"node": "cls"}), "cls", "left").select("doc_id", "n", F.coalesce("root", "cls").alias("root"))


def keep_first(docs: DataFrame, percent: int = 80, words: int = 5, bands: int | None = None, rows: int = 5,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (the smallest
    id; of rows that repeat it, one) and all rows with an empty set."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "minhash-docs")
    own = numbered.select(F.col("__row").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    roots = grouped_rows(own, percent, words, bands or bands_for(percent, rows), rows).select(F.col("doc_id").alias("__row"), "root")
    first = F.min(F.struct(F.col("__id"), F.col("__row"))).alias("first")
    ids = numbered.select("__row", F.col(id_col).alias("__id")).join(roots, "__row")
    stay = (ids.where("root is not null").groupBy("root").agg(first).select(F.col("first.__row").alias("__row"))
            .unionByName(ids.where("root is null").select("__row")))
    return numbered.join(stay, "__row", "left_semi").drop("__row")
