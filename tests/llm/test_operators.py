"""The operators on odd inputs and against brute force or exact round trips."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodgelens.llm import ann, bpe, fingerprint, langid, linededup, minhash, packing, pieces, shared, tokencount, toxicity, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["don't stop'll 'sAB x's", "ΑΣ Σας ß İstanbul ﬁ ① ２3", "éa ́b", "日本語 テスト。ok", "a b c\td\r\ne\x1cf", "<|endoftext|> hi", "", "    ",
         "naïve,. foo.", "x" * 200, "...", "é." * 40, "a_b. c_ .d “x.” y—.", "Å K Ω豈 豈.", ".", "1.5 2,3", " lead", "trail ", "x \n y\n\n", "a\1b c",
         "▁mark▁x", "😀 emoji", "\n\n a", "    indent\n        more", "hello world" * 20]


def library_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# ---- packing

def check_packing(docs, out, seq_len=2048):
    want = Counter()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    for (doc, _), ids in zip(texts, library_ids([t for _, t in texts])):
        want[(doc, tuple([*ids, 1]))] += 1
    got = out.toPandas()
    assert len(got) >= len(texts) and int(got["length"].sum()) == sum(len(i) * n for (_, i), n in want.items())
    for (doc, ids), n in want.items():  # documents whose id is their own: pieces cover each id once, with their checksums
        mine = got[got["doc_id"].isna()] if doc is None else got[got["doc_id"] == doc]
        if sum(k for (d, _), k in want.items() if d == doc) > 1:
            continue
        at = 0
        for p in mine.sort_values("start").itertuples():
            part = np.array(ids[p.start:p.start + p.length], dtype="<u4")
            assert p.start == at and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    padding = 0
    for _, group in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        ends = group["offset"] + group["length"]
        assert group["offset"].iloc[0] == 0 and (group["offset"].iloc[1:].to_numpy() == ends.iloc[:-1].to_numpy()).all()
        full = int(ends.iloc[-1])
        assert full <= seq_len
        padding += 0 if full & (full - 1) == 0 else seq_len - full
    return padding / max(1, int(got["length"].sum()))


def test_packing_odd(odd_docs, no_docs):
    check_packing(odd_docs, packing.pack(odd_docs, WORDS))
    assert packing.pack(no_docs, WORDS).count() == 0


def test_packing_pads_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_packing(docs, packing.pack(docs, WORDS)) < 0.01


def test_column_generation_reaches_the_bound():
    demand = np.zeros(16)
    demand[[8, 5, 2]] = [10, 10, 10]  # sizes 9, 6 and 3 in 16
    cols, x = packing.solve_patterns(demand, 16)
    assert np.allclose(cols @ x, demand) and (cols.T @ np.arange(1, 17) <= 16).all()
    assert x.sum() == pytest.approx(12, rel=1e-4)  # no sequence is fuller than 15: 180 / 15
    uses = packing.rounded_uses(cols, x, demand.astype(int))
    assert (cols @ uses <= demand).all()


def test_knapsack_is_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v, cap = rng.random(7) * (rng.random(7) < 0.7), 7
        worth, pattern = packing.best_pattern(v, cap)
        sets = [c for k in range(8) for c in itertools.combinations_with_replacement(range(7), k) if sum(i + 1 for i in c) <= cap]
        assert worth == pytest.approx(max(sum(v[i] for i in c) for c in sets)) and worth == pytest.approx(float(pattern @ v))


def test_word_encoder_equals_library():
    enc = bpe.WordEncoder(WORDS, cache_words=10)
    for _ in range(2):  # the second pass from the cache
        ids, ends = enc.encode_all(TEXTS)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == library_ids(TEXTS)


# ---- neighbours

def brute(vectors, query_ids, k=5):
    x = {i: np.asarray(v, dtype=np.float64) for i, v in vectors}
    out = {}
    for q in query_ids:
        s = sorted((-float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), i) for i, v in x.items() if i != q)
        out[q] = [(i, -s) for s, i in s[:k]]
    return out


def test_neighbours_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = ann.search(table, F.col("vec_id") % 10 == 0, probes=120).collect()
    want = brute(vectors, [i for i, _ in vectors if i % 10 == 0])
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = dict(vectors)
    for r in got[:50]:
        a, b = np.asarray(x[r["query_id"]], dtype=float), np.asarray(x[r["vec_id"]], dtype=float)
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 50 == 0).where("query_id = 0").collect()
    assert len(got) == 2 * 5 and {r["vec_id"] for r in got} == {0, 1, 2, None, 3}
    first = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])][:6:2]
    assert first == [0, 1, 2]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- token files

def test_token_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    files = {"a.bin": [5, 0, 7, 1, 0, 0, 3], "b.bin": [4], "c.bin": []}
    want = set()
    for name, lengths in files.items():
        at, ids = 0, []
        for k, n in enumerate(lengths):
            want.add((name, k, at, n, True))
            ids += [*rng.integers(0, 9, n).tolist(), 9]
            at += n + 1
        if name == "b.bin":
            want.add((name, 1, at, 2, False))
            ids += [1, 2]
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    for block in (1, 2, 3, 5, 100):
        got = tokencount.count_tokens(spark, f"file://{tmp_path}", 9, block_ids=block)
        assert {tuple(r) for r in got.collect()} == want


def test_token_counts_odd(spark, odd_docs, tmp_path):
    uri = f"file://{tmp_path}/files"
    placed = shared.written(tokencount.write_files(odd_docs, uri, WORDS, 49407), "t")
    got = tokencount.count_tokens(spark, uri, 49407, block_ids=1000).join(placed, ["file", "ordinal"])
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    want = Counter((d, len(i)) for (d, _), i in zip(texts, library_ids([t for _, t in texts])))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want


# ---- lines

def brute_lines(docs, least):
    """Delete every line in a run of ``least`` words or more that occurs earlier; all runs are tried."""
    seqs = [[(j, x) for j, x in enumerate(t.split("\n")) if x.encode().split()] for _, t in docs]
    seen, gone = {}, [set() for _ in docs]
    for d, seq in enumerate(seqs):
        for s in range(len(seq)):
            for e in range(s + 1, len(seq) + 1):
                run = tuple(x for _, x in seq[s:e])
                if sum(len(x.encode().split()) for x in run) >= least:
                    if run in seen and seen[run] < (d, s):
                        gone[d].update(range(s, e))
                    else:
                        seen.setdefault(run, (d, s))
    out = []
    for (doc, text), seq, drop in zip(docs, seqs, gone):
        number = {j: k for k, (j, _) in enumerate(seq)}
        kept, dropping = [], False
        for j, line in enumerate(text.split("\n")):
            dropping = number[j] in drop if j in number else dropping
            if not dropping:
                kept.append(line)
        out.append((doc, "\n".join(kept)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    lines = ["a b c", "d e", "f", "g h i j", "k", "", "l m n o p q r", "s t"]
    docs = [(i, "\n".join(lines[k] for k in rng.integers(0, len(lines), rng.integers(0, 14)))) for i in range(25)]
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=6)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(brute_lines(docs, 6))


def test_line_dedup_odd(odd_docs, no_docs):
    got = linededup.dedup(odd_docs)
    assert got.columns == [*odd_docs.columns, "__lines", "__deleted"] and got.count() == odd_docs.count()
    text = {r["doc_id"]: r["text"] for r in got.where("doc_id in (2, 3, 4, 5, 6)").collect()}
    assert text[2] is None and text[3] == "" and text[4] == "  \n\t \n" and text[6] == "intro two\n\nend two"
    assert text[5] == {r["doc_id"]: r["text"] for r in odd_docs.collect()}[5]
    assert linededup.dedup(no_docs).count() == 0


# ---- near-duplicates

def brute_groups(docs, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), (c := least.get(find(i)) if sets[i] else d), d == c) for i, (d, _) in enumerate(docs))


def test_near_duplicates_equal_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    base = [rng.choice(["red", "green", "blue", "one", "two", "three", "sun", "moon"], 120).tolist() for _ in range(4)]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    for i in range(80):
        w = list(base[i % 4])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 9)}"
        docs.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("cls", F.lit(1))
    for percent in (80, 85):
        assert rows_of(minhash.near_duplicates(df, percent=percent)) == brute_groups(docs, percent)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_links_beside_the_centre(spark):
    """All in one bucket, whose centre (most copies) is near, but not near enough: the others' links still count."""
    w = [f"w{k}" for k in range(300)]
    far = [f"z{k}" if k % 30 == 29 else x for k, x in enumerate(w)]  # ten words from the centre, 0.71
    docs = [(k, " ".join(w)) for k in range(10, 14)]
    for n in range(6):
        one = list(far)
        one[5 + n] = "other"
        docs.append((20 + n, " ".join(one)))
    docs += [(40, " ".join(w[:299])), (41, " ".join(far[:298]))]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85, bands=4, rows=1)
    want = brute_groups(docs, 85)
    assert len({c for _, _, c, _ in want}) == 2 and rows_of(got) == want


def test_links_within_a_group_of_near_copies(spark):
    """One text many times over with more or fewer edits, cuts and passages put in: every link counts, whichever centre its buckets have."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(90)]
    docs = [(k, " ".join(base)) for k in range(5)]
    for i in range(140):
        w = list(base)
        for at in rng.integers(0, 90, int(rng.integers(1, 6))):
            w[int(at)] = f"x{rng.integers(0, 4)}"
        lo, hi = int(rng.integers(0, 12)), 90 - int(rng.integers(0, 12))
        w = w[lo:hi] if i % 3 == 0 else w[:40] + [f"p{i % 2}{k}" for k in range(14)] + w[40:] if i % 3 == 1 else w
        docs.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (80, 85, 90):
        assert rows_of(minhash.near_duplicates(df, percent=percent, bands=30, rows=1)) == brute_groups(docs, percent)


def test_keep_first(odd_docs):
    got = minhash.keep_first(odd_docs)
    assert got.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[7] == 1 and ids[8] == 0 and ids[9] == 0 and ids[2] == ids[3] == ids[4] == 1 and ids[1] == 2


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100, k) for k in range(101, 130)] + [(k, k + 1) for k in range(200, 230)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = shared.components(spark.createDataFrame(links, "a long, b long"), "a", "b", "t")
    assert {tuple(r) for r in got.collect()} == {(i, find(i)) for i in root}


# ---- pieces

def test_pieces_equal_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = pieces.PieceModel(PIECES, cache_words=10)
    for _ in range(2):
        ids, ends = model.encode_all(TEXTS)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == sp.encode(TEXTS)
    assert model.decode(ids.astype(np.int64), ends) == sp.decode(sp.encode(TEXTS))


def test_pieces_pairs_are_told_apart_without_merging(monkeypatch):
    """Undoing the pieces' last merges says what merging each pair's text anew says."""
    model = pieces.PieceModel(PIECES)
    made = model.key_ids[model.lengths[model.key_ids] > 1]
    assert (model.level[made] >= 0).all() and (model.lengths[model.halves[:, made]].sum(axis=0) == model.lengths[made]).all()
    rng = np.random.default_rng(7)
    a, b = rng.choice(model.key_ids, (2, 20_000))
    a, b = np.concatenate([a, model.halves[0, made]]), np.concatenate([b, model.halves[1, made]])
    fit = model.lengths[a] + model.lengths[b] <= 2 * model.longest
    a, b = a[fit], b[fit]
    want = np.zeros(len(a), dtype=bool)
    for n in np.unique(model.lengths[a] + model.lengths[b]):
        at = np.flatnonzero(model.lengths[a] + model.lengths[b] == n)
        codes = np.array([[*model.codes[x, :model.lengths[x]], *model.codes[y, :model.lengths[y]]] for x, y in zip(a[at], b[at])])
        out = bpe.merge_rows(model.char_ids[codes], model.table)
        want[at] = (out[:, 0] == a[at]) & (out[:, 1] == b[at])
    assert want.any() and not want.all() and not want[-len(made):].any()
    monkeypatch.setattr(pieces, "merge_rows", None)
    assert (model._apart(a, b) == want).all()


def test_pieces_table(spark, sf, odd_docs, no_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        got = pieces.decode(pieces.encode(docs, PIECES), PIECES)
        want = Counter((d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes()), t.replace("▁", " ")) for (d, t), i in zip(texts, sp.encode([t for _, t in texts])))
        assert rows_of(got) == want
    assert pieces.decode(pieces.encode(no_docs, PIECES), PIECES).count() == 0


# ---- WARC

def test_warc_round_trip(spark, tmp_path):
    big = "<p>same</p>" * 20
    rows = [(1, "http://a/ä b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (None, "u", "nobody"), (7, "u", "é\r\n\r\n" * 40),
            (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("x")).repartition(3)
    raw, tidy = f"file://{tmp_path}/raw", f"file://{tmp_path}/tidy"
    warc.write_archives(pages, raw, file_bytes=300)
    assert warc.normalise(spark, raw, tidy) == len(rows)
    got = {r["page_id"]: r for r in warc.read_records(spark, tidy).collect()}
    for i, url, html in rows:
        data = (html or "").encode()
        r = got["" if i is None else str(i)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest()) and r["url"] == (url or "")
        if i in (2, 11):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", {2: "1", 11: "10"}[i], None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, data)
    assert warc.round_trip(pages.limit(0)) is None


def test_warc_members_stand_alone(spark, tmp_path):
    import gzip
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 30) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/raw")
    warc.normalise(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/tidy")
    raw = gzip.decompress(next((tmp_path / "raw").glob("*.gz")).read_bytes())
    tidy = gzip.decompress(next((tmp_path / "tidy/members").glob("*.gz")).read_bytes())
    assert raw == tidy and len(list(warc.split_records(raw))) == 20


# ---- language

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(shared.text_mod(F.col("doc_id"), 4) != 2))
    held = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(shared.text_mod(F.col("doc_id"), 4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in held)


def test_language_odd(odd_docs, no_docs):
    model = langid.fit(odd_docs, min_count=1)
    got = {r["doc_id"]: r for r in langid.predict(odd_docs, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4, 11)) and got[10]["lang_pred"] == "en"
    assert got[12]["lang_pred"] == "de" and langid.predict(odd_docs, model).count() == odd_docs.count()
    assert langid.fit(no_docs) is None and langid.predict(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, None).collect()} == {"und"}
    assert langid.with_language(odd_docs, model).columns == [*odd_docs.columns, "language"]


def test_letter_stream_and_hits_equal_brute_force():
    texts = ["Ab, c!", "", "é", " x  y ", "12", "a\0b"]
    stream, ends = langid.letter_stream(texts)
    parts = np.split(stream, ends + 1)[:-1]
    said = ["".join(map(chr, p[:-1].tolist())) for p in parts]
    assert [s.split() for s in said] == [["ab", "c"], [], ["é"], ["x", "y"], [], ["a", "b"]] and all(p[-1] == 0 for p in parts)
    assert all(s[:1] == " " and s[-1:] == " " for s in said)
    masks = np.random.default_rng(0).integers(0, 4, 1 << 8).astype(np.uint8)
    model = langid.LanguageModel(["a", "b"], masks, 8, np.zeros(2))
    fixed, total, has = model.hits(texts)
    for k, s in enumerate(said):
        want, n = np.zeros(2), 0
        for size in langid.SIZES:
            for h in langid.ngrams(np.array([ord(c) for c in s], dtype=np.uint64), size):
                both = 255
                for mix in langid.HASHES:
                    both &= int(masks[langid.slots(np.array([h]), mix, 8)[0]])
                want += [both & 1, both >> 1 & 1]
                n += 1
        assert (fixed[k] == want).all() and total[k] == n and has[k] == bool(s.strip())


# ---- toxicity

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels, lambda i: shared.text_mod(i, 5) != 0))
    held = toxicity.score(docs, model).join(labels, "doc_id").where(shared.text_mod(F.col("doc_id"), 5) == 0).collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in held)


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (None, 1), (99, 1), (10, 1), (10, 0)], "doc_id long, toxic int")
    every = lambda i: F.lit(True)
    for rows in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(toxicity.training_rows(odd_docs, rows, every))
        got = toxicity.score(odd_docs, model)
        assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1 or predicted != int(score >= 0.5)").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.with_score(odd_docs, model, out_col="__s").columns == [*odd_docs.columns, "__s"]


def test_label_model_finds_the_class():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.2
    votes = np.stack([(truth & (rng.random(3000) < 0.6)) | (rng.random(3000) < 0.02) for _ in range(8)], axis=1).astype(float)
    given = np.where(rng.random(3000) < 0.1, ~truth, truth).astype(float)  # a tenth of the labels is wrong
    post, odds = toxicity.label_model(votes, given)
    assert ((post > 0.5) == truth).mean() > 0.98 and (odds > 0).all()


# ---- fingerprints

def test_fingerprints_equal_sets(spark, sf, odd_docs):
    units = lambda t: set(re.findall(fingerprint.PARAGRAPH, t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("edited"))
    rows = sorted(((r["doc_id"], r["text"]) for r in table.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(table).collect()}
    prints = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(units(text), units(edited))) and r["near_next"] == pytest.approx(like(units(text), units(after)))
        assert len(r["edits"]) == len(units(text) ^ units(edited)) and prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_odd(odd_docs, no_docs):
    got = fingerprint.fingerprints(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["n_chars"] for r in rows if r["doc_id"] in (2, 3)} == {0} and fingerprint.fingerprints(no_docs).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
