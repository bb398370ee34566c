"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Words of equal length are rows of one matrix and advance together, one
character a step. At each end every substring up to the longest piece is
looked up: rolling hashes give its hash, which probes the sorted hashes of
all pieces. A backpointer keeps the largest (longest) admissible piece.

The model is a BPE one, whose segmentation is not the one of highest total
score, so a piece is admissible when it and the piece before it stay two
pieces if encoded alone. A row of pieces is the BPE encoding exactly when all
its neighbours pass this test, and every prefix of it is the encoding of its
own text, so the forward pass finds the one encoding (checked against the
sentencepiece library in the tests). Tests of piece pairs are made in batches
and remembered.

Texts are split at blanks first (no piece reaches over the start of a word);
words longer than ``LONG`` characters go to the library.

Defined cases: null and empty texts have no ids and decode to the empty text;
characters without a piece become byte pieces; bytes that are no UTF-8 decode
to replacement characters; the word-start mark itself counts as a blank;
repeated rows and ids are handled row by row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.bpe import NONE, PairTable, merge_rows
from lodgelens.llm.packing import by_chars
from lodgelens.llm.shared import text_batches

LONG = 64
MARK = "▁"
BARE = "\1"  # in front of a chunk that follows a line break; texts that hold it go to the library
_BASE = np.uint64(0x100000001B3)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Polynomial hashes of the prefixes of each row, of 0, 1, 2, ... characters."""
    out = [np.zeros(len(codes), dtype=np.uint64)]
    for k in range(codes.shape[1]):
        out.append(out[-1] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1))
    return out


class PieceTexts:
    """The bytes of each piece, for decoding."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        surface = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode()
                   for i in range(len(names))]
        self.sizes = np.array([len(b) for b in surface], dtype=np.int64)
        self.flat, self.first = np.frombuffer(b"".join(surface), dtype=np.uint8), np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids in a row: pieces' bytes gathered, the first word's blank taken off."""
        size = self.sizes[ids]
        stops = np.cumsum(size)
        raw = self.flat[np.repeat(self.first[ids] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)].tobytes()
        at = np.concatenate([[0], stops])[np.concatenate([[0], ends])]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return [t[1:] if t[:1] == " " else t for t in texts]


class PieceModel(PieceTexts):
    def __init__(self, path: str, cache_words: int = 200_000, pair_bits: int = 21):
        import sentencepiece
        super().__init__(path)
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        if any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in plain):
            raise ValueError("pieces reach over the start of a word or a line break")
        self.longest = max(len(names[i]) for i in plain)
        self.codes = np.zeros((size, self.longest), dtype=np.int32)  # characters of each piece
        self.lengths = np.zeros(size, dtype=np.int64)
        for i in plain:
            self.codes[i, :len(names[i])] = [ord(c) for c in names[i]]
            self.lengths[i] = len(names[i])
        # merges: any two pieces whose joined text is a piece, better scores first
        known = {names[i]: i for i in plain}
        ranks = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        left, right, rank = [], [], []
        for i in plain:
            for cut in range(1, len(names[i])):
                a, b = known.get(names[i][:cut]), known.get(names[i][cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(ranks[i])
        by_rank = np.zeros(len(plain), dtype=np.int32)
        for i, r in ranks.items():
            by_rank[r] = i
        self.table = PairTable(left, right, by_rank, rank)
        # single characters: their piece, or a number of their own behind all pieces
        self.size, self.char_ids = size, np.zeros(0x110000, dtype=np.int32)
        self.char_ids[:] = size + np.arange(0x110000)
        for i in plain:
            if len(names[i]) == 1:
                self.char_ids[ord(names[i])] = i
        # sorted hashes of the pieces that encode to themselves
        ids = np.array([i for i in plain if len(names[i]) <= self.longest])
        own = np.zeros(len(ids), dtype=bool)
        hashes = np.zeros(len(ids), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(self.lengths[ids] == n)
            if len(at):
                codes = self.codes[ids[at], :n]
                hashes[at] = _hashes(codes)[-1]
                own[at] = merge_rows(self.char_ids[codes], self.table)[:, 0] == ids[at]
        self._split(ids[own], np.array(left), np.array(right), np.array(rank), by_rank)
        order = np.argsort(hashes[own])
        self.keys, self.key_ids = hashes[own][order], ids[own][order].astype(np.int64)
        self.bits = np.zeros(1 << 20, dtype=bool)  # first filter before the search
        self.bits[self._bit(self.keys)] = True
        self.powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        # remembered pair tests, the newest in each slot
        self.pair_keys = np.full(1 << pair_bits, -1, dtype=np.int64)
        self.pair_ok = np.zeros(1 << pair_bits, dtype=bool)
        self.pair_shift = np.uint64(64 - pair_bits)
        self.limit, self.cache, self.older = cache_words, {}, {}

    @staticmethod
    def _bit(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, -1 for none."""
        out = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[self._bit(h)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        out[maybe[hit]] = self.key_ids[at[hit]]
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two pieces, encoded together, are these two pieces."""
        ok = np.ones(len(a), dtype=bool)
        ask = np.flatnonzero((a < self.size) & (b < self.size))  # characters without a piece never merge
        key = a[ask] * self.size + b[ask]
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.pair_shift).astype(np.int64)
        known = self.pair_keys[slot] == key
        ok[ask[known]] = self.pair_ok[slot[known]]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            found = self._apart(new // self.size, new % self.size)
            ok[ask[~known]] = found[back]
            self.pair_keys[slot[~known]], self.pair_ok[slot[~known]] = key[~known], found[back]
        return ok

    def _split(self, own: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, by_rank: np.ndarray) -> None:
        """The last merge of each piece that encodes to itself: its two halves
        and its rank. Single characters, which nothing made, rank first."""
        self.level = np.full(self.size, -1, dtype=np.int64)
        self.halves = np.zeros((2, self.size), dtype=np.int64)
        made, is_own = by_rank[rank].astype(np.int64), np.zeros(self.size, dtype=bool)
        is_own[own] = True
        usable = is_own[made] & is_own[left] & is_own[right]
        for n in range(2, self.longest + 1):  # halves are shorter than what they make
            at = np.flatnonzero(usable & (self.lengths[made] == n))
            at = at[self._apart(left[at], right[at], rank[at].astype(np.int64))]
            self.halves[0, made[at]], self.halves[1, made[at]], self.level[made[at]] = left[at], right[at], rank[at]

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank below ``limit`` crosses from a to b.

        The merges that made the two pieces are undone from the last one on. A
        pair that meets at the border in between would have been merged if it
        ranks before the merge undone (in b, further right, also if it ranks
        the same)."""
        ok, rows = np.zeros(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), NONE, dtype=np.int64) if limit is None else limit
        while len(rows):
            la, lb = self.level[a], self.level[b]
            kept = self.table.find(a, b) >= limit
            whole = (la < 0) & (lb < 0)
            ok[rows[kept & whole]] = True
            live = np.flatnonzero(kept & ~whole)
            rows, a, b, la, lb = rows[live], a[live], b[live], la[live], lb[live]
            first = la > lb
            limit = np.where(first, la, lb + 1)
            a, b = np.where(first, self.halves[1, a], a), np.where(first, b, self.halves[0, b])
        return ok

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (ids, or numbers of characters without one) of each row of
        equal-length words, at the right end of a row; how many there are."""
        n, width = codes.shape
        prefix = _hashes(codes)
        chars = self.char_ids[codes].astype(np.int64)
        last, back = np.full((n, width + 1), -1, dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
        for end in range(1, width + 1):
            todo = np.arange(n)
            for size in range(min(end, self.longest), 0, -1):
                begin = end - size
                if size == 1:
                    piece = chars[todo, begin]
                else:
                    piece = self.find(prefix[end][todo] - prefix[begin][todo] * self.powers[size])
                before = last[todo, begin]
                try_ = np.flatnonzero((piece >= 0) & ((begin == 0) | (before >= 0)))
                if not len(try_):
                    continue
                if begin:
                    try_ = try_[self.stay_apart(before[try_], piece[try_])]
                rows = todo[try_]
                last[rows, end], back[rows, end] = piece[try_], size
                left = np.ones(len(todo), dtype=bool)
                left[try_] = False
                todo = todo[left]
                if not len(todo):
                    break
        out = np.zeros((n, width), dtype=np.int64)
        at, count = np.full(n, width), np.zeros(n, dtype=np.int64)
        while (live := np.flatnonzero(at > 0)).size:
            out[live, width - 1 - count[live]] = last[live, at[live]]
            at[live] -= back[live, at[live]]
            count[live] += 1
        return out, count

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            n = len(w) - 1 if w[:1] == BARE else len(w) + 1
            if n > LONG or n == 0:
                self.cache[w] = self._library(w)
            else:
                by_length.setdefault(n, []).append(w)
        for n, group in by_length.items():
            text = "".join([w[1:] if w[:1] == BARE else MARK + w for w in group])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, n).astype(np.int64)
            out, count = self.viterbi(codes)
            whole, count = out.astype("<u4").tobytes(), count.tolist()
            self.cache.update((w, whole[4 * ((k + 1) * n - count[k]):4 * (k + 1) * n]) for k, w in enumerate(group))
            for k in np.flatnonzero((out >= self.size).any(axis=1)).tolist():
                ids = [[i] if i < self.size else self.byte_ids[list(chr(i - self.size).encode("utf-8", "replace"))].tolist()
                       for i in out[k, n - count[k]:].tolist()]
                self.cache[group[k]] = np.array([i for x in ids for i in x], dtype="<u4").tobytes()

    def _library(self, word: str) -> bytes:
        """Ids of a chunk by the library, which puts a word mark before each
        text; behind a line break, which has no piece, nothing merges."""
        if word == BARE:
            return b""
        bare = word[0:1] == BARE
        ids = self.library.encode("\n" + word[1:])[len(self.library.encode("\n")):] if bare else self.library.encode(word)
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        lists = pc.split_pattern(pa.array([_spaced(t) for t in texts], type=pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        if len(self.cache) > self.limit:
            self.cache, self.older = {}, self.cache
        new = [w for w in words if w not in self.cache]
        self.cache.update((w, self.older[w]) for w in new if w in self.older)
        self._learn([w for w in new if w not in self.older])
        ids = [self.cache[w] for w in words]
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        first, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(size)
        out = flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[lists.offsets.to_numpy()[1:]]
        if any(BARE in t for t in texts):
            parts = [np.asarray(self.library.encode(t), dtype="<u4") if BARE in t else x for t, x in zip(texts, np.split(out, ends[:-1]))]
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return out, ends


def _spaced(text: str) -> str:
    """A text whose chunks stand between single blanks: a chunk carries its
    further blanks as marks, and BARE in front when it doesn't start a word."""
    if not text or BARE in text:
        return BARE
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        text = re.sub(r" +", lambda m: " " + MARK * (len(m[0]) - 1), " " + text)[1:]
    return text.replace("\n", f" {BARE}\n {BARE}")


@functools.lru_cache(maxsize=1)
def _model(path: str) -> PieceModel:
    """One model for all tasks of a Python worker, its remembered words included."""
    return PieceModel(path)


def _encoded(path: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = _model(path)
    for pdf in batches:
        for lo, hi in by_chars(pdf["text"].tolist()):
            part = pdf.iloc[lo:hi]
            ids, ends = model.encode_all([t or "" for t in part["text"]])
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": np.split(ids.astype(np.int32), ends[:-1])})


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        lambda it: _encoded(path, it), f"doc_id {kind}, ids array<int>")


def _decoded(path: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = PieceTexts(path)
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo:lo + 500]
            lists = [np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in part["ids"]]
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
            texts = model.decode(flat, np.cumsum([len(x) for x in lists]))
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_pieces": [len(x) for x in lists],
                                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in lists], "text": texts})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, text of rows (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(lambda it: _decoded(path, it), f"doc_id {kind}, n_pieces long, ids_crc32 long, text string")
