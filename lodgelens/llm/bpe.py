"""Byte-pair merges over many words at once in numpy.

Words of equal length are rows of one matrix; every step merges the best pair
of each row, so a batch of words advances together. Pair ranks come from a
bucketed hash table that is probed for whole columns."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)  # rank of a pair that doesn't merge
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank, and rank -> merged id.

    Pairs have ranks of their own unless ``rank`` gives pairs a common one."""

    def __init__(self, left, right, merged, rank=None):
        key = (np.asarray(left, dtype=np.uint64) << np.uint64(32)) | np.asarray(right, dtype=np.uint64)
        bits = max(4, int(len(key) * 8).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(size + 64, np.uint64(2**64 - 1))
        self.rank = np.full(size + 64, NONE, dtype=np.int32)
        self.merged = np.asarray(merged, dtype=np.int32)
        self.probes = 1
        for r, k, slot in zip(range(len(key)) if rank is None else rank, key.tolist(), ((key * _MIX) >> self.shift).tolist()):
            step = 0
            while self.rank[slot + step] != NONE:
                step += 1
            self.keys[slot + step], self.rank[slot + step] = k, r
            self.probes = max(self.probes, step + 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of non-negative ids; NONE where they don't merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * _MIX) >> self.shift).astype(np.int64)
        hit = self.keys[slot] == key
        rank = self.rank[slot]
        open_ = np.flatnonzero(~hit & (rank != NONE))
        rank[~hit] = NONE
        for step in range(1, self.probes):
            if not open_.size:
                break
            at = slot.flat[open_] + step
            found = self.keys[at] == key.flat[open_]
            rank.flat[open_[found]] = self.rank[at[found]]
            open_ = open_[~found & (self.rank[at] != NONE)]
        return rank


def merge_rows(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """Merge each row's lowest-rank pair (the leftmost of equals) until none
    is left; rows end in -1 where merges shortened them."""
    out = np.full(symbols.shape, -1, dtype=np.int32)
    rows, s = np.arange(len(symbols)), symbols.astype(np.int32)
    rank = table.find(s[:, :-1], s[:, 1:])
    while len(rows):
        width = s.shape[1]
        p = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
        each = np.arange(len(rows))
        best = rank[each, p] if width > 1 else np.full(len(rows), NONE)
        done = best == NONE
        if done.any():
            out[rows[done], :width] = s[done]
            live = ~done
            rows, s, rank, p, best = rows[live], s[live], rank[live], p[live], best[live]
            each = each[:len(rows)]
            if not len(rows):
                break
        s[each, p] = table.merged[best]
        keep = np.ones(s.shape, dtype=bool)
        keep[each, p + 1] = False
        s = s[keep].reshape(len(rows), width - 1)
        keep = np.ones(rank.shape, dtype=bool)
        keep[each, p] = False
        rank = rank[keep].reshape(len(rows), width - 2)
        for at, fits in ((p - 1, p > 0), (p, p < width - 2)):
            i, j = each[fits], at[fits]
            rank[i, j] = table.find(s[i, j], s[i, j + 1])
    return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """Whole-text ids of a lower-casing word BPE, from cached words.

    The tokenizer's normaliser drops white space and its splitter never joins
    across it or across a change between letters and marks, so a text's ids
    are its words' ids in order. Words of letters are merged here in batches;
    any other chunk goes to the tokenizers library. The cache keeps two
    generations of at most ``cache_words`` words."""

    MARKS = ".,;:!?"

    def __init__(self, path: str, cache_words: int = 200_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs],
                               [vocab[a + b] for a, b in pairs])
        letters, end = _byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        self.limit, self.cache, self.older = cache_words, {"": b""}, {}
        # 0 letter, digit or blank; 1 other; 2 a mark that may be set apart (characters from U+0250 on: 1)
        self.kinds = np.array([2 if chr(c) in self.MARKS else 0 if chr(c).isalnum() or chr(c) in " \n\t\r" else 1
                               for c in range(0x250)] + [1], dtype=np.uint8)

    def _letters(self, words: list[str]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            raw = w.encode()
            by_length.setdefault(len(raw), []).append(raw)
        for n, group in by_length.items():
            raw = np.frombuffer(b"".join(group), dtype=np.uint8).reshape(-1, n)
            symbols = self.inner[raw]
            symbols[:, -1] = self.last[raw[:, -1]]
            ids = merge_rows(symbols, self.table).astype("<i4")
            ends = (np.arange(len(group)) * 4 * n + 4 * (ids >= 0).sum(axis=1)).tolist()
            whole = ids.tobytes()
            self.cache.update((w.decode(), whole[k * 4 * n:e]) for k, (w, e) in enumerate(zip(group, ends)))

    def _ready(self, texts: list[str]) -> list[str]:
        """Texts to be split at blanks: lower-cased and with marks set apart
        where that can't change the tokenizer's own splitting, that is where
        no mark touches another sign."""
        kind = self.kinds[np.minimum(np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0x250)]
        touch = np.flatnonzero(kind[1:] * kind[:-1] > 1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        odd = set(np.searchsorted(ends, touch, side="right").tolist())
        out = []
        for k, text in enumerate(texts):
            if k not in odd and "\u03a3" not in text:
                text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
                for m in self.MARKS:
                    text = text.replace(m, f" {m} ")
            out.append(text.replace("\n", " "))
        return out

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha() and len(w) < 64 and w == w.lower() and "\u03a3" not in w
                 and unicodedata.is_normalized("NFC", w)]
        self._letters(plain)
        other = list(set(words).difference(plain))
        for lo in range(0, len(other), 4096):
            part = other[lo:lo + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[w] = np.asarray(e.ids, dtype="<u4").tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        lists = pc.split_pattern(pa.array(self._ready(texts), type=pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        if len(self.cache) > self.limit:
            self.cache, self.older = {"": b""}, self.cache
        new = [w for w in words if w not in self.cache]
        self.cache.update((w, self.older[w]) for w in new if w in self.older)
        self._learn([w for w in new if w not in self.older])
        ids = [self.cache[w] for w in words]
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        first, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(size)
        out = flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[lists.offsets.to_numpy()[1:]]
