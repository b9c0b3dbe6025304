"""Byte-level BPE by speculation: propose greedily, verify pairs in bulk, merge only where that fails.

A sequence of tokens is the BPE encoding of its bytes exactly if every token
encodes to itself and every two neighbours encode to themselves. So the longest
matches are proposed, all neighbouring pairs of a batch are checked at once from
the merges that made the tokens, and only the words with a pair that fails are merged by rank.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.session import ship, spread

#: Where the public tokenizers are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how byte_bpe_50k splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are cut into groups of about this many characters, so memory doesn't follow the batch; words kept between groups.
GROUP_CHARS = 400_000
KEPT_WORDS = 150_000
KEPT_LENGTH = 48


#: Words of more bytes are merged with a heap.
LONG_WORD = 64
_NONE = 1 << 40


def _merged(word: bytes, ranks: dict[bytes, int], below: int = _NONE) -> list[int]:
    """Exact BPE: always the adjacent pair of lowest rank, leftmost first; only ranks under ``below`` are merged."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    dead = bytearray(n)
    rank = lambda a, b: r if (r := ranks.get(word[a:b], _NONE)) < below else _NONE
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i, i + 2)) < _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i] if not dead[i] else n
        if j >= n or end[j] != e:
            continue
        dead[j] = 1
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := rank(i, end[nxt[i]])) < _NONE:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := rank(prv[i], e)) < _NONE:
            heapq.heappush(heap, (r, prv[i], e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Tables:
    """What a vocabulary tells of its tokens, worked out once on the driver and sent along: a few megabytes, fixed.

    halves: the two tokens whose merge made each token; itself twice for a single
    byte; -1 for a token that its own bytes don't encode to. keys, made: every pair of tokens
    whose bytes together are a token (first << 20 | second), sorted, and that token.
    """

    def __init__(self, data: bytes):
        ranks = read_ranks(data)
        size = max(ranks.values()) + 1
        self.halves = np.full((2, size), -1, dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.halves[:, rank] = rank
                continue
            if len(parts := _merged(token, ranks, rank)) == 2:
                self.halves[:, rank] = parts
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 20 | b] = rank
        self.data = data
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token of each pair's bytes, _NONE where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair stay as they are when their bytes are merged together.

        The merges at the seam are undone, the latest first: a token that is a merge of the
        parts facing each other there, of a lower rank than the merge undone last, would
        have come before it. All pairs take a step at once.
        """
        good = (self.halves[0][a] >= 0) & (self.halves[0][b] >= 0)
        live = np.flatnonzero(good)
        a, b, limit = a[live].copy(), b[live].copy(), np.full(len(live), _NONE)
        while len(live):
            seam = self.together(a, b) < limit
            good[live[seam]] = False
            a, b, limit, live = a[~seam], b[~seam], limit[~seam], live[~seam]
            left = a > b
            inner_a, inner_b = self.halves[1][a], self.halves[0][b]
            undo_a = np.where(left, inner_a != a, (inner_b == b) & (inner_a != a))
            undo_b = np.where(left, (inner_a == a) & (inner_b != b), inner_b != b)
            # A merge of the left token comes first among equals, so the right one's limit is one more.
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, inner_a, a), np.where(undo_b, inner_b, b)
            on = undo_a | undo_b
            a, b, limit, live = a[on], b[on], limit[on], live[on]
        return good


def _ranges(kind: str, top: int) -> str:
    """The characters below ``top`` of a class of the pattern, written out for a character set."""
    of = sorted(map(ord, regex.findall(kind, "".join(map(chr, [*range(min(top, 0xD800)), *range(0xE000, top)])))))
    cuts = [i for i in range(1, len(of)) if of[i] != of[i - 1] + 1]
    return "".join(f"\\u{of[a]:04x}-\\u{of[b - 1]:04x}" for a, b in pairwise([0, *cuts, len(of)]))


def finders(pattern: str):
    """Splitters of texts in ASCII, in the basic plane, and of all texts, which give the same words.

    With its classes written out the pattern runs in the simpler engine, about twice as fast.
    """
    out = []
    for top in (0x80, 0x10000):
        sets = {kind: _ranges(kind, top) for kind in (r"\p{L}", r"\p{N}", r"\s")}
        inside, plain = re.compile(r"\[[^\]]*\]"), pattern.replace(r"\S", "[^" + sets[r"\s"] + "]")
        for kind, chars in sets.items():
            plain = inside.sub(lambda m, kind=kind, chars=chars: m[0].replace(kind, chars), plain).replace(kind, "\0")
            plain = re.sub(r"\[[^\]]*\]|\0", lambda m, chars=chars: m[0].replace("\0", chars) if len(m[0]) > 1 else f"[{chars}]", plain)
        out.append(re.compile(plain).findall)
    return (*out, regex.compile(pattern).findall)


class Codec:
    """Encoder for one vocabulary. Keeps the words it has seen, within KEPT_WORDS."""

    def __init__(self, tables: Tables, pattern: str = WORDS):
        self.tables = tables
        self.ranks = ranks = read_ranks(tables.data)
        self.tokens = {v: k for k, v in ranks.items()}
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, r in ranks.items():
            self.width[r] = len(t)
        self.bytes = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.pairs = dict(zip(tables.keys.tolist(), tables.made.tolist(), strict=True))
        self.finders = finders(pattern)
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.failed_words = self.seen_words = 0
        self._forget()

    def find(self, text: str) -> list[str]:
        """The words of a text."""
        plain, basic, whole = self.finders
        if text.isascii():
            return plain(text)
        return (basic if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else whole)(text)

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.place = np.empty((2, 1 << 14), dtype=np.int64)  # start and number of tokens of each word

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE of a word."""
        if len(word) > LONG_WORD:
            return _merged(word, self.ranks)
        get = self.pairs.get
        tokens = [self.bytes[b] for b in word]
        made = [get(a << 20 | b, _NONE) for a, b in pairwise(tokens)]
        while made:
            least = min(made)
            if least == _NONE:
                break
            i = made.index(least)
            tokens[i] = least
            del tokens[i + 1], made[i]
            if i:
                made[i - 1] = get(tokens[i - 1] << 20 | least, _NONE)
            if i < len(made):
                made[i] = get(least << 20 | tokens[i + 1], _NONE)
        return tokens

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest matches."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        out, i, n, get, lengths = [], 0, len(word), self.ranks.get, self.lengths.get
        while i < n:
            for size in lengths(word[i : i + 3], ()):
                t = get(word[i : i + size]) if i + size <= n else None
                if t is not None:
                    break
            else:
                size = 2 if (t := get(word[i : i + 2])) is not None and i + 2 <= n else 1
                t = t if size == 2 else self.bytes[word[i]]
            out.append(t)
            i += size
        return out

    def learn(self, words: list[str]) -> None:
        """Encode unseen words together and keep them."""
        raw = [w.encode() for w in words]
        guess = [self.proposed(b) for b in raw]
        sizes = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        ids = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        after = np.append(ids[1:], 0)
        good = np.zeros(len(ids), dtype=bool)
        last = np.zeros(len(ids), dtype=bool)
        last[ends - 1] = True  # the last token of each word is asked about alone
        good[last] = self.tables.halves[0][ids[last]] >= 0
        good[~last] = self.tables.hold(ids[~last], after[~last])
        bad = np.flatnonzero(np.logical_or.reduceat(~good, ends - sizes)) if len(ends) else []
        self.seen_words += len(words)
        self.failed_words += len(bad)
        if len(bad):
            for i in bad:
                guess[i] = self.merged(raw[i])
            sizes = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
            ids = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(sizes.sum()))
            ends = np.cumsum(sizes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        base = len(self.index)
        while base + len(words) > self.place.shape[1]:
            self.place = np.concatenate([self.place, np.empty_like(self.place)], axis=1)
        self.place[0, base : base + len(words)] = self.used + ends - sizes
        self.place[1, base : base + len(words)] = sizes
        self.used += len(ids)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its place and its number of tokens; and the array the places point into."""
        found = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            unseen = [words[i] for i in new.tolist()]
            self.learn(list(dict.fromkeys(unseen)))
            found[new] = np.fromiter(map(self.index.__getitem__, unseen), dtype=np.int64, count=len(new))
        starts, lengths, flat = self.place[0][found], self.place[1][found], self.flat
        if len(self.index) > KEPT_WORDS or self.used > 8 * KEPT_WORDS:
            self._forget()
        return starts, lengths, flat

    def split(self, texts: list[str | None]) -> Words:
        """The words of all texts with their tokens; null and empty texts have none."""
        words: list[str] = []
        count = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                w = self.find(t)
                count[i] = len(w)
                words.extend(w)
        if not words:
            return Words([], np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32))
        starts, lengths, flat = self.codes(words)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        return Words(words, np.concatenate([[0], np.cumsum(count)]), lengths, total, ids)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); null and empty texts have none."""
        w = self.split(texts)
        return w.ids, w.total[w.edge[1:]] - w.total[w.edge[:-1]]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        return self.encode_many([text])[0].tolist()


@dataclass(frozen=True)
class Words:
    """Words of several texts: edge has where each text's words start, total where each word's tokens start."""

    words: list[str]
    edge: np.ndarray
    lengths: np.ndarray
    total: np.ndarray
    ids: np.ndarray

    def of(self, i: int) -> Words:
        """Those of the i-th text."""
        a, b = int(self.edge[i]), int(self.edge[i + 1])
        return Words(self.words[a:b], np.array([0, b - a]), self.lengths[a:b], self.total[a : b + 1] - self.total[a], self.ids[self.total[a] : self.total[b]])


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on every line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_codecs: dict[int, Codec] = {}


def codec_of(tables: Tables) -> Codec:
    """The codec of this Python worker, made once per vocabulary."""
    key = hash(tables.data)
    if key not in _codecs:
        _codecs[key] = Codec(tables)
    return _codecs[key]


@lru_cache(maxsize=8)
def tables_of(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Tables:
    """The tables of a vocabulary, made on the driver."""
    return Tables(vocabulary(name, folder))


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file, read on the driver: a megabyte whatever the data."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def groups(texts: list[str | None], most: int = GROUP_CHARS):
    """Ranges of consecutive texts of about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., ids) or, with ``counts_only``, (id, keep..., tokens) of every row.

    Null and empty texts have no ids (an empty array, zero). Strings that look
    like special tokens are ordinary text. Rows with equal ids stay separate;
    columns other than those named are not read. No shuffle, unless the input has
    fewer splits than there are cores.
    """
    spark = df.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(tables_of(tokenizer, folder))  # a few megabytes, fixed
    src = spread(df.select(*dict.fromkeys((id_col, *keep)), F.col(text_col).alias("_text")), id_col)
    fields = [pa.field(c, pa.null()) for c in src.columns[:-1]]

    def run(batches):
        codec = codec_of(data.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in groups(texts):
                ids, n = codec.encode_many(texts[a:b])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(fields))]
                if counts_only:
                    columns.append(pa.array(n, pa.int64()))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "tokens" if counts_only else "ids"])

    types = dict(src.dtypes)
    schema = ", ".join([*[f"`{f.name}` {types[f.name]}" for f in fields], "tokens long" if counts_only else "ids array<int>"])
    return src.mapInArrow(run, schema)
