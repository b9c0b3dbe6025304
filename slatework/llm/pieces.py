"""Cutting texts that are too long at natural ends, with an overlap in tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.llm import bpe
from slatework.session import ship, spread

# Natural ends, strongest first. An end is where the match ends.
PARAGRAPH = regex.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*|[ \f]\s*")
LINE = regex.compile(r"\r\n|\r|\n| |\u0085|\v")
SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？｡]+[」』”）]*")
RECORD = regex.compile(r"[}\]]\s*,(?=\s*[{\[\"])|[};](?=\s)|\}(?=\{)")
KINDS = ("paragraph", "line", "sentence", "record")


def piece_tokens(codec: bpe.Codec, text: str, words: bpe.Words, word_char: np.ndarray, start: int, end: int) -> int:
    """Tokens of text[start:end] encoded by itself, from the words of the whole text where they are the same.

    The split into words goes from left to right and looks ahead by one character, behind
    blanks only. So from the first edge that both splits share on the words are those of the text, up to
    the blanks at the end, which are one word there.
    """
    a = int(np.searchsorted(word_char, start, side="left"))
    b = int(np.searchsorted(word_char, end, side="right")) - 1
    if word_char[b] != end:  # the piece ends within a word
        return int(codec.encode_many([text[start:end]])[1][0])
    last = b
    while last > a and words.words[last - 1].isspace():
        last -= 1
    head, begin = 0, start
    if word_char[a] != start:  # it starts within one: split anew until an edge of the text's words comes
        stop = int(word_char[min(a + 3, last)]) if a < last else start
        known, at = set(word_char[a : min(a + 3, last) + 1].tolist()), start
        fresh = []
        for w in codec.find(text[start:stop]):
            fresh.append(w)
            at += len(w)
            if at in known and at < stop:
                break
        else:
            return int(codec.encode_many([text[start:end]])[1][0])
        head, begin = int(codec.codes(fresh)[1].sum()), at
        a = int(np.searchsorted(word_char, begin, side="left"))
    tail = int(codec.codes([text[int(word_char[last]) : end]])[1].sum()) if last < b else 0
    return head + int(words.total[last] - words.total[a]) + tail


def cuts(codec: bpe.Codec, text: str, limit: int, overlap: int, words: bpe.Words | None = None):
    """Pieces of a text as (start char, end char, tokens, shared tokens, kind of cut), in order.

    A text within the limit is one piece. Token offsets are prefix sums, and the
    natural ends are sorted arrays of them: the last end under the limit is
    found by binary search, a stronger kind goes first if its piece is at least
    half full. Without any natural end the cut is between words, and inside a
    word only if the word itself is over the limit, never inside a character.
    Each piece is counted as encoded by itself; should it exceed the limit, it ends earlier.
    Only where the limit is so small that one character exceeds it a piece does too; its kind is ``over``.
    ``words`` are those of the text, if they are known already.
    """
    words = words or codec.split([text]).of(0)
    total = len(words.ids)
    if total <= limit:
        return [(0, len(text), total, 0, "whole")] if text else []
    word_char = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words.words), dtype=np.int64, count=len(words.words)))])
    word_token = words.total
    # Characters at token edges: only edges between characters can be cut.
    raw = text.encode()
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    byte_at = np.concatenate([[0], np.cumsum(codec.width[words.ids])])
    edge_ok = np.append(lead, True)[byte_at]
    char_at = chars[byte_at]

    def ends(pattern) -> np.ndarray:
        at = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        return np.unique(word_token[np.searchsorted(word_char, at, side="left")]) if len(at) else at

    kinds = [ends(p) for p in (PARAGRAPH, LINE, SENTENCE, RECORD)]

    def last(found: np.ndarray, low: int, high: int) -> int:
        i = int(np.searchsorted(found, high, side="right")) - 1
        return int(found[i]) if i >= 0 and found[i] > low else -1

    def choose(start: int, high: int, low: int) -> tuple[int, str]:
        tries = [(last(k, low, high), name) for k, name in zip(kinds, KINDS, strict=True)]
        for cut, name in tries:
            if cut >= start + limit // 2:
                return cut, name
        cut, name = max(tries, key=lambda x: x[0])
        if cut > 0:
            return cut, name
        cut = last(word_token, low, high)
        if cut > 0:
            return cut, "word"
        cut = high
        while cut > low + 1 and not edge_ok[cut]:
            cut -= 1
        while not edge_ok[cut]:  # a character of many tokens
            cut += 1
        return cut, "hard"

    out, start, shared = [], 0, 0
    while True:
        high = min(start + limit, total)
        low = start + overlap  # a cut further back would leave too little to share
        while True:
            cut, kind = (total, "end") if high == total else choose(start, high, low)
            n = piece_tokens(codec, text, words, word_char, int(char_at[start]), int(char_at[cut]))
            if n <= limit:
                break
            if cut <= low + 1:  # nothing is left to share: the piece alone must fit
                low = start
            if cut <= start + 1 or not edge_ok[start + 1 : cut].any():
                kind = "over"
                break
            high = max(low + 1, min(cut - max(1, n - limit), cut - 1))
        out.append((int(char_at[start]), int(char_at[cut]), n, shared, kind))
        if cut >= total:
            return out
        back = max(cut - overlap, start + 1)
        while back > start + 1 and not edge_ok[back]:
            back -= 1
        start, shared = (back, cut - back) if edge_ok[back] and back < cut else (cut, 0)


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, tokenizer: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS, with_text: bool = True) -> DataFrame:
    """(id, piece_no from 0, pieces, start_char, end_char, tokens, shared_tokens, cut, text) of every non-empty text.

    Null and empty texts give no piece. ``shared_tokens`` is what a piece shares
    with the one before it: ``overlap``, or up to three more where a character would
    be cut. Pieces join to the whole text when the shared starts are left out.
    Repeated ids are cut each by itself.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    spark = df.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(bpe.tables_of(tokenizer, folder))
    src = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("length(_text) > 0"), "_id")
    names = ["piece_no", "pieces", "start_char", "end_char", "tokens", "shared_tokens", "cut"]

    def run(batches):
        codec = bpe.codec_of(data.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in bpe.groups(texts):
                rows = {n: [] for n in ("at", *names, "text")}
                split = codec.split(texts[a:b])
                sizes = split.total[split.edge[1:]] - split.total[split.edge[:-1]]
                for i, size in zip(range(a, b), sizes.tolist(), strict=True):
                    found = [(0, len(texts[i]), size, 0, "whole")] if size <= limit else cuts(codec, texts[i], limit, overlap, split.of(i - a))
                    for no, (s, e, n, shared, kind) in enumerate(found):
                        for k, v in zip(("at", *names), (i, no, len(found), s, e, n, shared, kind), strict=True):
                            rows[k].append(v)
                        rows["text"].append(texts[i][s:e] if with_text else None)
                columns = [batch.column(0).take(pa.array(rows["at"], pa.int64()))]
                columns += [pa.array(rows[n], pa.string() if n == "cut" else pa.int32()) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows["text"], pa.string())], names=["_id", *names, "text"])

    kind = dict(src.dtypes)["_id"]
    out = src.mapInArrow(run, f"_id {kind}, piece_no int, pieces int, start_char int, end_char int, tokens int, shared_tokens int, cut string, text string")
    out = out.withColumnRenamed("_id", id_col)
    return out if with_text else out.drop("text")
