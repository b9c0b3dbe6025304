import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slatework.llm import bpe, pieces

DATA = bpe.vocabulary()
TABLES = bpe.tables_of()
CODEC = bpe.codec_of(TABLES)
PLAIN = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=bpe.read_ranks(DATA), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_exact_encoding(text):
    assert CODEC.encode(text) == PLAIN.encode_ordinary(text)


def test_equals_the_other_library_on_texts_like_ours(spark, sf):
    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs += ["<|endoftext|> x", "aaaa" * 5000, "日本語の屋根" * 900, "a\r\n\r\n  b\t", " ", "\u0000", "😀" * 50]
    assert [CODEC.encode(d) for d in docs] == [t.encode(d, add_special_tokens=False).ids for d in docs]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    c = bpe.Codec(TABLES)
    rnd = random.Random(1)
    for _ in range(40):
        text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(8))
        assert c.encode(text) == PLAIN.encode_ordinary(text)


def test_every_token_is_reachable_by_merges():
    assert all(CODEC.merged(t) == [i] for t, i in list(CODEC.ranks.items())[::97])


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "roof", "x"), (3, "roof", "y")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encoded(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, CODEC.encode("roof")), (3, CODEC.encode("roof"))]
    counts = bpe.encoded(df, "doc_id", "text", counts_only=True, keep=("ids",)).collect()
    assert sorted((r.ids, r.tokens) for r in counts if r.doc_id == 3) == [("x", len(CODEC.encode("roof"))), ("y", len(CODEC.encode("roof")))]
    assert bpe.encoded(df.where("false"), "doc_id", "text").count() == 0


def check(text, limit, overlap):
    out = pieces.cuts(CODEC, text, limit, overlap)
    end = 0
    for s, e, n, shared, _ in out:
        assert s <= end < e
        assert n == len(PLAIN.encode_ordinary(text[s:e])) <= limit
        assert s == 0 or shared >= overlap
        end = e
    assert end == len(text)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["roof ", "tile. ", "\n", "\n\n", "日本", "é", "12 345", "   ", "}, {", "x" * 30, "\r\n"]), min_size=1, max_size=120), st.integers(1, 5))
def test_pieces_are_whole_and_within_the_limit(parts, overlap):
    check("".join(parts), 24, overlap)


def test_natural_ends_go_first():
    text = "\n\n".join("The roof is flat and old. " * 6 for _ in range(4))
    assert {k for *_, k in check(text, 60, 5)} <= {"paragraph", "end"}
    lines = "\n".join("plain words without any stop " * 2 for _ in range(12))
    assert {k for *_, k in check(lines, 60, 5)} <= {"line", "end"}
    assert {k for *_, k in check("One roof is flat. " * 60, 60, 5)} <= {"sentence", "end"}
    assert {k for *_, k in check('{"a": 1}, ' * 60, 60, 5)} <= {"record", "end"}
    assert "word" in {k for *_, k in check("roof tile " * 100, 60, 5)}
    assert "hard" in {k for *_, k in check("qzxj" * 400, 60, 5)}


def test_split_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "One roof is flat. " * 40), (4, "One roof is flat. " * 40)], "doc_id long, text string").selectExpr("*", "'x' as cut")
    out = pieces.split_texts(df, "doc_id", "text", 50, 5).collect()
    assert sorted({r.doc_id for r in out}) == [3, 4]
    assert len([r for r in out if r.doc_id == 4]) == 2 * max(r.pieces for r in out)
    with pytest.raises(ValueError, match="overlap"):
        pieces.split_texts(df, "doc_id", "text", 5, 5)


def test_seams_equal_exact_merging():
    """The vectorised check of pairs against merging their bytes: pairs of all kinds, most of them met in greedy proposals."""
    import numpy as np

    rnd = random.Random(11)
    ids = sorted(CODEC.tokens)
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(4000)]
    for _ in range(4000):  # two parts of a token: near misses
        t = CODEC.tokens[rnd.choice(ids)]
        if len(t) > 2:
            k = rnd.randrange(1, len(t))
            if t[:k] in CODEC.ranks and t[k:] in CODEC.ranks:
                pairs.append((CODEC.ranks[t[:k]], CODEC.ranks[t[k:]]))
            pairs += list(zip(CODEC.proposed(t + t[k:]), CODEC.proposed(t + t[k:])[1:], strict=False))
    a, b = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    got = TABLES.hold(a, b).tolist()
    assert got == [bpe._merged(CODEC.tokens[x] + CODEC.tokens[y], CODEC.ranks) == [x, y] for x, y in pairs]
    assert 0.02 < sum(got) / len(got) < 0.98


def test_both_merges_are_one():
    rnd = random.Random(12)
    for _ in range(2000):
        word = bytes(rnd.choices(b"abcdeorst \xc3\xa9\xd0\xb0", k=rnd.randint(1, 40)))
        assert CODEC.merged(word) == bpe._merged(word, CODEC.ranks)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\t.'re sté屋😀", min_size=1, max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_tokens_of_a_piece_equal_those_of_its_text(text, i, j):
    import numpy as np

    start, end = sorted((min(i, len(text)), min(j, len(text))))
    words = CODEC.split([text]).of(0)
    edges = np.concatenate([[0], np.cumsum([len(w) for w in words.words])])
    if start < end:
        assert pieces.piece_tokens(CODEC, text, words, edges, start, end) == len(PLAIN.encode_ordinary(text[start:end]))


def test_limits_that_one_character_exceeds():
    text = "😀屋" * 6
    out = pieces.cuts(CODEC, text, 2, 1)
    assert "".join(text[max(s, e0) : e] for (s, e, *_), e0 in zip(out, [0, *(e for _, e, *_ in out)], strict=False)) == text
    assert all(n == len(PLAIN.encode_ordinary(text[s:e])) for s, e, n, *_ in out)
    assert all(kind == "over" and e - s == 1 for s, e, n, _, kind in out if n > 2)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_splitters_give_the_same_words(text):
    plain, basic, whole = CODEC.finders
    assert CODEC.find(text) == whole(text)
    low = "".join(chr(ord(c) % 128) for c in text)
    assert plain(low) == whole(low) == basic(low)


def test_splitters_on_every_character_of_the_basic_plane():
    _, basic, whole = CODEC.finders
    for at in range(0, 0x10000, 4096):
        chars = "".join(chr(c) for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000)
        text = "a".join(chars) + " ".join(chars) + chars
        assert basic(text) == whole(text)
