import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import EncodedText, Prefixes, from_bytes
from tidemark.llm.tokens import TOKENIZER, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    with open(TOKENIZER, "rb") as f:
        return from_bytes(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


HARD = ["", " ", "\n\n  x", "<|endoftext|>", "it's they'LL", "  a  b ", "\x1c\x85᠎　", "日本語 ё е́", "👩‍🔧", "=" * 3000, " " * 2001 + "x", "ab" * 5000, "  a", "1234567890٣²½", "a\r\n\r\n\tb\x00\x1b[0m", "Ġĉ"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(bpe, library, text):
    assert bpe.encode(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text(bpe, library, text):
    assert bpe.encode(text) == library(text)
    assert b"".join(bpe.bytes_of[i] for i in bpe.encode(text)).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\t lsé日1_- ", max_size=14), st.text(alphabet="ab '\n\t lsé日1_- ", max_size=8), st.data())
def test_appends_and_edits(bpe, text, new, data):
    i = data.draw(st.integers(0, len(text)))
    j = data.draw(st.integers(i, len(text)))
    e = EncodedText(bpe, text)
    e.edit(i, j, new)
    assert e.text == text[:i] + new + text[j:] and e.ids() == bpe.encode(e.text)
    e.append(text)
    assert e.ids() == bpe.encode(e.text)


def test_prefix_table(bpe):
    random.seed(1)
    for _ in range(200):
        a, b = (bytes(random.choices(b"theing er0", k=random.randrange(12))) for _ in "ab")
        p = Prefixes(bpe, a)
        p.append(b)
        assert p.ids() == bpe.encode_piece(a + b) and len(p.table) == len(a + b) + 1
        p.edit(len(a) // 2, len(a), b"xyz")
        assert p.data == a[: len(a) // 2] + b"xyz" + b and p.ids() == bpe.encode_piece(p.data)
        for n in range(1, len(p.data) + 1):
            assert p.table[n] == bpe.encode_piece(p.data[:n])[-1]


def test_column(spark, library):
    rows = [(1, None, "ids"), (2, "", "x"), (3, "Hello <|endoftext|> world", "x"), (4, "long " * 100_000, "x"), (3, "Hello <|endoftext|> world", "x")]
    got = token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == sorted((i, library(t) if t else []) for i, t, _ in rows)
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_documents(spark, library):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    want = {r["doc_id"]: library(r["text"]) if r["text"] else [] for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in token_ids(docs).collect()} == want


def test_edits_stop_where_the_old_table_holds_again(bpe):
    rnd = random.Random(3)
    data = b" ".join(rnd.choice([b"alpha", b"beta-gamma", b"12345", b"xx", "naïve".encode()]) for _ in range(3000))
    table = Prefixes(bpe, data)
    for _ in range(20):
        a = rnd.randrange(len(table.data))
        new = rnd.choice([b"", b"q", b"delta epsilon", b"    "])
        b = min(len(table.data), a + rnd.randrange(6))
        want = table.data[:a] + new + table.data[b:]
        again = table.edit(a, b, new)
        assert table.data == want and table.table == Prefixes(bpe, want).table and again <= 3 * bpe.longest


def test_other_splittings_are_refused():
    import json

    from tidemark.llm.bpe import Bpe
    from tidemark.llm.tokens import TOKENIZER

    with open(TOKENIZER, "rb") as f:
        whole = json.load(f)
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"model": whole["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            Bpe(json.dumps(whole | change).encode())
