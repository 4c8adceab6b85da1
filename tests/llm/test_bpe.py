import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm import bpe

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(bpe.default_path())
    held.no_truncation()
    held.no_padding()
    return held


def texts():
    r = random.Random(4)
    words = [("".join(r.choice("abcdeéßж漢 字🙂1297'.,!-") for _ in range(r.randrange(1, 9)))) for _ in range(400)]
    page = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\n\n ", "\t", "'s ", " ", "　"]) for _ in range(n))
    shared = page(2000)
    out = [page(r.randrange(1, 3000)) for _ in range(12)] + [page(50) + shared + page(70), shared, shared + page(9)]
    return [*out, "", None, " ", "a", "<|endoftext|>", " <|endoftext|> x<|endoftext|>\n", "x" * 30_000, " " * 20_000, "\n" * 9000 + "a", "don't I'll we've " * 900, "漢字" * 9000, "\x00\x7f" * 300]


def test_ids_and_texts_are_those_of_the_library(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(3, texts()[3], "x", 1), (None, "null id", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    got = bpe.encode(df)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got.collect()) == want
    back = {(str(r["doc_id"]), r["text"]) for r in bpe.decode(got).collect()}
    assert back == {(str(i), library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in rows}
    for r in bpe.digests(df).where("doc_id is not null").collect():
        ids = library.encode(texts()[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " c", "\n", "  ", "'s", "é", "漢", "9", ".", "\t", "<|endoftext|>", "word word", " ", "ſ"]), max_size=60), st.integers(1, 40))
def test_joins_of_chunks_agree_with_the_whole(library, parts, size):
    text = "".join(parts)
    data = text.encode()
    ends = [e for e in range(size, len(data), size) if data[e] & 0xC0 != 0x80] + [len(data)] * bool(data)
    encode, _ = bpe.codec(bpe.default_path())
    assert bpe.Reuse(encode).text(data, ends, 0).tolist() == library.encode(text, add_special_tokens=False).ids


def test_shared_passages_are_encoded_once():
    page = texts()[13].encode()
    reuse = bpe.Reuse(bpe.codec(bpe.default_path())[0])
    for lead in (b"", b"other words first, ", b"and more of them before the same passage "):
        data = np.frombuffer(lead + page, np.uint8)
        reuse.text(lead + page, bpe.chunk_ends(data, np.array([0, len(data)]))[0], 0)
    assert reuse.hits > reuse.chunks / 2


def test_chunks_without_blanks_are_reused_as_well(library):
    r = random.Random(6)
    page = "".join("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(r.randrange(3, 30))) + r.choice("。，、！") for _ in range(900))
    reuse = bpe.Reuse(bpe.codec(bpe.default_path())[0])
    for lead in ("", "別の言葉。", "and more "):
        data = np.frombuffer((lead + page).encode(), np.uint8)
        ids = reuse.text(data.tobytes(), bpe.chunk_ends(data, np.array([0, len(data)]))[0], 0)
        assert ids.tolist() == library.encode(lead + page, add_special_tokens=False).ids
    assert reuse.hits > reuse.chunks / 2 and not any(x is None for x in reuse.kept.values())


def test_joins_that_do_not_agree_grow(library, monkeypatch):
    """With places that are no borders the pieces' ids differ, so joins grow until they agree or the whole text is encoded."""
    monkeypatch.setattr(bpe, "firm", lambda chunk: [i for i in range(1, len(chunk)) if chunk[i] & 0xC0 != 0x80])
    encode, _ = bpe.codec(bpe.default_path())
    r, grown = random.Random(7), 0
    for _ in range(200):
        text = "".join(r.choice(["word", " ", "ing", "'ll", "  ", "é", "漢", ". "]) for _ in range(60))
        data, reuse = text.encode(), bpe.Reuse(encode)
        ends = [e for e in range(9, len(data), 9) if data[e] & 0xC0 != 0x80] + [len(data)]
        reuse.text(data, ends, 0)
        grown += reuse.grown
    assert grown
