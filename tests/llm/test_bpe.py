import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from simpairs.llm import bpe as module
from simpairs.llm.bpe import WordBpe, digests, encode_decode
from simpairs.llm.queries import tokenizer_path
from tests.conftest import SF001
from tests.llm.helpers import EDGE_DOCS, edge_docs, empty_docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path(), "rb") as f:
        return WordBpe(f.read())


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "b", "'s", "'LL", "é", "e\u0301", "\u0301", "Σ", "ΑΣ ", "İ", "\x1c", "\x85", "\u200b", "\u3000", "<|endoftext|>", "<|startoftext|>",
             "<|", "|>", "1", "２", "²", "!", "!!", "#", "th", "ing", " ", "\n", "日本", "👍", "ß", "ǅ", "</w>", "\x00", "_", "zzz"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_ids_equal_the_library_on_odd_texts(own, library):
    texts = odd_texts(4000)
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_exact_merging_equals_the_library_on_long_words(own, library):
    rnd = random.Random(2)
    for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rnd.choice(letters) for _ in range(3000))
        want = library.encode(word, add_special_tokens=False).ids
        assert own.merged(word) == want
        assert own.encode([word])[0].tolist() == want


def test_pair_check_agrees_with_merging(own):
    """A pair is compatible exactly if merging its joined letters gives it back."""
    rnd = np.random.default_rng(3)
    plain = np.array([i for s, i in own.vocab.items() if not s.endswith("</w>")])
    ends = np.array([i for s, i in own.vocab.items() if s.endswith("</w>")])
    a, b = rnd.choice(plain, 3000), rnd.choice(ends, 3000)
    for x, y, fine in zip(a, b, own.compatible(a, b)):
        word = own.tokens[x] + own.tokens[y].removesuffix("</w>")
        assert fine == (own.merged(word) == [x, y])


def test_a_full_memory_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(module, "WORD_MEMORY", 5)
    texts = odd_texts(50, 9)
    for _ in range(2):
        for t, ids in zip(texts, own.encode(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_query_rows(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(encode_decode(docs, tokenizer_path())).collect()}
    assert got == want


def test_edge_rows(spark, library):
    got = encode_decode(edge_docs(spark), tokenizer_path()).collect()
    forgot = encode_decode(edge_docs(spark), tokenizer_path(), forget=True).collect()
    assert sorted(map(str, forgot)) == sorted(map(str, got))
    want = sorted((repr(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in EDGE_DOCS)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == want
    assert digests(encode_decode(empty_docs(spark), tokenizer_path())).count() == 0
