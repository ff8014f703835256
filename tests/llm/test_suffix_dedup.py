import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from simpairs.llm import suffix_dedup as module
from simpairs.llm.suffix_dedup import longest_previous, remove_repeats, removal_digests, suffix_order
from tests.conftest import SF001
from tests.llm.helpers import EDGE_DOCS, docs_of, edge_docs, empty_docs


def brute(texts, width, keep_first=False):
    seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    met, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            w = t[i:i + width]
            if (w in met) if keep_first else seen[w] > 1:
                gone[i:i + width] = True
            met.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((list(zip(edges[0::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check(spark, texts, width, keep_first=False):
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, list(enumerate(texts))), width, keep_first).collect()}
    for i, (spans, kept) in enumerate(brute([t.encode() for t in texts], width, keep_first)):
        assert [(s.start, s.stop) for s in got[i].spans] == spans, i
        assert bytes(got[i].kept) == kept and got[i].n_bytes == len(texts[i].encode())


def texts_with_passages(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéx") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 15)))] + rnd.sample(passages, rnd.randint(0, 2))
        rnd.shuffle(parts)
        texts.append(" ".join(parts))
    return texts + texts[:3] + ["ab" * 60, "a" * 90, "xyz" * 40 + "q" + "xyz" * 40]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group", [512, 3])
def test_passages_and_periodic_texts(spark, monkeypatch, keep_first, group):
    monkeypatch.setattr(module, "GROUP", group)  # 3: the fingerprint way for hashes with many runs
    check(spark, texts_with_passages(40, 5), 24, keep_first)


def test_documents_at_the_contract_width(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    want = brute([(r.text or "").encode() for r in docs], 400)
    got = {r.doc_id: r for r in removal_digests(remove_repeats(docs_of(spark, [(r.doc_id, r.text) for r in docs]))).collect()}
    for r, (spans, kept) in zip(docs, want):
        g = got[r.doc_id]
        assert (g.n_spans, g.kept_sha256, g.n_removed) == (len(spans), hashlib.sha256(kept).hexdigest(), len((r.text or "").encode()) - len(kept))


def test_edge_rows(spark):
    got = remove_repeats(edge_docs(spark), 400).collect()
    assert len(got) == len(EDGE_DOCS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_bytes == 0 and bytes(by_id[1].kept) == b""
    assert bytes(by_id[6].kept) == b"" and bytes(by_id[8].kept) == b"" and by_id[9].spans == []
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_longest_previous_factors():
    rnd = random.Random(7)
    data = bytes(rnd.choice(b"ab") for _ in range(300))
    width = 20
    count = len(data) - width + 1
    order, common = suffix_order(np.frombuffer(data, np.uint8), np.array([0]), np.array([count]), width)
    assert order.tolist() == sorted(range(count), key=lambda i: (data[i:i + width], i))
    longest, source = longest_previous(order, common)

    def shared(i, j):
        k = 0
        while k < width and data[i + k] == data[j + k]:
            k += 1
        return k

    for at, place in enumerate(order.tolist()):
        assert longest[at] == max((shared(place, j) for j in range(place)), default=0)
        assert longest[at] == 0 or shared(place, int(source[at])) == longest[at] and source[at] < place
