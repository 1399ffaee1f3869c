"""Retrieval packing against the tokenizers library and a plain index."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayline.llm import retrieval_packing as rp

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, row string, topic string"
ALPHABETS = ["ÀÉîöß×÷ŒœŸÿıĲĳ aB'", "\x00\x01\x1f\x7f a'Ll", "<|endoftext|> ab", "ſŉİK Ω a","abcdefghijklmnopqrstuvwxyz", " abcTHE'sdtm", "\n\t  ab1 9", "éñß漢字кир ab", "aaaa b", "!#$%'s're' a", "\x1c\x1d\x85　  ab.", "é ́ΑΣ σς İi"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=300):
    r = random.Random(5)
    out = [None, "", " ", "\n", "<|endoftext|>", " a<|endoftext|> b <|endoftext|>x", "x" * 3000, "It's 're they'RE", "a  b", "a \n b", "word " * 900, " ́a"]
    return out + ["".join(r.choice(a) for _ in range(r.randint(0, 90))) for _ in range(n) for a in [r.choice(ALPHABETS)]]


def test_stretches_give_the_ids_of_the_library(library):
    w = rp.words(PATH)
    use = [t or "" for t in texts()]
    for t, got in zip(use, w.encode(use)):
        assert np.frombuffer(got, w.kind).tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("size,shard", [(64, 1 << 18), (32, 300), (100, 50)])
def test_every_token_lies_in_one_full_sequence(spark, library, size, shard):
    rows = [(i, t, "x", "y", None) for i, t in enumerate(texts())] + [((1 << 53) + 1, "a big id", "x", "y", "z"), (None, "no id", "x", "y", "z"), (3, "same id", "x", "y", "z"), (3, "same id", "x", "y", "z")]
    got = rp.retrieval_pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, 1, size, shard).collect()
    by_id, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    assert by_id.keys() == want.keys()
    for i, ids in want.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(by_id[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[0])
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[0][r["start"]:at], "<u4").tobytes())
            assert at == len(ids[0])
        else:
            assert sum(r["length"] for r in by_id[i]) == sum(map(len, ids))
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == size or at < size and at & at - 1 == 0


def test_topic_is_the_rarest_term_used_twice():
    assert rp.topic(np.array([5, 9, 5, 7, 7, 30])) == (7, 5) and rp.topic(np.array([5, 9, 30])) == (30, 9) and rp.topic(np.array([4, 4])) == (4, -1) and rp.topic(np.array([], "u2")) == (-1, -1)


def test_nothing_and_nulls(spark):
    assert rp.retrieval_pack(spark.createDataFrame([], SCHEMA), PATH, 1, 64).collect() == []
    got = rp.retrieval_pack(spark.createDataFrame([(None, None, None, None, None)], SCHEMA), PATH, 1, 64).collect()
    assert [(r["doc_id"], r["length"], r["offset"]) for r in got] == [(None, 1, 0)]


def test_shard_returns_the_unused_neighbours_of_the_seed():
    r = random.Random(8)
    docs = [np.array([r.randint(10 * (i % 3), 10 * (i % 3) + 14) for _ in range(r.randint(1, 30))] + [1]) for i in range(60)]
    df = Counter(t for d in docs for t in set(d[:-1].tolist()))
    frequency = np.zeros(64, "float32")
    for t, n in df.items():
        frequency[t] = n
    total = sum(len(d) - 1 for d in docs)
    bm25 = rp.Bm25(len(docs), total, frequency)

    def plain(seed, d):
        n, mean = Counter(d[:-1].tolist()), total / len(docs)
        idf = lambda t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
        return sum(idf(t) * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * (len(d) - 1) / mean)) for t in set(seed[:-1].tolist()) if t in n)

    index = rp.Shard([d[:-1] for d in docs], bm25)
    for i, d in enumerate(docs):
        assert index.scores(index.terms[i]) == pytest.approx([plain(d, x) for x in docs], rel=1e-4)
    windows = rp.Windows(50, bm25)
    free, seed, score = set(range(60)), None, None
    for parts in [*windows.shard(docs, list(range(60))), *([windows.open] if windows.open else [])]:
        for k, (doc, at, length, how) in enumerate(parts):
            if doc not in free:  # the rest of a cut document
                assert k == 0 and at > 0
            if k == 0 or how is None:
                seed = docs[doc]
            elif doc in free:
                best = max(plain(seed, docs[x]) for x in free)
                assert how == pytest.approx(best, rel=1e-4) and plain(seed, docs[doc]) == pytest.approx(best, rel=1e-4)
            free.discard(doc)
    assert not free
