"""Token counts and packing against the tokenizers library and plain recomputation."""

import random
import zlib
from collections import Counter as Bag

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayline.llm import packing
from wayline.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, piece string, length int, n_tokens string"
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", " abcTHE'sdtm", "\n\t  ab1 9", "éñß漢字кир ab", "aaaa b", "!#$%'s're' a", "\x1c\x1d\x85　  ab."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=600):
    r = random.Random(5)
    out = ["", " ", "\n", "<|endoftext|>", " a<|endoftext|> b <|endoftext|>", "x" * 3000, "it's 're they'RE", "a  b", "a \n b", "word " * 50]
    return out + ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for a in (r.choice(ALPHABETS) for _ in range(n))]


def rows(spark, values):
    return spark.createDataFrame([(i, t, "p", 1, "n") for i, t in values], SCHEMA)


@pytest.mark.parametrize("chunk", [1 << 16, 23])
def test_counts_equal_the_library(library, chunk):
    c = Counter(PATH, chunk)
    for t in texts():
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_scan_gives_every_prefix(library):
    c = Counter(PATH)
    text = "the cat sat\non the mat, it's 12 o'clock  again and again " * 3
    cuts = [text[i:i + 10] for i in range(0, len(text), 10)]
    scanned = c.scan([c.map_of(x) for x in cuts])
    for i, m in enumerate(scanned):
        assert c.total([m]) == len(library.encode("".join(cuts[:i + 1]), add_special_tokens=False).ids)


def test_states_beyond_the_bound_are_used_without_being_stored(library, monkeypatch):
    monkeypatch.setattr("wayline.llm.token_counts.STATES", 3)
    monkeypatch.setattr("wayline.llm.byte_bpe.KEPT", 2)
    c = Counter(PATH)
    assert c.count("several words in a row") == len(library.encode("several words in a row").ids) and len(c.machine.states) == 3


def test_count_rows(spark, library):
    values = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x y " * 400)]
    got = sorted(map(tuple, token_counts(rows(spark, values), PATH, 512).collect()))
    want = [(i, len((t or "").encode()), n, n > 512) for i, t in values for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert got == sorted(want)
    assert token_counts(rows(spark, []), PATH, 512).collect() == []


def check_packed(got, values, library, size):
    want = Bag()
    for i, t in values:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r.length for r in got) // size)


def test_packing_rows(spark, library):
    r = random.Random(1)
    values = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "w " * 700)] + [(i, "ab cd " * r.randint(1, 30)) for i in range(5, 300)]
    got = packing.pack(packing.pieces(rows(spark, values), PATH, 2, 64), 64).collect()
    used, least = check_packed(got, values, library, 64)
    assert used <= least * 1.05 + 1
    assert packing.pack(packing.pieces(rows(spark, []), PATH, 2, 64), 64).collect() == []


def test_ids_stay_whole_beside_null_ones(spark, library):
    values = [(None, "no id"), ((1 << 53) + 1, "a big id"), ((1 << 53) + 3, "another"), (None, "x " * 200)]
    got = packing.pack(packing.pieces(rows(spark, values).coalesce(1), PATH, 2, 64), 64).collect()
    check_packed(got, values, library, 64)


def test_pieces_carry_their_ids(spark, library):
    got = packing.pieces(rows(spark, [(1, "a b c d e f g")]), PATH, 2, 3, with_ids=True).orderBy("piece").collect()
    assert [x for r in got for x in r.ids] == [*library.encode("a b c d e f g").ids, 2] and [len(r.ids) for r in got] == [2, 3, 3]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    size = r.choice([8, 50, 1024])
    counts = Bag(min(size, int(r.expovariate(4 / size)) + 1) for _ in range(r.randint(0, 3000)))
    used = Bag()
    templates = packing.plan(counts, size)
    for lengths, n in templates:
        assert sum(lengths) <= size and n > 0
        for x in lengths:
            used[x] += n
    assert used == counts


def test_plan_fills_exactly_with_one_two_and_three():
    assert sum(n for _, n in packing.plan({6: 2, 4: 2}, 10)) == 2
    assert sum(n for _, n in packing.plan({7: 1, 2: 1, 1: 1}, 10)) == 1
    assert sum(n for _, n in packing.plan({5: 1, 2: 2, 1: 1}, 10)) == 1
    assert sum(n for _, n in packing.plan({5: 3}, 10)) == 2
