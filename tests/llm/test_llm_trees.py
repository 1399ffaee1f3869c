"""Prefix tries and hash trees against plain recomputation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayline.llm import merkle, prefix_trie, ranks

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
TURNS = "conv_id bigint, turn bigint, role string, text string, c string, depth string, at string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in sorted(full.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(kids[k]), leaves[k], saved[k], SHA(",".join(str(c) for c in m if len(full[c]) == len(k))))
                  for k, m in members.items())


def conversations(n=60, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 4, 9, 14])):
            rows.append((c, r.choice([t, t, None]) if t == 0 else t, r.choice(["user", "bot", None]), r.choice(["a", "é", "", None, "long " * 30]), "x", "y", "z"))
    same = [(c, t, "user", "s%d" % t, "x", None, "z") for c in range(200, 260) for t in range(5)]
    many = [(500, t, "user", "m", None, "y", "z") for t in range(700)] + [(505, t, "user", "m", None, "y", "z") for t in range(650)]
    return rows + same + many + [(None, 1, "user", "a", "x", "y", "z")]


@pytest.mark.parametrize("branch,held", [(4096, 500_000), (3, 2)])
def test_trie_equals_plain_recomputation(spark, branch, held):
    rows = conversations()
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS), branch, held).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []


def test_queue_gives_messages_in_order_from_memory_and_disk():
    r = random.Random(1)
    sent = [((r.randint(0, 50), r.randint(0, 3), 0), i, 1) for i in range(2000)]
    q = prefix_trie.SpillingQueue(held=37)
    for m in sent:
        q.push(m)
    assert len(q.fronts) > 10
    for place in sorted({m[0] for m in sent}):
        if place[0] % 7:  # places that nobody asks for are passed over
            assert sorted(q.take(place)) == sorted(m for m in sent if m[0] == place)
    assert not list(q.take((99, 0, 0)))


def test_scan_counts_and_folds_across_tasks(spark):
    r = random.Random(2)
    rows = [(0 if r.random() < 0.7 else r.randint(1, 5), i, r.getrandbits(40)) for i in range(3000)]
    got = ranks.scan(spark.createDataFrame(rows, "g int, o int, x bigint").repartition(7), ["g"], ["o"], ("x",)).collect()
    want, seen = {}, defaultdict(lambda: (0, 0))
    for g, o, x in sorted(rows):
        n, y = seen[g]
        want[g, o], seen[g] = (n, x ^ y), (n + 1, x ^ y)
    assert {(q["g"], q["o"]): (q["at"], q["x"]) for q in got} == want


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, at string, digest string"


def documents(n=90):
    r = random.Random(4)
    out = [(i, r.choice(["", None, "text %d" % i, "é:1"]), r.choice(["en"] * 9 + ["de", None, ""]), r.choice(["s", None]), r.choice([None, i]), "g", "a", None) for i in range(n)]
    return out + [(7, "twice", "en", "s", 3, "g", "a", None)] * 3 + [(None, "no id", "en", "s", 3, "g", "a", None), ((1 << 53) + 1, "big", "en", "s", 3, "g", "a", None)]


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_leaf(r, more=0):
    return SHA("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([SHA("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def climb(node, at, levels):
    proof = ""
    for nodes in levels[:-1]:
        sib = nodes[at ^ 1:][:1]
        proof += "".join(sib)
        node = SHA("".join([*sib, node] if at & 1 else [node, *sib]))
        at //= 2
    return node, proof


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_levels([plain_leaf(r) for r in sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))]) for g in langs}
    top = plain_levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))):
            own = plain_leaf(r)
            bad = plain_leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            _, low = climb(own, at, trees[g])
            _, high = climb(own, k, top)
            folded = climb(climb(bad, at, trees[g])[0], k, top)[0]
            out.append((-1 if r[0] is None else r[0], own, trees[g][-1][0], top[-1][0], SHA(low + high), folded, folded == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 5, 90])
@pytest.mark.parametrize("block", [4096, 4, 2])
def test_manifest_equals_plain_recomputation(spark, block, n):
    rows = documents(90) if n == 90 else [(i, "t", None, "s", i, "g", "a", None) for i in range(n)]
    got = merkle.tampered_check(spark.createDataFrame(rows, DOCS), block).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.tampered_check(spark.createDataFrame([], DOCS)).collect() == []


def test_frontier_extends_witnesses_as_siblings_complete():
    leaves = [bytes([i]) * 32 for i in range(11)]
    f = merkle.Frontier()
    for k, leaf in enumerate(leaves):
        f.append(leaf)
        assert len(f.open) == bin(k + 1).count("1")
    root = f.close(4)
    assert all(merkle.folded(leaf, i, 11, bytes(p)) == root for i, (leaf, p) in enumerate(zip(leaves, f.paths)))


def test_manifest_keeps_its_claims_apart(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    rows = merkle.verify(merkle.manifest(docs, claimed=F.when(F.col("doc_id") == 7, merkle.leaf(docs, {"text": F.lit("other")})))).collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == {7}
