"""Packing by lexical retrieval: a window is filled with a seed document and what an inverted index finds nearest to it.

Terms are the token ids of a document, so the table of document frequencies has at most the vocabulary's size; frequencies, the number of
documents and their mean length are counted over all documents. A document's topic is its two rarest terms, and documents are sorted by topic
over all tasks (a topic of any size is spread by a hash), so neighbours lie close together. A task takes its
documents in shards of about ``SHARD`` tokens and builds the inverted index of a shard: per term, the documents that hold it and their
weights.

The first unused document is the seed. Its terms are looked up, weights are added per document, and the unused neighbours follow in the
order of their BM25 scores until the window is full. The last one is cut where the window ends; what is left of it is the seed of the next window. Where no
unused neighbour shares a term, the next unused document of the shard seeds the rest of the window. A window still open at the end of a
shard goes on in the next. What is open at the end of a task is cut into sequences whose lengths are powers of two, which need no
padding; so every token lies in a full sequence.

A null text counts as empty: one piece with the end token. Rows that repeat an id are documents of their own; null ids stay null.
"""

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayline.llm.byte_bpe import byte_letters
from wayline.llm.words import KEPT, span_hashes, tidy
from wayline.operators.stage import stage

K1, B = 1.2, 0.75
#: Characters cut by bytes at once.
STRETCH = 1 << 20
#: Tokens of a shard, whose index a task holds at once.
SHARD = 1 << 17


# How this family of vocabularies cuts lower-case text, for characters that composition and folding leave alone.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u012f\u0131-\u0148\u014a-\u017e]*")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|[0-9]|[^\t-\r a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+")


#: The same cut by bytes, for texts without apostrophes and signs beyond ASCII: white space, letters, single digits, runs of other signs.
_CLASS = np.full(256, 3, "uint8")
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_SIGNS = re.compile("['×÷]")


class Words(dict):
    """Token ids of whole texts, little-endian in two or four bytes, from the results of their parts, which are kept.

    For vocabularies that fold case and drop white space: no token, rule or special string spans a space, so a stretch between spaces gives the same
    ids wherever it stands. Texts of plain letters are cut as the vocabulary's pattern does, and what is new among their parts goes to the library's
    merges in one call; any other stretch goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        letter = {b: c for c, b in byte_letters().items()}
        self.letters = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x180)}
        self.odd: dict[str, bytes] = {}
        self.by_hash: dict[int, bytes] = {}

    def _merged(self, parts: list[str]) -> list[bytes]:
        text = " ".join(parts)
        if not (text.isascii() and text.isprintable()):
            text = " ".join(x.translate(self.letters) for x in parts)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):
            raise ValueError("the vocabulary does not mark the ends of words")
        data, cuts = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *cuts], cuts)]

    def _learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 2000):
            some = parts[at:at + 2000]
            self.update(zip(some, self._merged(some)))

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not ("<" in text and any(s in text for s in self.specials))

    def _stretch(self, x: str) -> bytes:
        if x not in self.odd:
            if len(self.odd) > KEPT:
                self.odd.clear()
            self.odd[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.kind).tobytes()
        return self.odd[x]

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Texts that bytes can be cut for: different parts are looked up once for all of them."""
        data = [t.lower().encode() for t in texts]
        joined = b" ".join(data)
        a = np.frombuffer(joined, "uint8")
        c = np.zeros(len(a) + 2, "uint8")
        np.take(_CLASS, a, out=c[1:-1])
        edge = (c[1:] != c[:-1]) | (c[1:] == 2) & (c[:-1] == 2)
        start, end = np.flatnonzero(edge[:-1] & (c[1:-1] != 0)), np.flatnonzero(edge[1:] & (c[1:-1] != 0)) + 1
        if not len(start):
            return [b""] * len(texts)
        which, known = pd.factorize(span_hashes(a, start, end))
        at = np.zeros(len(known), "int64")
        at[which] = np.arange(len(which))
        known = known.tolist()
        if len(self.by_hash) > KEPT:
            self.by_hash.clear()
        new = [(h, k) for h, k in zip(known, at.tolist()) if h not in self.by_hash]
        for lo in range(0, len(new), 2000):
            some = new[lo:lo + 2000]
            self.by_hash.update(zip([h for h, _ in some], self._merged([joined[start[k]:end[k]].decode() for _, k in some])))
        found = [self.by_hash[h] for h in known]
        size = np.array([len(x) for x in found], "int32") // self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        n = size[which]
        done = np.zeros(len(n) + 1, "int32")
        np.cumsum(n, out=done[1:])
        ids = flat[np.repeat((np.cumsum(size, dtype="int32") - size)[which] - done[:-1], n) + np.arange(done[-1], dtype="int32")]
        cuts = done[np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in data)]))].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. At most ``STRETCH`` characters are cut by bytes at once, so a long text costs no more memory than many short ones."""
        simple = [len(t) <= STRETCH and self._plain(t) and not _SIGNS.search(t) for t in texts]
        out: dict[int, bytes] = {}
        held, size = [], 0
        for k in [k for k, s in enumerate(simple) if s]:
            held.append(k)
            size += len(texts[k])
            if size >= STRETCH:
                out.update(zip(held, self._simple([texts[i] for i in held])))
                held, size = [], 0
        if held:
            out.update(zip(held, self._simple([texts[i] for i in held])))
        rest = [k for k, s in enumerate(simple) if not s]
        out.update(zip(rest, self._cut([texts[k] for k in rest])))
        return [out[k] for k in range(len(texts))]

    def _cut(self, texts: list[str]) -> list[bytes]:
        cut = []  # parts of a text, or of its plain stretches, between the others
        for t in texts:
            if self._plain(t):
                cut.append([_CUT.findall(t.lower())])
            else:
                cut.append([_CUT.findall(x.lower()) if self._plain(x) else x for x in t.split(" ")])
        if len(self) > KEPT:
            self.clear()
        self._learn(list(set().union(*(x for c in cut for x in c if type(x) is list)) - self.keys()))
        get = self.__getitem__
        return [b"".join([b"".join(map(get, x)) if type(x) is list else self._stretch(x) for x in c]) for c in cut]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        _words[path] = Words(path)
    return _words[path]


def topic(ids: np.ndarray) -> tuple[int, int]:
    """The two rarest terms of a document, of those it uses more than once if there are any; -1 where there is none. Entries of a vocabulary come in
    the order of their frequency, so a later one is rarer."""
    x = np.sort(ids)
    twice = x[1:][x[1:] == x[:-1]]
    x = twice if len(twice) else x
    if not len(x):
        return -1, -1
    less = x[:np.searchsorted(x, x[-1])]
    return int(x[-1]), int(less[-1]) if len(less) else -1


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id``, ``row`` (unlike in all rows), ``doc_tokens``, ``ids``, which end with ``end_id``, and the document's topic; staged."""

    def run(batches):
        import pyarrow as pa

        w = words(path)
        end = np.array([end_id], w.kind).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = w.encode([t or "" for t in part.column("text").to_pylist()])
                topics = np.array([topic(np.frombuffer(x, w.kind)) for x in ids], "int32").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "row": part.column("row"), "ids": pa.array([x + end for x in ids], pa.binary()),
                                                  "doc_tokens": pa.array([len(x) // w.kind.itemsize + 1 for x in ids], pa.int64()), "topic": pa.array(topics[:, 0]), "second": pa.array(topics[:, 1])})

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(tidy(run), f"doc_id {kind}, row bigint, ids binary, doc_tokens bigint, topic int, second int"))


class Bm25:
    """Weights of the terms of documents from counts over the whole corpus."""

    def __init__(self, docs: int, tokens: int, frequency: np.ndarray):
        self.mean = max(1.0, tokens / max(1, docs))
        self.idf = np.log1p((docs - frequency + 0.5) / (frequency + 0.5)).astype("float32")

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different terms of a document, in order, and their weights."""
        terms, times = np.unique(ids, return_counts=True)
        tf = times.astype("float32")
        return terms, self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))


def counted(rows: DataFrame, kind: str, vocabulary: int) -> Bm25:
    """Document frequencies over all rows; the driver gets one row per term of the vocabulary at most."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(vocabulary, "int64")
        for b in batches:
            for ids in b.column("ids").to_pylist():
                n[np.frombuffer(ids, kind)[:-1]] += 1  # once for a term, however often it stands there
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(there, pa.int32()), "n": pa.array(n[there], pa.int64())})

    frequency = np.zeros(vocabulary, "float32")
    for r in rows.select("ids").mapInArrow(tidy(run), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r["term"]] = r["n"]
    total = rows.agg(F.count("*").alias("n"), F.sum("doc_tokens").alias("t")).first()
    return Bm25(total["n"], (total["t"] or 0) - total["n"], frequency)


class Shard:
    """The inverted index of some documents: postings per term, a document's score for a seed as the sum of its weights of the seed's terms."""

    def __init__(self, docs: list[np.ndarray], bm25: Bm25):
        found = [bm25.weights(ids) for ids in docs]
        self.terms = [t for t, _ in found]
        sizes = [len(t) for t in self.terms]
        term = np.concatenate([*self.terms, np.zeros(0, "int64")]).astype("int64")
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(len(docs), dtype="int32"), sizes)[order]
        self.weight = np.concatenate([*(w for _, w in found), np.zeros(0, "float32")])[order]
        self.known, start = np.unique(term[order], return_index=True)
        self.edge = np.append(start, len(term))
        self.n = len(docs)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.known, terms)
        there = k < len(self.known)
        there[there] = self.known[k[there]] == terms[there]
        k = k[there]
        size = self.edge[k + 1] - self.edge[k]
        at = np.repeat(self.edge[k] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(k) else np.zeros(0, "int64")
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Windows:
    """Fills windows with parts of documents; gives back full ones."""

    def __init__(self, size: int, bm25: Bm25):
        self.size, self.bm25 = size, bm25
        self.open: list[tuple] = []  # (row number, start, length, score)
        self.used = 0
        self.seed: np.ndarray | None = None  # terms that the open window was seeded with

    def _put(self, doc, tokens: int, score, terms: np.ndarray):
        """The whole document, over as many windows as it takes. What the last window holds of it is the seed if it stands first there."""
        at = 0
        while at < tokens:
            if not self.used:
                self.seed = terms
            take = min(tokens - at, self.size - self.used)
            self.open.append((doc, at, take, score))
            self.used, at = self.used + take, at + take
            if self.used == self.size:
                yield self.open
                self.open, self.used, self.seed = [], 0, None

    def shard(self, docs: list[np.ndarray], names: list):
        """Full windows of a shard's documents (ids with the end token)."""
        index = Shard([d[:-1] for d in docs], self.bm25)
        free = np.ones(len(docs), bool)
        first = 0
        while True:
            while first < len(docs) and not free[first]:
                first += 1
            if first == len(docs):
                return
            nearest: list[int] = []
            if self.seed is not None and len(self.seed):
                score = index.scores(self.seed)
                score[~free] = 0
                nearest = np.argsort(-score, kind="stable")[:np.count_nonzero(score)].tolist()
            if not nearest:
                free[first] = False
                yield from self._put(names[first], len(docs[first]), None, index.terms[first])
                if self.used:
                    self.seed = index.terms[first]
                continue
            for i in nearest:
                free[i] = False
                full = list(self._put(names[i], len(docs[i]), float(score[i]), index.terms[i]))
                yield from full
                if full:
                    break  # the rest of the document, or a fresh one, is the next seed
            else:
                self.seed = None

    def rest(self):
        """The open window in sequences of lengths that are powers of two."""
        parts, self.open = self.open[::-1], []
        for bit in reversed(range(self.used.bit_length())):
            room, out = self.used & 1 << bit, []
            while room:
                doc, at, length, score = parts.pop()
                take = min(length, room)
                out.append((doc, at, take, score))
                room -= take
                if take < length:
                    parts.append((doc, at + take, length - take, score))
            if out:
                yield out


def pack(rows: DataFrame, kind: str, bm25: Bm25, size: int, shard: int = SHARD) -> DataFrame:
    """Pieces of the documents of ``tokenized``: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and the
    BM25 ``score`` by which the document was found (null for seeds)."""
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        windows = Windows(size, bm25)
        held: dict[int, tuple] = {}  # documents that the open window or the shard needs
        read, tokens = 0, 0
        todo: list[int] = []

        def pieces(full):
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for parts in full:
                offset = 0
                for doc, at, length, score in parts:
                    doc_id, ids = held[doc]
                    for c, x in zip(cols, (doc_id, at, length, zlib.crc32(ids[at:at + length].astype("<u4").tobytes()), len(ids), number, offset, score)):
                        c.append(x)
                    offset += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [doc_type, *[pa.int64()] * 6, pa.float64()])],
                                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "score"])

        def flush():
            nonlocal tokens
            out = pieces(windows.shard([held[k][1] for k in todo], list(todo)))
            still = {p[0] for p in windows.open}
            for k in [k for k in held if k not in still]:
                del held[k]
            todo.clear()
            tokens = 0
            return out

        doc_type = None
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                held[read] = doc_id, np.frombuffer(ids, kind)
                todo.append(read)
                tokens += len(held[read][1])
                read += 1
                if tokens >= shard:
                    yield flush()
        if todo:
            yield flush()
        if windows.open:
            yield pieces(windows.rest())

    order = ["topic", "second", "tie", "row"]
    dealt = rows.withColumn("tie", F.xxhash64("row")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    return dealt.mapInArrow(tidy(run), f"doc_id {id_kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, score double")


def retrieval_pack(docs: DataFrame, path: str, end_id: int, size: int, shard: int = SHARD) -> DataFrame:
    w = words(path)
    rows = tokenized(docs, path, end_id)
    vocabulary = max(w.tokenizer.get_vocab_size(), end_id + 1)
    return pack(rows, w.kind.str, counted(rows, w.kind.str, vocabulary), size, shard)
