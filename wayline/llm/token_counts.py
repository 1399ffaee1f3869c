"""Token counts by a finite-state transducer whose transitions carry the number of tokens they emit.

Merging is a left-to-right machine: the last token of every prefix is the one vocabulary entry ending there that merging keeps apart
from the last token before it, so what may still happen depends only on the longest suffix that begins some entry and on the last tokens
at the places inside it. That window is the state, read one byte at a time; a transition carries the change of the token count. States
are made when first met and numbered; beyond ``STATES`` new ones are used without being stored, so memory is bounded and the count stays
exact.

A text is cut into chunks of a fixed size. The map of a chunk is the count between its first and last place where the pattern always
splits, with the open ends before and after; two neighbouring maps compose by counting the stretch between them. Composition is
associative, so the maps of a text are combined as in a parallel prefix scan, in rounds that each
halve their number (``scan`` gives the prefixes themselves). Rows never leave their partition: nothing is
shuffled, and the work of a task follows the bytes it reads.
"""

import regex
from pyspark.sql import DataFrame, functions as F

from wayline.llm.byte_bpe import KEPT, Kept, Vocabulary
from wayline.llm.words import tidy

STATES = 60_000
CHUNK = 1 << 16
_SEAM = regex.compile(r"(?<=\S) (?=\S)")


class Transducer:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.tokens = vocab, vocab.ids
        self.begins = {t[:i] for t in vocab.ids for i in range(len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self._number((b"", ((b"", 0),)))

    def _number(self, state) -> int:
        n = self.numbers.get(state)
        if n is None and len(self.states) < STATES:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return n

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Merging leaves these two as they are when they stand side by side."""
        got = self.apart.get((left, right))
        if got is None:
            if len(self.apart) > 4 * STATES:
                self.apart.clear()
            got = self.apart[left, right] = self.vocab.merge(left + right) == ([left, right] if left else [right])
        return got

    def step(self, state, byte: int):
        """``state``: the suffix, and for the places 0, 1, … bytes back the last token and the count relative to now."""
        suffix, back = state
        text = suffix + bytes((byte,))
        for size in range(len(text), 0, -1):
            token = text[-size:]
            if token in self.tokens and self._stays(back[size - 1][0], token):
                break
        else:
            raise ValueError("a byte of the text is not in the vocabulary")
        more = back[size - 1][1] + 1
        keep = next(text[i:] for i in range(len(text) + 1) if text[i:] in self.begins)
        return (keep, ((token, 0), *((t, n - more) for t, n in back[:len(keep)]))), more

    def count(self, word: str) -> int:
        total, at, state = 0, self.start, None
        for byte in word.encode():
            if at is not None:
                move = self.moves[at].get(byte)
                if move is None:
                    state, more = self.step(self.states[at], byte)
                    number = self._number(state)
                    if number is not None:
                        self.moves[at][byte] = number, more
                    at = number
                else:
                    at, more = move
            else:
                state, more = self.step(state, byte)
                at = self.numbers.get(state)
            total += more
        return total


class Counter:
    """Counts of whole texts by one vocabulary file."""

    def __init__(self, path: str, chunk: int = CHUNK):
        self.vocab, self.chunk = Vocabulary(path), chunk
        self.machine = Transducer(self.vocab)
        self.kept = Kept(self._pattern)
        self.words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= KEPT:
                self.words.clear()
            n = self.words[word] = self.machine.count(word)
        return n

    def _pattern(self, text: str) -> int:
        return sum(map(self._word, self.vocab.pattern.findall(text)))

    def stretch(self, text: str) -> int:
        """Tokens of a text that starts and ends where the pattern splits."""
        lead, *rest = text.split(" ")
        try:
            if not rest or lead[-1:].isspace():
                return self._pattern(text)
            return (self._pattern(lead) if lead else 0) + sum(map(self.kept.__getitem__, rest))
        except TypeError:
            return self._pattern(text)

    def map_of(self, text: str):
        """(open start, count, open end) of a chunk; a chunk without a sure split is open throughout."""
        first = _SEAM.search(text)
        if first is None:
            return text, None, ""
        last = next(i for i in range(len(text) - 1, -1, -1) if text[i] == " " and _SEAM.match(text, i))
        return text[:first.start()], self.stretch(text[first.start():last]) if last > first.start() else 0, text[last:]

    def compose(self, a, b):
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.stretch(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list):
        """Maps of all chunks up to each chunk, by a prefix scan of doubling strides."""
        stride = 1
        while stride < len(maps):
            maps = [m if i < stride else self.compose(maps[i - stride], m) for i, m in enumerate(maps)]
            stride *= 2
        return maps

    def total(self, chunks: list):
        """Tokens of a whole text: pairs of neighbours are composed until one map is left."""
        while len(chunks) > 1:
            chunks = [self.compose(*chunks[i:i + 2]) if i + 1 < len(chunks) else chunks[i] for i in range(0, len(chunks), 2)]
        start, inner, end = chunks[0]
        return self.stretch(start) if inner is None else (self.stretch(start) if start else 0) + inner + self.stretch(end)

    def count(self, text: str) -> int:
        n = 0
        for part, special in self.vocab.parts(text):
            if special:
                n += 1
            elif len(part) <= self.chunk:
                n += self.stretch(part)
            else:
                n += self.total([self.map_of(part[i:i + self.chunk]) for i in range(0, len(part), self.chunk)])
        return n


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``; a null text counts as empty."""

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = b["text"].fillna("")
            n = [c.count(t) for t in texts]
            yield b[["doc_id"]].assign(n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    # An id as text stays exact beside a null id.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tidy(run), "doc_id string, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
