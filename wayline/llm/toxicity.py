"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are as similar as the subsequences of three characters they share; a subsequence spread over gaps counts less, by ``DECAY`` for
each skipped character, and may span ``SPAN`` characters, so letters put between those of an insult only weaken the match. Landmark words
map a word into a small feature space (Nyström), where a linear support vector machine with squared hinge loss separates words that make
a sentence toxic from the words of clean ones. Labels belong to documents, so training alternates: the sentence and the word of each toxic
document that look worst stand for it, the machine is trained against the clean words that look most toxic, and the choice is made again.

Landmark weights fold into one table over the hashed alphabet's triples, so a word is scored by looking its subsequences up. A document
scores as its worst word; letters set apart by any white space are joined first, and a word with other signs between its letters is
also scored without them, however many they are. Every text is read whole, rows never leave their partition, and the
model is plain data of fixed size. It is fitted on a bounded, hashed sample of labelled documents (``FIT_TOXIC``, ``FIT_CLEAN``, texts up
to ``FIT_CHARS`` characters). Null and empty texts score 0; without labels of both kinds, or with an empty table, all texts do.
"""

import re
import sys

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wayline.llm.words import tidy

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 2_000, 4_000, 20_000
LANDMARKS, DECAY, SPAN, SIGNS, ROUNDS, KEPT = 128, 0.6, 6, 64, 3, 300_000
DECIDED = 0.7
_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")
_SIGNS = re.compile(r"[\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    return sys.intern(_EDGES.sub("", word.lower()))


def letters(word: str) -> str:
    """The letters of a normalised word."""
    return word if word.isalpha() else sys.intern(_SIGNS.sub("", word))


def codes(words: list[str]) -> np.ndarray:
    """Signs of words of one length, with a mark before and after; letters a to z keep their own sign, all others share the rest."""
    points = np.array([[ord(c) for c in w] for w in words], "int64").reshape(len(words), -1)
    own = (points >= 97) & (points <= 122)
    sign = np.where(own, points - 96, 28 + points * 7 % (SIGNS - 28))
    return np.pad(sign, ((0, 0), (1, 1)), constant_values=27)


def triples(words: list[str]):
    """Triple numbers and weights of the words, which have one length."""
    c = codes(words)
    n = c.shape[1]
    parts, weights = [np.zeros((len(words), 0), "int64")], [np.zeros(0)]
    for a, b in _PATTERNS:
        if n > b:
            parts.append((c[:, :n - b] * SIGNS + c[:, a:n - b + a]) * SIGNS + c[:, b:])
            weights.append(np.full(n - b, DECAY ** (b - 2)))
    return np.concatenate(parts, 1), np.concatenate(weights)


def norms(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself."""
    order = np.argsort(t, axis=1, kind="stable")
    t, w = np.take_along_axis(t, order, 1), w[order]
    total = (w * w).sum(1)
    for lag in range(1, t.shape[1]):
        same = t[:, lag:] == t[:, :-lag]
        if not same.any():
            break
        total += 2 * (w[:, lag:] * w[:, :-lag] * same).sum(1)
    return np.sqrt(np.maximum(total, 1e-12))


def by_length(words: list[str], block: int = 4096):
    """(positions, words) of equal length; a block holds about ``block`` times a few dozen characters."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, at in groups.items():
        step = max(1, block * 32 // max(32, n))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            yield part, [words[i] for i in part]


def features(words: list[str]) -> list[dict[int, float]]:
    """Explicit normalised subsequence weights; for the few words of the fit."""
    out: list[dict[int, float]] = [{}] * len(words)
    for at, part in by_length(words):
        t, w = triples(part)
        size = norms(t, w)
        for i, row, n in zip(at, t.tolist(), size):
            d: dict[int, float] = {}
            for x, y in zip(row, w.tolist()):
                d[x] = d.get(x, 0.0) + y / n
            out[i] = d
    return out


class Table:
    """Scores words by looking up their subsequences; ``weights`` has a value per triple, ``slope`` and ``base`` calibrate."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.slope, self.base = weights.astype("float32"), bias, 1.0, 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -2.0)
        for at, part in by_length(words):
            if part[0]:
                t, w = triples(part)
                out[at] = (self.weights[t] * w).sum(1) / norms(t, w) + self.bias
        return out

    def probability(self, margin):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.base, -40, 40)))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    place: dict[int, int] = {}
    marks = features(landmarks)
    for d in marks:
        for x in d:
            place.setdefault(x, len(place))
    dense = np.zeros((len(place) + 1, len(marks)))
    for j, d in enumerate(marks):
        for x, y in d.items():
            dense[place[x], j] = y
    index = np.full(SIGNS ** 3, len(place))
    index[list(place)] = list(place.values())
    out = np.zeros((len(words), len(marks)))
    for at, part in by_length(words, 96):
        t, w = triples(part)
        rows = dense[index[t]] * w[None, :, None]
        out[at] = rows.sum(1) / norms(t, w)[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights and bias (last) of the squared hinge by Newton steps over the support vectors."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        xs, cs = x[on], cost[on][:, None]
        new = np.linalg.solve(reg + xs.T @ (xs * cs), xs.T @ (cs[:, 0] * y[on]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray, nothing: float, spread: np.ndarray) -> tuple[float, float]:
    """Slope and base of the probability: ``DECIDED`` at the margin with the fewest errors, a wrong accusation counting twice; of
    several such margins one that finds most words with signs between letters, then the middle of the widest gap. ``nothing`` is the margin of a word that shares no subsequence with a landmark:
    it speaks for no toxicity, so the decision lies above it."""
    values = np.unique(np.concatenate([margin, spread, [nothing]]))
    values = values[values >= nothing]
    cuts = np.concatenate([(values[1:] + values[:-1]) / 2, [values[-1] + 0.1]])
    wide = np.concatenate([np.diff(values), [0.0]])
    good, bad = np.sort(margin[y == 1]), np.sort(margin[y == 0])
    errors = np.searchsorted(good, cuts) + 2 * (len(bad) - np.searchsorted(bad, cuts))
    best = max(np.flatnonzero(errors == errors.min()), key=lambda i: ((spread > cuts[i]).sum(), wide[i]))
    slope = 6.0 / max(0.1, np.median(good) - np.median(bad))
    return float(slope), float(np.log(DECIDED / (1 - DECIDED)) - slope * cuts[best])


def train(toxic: list[list[list[str]]], clean: list[list[list[str]]], seed: int = 7) -> Table | None:
    """From documents as lists of sentences as lists of normalised words."""
    rng = np.random.default_rng(seed)
    bags = [b for b in ([[w for w in s if w] for s in d] for d in toxic) if any(b)]
    clean_docs = [{w for s in d for w in s if w} for d in clean]
    seen: dict[str, int] = {}
    for d in clean_docs:
        for w in d:
            seen[w] = seen.get(w, 0) + 1
    if not bags or not seen:
        return None
    held: dict[str, int] = {}
    for d in bags:
        for w in {w for s in d for w in s}:
            held[w] = held.get(w, 0) + 1
    start: dict[str, int] = {}
    for d in bags:
        start_of = {w[:4] for s in d for w in s}
        for x in start_of:
            start[x] = start.get(x, 0) + 1
    clean_start: dict[str, int] = {}
    for d in clean_docs:
        for x in {w[:4] for w in d}:
            clean_start[x] = clean_start.get(x, 0) + 1
    rate = len(bags) / max(1, len(clean_docs))
    odds = lambda w: (np.log((held[w] + 0.5) / (rate * seen.get(w, 0) + 0.5)) + np.log((start[w[:4]] + 0.5) / (rate * clean_start.get(w[:4], 0) + 0.5)))
    worst = [max((max(s, key=odds) for s in d if s), key=odds) for d in bags]
    vocabulary = sorted(seen)
    hard: list[str] = []
    table = None
    for _ in range(ROUNDS):
        counts: dict[str, int] = {}
        for w in worst:
            counts[w] = counts.get(w, 0) + 1
        good = sorted(counts, key=lambda w: (-counts[w], w))
        # Training words with a sign put between letters: what a filter has to expect.
        spread = []
        for w in good[:1000]:
            if len(w) > 3:
                sign = "*.-_"[len(w) % 4]
                k = int(rng.integers(1, len(w)))
                spread += [sign.join(w), w[:k] + sign + w[k:], (sign * 2).join(w), (sign * 3).join(w)]
        bad = hard + [vocabulary[i] for i in rng.permutation(len(vocabulary))[:20_000]]
        bad = [w for w in dict.fromkeys(bad) if w not in counts]
        near = bad[:LANDMARKS // 3] + bad[len(hard):len(hard) + LANDMARKS // 6]
        landmarks = list(dict.fromkeys(good[:LANDMARKS - len(near)] + near))
        words = good + spread + bad
        y = np.array([1.0] * (len(good) + len(spread)) + [-1.0] * len(bad))
        cost = np.array([np.sqrt(counts[w]) * 4 for w in good] + [8.0] * len(spread) + [np.sqrt(1 + seen.get(w, 0)) for w in bad])
        gram = _kernel(landmarks, landmarks)
        value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(landmarks)))
        root = vector / np.sqrt(np.maximum(value, 1e-6))
        # A word that shares nothing with any landmark is one more clean example: it settles the bias.
        x = np.vstack([_kernel(words, landmarks) @ root, np.zeros(len(landmarks))])
        w = _svm(x, np.append(y, -1.0), np.append(cost, 100.0))
        alpha = root @ w[:-1]
        weights = np.zeros(SIGNS ** 3)
        for a, d in zip(alpha, features(landmarks)):
            for x, v in d.items():
                weights[x] += a * v
        table = Table(weights, float(w[-1]))
        margin = dict(zip(vocabulary, table.margins(vocabulary).tolist()))
        hard = sorted((w for w in vocabulary if margin[w] > -0.8), key=lambda w: (-margin[w], w))[:4000]
        mine = sorted(held)
        of = dict(zip(mine, table.margins(mine).tolist()))
        look = lambda w: of[w] + 0.1 * odds(w)
        worst = [max((max(s, key=look) for s in d if s), key=look) for d in bags]
    tops = np.array([max(of[w] for s in d for w in s) for d in bags] + [max((margin[w] for w in d), default=-2.0) for d in clean_docs])
    table.slope, table.base = _calibrate(tops, np.array([1.0] * len(bags) + [0.0] * len(clean_docs)), table.bias, table.margins(spread))
    return table


def sentences(text: str) -> list[list[str]]:
    return [[normal(w) for w in words_of(s)] for s in re.split(r"[.!?\n]+", text)]


def words_of(text: str) -> list[str]:
    words = text.split()
    if _SPACED.search(text):
        words += ["".join(m.group().split()) for m in _SPACED.finditer(text)]
    return words


def fit(docs: DataFrame, labels: DataFrame) -> Table | None:
    """``labels`` (``doc_id``, ``toxic``) must hold the rows that may be learned from, no others."""
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = labels.filter(F.when(F.col("toxic") == 1, part < int(min(1.0, FIT_TOXIC / max(1, n.get(1, 0))) * (1 << 30)))
                           .otherwise(part < int(min(1.0, FIT_CLEAN / max(1, n.get(0, 0))) * (1 << 30))))
    # At most about FIT_TOXIC + FIT_CLEAN rows of two numbers: a bound of the parameters.
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= FIT_CHARS)
            .select("doc_id", "toxic", "text").distinct().collect())
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([sentences(r["text"]) for r in rows if r["toxic"] == 1], [[sorted({w for x in sentences(r["text"]) for w in x})] for r in rows if r["toxic"] == 0])


class Margins(dict):
    """Margins by word as written."""

    def learn(self, table: Table, words: set[str]):
        if len(self) > KEPT:
            self.clear()
        new = [w for w in words if w not in self]
        plain = [normal(w) for w in new]
        self.update(zip(new, table.margins(plain).tolist()))
        signed = [(w, bare) for w, x in zip(new, plain) if len(bare := letters(x)) > 3 and bare != x]
        for (w, _), margin in zip(signed, table.margins([bare for _, bare in signed]).tolist()):
            self[w] = max(self[w], margin)


def _scored(texts: list, known: Margins, table: Table):
    """(score, worst word) of each text."""
    for at in range(0, len(texts), 512):
        split = [words_of(x) if isinstance(x, str) else [] for x in texts[at:at + 512]]
        known.learn(table, set().union(*split))
        for words in split:
            top = max(words, key=known.__getitem__, default=None)
            yield (0.0, None) if top is None else (float(table.probability(known[top])), top)


def toxicity(docs: DataFrame, table: Table | None) -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1) and ``worst``, the word it comes from."""
    if table is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("worst"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # one value per triple of the alphabet

    def run(batches):
        known = Margins()
        for b in batches:
            got = list(_scored(b["text"].tolist(), known, shared.value))
            yield b[["doc_id"]].assign(score=[x for x, _ in got], worst=[w for _, w in got])

    # An id as text stays exact beside a null id.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tidy(run), "doc_id string, score double, worst string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def kept(docs: DataFrame, table: Table | None, limit: float = DECIDED) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``."""
    if table is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        known = Margins()
        for b in batches:
            got = _scored(b.column("text").to_pylist(), known, shared.value)
            yield b.filter(pa.array([x < limit for x, _ in got], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
