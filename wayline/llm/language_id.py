"""Language spans of mixed text: script ranges, scores per word, and the best path with a price for each switch.

Each word (a run without white space) has a score per learned language: the logarithm of its probability under the language's character
trigrams, mixed with its frequency as a whole word where it was frequent enough to be kept. Ranges of code points give the script of its
letters first; only languages learned with that script stay candidates, and a word whose script none of them uses scores alike for all.
The best labelling of a text maximises the sum of word scores less a penalty for each change of language (Viterbi). All texts of an Arrow
batch step through their words side by side, longest first, so the cost follows the words and one very long text holds up nobody.

The model is fitted on a bounded, hashed sample of ``FIT_ROWS`` different labelled texts per language; its word lists are counted by Spark and have
``FIT_WORDS`` entries per language at most. Null texts and texts without a letter are ``und``; if nothing could be learned, all are.
"""

import math
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wayline.llm.words import tidy
from wayline.operators.stage import stage

FIT_ROWS, FIT_WORDS, SWITCH, KEPT = 2_000, 20_000, 6.0, 300_000
AT_ONCE = 200_000  # trigrams scored in one array

# First and last code point of script ranges.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
]


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> str:
    return next((s for s, lo, hi in SCRIPTS if lo <= ord(letter) <= hi), "other")


def script_of(letters: str) -> str:
    """The script of most letters; ``other`` outside the ranges."""
    if letters.isascii():
        return "latin"
    n: dict[str, int] = defaultdict(int)
    for c in letters:
        n[_script(c)] += 1
    return max(sorted(n), key=n.get)


def letters_of(word: str) -> str:
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFC", low)
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


class Model:
    """Scores of words; plain data, so it travels with the tasks."""

    def __init__(self, words: dict[str, dict[str, int]]):
        self.langs = sorted(words)
        self.scripts: dict[str, set[int]] = defaultdict(set)
        grams, pairs, self.known, self.total = [], [], [], []
        for k, lang in enumerate(self.langs):
            g, p = defaultdict(int), defaultdict(int)
            seen = defaultdict(int)
            for w, n in words[lang].items():
                seen[script_of(w)] += n
                s = f"^^{w}$"
                for i in range(len(s) - 2):
                    g[s[i:i + 3]] += n
                    p[s[i:i + 2]] += n
            grams.append(dict(g))
            pairs.append(dict(p))
            self.known.append(words[lang])
            self.total.append(sum(words[lang].values()))
            for script, n in seen.items():
                if n >= 0.01 * self.total[-1]:
                    self.scripts[script].add(k)
        self.scripts = dict(self.scripts)
        self.grams, self.pairs = grams, pairs

        kept = sorted(set().union(*words.values()))
        self.row = {w: i for i, w in enumerate(kept)}
        self.share = np.zeros((len(kept) + 1, len(self.langs)))  # the last row is that of unknown words
        for k, (known, total) in enumerate(zip(self.known, self.total)):
            for w, n in known.items():
                self.share[self.row[w], k] = n / total

    def gram(self, s: str) -> list[float]:
        """Logarithm of a trigram's probability in each language."""
        return [math.log((g.get(s, 0) + 0.1) / (p.get(s[:2], 0) + 5.0)) for g, p in zip(self.grams, self.pairs)]

    def spelled(self, letters: list[str], grams: "Grams") -> np.ndarray:
        """Sums of trigram logarithms, a bounded number of trigrams at a time; a longer word is one step of its own."""
        out, sizes, lo = np.zeros((len(letters), len(self.langs))), [len(w) + 1 for w in letters], 0
        while lo < len(letters):
            hi, n = lo + 1, sizes[lo]
            while hi < len(letters) and n + sizes[hi] <= AT_ONCE:
                n += sizes[hi]
                hi += 1
            ids = np.fromiter((grams[s[i:i + 3]] for s in (f"^^{w}$" for w in letters[lo:hi]) for i in range(len(s) - 2)), "int64", n)
            table = grams.table()
            if hi == lo + 1:
                out[lo] = np.bincount(ids, minlength=len(table)) @ table
            else:
                ends = np.cumsum(sizes[lo:hi])
                out[lo:hi] = np.add.reduceat(table[ids], np.concatenate([[0], ends[:-1]]), axis=0)
            lo = hi
        return out

    def scores(self, letters: list[str], grams: "Grams") -> np.ndarray:
        """Per word and language; the best is 0, and all are 0 where no language has the script."""
        use = np.zeros((len(letters), len(self.langs)), bool)
        for i, w in enumerate(letters):
            if w:
                use[i, list(self.scripts.get(script_of(w), ()))] = True
        whole = self.share[[self.row.get(w, -1) for w in letters]]
        out = np.log(0.5 * whole + 0.5 * np.exp(np.maximum(self.spelled(letters, grams), -600.0)))
        top = np.where(use, out, -np.inf).max(1, keepdims=True)
        return np.where(use.any(1, keepdims=True), np.where(use, np.maximum(out - np.where(np.isfinite(top), top, 0.0), -50.0), -50.0), 0.0)


class Grams(dict):
    """Row number of each trigram in a growing table of logarithms."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.made = model, [], np.zeros((0, len(model.langs)))

    def __missing__(self, s: str) -> int:
        self[s] = n = len(self)
        self.new.append(self.model.gram(s))
        return n

    def table(self) -> np.ndarray:
        if self.new:
            self.made, self.new = np.concatenate([self.made, np.array(self.new)]), []
        return self.made


def fit(labelled: DataFrame, rows: int = FIT_ROWS, words: int = FIT_WORDS) -> Model:
    """From rows with ``text`` and a non-null ``lang``: at most about ``rows`` different texts per language, by hash; copies count once."""
    labelled = labelled.filter("lang is not null and text is not null")
    keys = stage(labelled.select("lang", F.xxhash64("text").alias("key")).distinct())
    counts = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        # Few texts are all taken; a share that leaves some out has enough of them not to end up empty.
        chosen = chosen | ((F.col("lang") == lang) & (part < int(min(1.0, rows / n) * (1 << 30))))
    once = labelled.filter(chosen).select("lang", "text").distinct()
    found = once.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    found = stage(found)
    kept: dict[str, dict[str, int]] = {}
    for lang in sorted(counts):
        top = found.filter(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(words).collect()
        if top:
            kept[lang] = {r["word"]: r["n"] for r in top}
    return Model(kept)


class Scored(dict):
    """Row number of each word in a growing table of scores and letter counts."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self):
        self.clear()
        self.new, self.grams = [], Grams(self.model)
        self.score, self.size = np.zeros((0, max(1, len(self.model.langs))), "float32"), np.zeros(0, "int64")

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(letters_of(word))
        return n

    def tables(self):
        if self.new:
            found = self.model.scores(self.new, self.grams) if self.model.langs else np.zeros((len(self.new), 1))
            self.score = np.concatenate([self.score, found.astype("float32")])
            self.size = np.concatenate([self.size, np.array([len(x) for x in self.new], "int64")])
            self.new = []
        return self.score, self.size


def best_paths(rows: np.ndarray, lengths: np.ndarray, score: np.ndarray, switch: float) -> np.ndarray:
    """Labels of all words; ``rows`` holds the texts one after another, ``score`` the score rows they point to."""
    labels = np.zeros(len(rows), "int32")
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    long = lengths[order]
    most = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(most), "left")  # texts with more than t words
    stay = np.zeros((len(rows), score.shape[1]), bool)
    came = np.zeros(len(rows), "int32")
    now = np.zeros((len(order), score.shape[1]), "float32")
    for t in range(most):
        n = active[t]
        at = starts[:n] + t
        if t:
            v = now[:n]
            top = v.argmax(1)
            jump = v[np.arange(n), top] - switch
            keep = v >= jump[:, None]
            stay[at], came[at] = keep, top
            now[:n] = np.where(keep, v, jump[:, None])
        now[:n] += score[rows[at]]
    last = now.argmax(1).astype("int32")
    for t in range(most - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        lab = last[:n]
        labels[at] = lab
        if t:
            last[:n] = np.where(stay[at, lab], lab, came[at])
    return labels


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred``, ``score`` (its share of the letters) and ``spans`` (first word, words, language)."""
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_WORDS per language

    def run(batches):
        s = Scored(shared.value)
        for b in batches:
            out, texts = [], b["text"].tolist()
            for at in range(0, len(texts), 2048):
                if len(s) > KEPT:
                    s.reset()
                split = [t.split() if isinstance(t, str) else [] for t in texts[at:at + 2048]]
                lengths = np.array([len(x) for x in split], "int64")
                rows = np.fromiter((s[w] for x in split for w in x), "int64", int(lengths.sum()))
                score, size = s.tables()
                labels = best_paths(rows, lengths, score, switch)
                end = 0
                for n in lengths.tolist():
                    lo, end = end, end + n
                    mine, weight = labels[lo:end], size[rows[lo:end]]
                    by = np.bincount(mine, weight, max(1, len(langs)))
                    letters = by.sum()
                    cut = np.flatnonzero(np.diff(mine)) + 1
                    first = [0, *cut.tolist()] if n and langs else []
                    spans = [(a, z - a, langs[mine[a]]) for a, z in zip(first, [*first[1:], n])]
                    if letters and langs:
                        out.append((langs[int(by.argmax())], float(by.max() / letters), spans))
                    else:
                        out.append(("und", 0.0, []))
            yield b[["doc_id"]].assign(lang_pred=[x[0] for x in out], score=[x[1] for x in out], spans=[[{"first": a, "words": n, "lang": x} for a, n, x in y[2]] for y in out])

    # An id as text stays exact beside a null id.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tidy(run), "doc_id string, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
