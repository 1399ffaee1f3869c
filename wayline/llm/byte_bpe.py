"""Byte-level merge vocabularies: reading the file, plain merging, and cached encoding of stretches between spaces.

A stretch that starts after a single space, contains no white space at either end and is followed by a space or the end of the text is
split from its neighbours by the vocabulary's pattern wherever it stands, so its result can be kept and looked up again. Texts with other
white space beside a space take the pattern over the whole text instead. Kept results are bounded: beyond ``KEPT`` the table starts anew.
"""

import json

import regex

# The pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The letter by which such files write each byte: itself where printable, else the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        raw = lambda s: bytes(of[c] for c in s)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def merge(self, word: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; for short inputs."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, text: str):
        """(stretch, is special) in order."""
        if self.special is None or not any(s in text for s in self.specials):
            yield text, False
            return
        for i, x in enumerate(self.special.split(text)):
            if x:
                yield x, bool(i & 1)


class Kept(dict):
    """Results by stretch; a stretch with white space at an end has none."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str):
        if len(self) >= KEPT:
            self.clear()
        out = self[part] = None if not part or part[0].isspace() or part[-1].isspace() else self.make(" " + part)
        return out
