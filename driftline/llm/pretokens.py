"""Parts into which byte-level tokenizers cut a text before they merge, and a bounded memory for them.

``Parts`` cuts as the tokenizer libraries do. Their tables of letters and numbers are older than
those of the ``regex`` package: code points that came later are neither letter nor number there.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

# White space as the pre-tokenizing pattern understands it, and this pattern.
SPACES = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Letters and numbers of the ``regex`` package that the tokenizer libraries do not have yet.
NEWER_LETTERS = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))

#: Signs that are a part of their own where they end a word of letters.
SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

#: Entries of each half of a memory (some 25 MB), and the longest key that is kept.
REMEMBERED = 120_000
LONGEST_REMEMBERED = 64


def _ranges(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def pattern(letter: str = r"\p{L}", number: str = r"\p{N}", other: str = rf"[^{SPACE}\p{{L}}\p{{N}}]") -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


class Memory(dict):
    """Values by key, in two halves: when the new one is full it becomes the old one, which is forgotten.

    A value found in the old half moves to the new one, so what is met again and again stays.
    """

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def recall(self, key):
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Parts:
    """Cuts texts into parts and encodes them by ``encode``, a function of one part.

    One memory holds what short parts and words gave: a word that is a part is in it once.
    """

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        newer = _ranges(NEWER_LETTERS + NEWER_NUMBERS)
        self.newer = regex.compile(f"[{newer}]")
        self.plain = regex.compile(pattern())
        self.exact = regex.compile(
            pattern(
                rf"[\p{{L}}--[{_ranges(NEWER_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(NEWER_NUMBERS)}]]",
                rf"(?:[^{SPACE}\p{{L}}\p{{N}}]|[{newer}])",
            ),
            regex.V1,
        )
        self.encode = encode
        self.memory = Memory()

    def forget(self) -> None:
        """Frees what is remembered."""
        self.memory = Memory()

    def of(self, text: str) -> list[str]:
        """All parts of a text, in order."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                return self.exact.findall(text)
        return self.plain.findall(text)

    def part(self, part: str) -> bytes:
        known = self.memory.get(part) or self.memory.recall(part)
        if known is None:
            known = self.encode(part)
            if len(part) <= LONGEST_REMEMBERED:
                self.memory.keep(part, known)
        return known

    def word(self, word: str) -> bytes:
        """Of a stretch of text at whose ends the pattern cuts anyway.

        Python's letters are all in the libraries' older tables too: a word of them alone is one part, and
        one sign after them another. Such a word takes no place in the memory beside its parts.
        """
        if word[-1:] in SIGNS and (word[1:-1] if word[0] == " " else word[:-1]).isalpha():
            return self.part(word[:-1]) + self.part(word[-1])
        known = self.memory.recall(word)
        if known is None:
            if (word[1:] if word[:1] == " " else word).isalpha():
                known = self.encode(word)
            else:
                known = b"".join(map(self.part, self.of(word)))
            if len(word) <= LONGEST_REMEMBERED:
                self.memory.keep(word, known)
        return known

    def stretches(self, text: str) -> tuple[list[str], bool]:
        """A text cut into words, or into parts (then true).

        A lone space between other signs always starts a part: such texts go word by word.
        """
        found = [c for c in SPACES if c in text]
        if (
            text[0] == " " or text[-1] == " " or "  " in text or text[0] in found or text[-1] in found
            or any(f"{c} " in text or f" {c}" in text for c in found)
        ):
            return self.of(text), True
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]], False

    def encoded(self, text: str) -> bytes:
        """All parts of a text encoded and joined."""
        if not text:
            return b""
        found, are_parts = self.stretches(text)
        remembered, other = self.memory.get, self.part if are_parts else self.word
        return b"".join([remembered(w) or other(w) for w in found])

    def encoded_together(self, texts: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The same for many texts: what none of them and no earlier text held is encoded by one call of ``encode``."""
        cut = [self.stretches(t) if t else ([], True) for t in texts]
        known: dict[str, bytes] = {}
        words: dict[str, list[str]] = {}
        new: dict[str, None] = {}
        for are_parts in (True, False):
            for w in set().union(*(found for found, parts in cut if parts == are_parts)):
                value = self.memory.get(w) or self.memory.recall(w)
                if value is not None:
                    known[w] = value
                elif are_parts or (w[1:] if w[:1] == " " else w).isalpha():
                    new[w] = None
                elif w not in new:
                    words[w] = self.of(w)
        for p in set().union(*words.values()):
            if p not in known and p not in new:
                value = self.memory.get(p) or self.memory.recall(p)
                if value is None:
                    new[p] = None
                else:
                    known[p] = value
        fresh = dict(zip(new, encode(list(new))))
        known |= fresh
        whole = {w: b"".join(map(known.__getitem__, parts)) for w, parts in words.items()}
        known |= whole
        for made in (fresh, whole):
            for w, value in made.items():
                if len(w) <= LONGEST_REMEMBERED:
                    self.memory.keep(w, value)
        return [b"".join(map(known.__getitem__, found)) for found, _ in cut]
