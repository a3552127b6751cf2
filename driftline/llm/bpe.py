"""Exact byte-pair encoding and decoding by dynamic programming over prefixes.

A text is parted by the tokenizer's own pre-tokenizing pattern, and each part is encoded alone.
For every prefix of a part the encoder stores its one possible last token: of the tokens that end
there (an automaton over the vocabulary finds all suffixes that are tokens), the one that may
follow the last token of the prefix before it. Two tokens may stand side by side if no merge
across their border would have come before the merges inside them. Following the stored tokens
back from the end gives the ids, the same as merging pairs by rank.

``ids`` are packed as little-endian unsigned 32-bit integers in a binary column, so that a long
text needs no object for each token. A null text counts as empty and has no tokens. Texts of any
length are encoded whole, in time linear in their length. Words already encoded are remembered
in each worker, up to a bound; what has been met lately stays, the rest is forgotten.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import give_back, ship
from driftline.llm.pretokens import REMEMBERED, Parts


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are their own."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A byte-level tokenizer file as read from ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters = byte_letters()
        spelled = {t: bytes(letters[c] for c in t) for t in whole["model"]["vocab"]}
        ids = {b: whole["model"]["vocab"][t] for t, b in spelled.items()}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # rank at which a token is made, and of what
        for rank, pair in enumerate(whole["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = ids[spelled[left]], ids[spelled[right]], ids[spelled[left] + spelled[right]]
            self.merge[a, b] = rank
            self.halves.setdefault(made, (rank, a, b))
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fits: dict[int, dict[int, bool]] = {}  # of each token that ends a prefix, by the token before it
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if len(token) == 1 or (h := self.halves.get(i)) and self.first_across(h[1], h[2]) == h[0]:
                self.fits[i] = {}
                self.automaton.add_word(token.decode("latin-1"), (i, len(token), self.fits[i]))
        self.automaton.make_automaton()
        self.edges.clear()
        self.parts = Parts(self.encode_part)
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))

    def forget(self) -> None:
        """Frees the words that are remembered: workers outlive their tasks. Pair tests, of bounded number, stay."""
        self.parts.forget()
        self.edges.clear()
        give_back()

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that once stood at a token's end (side 2) or start (side 1), each with the rank at which it went."""
        key = token, side
        if key not in self.edges:
            found, gone = [(token, float("inf"))], token
            while gone in self.halves:
                rank = self.halves[gone][0]
                gone = self.halves[gone][side]
                found.append((gone, rank))
            self.edges[key] = found
        return self.edges[key]

    def first_across(self, a: int, b: int) -> float:
        """Rank of the first merge across the border of two tokens while they are being made; infinite if none.

        Of equal ranks the merge further left comes first.
        """
        first, merge = float("inf"), self.merge
        for x, x_gone in self.edge(a, 2):
            for y, y_gone in self.edge(b, 1):
                rank = merge.get((x, y))
                if rank is not None and rank < first and rank < x_gone and rank <= y_gone:
                    first = rank
        return first

    def may_follow(self, a: int, b: int) -> bool:
        if self.tested >= 2 * REMEMBERED:
            self.tested = 0
            for known in self.fits.values():
                known.clear()
        self.tested += 1
        fits = self.fits[b][a] = self.first_across(a, b) == float("inf")
        return fits

    def encode_part(self, part: str) -> bytes:
        """Ids of a part of text, by the last token of each of its prefixes."""
        letters = part.encode().decode("latin-1")
        at = len(letters) - 1
        last, size_of = [0] * (at + 1), [0] * (at + 1)
        done, may_follow = -1, self.may_follow
        for end, (token, size, known) in self.automaton.iter(letters):
            if end == done:
                continue
            if end >= size:
                before = last[end - size]
                if before in known:
                    if not known[before]:
                        continue
                elif not may_follow(before, token):
                    continue
            last[end] = token
            size_of[end] = size
            done = end
        ids = []
        while at >= 0:
            ids.append(last[at])
            at -= size_of[at]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_plain(self, text: str) -> bytes:
        return self.parts.encoded(text)

    def encode(self, text: str) -> bytes:
        if not self.special:
            return self.encode_plain(text)
        packed, at = [], 0
        for m in self.at_special.finditer(text):
            packed += [self.encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*packed, self.encode_plain(text[at:] if at else text)])

    def decode(self, packed: bytes) -> str:
        spelled = map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())
        return b"".join(spelled).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: Column, path: str | None = None) -> Column:
    """Packed ids of a text column; ``path`` names the tokenizer file on every machine."""
    path = path or default_path()

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(path)
        try:
            for texts in batches:
                yield texts.map(coder.encode)
        finally:
            coder.forget()

    return packed(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of packed ids."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        return packed.map(encoder(path).decode)

    return text(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the packed ids of every text and the text that they spell. No shuffle.

    Both come from one function, so that a task needs one Python worker.
    """
    ship(docs.sparkSession)
    path = path or default_path()

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        try:
            for texts in batches:
                ids = texts.map(coder.encode)
                yield pd.DataFrame({"ids": ids, "decoded": ids.map(coder.decode)})
        finally:
            coder.forget()

    return docs.select("doc_id", both(F.coalesce("text", F.lit(""))).alias("b")).select("doc_id", "b.ids", "b.decoded")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    return encode_documents(docs, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
