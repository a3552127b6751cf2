"""Byte-level byte-pair encoding and decoding with a bitmap queue of merge ranks.

Each part of a text (see ``pretokens``) starts as a linked list of single bytes. Every pair of
neighbours that makes a token is queued under the rank of that token: one bucket of list positions
for each rank, and above the buckets a bitmap of two levels, in words of ``2 ** BITS`` bits, whose
bit is set where something below it is. The next merge is found by taking the first set bit of the
upper level, then of the lower; of a rank's positions the leftmost comes first. A merge joins two list nodes and queues at
most two new pairs; entries whose pair has changed meanwhile are stale and skipped. So a part of n
bytes takes about n steps of constant size and one small heap step each, however long it is.

The short parts of a batch that are met for the first time share one list and one queue, in which
pairs never cross from part to part: what stands under the least rank of all is merged in all of
them at once. Parts do not touch each other, so each goes through the same merges as alone, as long as
a merge makes no pair of a rank below its own; a part in which it does is encoded alone.

``path`` names a file of lines "token in base64, rank". A part that is a token itself is that
token. ``ids`` are packed as little-endian unsigned 32-bit integers in one binary column. A null
text counts as empty and has no tokens; texts of any length are encoded whole. Rows are encoded
one by one, so repeated rows and ids, ties and columns of other names play no part; an empty table
gives no rows. Short words already encoded are remembered in each worker, up to a bound; what has
been met lately stays, also from task to task.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import ship
from driftline.llm.pretokens import Parts

#: Ranks to a word of the bitmap, as a power of two; its upper level is one word.
BITS = 8
MASK = (1 << BITS) - 1
#: Bytes of the longest part that shares a queue, and of all parts that share one; fewer parts than ``FEW`` go alone.
SHORT, SHARED, FEW = 64, 1_000_000, 200
#: Characters of the texts whose parts are looked up together.
TEXT_BLOCK = 2_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """The ranks of a file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.single:
            raise ValueError("every byte needs a rank")
        highest = max(self.bytes_of)
        self.shift = highest.bit_length()
        #: Rank of what two neighbours make, by both ranks in one number.
        self.pairs = {
            self.ranks[token[:i]] << self.shift | self.ranks[token[i:]]: rank
            for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks
        }
        single = self.single
        self.byte_pairs = [self.pairs.get(a << self.shift | b, -1) for a in single for b in single]
        # The same for many at once: by byte, and the pairs in order with one more that is none.
        self.singles = np.array(single, np.int32)
        self.pairs_of_bytes = np.array(self.byte_pairs, np.int32)
        self.pair_keys = np.array([*sorted(self.pairs), np.iinfo(np.int64).max])
        self.pair_ranks = np.array([*map(self.pairs.__getitem__, self.pair_keys[:-1].tolist()), -1], np.int32)
        # The queue; between parts it is empty, so all of this is as here.
        self.first = [-1] * (highest + 1)  # the leftmost position of each bucket
        self.words = [0] * ((highest >> BITS) + 1)  # lower level of the bitmap
        self.bit = [1 << i for i in range(max(len(self.words), 1 << BITS))]
        self.parts = Parts(lambda part: self.packed(part.encode()))

    def merged(self, data: bytes) -> list[int]:
        """Ids of one part.

        Of the bitmap, ``top`` tells the words with a bit and ``words`` the ranks with a bucket. A
        bucket is its leftmost position in ``first`` and a heap of all others in ``more``.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, single, first, words, bit, shift, pair = len(data), self.single, self.first, self.words, self.bit, self.shift, self.pairs.get
        token = [single[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        byte_pairs = self.byte_pairs
        rank_at = [byte_pairs[a << 8 | b] for a, b in zip(data, data[1:])]
        rank_at.append(-1)
        top, more = 0, {}
        for position, rank in enumerate(rank_at):
            if rank >= 0:
                if first[rank] < 0:
                    first[rank] = position
                    word = rank >> BITS
                    words[word] |= bit[rank & MASK]
                    top |= bit[word]
                else:
                    more.setdefault(rank, []).append(position)  # positions rise, so this is a heap
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << BITS | low.bit_length() - 1
            here = first[rank]
            if rank in more:
                heap = more[rank]
                first[rank] = heappop(heap)
                if not heap:
                    del more[rank]
            else:
                first[rank] = -1
                words[word] = bits = bits ^ low
                if not bits:
                    top &= top - 1
            if rank_at[here] != rank:
                continue  # stale: one of its two nodes has been merged meanwhile
            gone = after[here]
            following, previous = after[gone], before[here]
            token[here] = rank
            after[here] = following
            rank_at[gone] = new = -1
            if following < n:
                before[following] = here
                new = pair(rank << shift | token[following], -1)
            rank_at[here] = new
            position = here
            while True:
                if new >= 0:
                    if first[new] < 0:
                        first[new] = position
                        word = new >> BITS
                        words[word] |= bit[new & MASK]
                        top |= bit[word]
                    else:
                        if position < first[new]:
                            position, first[new] = first[new], position
                        heappush(more.setdefault(new, []), position)
                if previous < 0:
                    break
                position, new = previous, pair(token[previous] << shift | rank, -1)
                rank_at[position] = new
                previous = -1
        ids, at = [], 0
        while at < n:
            ids.append(token[at])
            at = after[at]
        return ids

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of tokens make, -1 for nothing; a token of -1 is none."""
        keys = left.astype(np.int64) << self.shift | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merged_together(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of parts, none of them empty, by one queue.

        A bucket is a list of arrays of positions. The node after the last is no node: no pair has it.
        """
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate([[0], ends[:-1]])
        token = np.append(self.singles[data], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = before[starts] = after[n] = n
        rank_at = np.full(n + 1, -1, np.int32)
        rank_at[: n - 1] = self.pairs_of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]]
        rank_at[ends - 1] = -1
        stands = np.ones(n, bool)
        alone: set[int] = set()
        words, bit, top = [0] * len(self.words), self.bit, 0
        buckets: dict[int, list[np.ndarray]] = {}

        def queue(top: int, positions: np.ndarray, ranks: np.ndarray) -> int:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            borders = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lows, highs = [0, *borders.tolist()], [*borders.tolist(), len(ranks)]
            for rank, low, high in zip(ranks[lows].tolist(), lows, highs):
                if rank in buckets:
                    buckets[rank].append(positions[low:high])
                else:
                    buckets[rank] = [positions[low:high]]
                    word = rank >> BITS
                    words[word] |= bit[rank & MASK]
                    top |= bit[word]
            return top

        first = np.flatnonzero(rank_at >= 0)
        if len(first):
            top = queue(top, first, rank_at[first])
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << BITS | low.bit_length() - 1
            words[word] = bits ^ low
            if bits == low:
                top &= top - 1
            found = buckets.pop(rank)
            here = found[0] if len(found) == 1 else np.concatenate(found)
            here = np.unique(here[rank_at[here] == rank])  # others are stale
            if not len(here):
                continue
            gone = after[here]
            shared = gone[:-1] == here[1:]
            if shared.any():  # of pairs that share a node, the leftmost, the third and so on
                place = np.arange(len(here))
                run = np.maximum.accumulate(np.where(np.append(True, ~shared), place, 0))
                here = here[(place - run) % 2 == 0]
                gone = after[here]
            following = after[gone]
            beside = following[:-1] == here[1:]
            if beside.any():  # what stands between two merges of a rank
                between = self.made(np.full(beside.sum(), rank, np.int32), token[here[1:][beside]])
                lower = (between >= 0) & (between < rank)
                if lower.any():
                    alone.update(np.searchsorted(ends, here[1:][beside][lower], "right").tolist())
            token[here] = rank
            after[here] = following
            before[following] = here
            stands[gone] = False
            rank_at[gone] = -1
            both = np.concatenate([here, before[here]])
            new = self.made(token[both], token[after[both]])
            new[both == n] = -1
            rank_at[both] = new
            known = new >= 0
            if known.any():
                both, new = both[known], new[known]
                if new.min() < rank:
                    alone.update(np.searchsorted(ends, both[new < rank], "right").tolist())
                top = queue(top, both, new)
        packed = token[:n][stands].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.add.reduceat(stands, starts, dtype=np.int64))).tolist()]
        return [self.packed(p) if i in alone else packed[cuts[i] : cuts[i + 1]] for i, p in enumerate(parts)]

    def packed(self, data: bytes) -> bytes:
        ids = self.merged(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part; short ones that are no token share a queue."""
        every = [p.encode() for p in parts]
        if len(every) < FEW:
            return [self.packed(p) for p in every]
        out: list[bytes] = [b""] * len(every)
        lot, size = [], 0

        def settle() -> None:
            for i, ids in zip(lot, self.merged_together([every[i] for i in lot])):
                out[i] = ids

        for i, p in enumerate(every):
            if p in self.ranks or len(p) > SHORT:
                out[i] = self.packed(p)
                continue
            lot.append(i)
            size += len(p)
            if size >= SHARED:
                settle()
                lot, size = [], 0
        if lot:
            settle()
        return out

    def encode(self, text: str) -> bytes:
        return self.parts.encoded(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, in blocks of texts whose parts are looked up together."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT_BLOCK):
                size += len(texts[end])
                end += 1
            out += self.parts.encoded_together(texts[at:end], self.encode_parts)
            at = end
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: Column, path: str | None = None) -> Column:
    """Packed ids of a text column; ``path`` names the file of ranks on every machine."""
    path = path or default_path()

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(path).encode_all(texts.tolist()), dtype=object)

    return packed(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that packed ids spell."""
    path = path or default_path()

    @F.pandas_udf("binary")
    def spelled(packed: pd.Series) -> pd.Series:
        return packed.map(encoder(path).decode)

    return spelled(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the packed ids of every text and the bytes that they spell. No shuffle.

    Both come from one function, so that a task needs one Python worker.
    """
    ship(docs.sparkSession)
    path = path or default_path()

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        coder = encoder(path)
        ids = pd.Series(coder.encode_all(texts.tolist()), dtype=object)
        return pd.DataFrame({"ids": ids, "decoded": ids.map(coder.decode)})

    return docs.select("doc_id", both(F.coalesce("text", F.lit(""))).alias("b")).select("doc_id", "b.ids", "b.decoded")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    return encode_documents(docs, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
