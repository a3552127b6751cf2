"""Byte-level BPE by ranks against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from driftline.llm import byte_bpe, pretokens
from tests.llm import cases


def library(name="byte_bpe_50k.tiktoken"):
    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_queue_takes_least_rank_and_leftmost_position(tmp_path):
    """Ranks drawn at random, far apart, against merging the least leftmost pair step by step."""
    for seed in range(20):
        draw = random.Random(seed)
        tokens = {bytes([b]): b for b in range(256)}
        free = draw.sample([*range(256, 600), *range(65_500, 66_000), *range(199_000, 200_000)], 300)
        while free:
            made = draw.choice([t for t in tokens if t <= b"d" * 9 and t >= b"a"][:40]) + draw.choice([b"a", b"b", b"c", b"ab", b"aa"])
            tokens.setdefault(made, free.pop())
        file = tmp_path / f"{seed}.tiktoken"
        file.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in tokens.items()))
        mine = byte_bpe.Encoder(str(file))
        for _ in range(60):
            data = bytes(draw.choice(b"aaabcd") for _ in range(draw.randint(1, 60)))
            left = [bytes([b]) for b in data]
            while data not in tokens:
                ranks = [tokens.get(a + b, 10**9) for a, b in zip(left, left[1:])]
                if not ranks or min(ranks) == 10**9:
                    break
                at = ranks.index(min(ranks))
                left[at : at + 2] = [left[at] + left[at + 1]]
            assert mine.merged(data) == ([tokens[data]] if data in tokens else [tokens[t] for t in left])
            assert not any(mine.words) and max(mine.first) == -1


def test_fuzz_equals_library():
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        draw, mine, theirs = random.Random(7), byte_bpe.Encoder(public_tokenizers.path(name)), library(name)
        pool = ["a", "b", "A", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "½", "٣", "文", "😀", "'s", "'ll", "'", "!", "<|endoftext|>",
                "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "the", "ing", "aaaa", "----", "\r\n", "\u0301", "Ⅷ", "_", "\x00"]
        for _ in range(3000):
            text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 25)))
            assert ids(mine.encode(text)) == theirs.encode_ordinary(text), text
            assert mine.decode(mine.encode(text)) == text.encode()


def test_parts_of_one_queue_equal_parts_alone(tmp_path, monkeypatch):
    """Ranks drawn at random (odd seeds), so that merges often make pairs of lower ranks, or rising; merges that overlap."""
    monkeypatch.setattr(byte_bpe, "FEW", 1)
    left_alone = 0
    for seed in range(25):
        draw = random.Random(seed)
        tokens = {bytes([b]): b for b in range(256)}
        free = draw.sample(range(256, 900), 200)
        if seed % 2 == 0:
            free.sort(reverse=True)
        while free:
            made = draw.choice([t for t in tokens if t <= b"d" * 9 and t >= b"a"][:40]) + draw.choice([b"a", b"b", b"ab", b"aa"])
            tokens.setdefault(made, free.pop())
        file = tmp_path / f"{seed}.tiktoken"
        file.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in tokens.items()))
        mine = byte_bpe.Encoder(str(file))
        parts = ["".join(draw.choice("aaabcd") for _ in range(draw.randint(1, 80))) for _ in range(400)]
        want = [mine.merged(p.encode()) for p in parts]
        alone = []
        merged = mine.merged
        mine.merged = lambda data: alone.append(data) or merged(data)
        assert [ids(p) for p in mine.encode_parts(parts)] == want
        left_alone += sum(len(p) <= byte_bpe.SHORT and p not in tokens for p in alone)
        monkeypatch.setattr(byte_bpe, "SHARED", draw.choice([50, 1_000_000]))
        assert [ids(p) for p in mine.encode_parts(parts)] == want
    assert 0 < left_alone < 25 * 400 * 0.7


def test_texts_together_equal_library(monkeypatch):
    """In blocks, with a small memory, with texts that are cut into words and texts that are not."""
    monkeypatch.setattr(pretokens, "REMEMBERED", 40)
    for few, block in ((1, 60), (1, 10_000), (10**9, 500)):
        monkeypatch.setattr(byte_bpe, "FEW", few)
        monkeypatch.setattr(byte_bpe, "TEXT_BLOCK", block)
        draw, mine, theirs = random.Random(5), byte_bpe.Encoder(byte_bpe.default_path()), library()
        pool = ["a", "the", "ing", "thonion", "erhend", " ", " ", " ", "  ", ".", ",", "\n", "'s", "é", "文", "1", "aaaa", "x" * 70, "\u088f"]
        texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(400)]
        assert [ids(p) for p in mine.encode_all(texts)] == [theirs.encode_ordinary(t) for t in texts]
        assert max(map(len, (mine.parts.memory, mine.parts.memory.old))) <= 40


def test_new_words_take_a_few_steps_together():
    """Most words of the corpora are met once only: their merges must not be a loop of their own."""
    draw, mine = random.Random(9), byte_bpe.Encoder(byte_bpe.default_path())
    syllables = ["th", "en", "in", "er", "on", "tion", "ing", "st", "ea", "ou", "ed", "hand", "ly", "ble"]
    words = sorted({"".join(draw.choice(syllables) for _ in range(draw.randint(2, 6))) for _ in range(30_000)})
    calls = []
    merged = mine.merged
    mine.merged = lambda data: calls.append(data) or merged(data)
    got = mine.encode_all([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
    alone = [w for w in calls if w not in mine.ranks]
    assert len(words) > 15_000 and len(alone) < len(words) / 100
    assert [ids(p) for p in got] == [library().encode_ordinary(" ".join(words[i : i + 100])) for i in range(0, len(words), 100)]


def test_letters_of_all_planes():
    draw, mine, theirs = random.Random(11), byte_bpe.Encoder(byte_bpe.default_path()), library()
    newer = [c for a, b in pretokens.NEWER_LETTERS + pretokens.NEWER_NUMBERS for c in {a, b, (a + b) // 2}]
    for _ in range(4000):
        codes = [draw.choice(newer) if draw.random() < 0.3 else draw.randrange(0x110000) for _ in range(draw.randint(1, 12))]
        text = "".join(chr(c) + draw.choice(["", "", " ", "a", "7", "\n", "!"]) for c in codes if not 0xD800 <= c < 0xE000)
        assert ids(mine.encode(text)) == theirs.encode_ordinary(text), text


def test_very_long_parts():
    draw, mine, theirs = random.Random(3), byte_bpe.Encoder(byte_bpe.default_path()), library()
    noise = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    for text in ("a" * 20_000, "ab" * 9000, " " * 5000, "the " * 1000, "!" * 999, "x" * 20_000 + "  ", noise, "é" * 7000, "abcab" * 4000):
        assert ids(mine.encode(text)) == theirs.encode_ordinary(text)


def test_time_grows_with_length_only():
    import time

    mine = byte_bpe.Encoder(byte_bpe.default_path())
    took = []
    for n in (50_000, 400_000):
        start = time.process_time()
        mine.encode("ab" * n)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]  # eight times the text; a scan for the least rank would take 64 times as long


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 3)
    mine, theirs = byte_bpe.Encoder(byte_bpe.default_path()), library()
    text = " ".join(cases.sentences(3, 20))
    assert ids(mine.encode(text)) == theirs.encode_ordinary(text)
    assert max(map(len, (mine.parts.memory, mine.parts.memory.old))) <= 3


def test_awkward_documents(spark):
    docs, theirs = cases.documents(spark), library()
    got = byte_bpe.token_digests(docs).toPandas()
    want = []
    for row in docs.collect():
        found = theirs.encode_ordinary(row.text or "")
        want.append((
            row.doc_id, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(theirs.decode_bytes(found)).hexdigest(),
        ))
    key = lambda r: (str(r[0]), r[1:])
    have = [(None if r[0] != r[0] else int(r[0]), *r[1:]) for r in got.itertuples(index=False, name=None)]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert byte_bpe.token_digests(cases.no_documents(spark)).count() == 0


def test_query_and_columns(spark):
    from driftline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{cases.SMALL}/documents.parquet")
    theirs = library()
    want = {r.doc_id: theirs.encode_ordinary(r.text or "") for r in docs.collect()}
    got = QUERIES["op12_byte_bpe"](spark, cases.SMALL)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got.collect()} == {
        i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want.items()
    }
    turned = docs.select("doc_id", byte_bpe.decode(byte_bpe.encode(docs.text)).cast("string").alias("t"), "text")
    assert turned.where("NOT (t <=> coalesce(text, ''))").count() == 0
