"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from driftline.llm import bpe, pretokens
from tests.llm import cases


def library():
    return Tokenizer.from_file(bpe.default_path())


def test_fuzz_equals_library():
    draw, mine, theirs = random.Random(7), bpe.Encoder(bpe.default_path()), library()
    pool = ["a", "b", "A", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "½", "٣", "文", "😀", "'s", "'ll", "'", "!", "<|endoftext|>",
            "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "the", "ing", "aaaa", "----", "\r\n", "\u0301", "Ⅷ", "_", "\x00", "<|"]
    for _ in range(3000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 25)))
        packed, ids = mine.encode(text), theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert mine.decode(packed) == theirs.decode(ids, skip_special_tokens=False), text


def test_letters_of_all_planes():
    """Code points that the libraries' tables do not have yet are parted as theirs."""
    draw, mine, theirs = random.Random(11), bpe.Encoder(bpe.default_path()), library()
    newer = [c for a, b in pretokens.NEWER_LETTERS + pretokens.NEWER_NUMBERS for c in {a, b, (a + b) // 2}]
    for _ in range(4000):
        codes = [draw.choice(newer) if draw.random() < 0.3 else draw.randrange(0x110000) for _ in range(draw.randint(1, 12))]
        text = "".join(chr(c) + draw.choice(["", "", " ", "a", "7", "\n", "!"]) for c in codes if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_repeats_and_long_parts():
    mine, theirs = bpe.Encoder(bpe.default_path()), library()
    for text in ("a" * 5000, "ab" * 3000, " " * 1000, "the " * 1000, "!" * 999, "x" * 20000 + "  "):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_awkward_documents(spark):
    docs, theirs = cases.documents(spark), library()
    got = bpe.token_digests(docs).toPandas()
    want = []
    for row in docs.collect():
        ids = theirs.encode(row.text or "", add_special_tokens=False).ids
        want.append((
            row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        ))
    key = lambda r: (str(r[0]), r[1:])
    have = [(None if r[0] != r[0] else int(r[0]), *r[1:]) for r in got.itertuples(index=False, name=None)]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert bpe.token_digests(cases.no_documents(spark)).count() == 0


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 3)
    mine, theirs = bpe.Encoder(bpe.default_path()), library()
    text = " ".join(cases.sentences(3, 20))
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert max(map(len, (mine.parts.memory, mine.parts.memory.old))) <= 3


def test_query_decodes_to_the_text(spark):
    docs = spark.read.parquet(f"{cases.SMALL}/documents.parquet")
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    from driftline.llm.queries import QUERIES

    got = {r.doc_id: r.decoded_sha256 for r in QUERIES["op2_bpe"](spark, cases.SMALL).collect()}
    assert got == want


def test_words_before_a_sign():
    """A word and the sign after it are remembered as two parts, not as a third entry; any sign parts as the library does."""
    draw, mine, theirs = random.Random(23), bpe.Encoder(bpe.default_path()), library()
    mine.encode("Sonne, Mond. Sonne.")
    assert set(mine.parts.memory) == {"Sonne", " Mond", " Sonne", ",", "."}
    signs = [chr(c) for c in range(33, 127)] + ["²", "–", "文", "́", "'s", "'", ""]
    words = ["Sonne", "été", "x", "文字", "ʻa", "ǅ", "ª", "\U00018d9a", "a\nb", "", "7", "s", "́"]
    for _ in range(3000):
        text = " ".join(draw.choice(words) + draw.choice(signs) for _ in range(draw.randint(1, 6)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_pair_tests_outlive_a_task(monkeypatch):
    """What two tokens side by side gave is kept between tasks, up to its bound; the words are not."""
    mine, theirs = bpe.Encoder(bpe.default_path()), library()
    text = " ".join(cases.sentences(5, 40))
    want = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == want
    mine.forget()
    tried = []
    plain = mine.first_across
    monkeypatch.setattr(mine, "first_across", lambda a, b: tried.append((a, b)) or plain(a, b))
    assert not mine.parts.memory and not mine.edges
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == want and not tried
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    for more in cases.sentences(6, 40):
        assert np.frombuffer(mine.encode(more), "<u4").tolist() == theirs.encode(more, add_special_tokens=False).ids
        assert mine.tested == sum(map(len, mine.fits.values())) <= 8 and tried
