"""Encoding and decoding against the reference library of the model."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from ledgerloom.llm import piece_bpe

PATH = P.path("piece_bpe_32k.model")
BITS = [" ", "  ", "   ", "a", "b", "the", "ing", "▁", "\n", "é", "ñ", "😀", "x", "1", "0", "<s>", "<0x41>", "　", "日本", "語", "\t", "tion", "==", "**", "--", "//", "\x00", "ﬁ", *[" " * k for k in range(4, 20)]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts(library):
    m, r = piece_bpe.model(PATH), random.Random(1)
    for _ in range(5000):
        s = "".join(r.choice(BITS) for _ in range(r.randint(0, 14)))
        ids = library.encode(s)
        assert m.encode(s) == ids and m.decode(ids) == library.decode(ids), repr(s)


def test_long_runs(library):
    m = piece_bpe.model(PATH)
    for s in ("a" * 5000, "ab" * 3000, "the" * 2000, "=" * 999, " " * 777 + "x", "日本語" * 500, "\n" * 300, "1234567890" * 300, "lo" + "ol" * 800):
        assert m.encode(s) == library.encode(s)


def test_every_piece_alone(library):
    m = piece_bpe.model(PATH)
    for t in list(m.ids)[::7]:
        assert m.encode(t) == library.encode(t), t


def test_documents(spark, library):
    rows = [(1, None, "z"), (2, "", "z"), (3, "the  cat\n\tsat 😀", "z"), (3, "the  cat\n\tsat 😀", "z"), (None, "long " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = piece_bpe.encode_documents(df, PATH).collect()
    assert len(out) == 5
    for r in out:
        ids = library.encode(r.text or "")
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_documents(df.limit(0), PATH).count() == 0
    assert "text" not in piece_bpe.encode_documents(df, PATH, with_ids=False).columns


def test_distinct_words_are_searched_side_by_side(library, monkeypatch):
    """One search a word took most of the operator's time; at most a few words of a text are left to it."""
    m, calls = piece_bpe.PieceModel(PATH), []
    alone = m._known
    monkeypatch.setattr(m, "_known", lambda text: calls.append(text) or alone(text))
    r = random.Random(2)
    text = " ".join("".join(r.choice(["th", "ing", "er", "é", "ción", "a", "x", "s."]) for _ in range(r.randint(2, 7))) for _ in range(5000))
    assert m.encode(text) == library.encode(text)
    assert len(calls) < 50


@pytest.mark.parametrize("few, weights", [(0, None), (0, 0), (24, 0)])
def test_many_texts_at_once(library, monkeypatch, few, weights):
    """Also with no word left to the search of single words, and where all words have one hash."""
    monkeypatch.setattr(piece_bpe, "FEW", few)
    m, r = piece_bpe.PieceModel(PATH), random.Random(3)
    if weights is not None:
        m.weights[:] = weights
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    texts += ["", " ", "", "lo" + "ol" * 120, "ol" * 127, "a" * 255, "a" * 256, "a" * 257, "=" * 300, "日本語" * 80, "x" * 254 + "😀", "😀" * 9, "\n\n", "한국", "", *map(m.text.get, sorted(m.reached)[::9])]
    ids, at, of_ids, of_text = m.digested_batch(texts)
    for k, t in enumerate(texts):
        want = library.encode(t)
        assert ids[at[k] : at[k + 1]].tolist() == want, repr(t)
        assert of_ids[k] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert of_text[k] == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_pairs_that_share_a_slot(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "PAIR_BITS", 3)
    m, r = piece_bpe.PieceModel(PATH), random.Random(5)
    texts = [" ".join("".join(r.choice(BITS[3:]) for _ in range(5)) for _ in range(50)) for _ in range(40)]
    ids, at = m.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in texts]
