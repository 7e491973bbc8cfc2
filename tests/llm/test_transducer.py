import random

import pytest

from fleetlens.llm import queries, transducer

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")
SIGNS = ["a", "ab", "aeiouth ", "é€漢字 a", "0123456789", "-=_ ", "\n\t x ", " \n", "'svretlmdRS a'", "the of an🙂d  ", "\0\x1c \x85\xa0 a", "½x٣ ", "'ll 're've"]


@pytest.fixture(scope="module")
def counter():
    return transducer.Counter(PATH)


@pytest.fixture(scope="module")
def library():
    lib = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def random_texts(r, n):
    for _ in range(n):
        signs = r.choice(SIGNS)
        text = "".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 5, 33, 49, 100, 700, 3000])))
        yield text[:9] + "<|endoftext|>" + text[9:] + "<|endoftext|>" * r.choice([0, 2]) if r.random() < 0.1 else text


@pytest.mark.parametrize("piece, classes, chunks, states, together", [
    (48, 256, 1 << 14, 250_000, 1 << 19), (1, 1, 2, 50, 10), (3, 5, 5, 250_000, 1000), (7, 256, 3, 50, 1 << 19),
])
def test_counts_are_those_of_the_library(counter, library, monkeypatch, piece, classes, chunks, states, together):
    for name, value in {"PIECE_CHUNK": piece, "CLASS_CHUNK": classes, "CHUNKS": chunks, "STATES": states, "TOGETHER": together}.items():
        monkeypatch.setattr(transducer, name, value)
    r = random.Random(piece)
    for _ in range(6):
        texts = list(random_texts(r, 40))
        assert list(counter.count(texts)) == library(texts)


def test_long_pieces(counter, library):
    r = random.Random(5)
    texts = ["a" * 100_000, "ab" * 30_000, "".join(r.choice("abcdefgh") for _ in range(30_000)), "漢字" * 20_000, " " * 70_000, "=" * 999]
    assert list(counter.count(texts)) == library(texts)


def test_pieces_begin_where_the_pattern_says(counter):
    r = random.Random(11)
    for text in random_texts(r, 300):
        spans = [span for _, span in counter.pieces_of(text)]
        counter.counts([text])
        classes = [transducer.END if i == len(text) else counter.classes[ord(text[i])] for i in range(len(text) + 1)]
        starts = counter.piece_starts(transducer.np.array(classes, "uint8"))
        assert [i for i, s in enumerate(starts[:-1].tolist()) if s] == [a for a, _ in spans]


def test_awkward_rows(awkward, library):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    got = transducer.counts(awkward, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted(((i, len(t.encode()), n) for (i, t), n in zip(rows, library([t for _, t in rows]))), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert transducer.counts(awkward.limit(0), PATH).count() == 0


def test_query(spark, documents, library, tmp_path):
    rows = [(1, None), (2, "word " * 1024), (3, "word " * 1025), (4, "<|endoftext|>" * 3 + " "), (5, "naïve 漢字 don't  \n\n x")]
    documents(rows, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_token_counts"](spark, str(tmp_path))
    want = {(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))}
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {tuple(r) for r in got.collect()} == want and {r["over_limit"] for r in got.collect()} == {True, False}


def test_other_kinds_of_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        transducer.Counter(P.path("word_bpe_49k.json"))
