import random
import sys
from hashlib import sha256

import pytest

from fleetlens.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def random_texts(n, seed=3):
    r = random.Random(seed)
    for _ in range(n):
        signs = r.choice(["a", "ab", "aeiouth ", "é€漢字 a", "0123456789", "-=_ ", "\n\t x ", "'sv re", "the of an🙂d  "])
        yield "".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 33, 100, 700, 3000])))


@pytest.mark.parametrize("leaf_chars, leaf_bytes", [(8192, 512), (7, 4), (64, 16)])
def test_trees_give_the_ids_of_the_library(codec, library, monkeypatch, leaf_chars, leaf_bytes):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
    for text in random_texts(120):
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip_remembers_and_forgets(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TEXTS", 4)
    texts = list(random_texts(60, seed=9))
    for text, (ids, data) in zip(texts, codec.round_trip(texts)):
        assert ids == ",".join(map(str, library.encode_ordinary(text))) and data == text.encode()


def test_common_pieces_are_learned_once(monkeypatch):
    """Rare pieces fill what is remembered again and again; a piece met in every text is still learned once."""
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TEXTS", 4)
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    learn, learned = codec.learn, []
    monkeypatch.setattr(codec, "learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    texts = [f"everywhere{' everywhere' * 3} {'x' * n}q {'y' * n}q {'z' * n}q {'v' * n}q" for n in range(1, 120)]
    assert b"".join(data for _, data in codec.round_trip(texts)) == "".join(texts).encode()
    assert learned.count(" everywhere") == 1 and len(learned) == len(set(learned)) == 4 * 119 + 2
    assert len(codec.known) <= 50 and len(codec.before) <= 50


def test_what_is_remembered_is_small():
    """A worker lives on after its stage, so two full stores of rare pieces must leave room for the stages after it."""
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    codec.learn(pieces := {f" q{i * 7919:x}zß" for i in range(10_000)})
    held = sys.getsizeof(codec.known)
    for piece, found in codec.known.items():
        held += sum(map(sys.getsizeof, (piece, found, *(found if isinstance(found, tuple) else ()))))
    assert len(codec.known) == len(pieces) and held / len(pieces) * 2 * bpe.REMEMBERED < 64 << 20


def test_digests(awkward, library):
    rows = {(r["doc_id"], r["text"] or "") for r in awkward.collect()}
    got = bpe.digests(awkward, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = set()
    for i, t in rows:
        ids = library.encode_ordinary(t)
        want.add((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest()))
    found = got.collect()
    assert {tuple(r) for r in found} == want and len(found) == awkward.count()
    assert bpe.digests(awkward.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_tokens(documents):
    one = bpe.tokens(documents([(1, "the ß")]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first()
    assert one["decoded"] == "the ß" and len(one["ids"]) >= 2
