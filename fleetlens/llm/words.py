"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial hash, its inverse modulo 2**64, and one for each place in a shingle.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
#: Bytes of text that are worked on together; a longer text is worked on alone.
CHUNK = 1 << 19

_powers = {}


def _folding() -> np.ndarray:
    """Byte to byte: A-Z in lower case, digits, a-z and all beyond ASCII as they are, 0 for what is in no word."""
    table = np.zeros(256, "uint8")
    for b in range(256):
        if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128:
            table[b] = b
        elif 65 <= b <= 90:
            table[b] = b + 32
    return table


FOLD = _folding()


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("up", BASE), ("down", INVERSE)):
            out = np.empty(size, "uint64")
            out[0], done = 1, 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                more = min(done, size - done)
                out[done : done + more] = out[:more] * step
                done += more
            _powers[key] = out
    return _powers["up"][:n], _powers["down"][:n]


def chunks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, bytes, ends): the bytes of texts first .. stop - 1, each with a line feed after it, and where those end."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "surrogatepass") + b"\n")
        size += len(held[-1])
        if size >= CHUNK or i + 1 == len(texts):
            yield first, i + 1, np.frombuffer(b"".join(held), "uint8"), np.cumsum([len(h) for h in held])
            first, held, size = i + 1, [], 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in which ``mask`` holds."""
    edges = np.flatnonzero(np.diff(mask.astype("int8"), prepend=0, append=0))
    return edges[::2], edges[1::2]


def hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    up, down = powers(len(folded) + 1)
    total = np.zeros(len(folded) + 1, "uint64")
    np.cumsum(folded * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def shingles(texts: list[str], k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, hashes, ends): hashes of every k consecutive words of texts first .. stop - 1, and where each text's end.

    Words are runs of a-z, A-Z (in lower case), digits and characters beyond ASCII. A text of fewer words than k, but
    one at least, has one shingle of all its words; one without words has none.
    """
    for first, stop, data, ends in chunks(texts):
        folded = FOLD[data]
        a, b = spans(folded != 0)
        word = hashes(folded, a, b)
        upto = np.searchsorted(a, ends)
        n = np.diff(upto, prepend=0)
        text = np.repeat(np.arange(len(n)), n)
        total = np.zeros(len(word), "uint64")
        for j in range(k):
            total[: max(0, len(word) - j)] += word[j:] * np.uint64(PLACES[j % 5] * (1 + 2 * (j // 5)) % (1 << 64))
        whole = np.arange(len(word)) + k <= upto[text] if len(word) else np.zeros(0, bool)
        short = np.flatnonzero((n > 0) & (n < k))
        for t in short:
            i = upto[t] - n[t]
            whole[i] = True
            total[i] = sum(int(word[i + j]) * PLACES[j % 5] * (1 + 2 * (j // 5)) for j in range(n[t])) % (1 << 64)
        yield first, stop, mixed(total[whole]), np.cumsum(np.bincount(text[whole], minlength=len(n)))
