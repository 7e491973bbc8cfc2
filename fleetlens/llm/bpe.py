"""Byte-level BPE as a monoid: halves are encoded on their own and joined by encoding again around the seam.

On texts: a text is cut into pieces by a pattern that looks only forward. Pieces of the left half that end before its
last character but one are decided by what that half holds; from there the join cuts again until it comes to a place
where the right half had a cut too, and everything after it stays as it was.

On the bytes of a piece: a sequence of tokens is the encoding of its bytes exactly if each two neighbours, encoded
together, give themselves again. Both halves meet this inside, so the join encodes a window around the seam anew,
widening it until the two neighbours at its edges meet it too.

Decoding concatenates up the same tree. Texts stay whole within one task, which holds the tree of one text at a time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlens.llm.columns import text_of

#: Longest text and longest piece that are encoded without being halved.
LEAF_CHARS, LEAF_BYTES = 8192, 512
#: Up to this many bytes, a list of pairs beats a heap.
SHORT = 64
#: Distinct pieces a worker remembers before it starts anew. Those of the last time stay at hand until then and are taken
#: over where they are met again, so common pieces stay and rare ones go. It holds twice as many, beside those of the texts at hand.
#: A worker outlives its stage, so what it remembers stays in an executor's memory: some 400 bytes a piece.
REMEMBERED = 100_000
NO_RANK = 1 << 60
#: Texts that are cut before new pieces are looked up together, and new pieces that are merged together.
TEXTS, TOGETHER = 64, 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes with given ranks and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cut = regex.compile(pattern)
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.text_of_id = {rank: str(rank) for rank in self.tokens}
        self.said = {said: self.tokens[rank] for rank, said in self.text_of_id.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        self.pairs = np.array(sorted(pairs))
        self.made = np.array([pairs[p] for p in self.pairs.tolist()])

    # bytes of one piece

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a run of bytes: the neighbours with the lowest rank are merged first, the leftmost of equal ones."""
        if len(data) > SHORT:
            return self.merged_by_heap(data)
        rank_of, at = self.ranks.get, list(range(len(data) + 1))
        pairs = [rank_of(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) != NO_RANK:
            i = pairs.index(low)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(data[at[i] : at[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = rank_of(data[at[i - 1] : at[i + 1]], NO_RANK)
        return [self.ranks[data[i:j]] for i, j in zip(at, at[1:])]

    def merged_by_heap(self, data: bytes) -> list[int]:
        """The same for a long run, in n log n steps: pairs wait in a heap, out-of-date ones are passed over."""
        n, rank_of = len(data), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] == n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := rank_of(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := rank_of(data[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether two tokens, encoded together, give themselves again."""
        if (known := self.stable.get((a, b))) is None:
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two halves' bytes together."""
        if not left or not right or self.neighbours(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            starts = i == 0 or self.neighbours(left[i - 1], window[0])
            ends = j == len(right) or self.neighbours(window[-1], right[j])
            if starts and ends:
                return left[:i] + window + right[j:]
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        """Tokens of a run of bytes, by halves."""
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece; a piece that is itself a token is that token."""
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else [rank]

    # texts

    def cuts(self, text: str) -> list[str]:
        """Pieces of a text, by halves."""
        if len(text) <= LEAF_CHARS:
            return self.cut.findall(text)
        half = len(text) // 2
        left, right = self.cuts(text[:half]), self.cuts(text[half:])
        at = half
        while left and at > half - 2:
            at -= len(left.pop())
        end, middle, k = half, [], 0
        while at < len(text):
            while k < len(right) and end < at:
                end += len(right[k])
                k += 1
            if at == end:
                break
            match = self.cut.match(text, at)
            middle.append(match[0])
            at = match.end()
        else:
            k = len(right)
        return left + middle + right[k:]

    def merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of many short pieces: a step merges, in each piece that can go on, its lowest and leftmost pair."""
        wide = max(map(len, pieces))
        flat = np.frombuffer(b"".join([p.ljust(wide, b"\0") for p in pieces]), "uint8").reshape(-1, wide)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(wide) < size[:, None], self.of_byte[flat], -1)
        ranks, rows, column = self.pair_ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(pieces)), np.arange(wide)
        while len(rows):
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            if not (go := low < NO_RANK).all():
                ranks, rows, at, low = ranks[go], rows[go], at[go], low[go]
                continue
            each, now = np.arange(len(rows)), ids[rows]
            moved = np.minimum(column + (column > at[:, None]), wide - 1)
            now = np.take_along_axis(now, moved, 1)
            now[each, at], now[:, -1] = low, -1
            ranks = np.take_along_axis(ranks, moved[:, :-1].clip(max=wide - 2), 1)
            ranks[:, -1] = NO_RANK
            after = np.minimum(at + 1, wide - 1)
            ranks[each, np.minimum(at, wide - 2)] = self.pair_ranks(low, np.where(at + 1 < wide, now[each, after], -1))
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.pair_ranks(now[inner, at[inner] - 1], low[inner])
            ids[rows] = now
        return [row[: row.index(-1)] if row[-1] < 0 else row for row in ids.tolist()]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two neighbouring tokens make together; NO_RANK if nothing, or if one is missing (-1)."""
        wanted = left.astype("int64") << 32 | right
        at = np.searchsorted(self.pairs, wanted).clip(max=len(self.pairs) - 1)
        return np.where((self.pairs[at] == wanted) & (left >= 0) & (right >= 0), self.made[at], NO_RANK)

    def learn(self, pieces: set[str]) -> None:
        """Remembers ids as decimal text of pieces not met before."""
        known, ranks, text_of_id = self.known, self.ranks, self.text_of_id
        short: list[list[tuple[str, bytes]]] = [[] for _ in range(4)]  # up to 8, 16, 24 and 32 bytes
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            if (rank := ranks.get(data)) is not None:
                known[p] = text_of_id[rank]
            elif len(data) <= 32:
                short[(len(data) - 1) // 8].append((p, data))
            else:
                known[p] = ",".join([text_of_id[t] for t in self.tree(data)])
        for some in short:
            for i in range(0, len(some), TOGETHER):
                group = some[i : i + TOGETHER]
                for (p, _), found in zip(group, self.merged_together([data for _, data in group])):
                    known[p] = ",".join([text_of_id[t] for t in found])

    def encode(self, text: str) -> list[int]:
        return [t for p in self.cuts(text) for t in self.piece(p.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[t] for t in ids])

    def round_trip(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids as decimal text joined by commas, and the bytes they decode to."""
        for i in range(0, len(texts), TEXTS):
            cut = [self.cuts(text) for text in texts[i : i + TEXTS]]
            needed = set().union(*cut)
            new = needed.difference(self.known)
            if self.known and len(self.known) + len(new) > REMEMBERED:
                if len(self.known) <= REMEMBERED:  # not what one heap of texts brought all at once
                    self.before = self.known
                self.known, new = {}, needed
            if new and self.before:
                self.known.update([(p, found) for p in new if (found := self.before.get(p)) is not None])
                new = new.difference(self.known)
            if new:
                self.learn(new)
            for pieces in cut:
                said = ",".join([self.known[p] for p in pieces])
                yield said, b"".join([self.said[t] for t in said.split(",")]) if said else b""


def _codec(path: str, pattern: str, made: dict = {}) -> Codec:  # noqa: B006  one for each worker
    if (path, pattern) not in made:
        made[path, pattern] = Codec(read_ranks(path), pattern)
    return made[path, pattern]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of ``docs``, other columns left out.

    A null text counts as empty: no tokens, both digests those of the empty string. ``path``: the rank file, at the
    same place on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = _codec(path, pattern), hashlib.sha256
        for batch in batches:
            n, ids, back = [], [], []
            for said, data in codec.round_trip(batch["text"].to_pylist()):
                n.append(said.count(",") + 1 if said else 0)
                ids.append(sha(said.encode()).hexdigest())
                back.append(sha(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, "int64"), pa.array(ids, "string"), pa.array(back, "string")],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, an array of int, and decoded, the text that the ids give back (undecodable bytes replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            ids = [codec.encode(value.as_py()) for value in batch["text"]]
            back = [codec.decode(i).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(back, "string")], ["doc_id", "ids", "decoded"]
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
