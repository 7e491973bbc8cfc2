"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic transducers count the tokens of a text. The first reads classes of characters and says where pieces
begin; it has a dozen states. The second reads the bytes of a piece. Its state holds what can still matter: the places
from which the bytes read so far begin some longer token, the last token before each, and how many tokens more than the
fewest lie before it. Each transition emits the tokens by which all these numbers can be lowered, and each state has a
final number. There are finitely many states; like those of a lazily built automaton they are compiled when a byte
first leads to them, and kept.

Text is cut into chunks of fixed length, and all chunks take a step at once. A chunk's result is a map from
the state in which it is entered to the state in which it is left (and tokens emitted); maps compose associatively, so
a parallel prefix scan gives every chunk the state in which it is really entered. For classes all states are entries; for
bytes of long pieces the entries are the starting state and whatever states the chunk before can be left in.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.columns import text_of

#: Characters in a chunk of classes, bytes in a chunk of a piece, characters that are worked on together.
CLASS_CHUNK, PIECE_CHUNK, TOGETHER = 256, 48, 1 << 19
#: Chunks of long pieces that are worked on together, and states that a worker keeps before it starts anew.
CHUNKS, STATES = 1 << 14, 250_000
#: A state's live places, each as three numbers: bytes back, last token before it (-1: none), tokens above the fewest.
LIVE = struct.Struct("<iii")
#: Odd multiplier that spreads the keys of transitions over their table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)

# classes of characters, and states between them; x: letters s t m d, r: letters r v
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, X, R, L, E, END = range(11)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_L, SHORTENED, ONE_SPACE, ONE_BLANK, SPACES, BLANKS = range(12)
N_CLASSES, N_STATES = 16, 12
#: What a step says: a piece begins at this character; a piece begins at the one before.
HERE, BEFORE = 1, 2


def _piece_rules() -> tuple[np.ndarray, np.ndarray]:
    """State and output by state and class, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before more text|white space."""
    to = np.zeros((N_STATES, N_CLASSES), "uint8")
    says = np.zeros((N_STATES, N_CLASSES), "uint8")
    letters = (LETTER, X, R, L, E)
    kinds = {IN_LETTERS: letters, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, QUOTE)}
    for state in range(N_STATES):
        blank = state in (ONE_SPACE, ONE_BLANK, SPACES, BLANKS)
        glued = state in (ONE_SPACE, SPACES)
        late = BEFORE if state in (SPACES, BLANKS, QUOTED_R, QUOTED_L) else 0
        run = {QUOTED: IN_OTHERS, QUOTED_R: IN_LETTERS, QUOTED_L: IN_LETTERS}.get(state, state)
        for kind, classes in kinds.items():
            for c in classes:
                goes_on = glued or run == kind
                to[state, c], says[state, c] = kind, late | (0 if goes_on else HERE)
                if c == QUOTE and not goes_on:
                    to[state, c] = QUOTED
        for c, (one, more) in {SPACE: (ONE_SPACE, SPACES), BLANK: (ONE_BLANK, BLANKS)}.items():
            to[state, c], says[state, c] = (more, 0) if blank else (one, HERE | late)
        to[state, END], says[state, END] = START, HERE | (late if not blank else 0)
    for c, state in {X: SHORTENED, R: QUOTED_R, L: QUOTED_L}.items():
        to[QUOTED, c], says[QUOTED, c] = state, 0
    for state, c in ((QUOTED_R, E), (QUOTED_L, L)):
        to[state, c], says[state, c] = SHORTENED, 0
    return to.ravel(), says.ravel()


def _byte_of_sign() -> dict[str, int]:
    """Bytes by the characters that stand for them in the file: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the library of the file does: pieces, merges by rank, added special tokens found in a text."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter, model = spec["pre_tokenizer"], spec["model"]
        simple = model["type"] == "BPE" and cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        if not simple or spec["normalizer"] or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or len(spec["added_tokens"]) > 1:
            raise ValueError("one added token without options is supported")
        self.special = next((t["content"] for t in spec["added_tokens"]), None)
        sign = _byte_of_sign()
        self.tokens = {i: bytes(sign[c] for c in token) for token, i in model["vocab"].items()}
        self.ids = {token: i for i, token in self.tokens.items()}
        self.begins = {token[:k] for token in self.ids for k in range(1, len(token))}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pieces_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.classes = np.full(0x110000, 255, "uint8")
        for c, kind in {" ": SPACE, "'": QUOTE, "r": R, "v": R, "l": L, "e": E, "s": X, "t": X, "m": X, "d": X}.items():
            self.classes[ord(c)] = kind
        self.to, self.says = _piece_rules()
        self.agreed: dict[tuple[int, int], bool] = {}
        self.forget()

    # the transducer of bytes

    def forget(self) -> None:
        """Only the starting state stays."""
        self.states = [(b"", LIVE.pack(0, -1, 0))]
        self.number = {self.states[0]: 0}
        self.final = np.zeros(1024, "int32")
        self.filled = 0
        self.keys = np.full(1 << 14, -1, "int64")
        self.next, self.emits = np.zeros(1 << 14, "int32"), np.zeros(1 << 14, "uint8")

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where the table has the transitions of ``key`` (state * 256 + byte), or the free slot where each would go."""
        mask = len(self.keys) - 1
        at = ((key.astype("uint64") * SPREAD) >> np.uint64(40)).astype("int64") & mask
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            seen = self.keys[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        return at

    def kept(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """Puts new transitions into the table, which grows before it is half full."""
        self.filled += len(keys)
        if self.filled * 2 > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            keys = np.concatenate((self.keys[old], keys))
            to, emits = np.concatenate((self.next[old], to)), np.concatenate((self.emits[old], emits))
            size = 1 << (4 * self.filled).bit_length()
            self.keys = np.full(size, -1, "int64")
            self.next, self.emits = np.zeros(size, "int32"), np.zeros(size, "uint8")
        while len(keys):
            at = self.places(keys)
            _, one = np.unique(at, return_index=True)
            self.keys[at[one]], self.next[at[one]], self.emits[at[one]] = keys[one], to[one], emits[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, to, emits = keys[rest], to[rest], emits[rest]

    def merged(self, ids: list[int]) -> list[int]:
        """The pair of lowest rank is merged first, the leftmost of equal ones."""
        while len(ids) > 1:
            rank, i = min((self.merges.get(pair, (1 << 60,))[0], i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids = [*ids[:i], self.merges[ids[i], ids[i + 1]][1], *ids[i + 2 :]]
        return ids

    def agree(self, last: int, token: int) -> bool:
        """Whether ``token`` stays itself behind ``last`` (-1: at the beginning)."""
        known = self.agreed.get((last, token))
        if known is None:
            if len(self.agreed) > 1_000_000:
                self.agreed.clear()
            data = (self.tokens[last] if last >= 0 else b"") + self.tokens[token]
            alone = self.merged([self.ids[bytes([b])] for b in data])
            known = self.agreed[last, token] = alone == ([token] if last < 0 else [last, token])
        return known

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """The state to which ``state`` leads on ``byte``, and the tokens emitted."""
        suffix, live = self.states[state]
        data = suffix + bytes([byte])
        found, stays = [], []
        for back, last, more in LIVE.iter_unpack(live):
            part = data[len(suffix) - back :]
            token = self.ids.get(part)
            if token is not None and self.agree(last, token):
                found.append((token, more + 1))
            if part in self.begins:
                stays.append((back + 1, last, more))
        if len(found) != 1:
            raise ValueError("the merges do not define one last token")
        stays.append((0, *found[0]))
        least = min(more for _, _, more in stays)
        new = (data[len(data) - stays[0][0] :], b"".join([LIVE.pack(back, last, more - least) for back, last, more in stays]))
        return self.numbered(new), least

    def numbered(self, state: tuple[bytes, bytes]) -> int:
        """Number of a state, which is added if it is new."""
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            if to >= len(self.final):
                self.final = np.concatenate((self.final, np.zeros(len(self.final), "int32")))
            self.final[to] = LIVE.unpack(state[1][-LIVE.size :])[2]
        return to

    def steps(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and emitted tokens after ``lengths`` bytes from ``starts`` on, entered in ``states``."""
        by = np.argsort(-lengths, kind="stable")
        start, now, out = starts[by], states[by].astype("int64"), np.zeros(len(by), "int64")
        active = np.searchsorted(-lengths[by], -np.arange(int(lengths.max(initial=0))), side="left")
        for t, n in enumerate(active.tolist()):
            key = now[:n] << 8 | data[start[:n] + t]
            at = self.places(key)
            new = self.keys[at] < 0
            if new.any():
                missing = np.unique(key[new])
                made = np.array([self.compiled(k >> 8, k & 255) for k in missing.tolist()])
                self.kept(missing, made[:, 0], made[:, 1])
                at = self.places(key)
            out[:n] += self.emits[at]
            now[:n] = self.next[at]
        left, emitted = np.empty(len(by), "int64"), np.empty(len(by), "int64")
        left[by], emitted[by] = now, out
        return left, emitted

    def long_piece(self, data: np.ndarray) -> int:
        """Tokens of a long piece, a block of chunks at a time; the state between blocks is all that is carried."""
        state, total = self.states[0], 0
        for at in range(0, len(data), CHUNKS * PIECE_CHUNK):
            if len(self.states) > STATES:
                self.forget()
            left, emitted = self.block(data[at : at + CHUNKS * PIECE_CHUNK], self.numbered(state))
            state, total = self.states[left], total + emitted
        return total + int(self.final[self.numbered(state)])

    def block(self, data: np.ndarray, entry: int) -> tuple[int, int]:
        """State and emitted tokens after ``data``, entered in ``entry``: maps of chunks, composed by a prefix scan."""
        starts = np.arange(0, len(data), PIECE_CHUNK)
        lengths = np.minimum(PIECE_CHUNK, len(data) - starts)
        n = len(starts)
        entries: list[dict[int, int]] = [{0: 0} for _ in range(n)] + [{}]
        entries[0] = {entry: 0}
        chunk, state = np.arange(n), np.array([entry] + [0] * (n - 1))
        rows: list[tuple[np.ndarray, ...]] = []
        while len(chunk):
            left, emitted = self.steps(data, starts[chunk], lengths[chunk], state)
            slot = np.array([entries[c][s] for c, s in zip(chunk.tolist(), state.tolist())])
            fresh, exits = [], np.empty(len(chunk), "int64")
            for i, (c, s) in enumerate(zip((chunk + 1).tolist(), left.tolist())):
                known = entries[c]
                if s not in known:
                    known[s] = len(known)
                    if c < n:
                        fresh.append((c, s))
                exits[i] = known[s]
            rows.append((chunk, slot, exits, emitted))
            chunk, state = np.array(fresh, "int64").reshape(-1, 2).T
        wide = max(map(len, entries))
        to, out = np.zeros((n, wide), "int64"), np.zeros((n, wide), "int64")
        for chunk, slot, exits, emitted in rows:
            to[chunk, slot], out[chunk, slot] = exits, emitted
        step = 1
        while step < n:
            out[step:] = out[:-step] + np.take_along_axis(out[step:], to[:-step], 1)
            to[step:] = np.take_along_axis(to[step:], to[:-step], 1)
            step *= 2
        return list(entries[n])[to[-1, 0]], int(out[-1, 0])

    # the transducer of classes

    def class_of(self, code: int) -> int:
        """Class of a character as the library's own pattern has it."""
        c = chr(code)
        if [span for _, span in self.pieces_of("a" + c + "1")] == [(0, 2), (2, 3)]:
            return LETTER
        if [span for _, span in self.pieces_of("a" + c + "1")] == [(0, 1), (1, 3)]:
            return NUMBER
        return OTHER if [span for _, span in self.pieces_of("!" + c)] == [(0, 2)] else BLANK

    def piece_starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character; every text in ``classes`` is followed by END."""
        n = len(classes)
        chunks = -(-n // CLASS_CHUNK)
        padded = np.full(chunks * CLASS_CHUNK, END, "uint8")
        padded[:n] = classes
        columns = np.ascontiguousarray(padded.reshape(chunks, CLASS_CHUNK).T)
        maps = np.tile(np.arange(N_STATES, dtype="uint8"), (chunks, 1))
        for column in columns:
            maps = self.to[(maps << 4) + column[:, None]]
        step = 1
        while step < chunks:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
            step *= 2
        now = np.concatenate(([START], maps[:-1, START])).astype("uint8")
        said = np.empty_like(columns)
        for t, column in enumerate(columns):
            key = (now << 4) + column
            said[t], now = self.says[key], self.to[key]
        said = said.T.ravel()[:n]
        starts = (said & HERE) > 0
        starts[:-1] |= (said[1:] & BEFORE) > 0
        return starts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as ordinary text throughout."""
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "uint32")
        data = np.frombuffer(("\n".join(texts) + "\n").encode(), "uint8")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes = self.classes[codes]
        if (classes == 255).any():
            for code in np.unique(codes[classes == 255]).tolist():
                self.classes[code] = self.class_of(code)
            classes = self.classes[codes]
        classes[ends] = END
        begin = np.flatnonzero(self.piece_starts(classes))
        at = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        place = np.append(0, at[:-1])[begin]
        lengths = np.diff(np.append(place, len(data)))
        lengths[classes[begin] == END] = 0
        n = np.zeros(len(begin), "int64")
        short = np.flatnonzero((lengths > 0) & (lengths <= PIECE_CHUNK))
        if len(self.states) > STATES:
            self.forget()
        left, emitted = self.steps(data, place[short], lengths[short], np.zeros(len(short), "int64"))
        n[short] = emitted + self.final[left]
        for k in np.flatnonzero(lengths > PIECE_CHUNK).tolist():
            n[k] = self.long_piece(data[place[k] : place[k] + lengths[k]])
        upto = np.cumsum(n)[np.searchsorted(begin, ends)]
        return np.diff(upto, prepend=0)

    def count(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each text; the added special token counts as one wherever it stands."""
        held, owner, extra, size = [], [], [], 0
        for i, text in enumerate(texts):
            parts = text.split(self.special) if self.special and self.special in text else [text]
            extra.append(len(parts) - 1)
            for part in parts:
                held.append(part)
                owner.append(len(extra) - 1)
                size += len(part)
            if size >= TOGETHER or i + 1 == len(texts):
                found = np.bincount(owner, self.counts(held), len(extra)).astype("int64") + extra
                yield from found.tolist()
                held, owner, extra, size = [], [], [], 0


def _counter(path: str, made: dict = {}) -> Counter:  # noqa: B006  one for each worker
    if path not in made:
        made[path] = Counter(path)
    return made[path]


def counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (in UTF-8), n_tokens: one row for each row of ``docs``, other columns left out.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give equal rows, an empty table an empty one. ``path``:
    a file of a byte-level BPE tokenizer, at the same place on every machine. A text is worked on whole; a long
    one needs some ten bytes of memory for each of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            n = list(counter.count(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(n, "int64")], ["doc_id", "n_bytes", "n_tokens"]
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    sized = rows.selectExpr("doc_id", "text", "cast(octet_length(text) as long) as n_bytes")
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
