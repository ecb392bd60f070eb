"""Token counts by a compiled finite-state tokenizer.

A word-level BPE tokenizer (pieces end words with ``</w>``) becomes a
deterministic transducer over bytes. A state holds, for each suffix of the read
part of a word that can still grow into a piece, the trie node of the suffix,
the last piece before it and the number of pieces up to there, relative to the
count at the current place. A transition is annotated with the number of tokens
that it emits (it can be negative: pieces merge); the emissions of a word's
transitions sum to its count. Which piece ends at a place is decided by
adjacency: two neighbouring pieces stand in an encoding exactly if their
concatenation, encoded alone, gives the two back.

The machine is compiled on demand, as lazily built automata are: unknown
transitions are added when first taken, and beyond ``MAX_STATES`` the table is
cleared and built anew, so that its memory is bounded.

Texts are cut into chunks of equal length, and one vectorised step moves all
chunks of a slice by a byte. A chunk's map from entry state to exit state and
count is constant behind its first place between words; only the part before
(the head) depends on the entry. Chunks inside a long word have no such place, so
their maps are tabulated: for the entry states that neighbours' exits propose, all
chunks at once, until no chunk's exit is a new entry of the next one. Equal chunks
share a map. A parallel prefix scan then composes the maps by doubling: after k
steps it knows each chunk's state as far as 2**k chunks behind a known one. Few
entries need tabulating, as states forget what lies far back, or repeat; a word
made so that they do neither takes a round for each chunk.

Nulls: a null text counts as empty and has no tokens; a null doc_id stays null.
Repeated rows are kept; empty tables give empty results; other columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_slices
from quarry.llm.unicode_classes import LETTER, NUMBER, OTHER, SPACE, classes, disputed, has_disputed

#: Bytes that a chunk holds.
CHUNK = 256
#: States that the machine holds before it is cleared.
MAX_STATES = 200_000
END = "</w>"
#: Symbols: a byte inside a word, 256 + a byte that ends a word, and the place between words.
GAP = 512
UNKNOWN = -1


class Machine:
    """The transducer. State 0 stands between words."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        byte = {c: b for b, c in letter.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            if a in vocab and b in vocab and a + b in vocab:
                self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.single = [vocab[letter[b]] for b in range(256)] + [vocab[letter[b] + END] for b in range(256)]
        self.symbols: dict[int, list[int]] = {}  # of a piece
        self.child: list[dict[int, int]] = [{}]
        self.piece: list[int] = [-1]
        for text, i in vocab.items():
            last = text.endswith(END) and len(text) > len(END)
            body = text[: -len(END)] if last else text
            if not all(c in byte for c in body):
                continue
            word = [byte[c] for c in body]
            if last:
                word[-1] += 256
            self.symbols[i] = word
            if self.encode(word) == [i]:  # else no encoding has it
                node = 0
                for s in word:
                    if s not in self.child[node]:
                        self.child[node][s] = len(self.child)
                        self.child.append({})
                        self.piece.append(-1)
                    node = self.child[node][s]
                self.piece[node] = i
        self.column = np.full(GAP + 1, -1, np.int32)
        self.clear()

    def encode(self, word: list[int]) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first."""
        ids = [self.single[s] for s in word]
        rank = self.rank
        while len(ids) > 1:
            best, at = min(((rank.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best == 1 << 30:
                break
            ids[at : at + 2] = [rank[ids[at], ids[at + 1]][1]]
        return ids

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.known = {start: 0}
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.columns = 1  # column 0: the gap
        self.column[:] = -1
        self.column[GAP] = 0
        # a transition: next state * 128 + emission + 64, at state * width + column
        self.width = 64
        self.moves = np.full((1024, 64), UNKNOWN, np.int32)
        self.moves[:, 0] = 64

    def fits(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = (a, b)
        found = self.adjacent.get(key)
        if found is None:
            found = self.adjacent[key] = self.encode(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def add(self, state: int, symbol: int) -> None:
        """Compile one transition."""
        chain = self.states[state]
        ended = None
        grown = []
        for node, before, count in chain:  # longest suffix first
            to = self.child[node].get(symbol)
            if to is None:
                continue
            piece = self.piece[to]
            if ended is None and piece >= 0 and self.fits(before, piece):
                ended = (piece, count + 1)
            if self.child[to]:
                grown.append((to, before, count))
        if ended is None:
            raise ValueError("a byte is missing from the vocabulary")
        piece, emitted = ended
        if not -64 <= emitted < 64:
            raise ValueError("a transition emits more than its table can hold")
        if symbol >= 256:
            to = 0
        else:
            key = (*((n, b, c - emitted) for n, b, c in grown), (0, piece, 0))
            to = self.known.get(key)
            if to is None:
                to = self.known[key] = len(self.states)
                self.states.append(key)
                if to >= len(self.moves):
                    self._grow(len(self.moves) + max(1024, len(self.moves) // 2), self.width)
        self.moves[state, self.column[symbol]] = to * 128 + emitted + 64

    def _grow(self, rows: int, columns: int) -> None:
        a = np.full((rows, columns), UNKNOWN, np.int32)
        a[:, 0] = 64
        a[: len(self.moves), : self.width] = self.moves
        self.moves, self.width = a, columns

    def columns_of(self, symbols: np.ndarray) -> np.ndarray:
        """Compact numbers of symbols; new symbols get new columns."""
        present = np.flatnonzero(np.bincount(symbols, minlength=GAP + 1))
        for s in present[self.column[present] < 0].tolist():
            if self.columns >= self.width:
                self._grow(len(self.moves), self.width + 32)
            self.column[s] = self.columns
            self.columns += 1
        return self.column[symbols].astype(np.int16)

    def step(self, state: np.ndarray, column: np.ndarray, symbol_of: np.ndarray) -> np.ndarray:
        """Move every lane by one symbol: the transitions taken."""
        at = state * self.width
        at += column
        taken = self.moves.ravel().take(at)
        if len(taken) and taken.min() < 0:
            missing = np.unique(state[taken < 0].astype(np.int64) * 1024 + column[taken < 0])
            for key in missing.tolist():
                self.add(key >> 10, int(symbol_of[key & 1023]))
            taken = self.moves[state, column]
        return taken

    def run(self, symbols: np.ndarray, chunk: int | None = None) -> np.ndarray:
        """Emissions of each symbol; the first symbol must stand at a word's start or a gap."""
        chunk = chunk or CHUNK
        if len(self.states) > MAX_STATES:
            self.clear()
        columns = self.columns_of(symbols)
        symbol_of = np.zeros(1024, np.int64)
        there = np.flatnonzero(self.column >= 0)
        symbol_of[self.column[there]] = there
        lanes = -(-len(symbols) // chunk)
        padded = np.zeros(lanes * chunk, np.int16)
        padded[: len(symbols)] = columns
        grid = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
        # places behind which the state is 0 whatever came before: a gap, or a byte that ended a word
        flags = np.ones(lanes * chunk, bool)
        flags[: len(symbols)] = symbols >= 256
        flags = flags.reshape(lanes, chunk)
        head = np.where(flags.any(axis=1), flags.argmax(axis=1) + 1, chunk)
        head[0] = 0
        # maps behind the heads, all chunks at once: a head counts as gaps
        body = np.where(np.arange(chunk)[:, None] < head, np.int16(0), grid)
        emissions = np.zeros((chunk, lanes), np.int8)
        state = np.zeros(lanes, np.int32)
        for t in range(chunk):
            taken = self.step(state, body[t], symbol_of)
            state = taken >> 7
            emissions[t] = (taken & 127) - 64
        leaves = state
        open_chunks = head == chunk
        totals = np.zeros(lanes, np.int64)
        if open_chunks.any():
            inside = np.flatnonzero(open_chunks)
            leaves[inside], totals[inside] = self.scan(grid[:, inside], inside, leaves, symbol_of)
        # heads of the other chunks take the exit state of the chunk before
        lane = np.flatnonzero((head > 0) & ~open_chunks)
        lane = lane[np.argsort(-head[lane], kind="stable")]
        length, state = head[lane], leaves[lane - 1]
        for t in range(int(length[0]) if len(lane) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))  # lanes whose heads are longer than t
            taken = self.step(state[:n], grid[t, lane[:n]], symbol_of)
            state[:n] = taken >> 7
            emissions[t, lane[:n]] = (taken & 127) - 64
        out = emissions.T.astype(np.int32)
        out[open_chunks, -1] = totals[open_chunks]  # inside a word only the sum matters
        return out.ravel()[: len(symbols)]

    def through(self, columns: np.ndarray, state: np.ndarray, symbol_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of whole chunks, a column each, from entry states."""
        state, total = state.astype(np.int32), np.zeros(len(state), np.int64)
        for row in columns:
            taken = self.step(state, row, symbol_of)
            state = taken >> 7
            total += (taken & 127) - 64
        return state, total

    def scan(self, columns: np.ndarray, lane: np.ndarray, leaves: np.ndarray, symbol_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of chunks inside words: ``columns`` of the chunks ``lane``; ``leaves``: exits of the others."""
        kinds, kind = np.unique(columns.T, axis=0, return_inverse=True)
        kind = kind.ravel().astype(np.int64)
        first = np.concatenate([[True], lane[1:] != lane[:-1] + 1])  # of a word's chunks
        last = np.concatenate([first[1:], [True]])
        low = (np.int64(1) << 32) - 1
        table = np.zeros((3, 0), np.int64)  # kind and entry as one number, sorted; exit; count
        # proposals (chunk and entry as one number): the true entries, and state 0, whose exits propose more
        fresh = np.arange(len(lane)) << 32 | np.where(first, leaves[lane - 1], 0)
        proposed = fresh[:0]
        while len(fresh):
            proposed = np.union1d(proposed, fresh)
            at, entry = fresh >> 32, fresh & low
            new = np.setdiff1d(kind[at] << 32 | entry, table[0])
            if len(new):
                left, total = self.through(kinds[new >> 32].T, new & low, symbol_of)
                table = np.concatenate([table, np.stack([new, left, total])], axis=1)
                table = table[:, np.argsort(table[0], kind="stable")]
            left = table[1, np.searchsorted(table[0], kind[at] << 32 | entry)]
            fresh = np.setdiff1d((at + 1 << 32 | left)[~last[at]], proposed)
        at, entry = proposed >> 32, proposed & low
        row = np.searchsorted(table[0], kind[at] << 32 | entry)
        ahead = np.where(last[at], np.arange(len(proposed)), np.searchsorted(proposed, at + 1 << 32 | table[1, row]))
        true = first[at] & (entry == leaves[lane - 1][at])
        for _ in range(int(len(lane)).bit_length()):  # maps composed by doubling
            true[ahead[true]] = True
            ahead = ahead[ahead]
        row = row[true]  # one for each chunk, in order
        return table[1, row].astype(np.int32), table[2, row]


class Counter:
    """Counts tokens of texts with the machine of one tokenizer."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary whose words end with </w> is asked for")
        self.machine = Machine(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.normalizer = Tokenizer.from_str(source).normalizer
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        table = np.frombuffer(classes(), np.uint8).copy()
        pre = Tokenizer.from_str(source).pre_tokenizer
        for c in disputed():
            table[c] = {1: LETTER, 4: NUMBER}.get(len(pre.pre_tokenize_str(f"a{chr(c) * 2}a")), OTHER)
        self.table = table

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if has_disputed(text):
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        plain = []
        for i, text in enumerate(texts):
            if "<|" in text and self.split is not None and any(x in text for x in self.special):
                parts = self.split.split(text)
                extra[i] = len(parts) - 1
                plain.append("\n".join(map(self.normal, parts)))
            else:
                plain.append(self.normal(text))
        sizes = np.fromiter((len(x.encode()) + 1 for x in plain), np.int64, len(plain))
        ends = np.cumsum(sizes)
        emitted = np.concatenate([[0], np.cumsum(self.machine.run(self.symbols("\n".join(plain) + "\n")), dtype=np.int64)])
        return emitted[ends] - emitted[ends - sizes] + extra

    def symbols(self, text: str) -> np.ndarray:
        """A symbol for each byte of UTF-8."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.table[points]
        before = np.concatenate([[SPACE], kind[:-1]])
        starts = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        # contractions: an apostrophe that starts a word, with what may follow it
        quotes = np.flatnonzero((points == 39) & (before != OTHER))
        if len(quotes):
            ahead = np.concatenate([points, [0, 0]])
            one, two = ahead[quotes + 1], ahead[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quotes), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            hit = quotes[short | long]
            width = np.where(short, 2, 3)[short | long]
            starts[hit + 1] = False
            after = hit + width
            inside = after < len(points)
            after = after[inside]
            starts[after] = kind[after] != SPACE
        stops = np.concatenate([starts[1:] | (kind[1:] == SPACE), [True]]) & (kind != SPACE)
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(points):
            return np.where(kind == SPACE, GAP, raw + 256 * stops.astype(np.int32)).astype(np.int16)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        last = np.cumsum(width) - 1
        ended = np.zeros(len(raw), np.int32)
        ended[last[stops]] = 256
        return np.where(np.repeat(kind, width) == SPACE, GAP, raw + ended).astype(np.int16)


@functools.lru_cache(maxsize=1)
def counter(source: str) -> Counter:
    return Counter(source)


def count_tokens(docs: DataFrame, source: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text.

    ``source`` is the text of the tokenizer's .json file. No begin, end or added
    special tokens are counted; strings of special tokens inside texts are one
    token each, as the library has it by default.
    """
    shared = docs.sparkSession.sparkContext.broadcast(source)  # a vocabulary's size, whatever the input's
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for texts, other in text_slices(batches, "doc_id"):
            n = own.count(texts)
            sizes = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(other["doc_id"], pa.int64()), pa.array(sizes), pa.array(n), pa.array(n > limit)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
