"""Token counts by a finite-state tokenizer.

A BPE vocabulary with an end-of-word mark is compiled into a deterministic transducer over bytes. A transition carries how
much the number of tokens grows (or shrinks, where a byte lets tokens merge). A state holds, for every place where a
vocabulary entry could have begun, the trie node reached since, the last token before that place and its count; states are
built when a text first needs them (lazy determinisation). The last token of a prefix is the only entry that ends there and
may follow the last token before it; two tokens may follow each other if BPE of both together gives just these two.

The byte that ends a word leads back to the start state, so a chunk's state map is a constant behind the first word end in
it. All chunks of a piece step together from the start state. Maps of chunks inside of long words are worked out for the states
that their predecessors can end in, usually one or two, and a prefix scan composes them in logarithmically many steps; the bytes before a
chunk's first word end are then redone from the state that its predecessors lead to. Pieces of long texts follow each other, each from
the state in which the last one ended.

Between steps only the states of the piece's chunks are in use. Beyond STATE_LIMIT states, or PLACE_LIMIT open places in them, all others
are forgotten and built anew when needed, inside of a text and of a word as well.

Null text counts as empty: no bytes, no tokens. Special strings in a text count as one token, as by the library's default.
Very long texts are counted whole. Repeated rows and ids are rows of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
END = 256  # added to the byte that ends a word
CHUNK = 128
PIECE = CHUNK << 13  # symbols whose chunks step together
STATE_LIMIT, PLACE_LIMIT = 60_000, 1_000_000  # then the lazily built part starts anew, but for the states in use
PAIR_LIMIT = 500_000  # remembered answers on pairs of tokens
WIDTH = 32  # states in which a chunk's predecessor can end; with more of them the word's chunks are settled one by one
FEW = 4  # entries below a trie node, so that states keep answers in place of the token before
# The code points with the Unicode property White_Space.
WHITE_SPACE = frozenset([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the
    other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


State = tuple[tuple[int, int, int], ...]
START: State = ((0, -1, 0),)


class Transducer:
    def __init__(self, model: dict):
        letters = byte_alphabet()
        suffix = model["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            ended = token.endswith(suffix) and len(token) > len(suffix)
            coded = [letters[c] for c in (token[: -len(suffix)] if ended else token)]
            return (*coded[:-1], coded[-1] + END) if ended else tuple(coded)

        self.spelled = {i: symbols(t) for t, i in model["vocab"].items() if all(c in letters for c in t.removesuffix(suffix))}
        self.single = {s[0]: i for i, s in self.spelled.items() if len(s) == 1}
        vocab = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, spelling in self.spelled.items():
            node = 0
            for s in spelling:
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][s]
            self.token_at[node] = token
        self.below = self.few_below()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.ids, self.places = [START], {START: 0}, 1
        self.next = np.full((1024, 256), -1, np.int32)
        self.emit = np.zeros((1024, 512), np.int8)
        self.ended = np.zeros((1024, 256), bool)
        self.open: dict[tuple[int, int], int] = {}
        if len(self.pairs) > PAIR_LIMIT:
            self.pairs.clear()

    def few_below(self) -> list[tuple[int, ...] | None]:
        """The vocabulary entries below each node, None where there are more than FEW."""
        out: list[tuple[int, ...] | None] = [()] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):  # children come behind their parents
            found: list[int] = []
            for child in self.children[node].values():
                if out[child] is None:
                    found = [0] * (FEW + 1)
                    break
                found += [self.token_at[child]] if self.token_at[child] >= 0 else []
                found += out[child]
            out[node] = tuple(found) if len(found) <= FEW else None
        return out

    def stands_for(self, node: int, before: int) -> int:
        """What a state must know of the token before an open place: the token itself, or, where few entries can still
        come of the node, which of these may follow it (-2 - bits; -2 alone: none, the place is dead)."""
        below = self.below[node]
        if below is None or before < -1:
            return before
        key = node, before
        if key not in self.open:
            self.open[key] = -2 - sum(1 << i for i, token in enumerate(below) if self.follows(before, token))
        return self.open[key]

    def allowed(self, node: int, child: int, before: int, token: int) -> bool:
        return self.follows(before, token) if before >= -1 else bool(-2 - before >> self.below[node].index(token) & 1)

    def narrowed(self, node: int, child: int, before: int) -> int:
        """stands_for() of a child, from what stands for the node."""
        if before >= -1:
            return self.stands_for(child, before)
        bits, of = -2 - before, self.below[node]
        return -2 - sum(1 << i for i, token in enumerate(self.below[child]) if bits >> of.index(token) & 1)

    def bpe(self, spelling: tuple[int, ...]) -> list[int]:
        parts = [self.single[s] for s in spelling]
        while len(parts) > 1:
            best = min((self.merges[p] + (i,) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=None)
            if best is None:
                break
            rank, whole, at = best
            parts[at : at + 2] = [whole]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """May the token stand right behind this one (-1: at the start of a word)?"""
        key = before, token
        if key not in self.pairs:
            alone = [token] if before < 0 else [before, token]
            self.pairs[key] = self.bpe((self.spelled[before] if before >= 0 else ()) + self.spelled[token]) == alone
        return self.pairs[key]

    def add(self, state: int, symbol: int) -> None:
        """Works out one transition."""
        moved, found = [], None
        for node, before, count in self.states[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if found is None and token >= 0 and self.allowed(node, child, before, token):
                found = token, count + 1
            if symbol < END and self.children[child] and (known := self.narrowed(node, child, before)) != -2:
                moved.append((child, known, count))
        if found is None:
            raise ValueError(f"no token ends with symbol {symbol}")
        token, change = found
        self.emit[state, symbol] = change
        if symbol >= END:
            self.ended[state, symbol - END] = True
            return
        self.next[state, symbol] = self.number((*((n, b, c - change) for n, b, c in moved), (0, token, 0)))

    def number(self, state: State) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
            self.places += len(state)
            if at == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
                self.ended = np.concatenate([self.ended, np.zeros_like(self.ended)])
        return at

    def bounded(self, used: np.ndarray) -> np.ndarray:
        """The numbers of the states in use, after all others are forgotten if there are too many."""
        for memo in (self.pairs, self.open):
            if len(memo) > PAIR_LIMIT:
                memo.clear()
        if len(self.states) <= STATE_LIMIT and self.places <= PLACE_LIMIT:
            return used
        known, at = np.unique(used, return_inverse=True)
        kept = [self.states[i] for i in known.tolist()]
        self.reset()
        return self.numbers(kept)[at]

    def numbers(self, states: list[State]) -> np.ndarray:
        return np.array([self.number(s) for s in states], np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(following states, changes of the count) of many places at once."""
        low = symbols & 255
        ends = symbols >= END
        while True:
            at = states * 256 + low
            following = np.where(ends, 0, self.next.reshape(-1)[at])
            unknown = (following < 0) | (ends & ~self.ended.reshape(-1)[at])
            if not unknown.any():
                return following, self.emit.reshape(-1)[states * 512 + symbols]
            for key in np.unique(states[unknown].astype(np.int64) * 512 + symbols[unknown]).tolist():
                self.add(key // 512, key % 512)

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """What every symbol of a sequence adds to the number of tokens; the sequence begins with a word."""
        out, state = np.empty(len(symbols), np.int8), START
        for begin in range(0, len(symbols), PIECE):
            piece = symbols[begin : begin + PIECE]
            out[begin : begin + len(piece)], state = self.piece(piece, state, begin + PIECE < len(symbols))
        return out

    def piece(self, symbols: np.ndarray, before: State, goes_on: bool) -> tuple[np.ndarray, State]:
        """The same for a piece that begins in a state, and the state behind it if the sequence goes on."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        laid = np.full(chunks * CHUNK, END + 32, np.int32)
        laid[:n] = symbols
        laid = np.ascontiguousarray(laid.reshape(chunks, CHUNK).T)
        out = np.empty((CHUNK, chunks), np.int8)
        states = np.zeros(chunks, np.int64)
        for k in range(CHUNK):
            states, out[k] = self.step(self.bounded(states), laid[k])
            states = states.astype(np.int64)
        ends = laid >= END
        first = np.where(ends.any(axis=0), ends.argmax(axis=0), CHUNK)  # a chunk's map is constant if it has a word end
        # From here on states are held by what they are: their numbers change when others are forgotten.
        into = [before, *(self.states[s] for s in states.tolist())]
        self.settle(laid, first == CHUNK, into)
        moving = np.array([c for c in range(chunks) if into[c] != START], np.int64)
        now = self.numbers([into[c] for c in moving.tolist()])
        for k in range(min(int(first[moving].max(initial=-1)) + 1, CHUNK)):
            live = first[moving] >= k
            moving, now = moving[live], self.bounded(now[live])
            now, out[k, moving] = self.step(now, laid[k, moving])
            now = now.astype(np.int64)
        return out.T.reshape(-1)[:n], into[chunks] if goes_on else START

    def through(self, laid: np.ndarray, chunks: np.ndarray, before: list[State]) -> list[State]:
        """The states behind whole chunks."""
        states = self.numbers(before)
        for k in range(CHUNK):
            states = self.step(self.bounded(states), laid[k, chunks])[0].astype(np.int64)
        return [self.states[s] for s in states.tolist()]

    def settle(self, laid: np.ndarray, is_open: np.ndarray, into: list[State]) -> None:
        """Corrects the states behind open chunks, which have no word end. `into` has the states before all chunks and behind the
        last one; it comes with what the start state leads to."""
        opened = np.flatnonzero(is_open)
        if not len(opened):
            return
        starts = np.r_[True, np.diff(opened) > 1]
        place = np.arange(len(opened)) - np.maximum.accumulate(np.where(starts, np.arange(len(opened)), 0))
        # Maps: {state before: state behind} of each open chunk, for what its predecessor can end in; the first of a run has one.
        maps: list[dict[State, State]] = [{} for _ in opened]
        new = [(i, into[c]) for i, c in enumerate(opened.tolist())]
        wide = np.zeros(len(opened), bool)
        while new:
            behind = self.through(laid, opened[[i for i, _ in new]], [s for _, s in new])
            following = []
            for (i, s), e in zip(new, behind):
                maps[i][s] = e
            for (i, _), e in zip(new, behind):
                if i + 1 < len(opened) and place[i + 1] and e not in maps[i + 1] and not wide[i + 1]:
                    maps[i + 1][e] = START
                    following.append((i + 1, e))
                    wide[i + 1] = len(maps[i + 1]) > WIDTH
            new = following
        run = np.cumsum(starts) - 1
        slow = np.zeros(run[-1] + 1, bool)
        slow[run[wide]] = True
        fits = ~slow[run]
        # Scan: after a step, composed[i] leads from the states before 2 * step chunks up to i to those behind i.
        names = [{s: k for k, s in enumerate(own)} for own in maps]
        behind = [names[i + 1] if i + 1 < len(opened) and place[i + 1] else {e: k for k, e in enumerate(dict.fromkeys(own.values()))} for i, own in enumerate(maps)]
        composed = np.zeros((len(opened), max(len(own) for own in maps)), np.int64)
        for i in np.flatnonzero(fits).tolist():
            composed[i, : len(maps[i])] = [behind[i][e] for e in maps[i].values()]
        step = 1
        while step <= place.max():
            later = np.flatnonzero(place >= step)
            composed[later] = np.take_along_axis(composed[later], composed[later - step], axis=1)
            step *= 2
        ends = [list(own) for own in behind]
        for i in np.flatnonzero(fits).tolist():
            into[opened[i] + 1] = ends[i][composed[i, 0]]
        for i in np.flatnonzero(~fits).tolist():
            into[opened[i] + 1] = self.through(laid, opened[i : i + 1], [into[opened[i]]])[0]


class Counter:
    def __init__(self, spec: dict):
        self.machine = Transducer(spec["model"])
        specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.marks = {x[0] for x in specials}
        self.kinds = np.zeros(0x110000, np.uint8)

    def classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if not kinds.all():
            for p in np.unique(points[kinds == 0]).tolist():
                category = unicodedata.category(chr(p))[0]
                self.kinds[p] = SPACE if p in WHITE_SPACE else LETTER if category == "L" else NUMBER if category == "N" else OTHER
            kinds = self.kinds[points]
        return kinds

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case character by character (a sigma at a word's end gets no form of its own)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word_ends(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Which characters end a word: runs of letters, single numbers, runs of other characters, and the English
        contractions behind a lone apostrophe. Nothing is a word across white space."""
        n = len(points)
        pad = np.zeros(3, np.uint8)
        kind, point = np.concatenate([kinds, pad]), np.concatenate([points, pad.astype(points.dtype)])
        before = np.concatenate([[SPACE], kinds[:-1]])
        starts = np.concatenate([(kinds != SPACE) & ((kinds != before) | (kinds == NUMBER)), [True] * 3])
        lone = np.flatnonzero((points == ord("'")) & (before != OTHER) & (kind[1 : n + 1] == LETTER))
        one, two = point[lone + 1], point[lone + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((lone[short], 2), (lone[long], 3)):
            starts[found + 1] = False
            after = found + size
            starts[after[kind[after] == LETTER]] = True
        return (kinds != SPACE) & (starts[1 : n + 1] | (kind[1 : n + 1] == SPACE))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        clean = []
        for i, text in enumerate(texts):
            if any(m in text for m in self.marks):
                parts = self.special.split(text)
                extra[i] = len(parts) - 1
                clean.append(" ".join(map(self.normal, parts)))
            else:
                clean.append(self.normal(text))
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in clean])])
        joined = " ".join(clean) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes(points)
        ends = self.word_ends(points, kinds)
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        last = np.cumsum(widths) - 1
        symbols = raw.astype(np.int32)
        symbols[last[ends]] += END
        inside = np.repeat(kinds != SPACE, widths)
        sums = np.zeros(len(raw) + 1, np.int64)
        emitted = np.zeros(len(raw), np.int8)
        if inside.any():
            emitted[inside] = self.machine.changes(symbols[inside])
        np.cumsum(emitted, out=sums[1:], dtype=np.int64)
        at = np.concatenate([[0], last + 1])[bounds]
        return sums[at[1:]] - sums[at[:-1]] + extra


_counters: dict[str, Counter] = {}


def counter(raw: bytes) -> Counter:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(json.loads(raw))
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_tokens, over_limit."""
    with open(vocabulary, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the vocabulary file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(raw.value)
        for batch in sliced(batches, "text", 2 << 20):
            n = own.count([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
