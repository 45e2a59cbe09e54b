"""Masking with long rule lists: one pass over a text finds the rules that can match at all.

Every rule has strings of which each of its matches contains one (required_texts). An Aho-Corasick automaton over those of all
rules reads a text once; strings of one or two characters, which would be met everywhere, are looked for one by one. Only the rules that are found run, in
their order, each on what the one before has left, as in the plain fold; of those that are a plain string, with word borders or without, the
automaton has told all places where they can match, and only these are looked at. Masking writes nothing but X, so a string without an x that
is not there at first never comes; strings with one are looked for again when it is their rule's turn, and rules without strings always run.

The plan is one node for any number of rules, and hits are told for the rules that have some. Null text stays null.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .masking import OUTSIDE, sliced
from .rules import compiled, plain_literal, required_texts

LEAST = 3  # characters of a string for the automaton


def _crosses(match: re.Match) -> str:
    return "X" * (match.end() - match.start())


WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


class RuleSet:
    """Rules with their automaton; patterns are compiled when they first run."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.outside = re.compile(OUTSIDE)
        self.always: list[int] = []
        self.late: dict[int, list[bytes]] = {}  # strings with an x, looked for when it is the rule's turn
        self.literals: dict[int, tuple[bytes, bool, bool]] = {}
        short: dict[str, list[int]] = {}
        long: dict[str, list[int]] = {}
        for place, rule in enumerate(rules, 1):
            texts = required_texts(rule)
            whole = plain_literal(rule)
            if whole:
                texts = frozenset([whole[0]])
            if not texts or any("x" in t for t in texts):
                self.always.append(place)
                self.late[place] = [t.encode() for t in texts]
                texts = frozenset()
            if whole and (place in self.late or len(whole[0]) >= LEAST):
                self.literals[place] = whole[0].encode(), *whole[1:]
            for text in texts:
                (long if len(text) >= LEAST else short).setdefault(text, []).append(place)
        self.short = list(short.items())
        self.long = list(long.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, text in enumerate(long):
            self.automaton.add_word(text, number)
        if long:
            self.automaton.make_automaton()
        self.compiled: dict[int, re.Pattern] = {}

    def possible(self, low: str) -> dict[int, list[int]]:
        """The rules, by place and in order, that can match a lower-case text or what masking makes of it, with the places where their
        string ends."""
        found: dict[int, list[int]] = {place: [] for place in self.always}
        for needed, places in self.short:
            if needed in low:
                found.update(dict.fromkeys(places, []))
        if self.long:
            ends: dict[int, list[int]] = {}
            for end, number in self.automaton.iter(low):
                if number in ends:
                    ends[number].append(end + 1)
                else:
                    ends[number] = [end + 1]
            for number, own in ends.items():
                found.update(dict.fromkeys(self.long[number], own))
        return dict(sorted(found.items()))

    def mask(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """(masked text, [(place, hits)]): place 0 is the masking of characters outside of printable ASCII."""
        hits = []
        if not (text.isascii() and text.isprintable()):
            text, n = self.outside.subn(_crosses, text)
            if n:
                hits.append((0, n))
        low = text.lower()
        raw, lower = bytearray(text, "ascii"), bytearray(low, "ascii")  # the text as it is by now; text is None where it is not
        for place, ends in self.possible(low).items():
            late = self.late.get(place)
            if late and not any(t in lower for t in late):
                continue
            if place in self.literals:
                n = _cross_out(raw, lower, _ends(lower, late[0]) if late else ends, *self.literals[place])
                if n:
                    text = None
            else:
                if text is None:
                    text = raw.decode("ascii")
                pattern = self.compiled.get(place)
                if pattern is None:
                    pattern = self.compiled[place] = compiled(self.rules[place - 1])
                text, n = pattern.subn(_crosses, text)
                if n:
                    raw = bytearray(text, "ascii")
                    lower = raw.lower()
            if n:
                hits.append((place, n))
        return raw.decode("ascii") if text is None else text, hits


def _ends(lower: bytearray, literal: bytes) -> list[int]:
    """Where a literal ends, overlapping places included."""
    out, at = [], lower.find(literal)
    while at >= 0:
        out.append(at + len(literal))
        at = lower.find(literal, at + 1)
    return out


def _cross_out(raw: bytearray, lower: bytearray, ends: list[int], literal: bytes, before: bool, behind: bool) -> int:
    """Masks a literal at the places where it can be, in both forms of the text; the number of hits."""
    n, free, width = 0, 0, len(literal)
    for end in ends:
        at = end - width
        if at < free or lower[at:end] != literal:  # inside of the last hit, or masked since
            continue
        if before and (at > 0 and raw[at - 1] in WORD) == (raw[at] in WORD):
            continue
        if behind and (end < len(raw) and raw[end] in WORD) == (raw[end - 1] in WORD):
            continue
        raw[at:end], lower[at:end] = b"X" * width, b"x" * width
        n, free = n + 1, end
    return n


@lru_cache(8)
def rule_set(pickled: bytes) -> RuleSet:
    """Workers keep the rule sets that they have built."""
    return RuleSet(pickle.loads(pickled))


HITS = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())]))
_ARROW_HITS = pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int64())]))


def masked_by_automaton(df: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """df with masked (string), found (array<struct<place, n>>: the rules with hits, in order; place 0 is step 0) and total."""
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(list(rules)))  # as large as the rule list
    schema = T.StructType([*df.schema.fields, T.StructField("masked", T.StringType()), T.StructField("found", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rule_set(sent.value)
        for batch in sliced(batches, column):
            texts, hits = [], []
            for value in batch.column(column):
                text = value.as_py()
                done = (None, None) if text is None else own.mask(text)
                texts.append(done[0])
                hits.append(None if done[1] is None else [{"place": p, "n": n} for p, n in done[1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(hits, _ARROW_HITS)], names=[*batch.schema.names, "masked", "found"])

    return df.mapInArrow(run, schema).withColumn("total", F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"]))


def rule_totals(done: DataFrame, rules: list[str]) -> DataFrame:
    """place, rule, n for every rule, with 0 where it has no hits; place 0 has no rule. One row a rule is made before any shuffle."""
    known = done.sparkSession.createDataFrame([(0, None), *enumerate(rules, 1)], "place int, rule string")
    counts = done.select(F.explode("found").alias("f")).groupBy("f.place").agg(F.sum("f.n").alias("n"))
    return known.join(counts, "place", "left").select("place", "rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
