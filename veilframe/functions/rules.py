"""Masking rules: an ordered list of regular expressions.

Rules are bound on the driver before a query is planned. A rule file has one rule a line; everything from the first # on
is a comment. Rules use Python's syntax; translated() gives the same rule for the JVM, or None where the two dialects
could differ.
"""

from __future__ import annotations

import os
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NON_ASCII = "Non-ASCII Character"
FILENAME_FORMAT = "Filename Format"

# The rules that are active by default, in order.
DEFAULT_RULES = [
    r"(?<!version=)(?<!version:)(?<!version )(?<!ver=)(?<!ver:)(?<!ver )(?<!build=)(?<!build:)(?<!build )(?<!release=)(?<!release:)(?<!release )(?<!firmware=)(?<!firmware:)(?<!firmware )(?<!fw=)(?<!fw:)(?<!fw )(?<!v)\b(?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d))\b",
    r"\b[\w\.-]+@(?:company\.com|company\.org)\b",
    r"\b(?: company\.com|company\.org)\b",
    r"\bWindows\b",
    r"\bActive Directory\b",
    r"2023",
    r"\bandy\b",
    r"\babu dhabi\b",
    r"csv",
    r"\bt1\b",
    r"\bt2\b",
    r"\bt3\b",
    r"\bt4\b",
    r"\b14andy\b",
    r"\bdhabi5\b",
]

# Categories in the order of their tests; a test is a list of alternatives, each a list of substrings that
# must all occur in the lower-cased rule.
CATEGORIES = [
    ("Email Address", [["@"], ["email"]]),
    ("IPv4 Address", [["ipv4"], [r"\d{1,3}", r"\."]]),
    ("IPv6 Address", [["ipv6"], ["[0-9a-f", ":"]]),
    ("MAC Address", [["mac"], [":", "{6}"]]),
    ("Credential / Secret", [["password"], ["passwd"], ["secret"], ["token"], ["api", "key"]]),
    ("URL", [["http"], ["url"]]),
    ("Hostname / Domain", [["host"], ["domain"]]),
    ("Identity", [["user"], ["employee"]]),
]


def active_rules(lines: Iterable[str]) -> list[str]:
    """The rules of a rule file's lines."""
    return [rule for line in lines if (rule := line.partition("#")[0].strip())]


def read_rules(path: str) -> list[str]:
    """Active rules of a file; none if there is no such file."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as file:
        return active_rules(file.read().splitlines())


def write_rules(path: str, lines: list[str]) -> list[str]:
    """Replaces a rule file as a whole, if all its rules are valid; returns the active ones."""
    if problem := invalid_rule(active_line_numbers(lines)):
        raise ValueError(problem)
    waiting = f"{path}.new"
    with open(waiting, "w", encoding="utf-8") as file:
        file.write("".join(f"{line}\n" for line in lines))
    os.replace(waiting, path)
    return active_rules(lines)


def active_line_numbers(lines: Iterable[str]) -> list[tuple[int, str]]:
    return [(number, rule) for number, line in enumerate(lines, 1) for rule in active_rules([line])]


def invalid_rule(numbered: Iterable[tuple[int, str]]) -> str | None:
    """What is wrong with the first invalid rule, or None."""
    for number, rule in numbered:
        try:
            re.compile(rule)
        except re.error as error:
            return f"Line {number}: invalid regex — {error}"
    return None


def edited(lines: list[str], action: str, index: int | None = None, rule: str = "") -> list[str]:
    """A rule list after one edit: add, edit, remove (indexes from 0) or clear."""
    if action == "clear":
        return []
    if action == "add":
        out = [*lines, rule]
    else:
        if index is None or not 0 <= index < len(lines):
            raise IndexError("no rule has this index")
        out = [*lines[:index], *([rule] if action == "edit" else []), *lines[index + 1 :]]
    if problem := invalid_rule(active_line_numbers(out)):
        raise ValueError(problem)
    return out


@lru_cache(4096)
def category(rule: str, index: int) -> str:
    """A rule's kind, told from its text; index counts from 1."""
    low = rule.lower()
    return next((name for name, tests in CATEGORIES if any(all(part in low for part in parts) for parts in tests)), f"Custom Rule {index}")


def category_column(rule, index):
    """category() as an expression."""
    low = F.lower(rule)
    out = None
    for name, tests in CATEGORIES:
        hit = None
        for parts in tests:
            both = None
            for part in parts:
                has = F.contains(low, F.lit(part))
                both = has if both is None else both & has
            hit = both if hit is None else hit | both
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.concat(F.lit("Custom Rule "), index.cast("string")))


def rule_table(spark: SparkSession, rules: list[str]) -> DataFrame:
    """rule_ix, pattern, kind."""
    rows = spark.createDataFrame(list(enumerate(rules, 1)), "rule_ix int, pattern string")
    return rows.withColumn("kind", category_column(F.col("pattern"), F.col("rule_ix")))


def keyword_table(spark: SparkSession, rules: list[str]) -> DataFrame:
    """kind, keywords: all rules of a kind, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule_ix", "pattern"))), lambda x: x["pattern"])
    return rule_table(spark, rules).groupBy("kind").agg(F.array_join(ordered, " | ").alias("keywords"))


class Untranslatable(Exception):
    pass


_CATEGORY = {sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D", sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S", sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W"}
_PLACE = {sre.AT_BEGINNING: "^", sre.AT_BEGINNING_STRING: r"\A", sre.AT_BOUNDARY: r"\b", sre.AT_NON_BOUNDARY: r"\B", sre.AT_END: "$", sre.AT_END_STRING: r"\z"}


def _character(code: int) -> str:
    if not 0x09 <= code < 0x7F:
        raise Untranslatable
    return chr(code) if chr(code).isalnum() else f"\\x{code:02x}"


def _emitted(items) -> str:
    out = []
    for op, given in items:
        if op is sre.LITERAL:
            out.append(_character(given))
        elif op is sre.NOT_LITERAL:
            out.append(f"[^{_character(given)}]")
        elif op is sre.ANY:
            out.append(".")
        elif op is sre.IN:
            out.append(_character_class(given))
        elif op is sre.AT and given in _PLACE:
            out.append(_PLACE[given])
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(_emitted(x) for x in given[1]) + ")")
        elif op is sre.SUBPATTERN and not given[1] and not given[2]:
            out.append(("(" if given[0] else "(?:") + _emitted(given[3]) + ")")
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = given
            upper = "" if high is sre.MAXREPEAT else str(high)
            out.append(f"(?:{_emitted(inner)}){{{low},{upper}}}" + "?" * (op is sre.MIN_REPEAT))
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            out.append(f"(?{'<' * (given[0] < 0)}{'=' if op is sre.ASSERT else '!'}{_emitted(given[1])})")
        else:  # references, conditions, flags inside: Python's own engine
            raise Untranslatable
    return "".join(out)


def _character_class(given) -> str:
    parts, negated = [], ""
    for op, value in given:
        if op is sre.NEGATE:
            negated = "^"
        elif op is sre.LITERAL:
            parts.append(_character(value))
        elif op is sre.RANGE:
            parts.append(f"{_character(value[0])}-{_character(value[1])}")
        elif op is sre.CATEGORY and value in _CATEGORY:
            parts.append(_CATEGORY[value])
        else:
            raise Untranslatable
    return f"[{negated}{''.join(parts)}]"


def _first_characters(items) -> set[int] | None:
    """ASCII characters that a match can begin with; None if unknown."""
    out: set[int] = set()
    for op, given in items:
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.LITERAL:
            return out | {given, ord(chr(given).lower()), ord(chr(given).upper())} if given < 128 else None
        if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) or (o is sre.CATEGORY and v is sre.CATEGORY_DIGIT) for o, v in given):
            for o, v in given:
                codes = [v] if o is sre.LITERAL else range(v[0], v[1] + 1) if o is sre.RANGE else range(48, 58)
                for code in codes:
                    if code > 127:
                        return None
                    out |= {code, ord(chr(code).lower()), ord(chr(code).upper())}
            return out
        if op is sre.SUBPATTERN:
            found = _first_characters(given[3])
            return None if found is None else out | found
        if op is sre.BRANCH:
            each = [_first_characters(x) for x in given[1]]
            return None if any(x is None for x in each) else out.union(*each)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            found = _first_characters(given[2])
            if found is None:
                return None
            out |= found
            if given[0]:
                return out
            continue
        return None
    return None


def _width(rule: str) -> tuple[int, int]:
    return parser.parse(rule, re.IGNORECASE).getwidth()


def translated(rule: str) -> str | None:
    """The rule for the JVM, on text of printable ASCII and line ends, or None if it must stay in Python: rules that can
    match nothing, references, conditions, inline flags, characters beyond ASCII. Zero-width tests that open a rule all
    hold at the same place, so a cheap look at the first character goes before them."""
    try:
        tree = parser.parse(rule, re.IGNORECASE)
        if tree.state.flags & ~(re.IGNORECASE | re.UNICODE) or tree.getwidth()[0] == 0:
            return None
        first = _first_characters(tree)
        body = _emitted(tree)
        ahead = "" if not first or len(first) > 64 else "(?=[" + "".join(_character(c) for c in sorted(first)) + "])"
        return f"(?id){ahead}{body}"
    except (Untranslatable, re.error):
        return None


def fixed_width(rule: str) -> int | None:
    """The length of every match, where all are equally long."""
    low, high = _width(rule)
    return low if low == high else None


def required_text(rule: str) -> str:
    """A lower-case ASCII string that every match contains ('' if none is known): the longest run of literals."""
    best = run = ""
    try:
        for op, given in parser.parse(rule, re.IGNORECASE):
            if op is sre.LITERAL and given < 128:
                run += chr(given).lower()
                best = max(best, run, key=len)
            elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                run = ""
    except re.error:
        pass
    return best


def required_texts(rule: str) -> frozenset[str]:
    """Lower-case ASCII strings of which every match contains one at least; none if none are known. They come from runs of literals, from
    all branches of a choice, and from what is repeated once or more; the set whose shortest string is longest."""
    try:
        return _required(parser.parse(rule, re.IGNORECASE))
    except re.error:
        return frozenset()


@lru_cache(16384)
def compiled(rule: str) -> re.Pattern:
    """The rule as a pattern. Where several look-arounds open it, a look at the first character goes before them: all hold at the
    same place, so nothing changes but the time that they take at places where no match begins."""
    pattern = re.compile(rule, re.IGNORECASE)
    tree = parser.parse(rule, re.IGNORECASE)
    opening = [op for op, _ in tree[:2]]
    if tree.state.flags & ~(re.IGNORECASE | re.UNICODE) or len(opening) < 2 or any(op not in (sre.ASSERT, sre.ASSERT_NOT) for op in opening):
        return pattern
    first = _first_characters(tree)
    return re.compile("(?=[" + "".join(f"\\x{c:02x}" for c in sorted(first)) + f"])(?:{rule})", re.IGNORECASE) if first else pattern


def plain_literal(rule: str) -> tuple[str, bool, bool] | None:
    """(lower-case literal, word border before it, word border behind it) of a rule that is nothing else; None for all others."""
    try:
        items = list(parser.parse(rule, re.IGNORECASE))
    except re.error:
        return None
    border = (sre.AT, sre.AT_BOUNDARY)
    before, behind = items[:1] == [border], len(items) > 1 and items[-1] == border
    inner = items[before : len(items) - behind]
    if not inner or not all(op is sre.LITERAL and given < 128 for op, given in inner):
        return None
    return "".join(chr(given) for _, given in inner).lower(), before, behind


def _required(items) -> frozenset[str]:
    found, run = [], ""
    for op, given in items:
        if op is sre.LITERAL and given < 128:
            run += chr(given).lower()
            continue
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        found.append(frozenset([run] if run else []))
        run = ""
        if op is sre.SUBPATTERN:
            found.append(_required(given[3]))
        elif op is sre.IN and len(given) <= 8 and all(o is sre.LITERAL and v < 128 for o, v in given):
            found.append(frozenset(chr(v).lower() for _, v in given))
        elif op is sre.BRANCH:
            each = [_required(x) for x in given[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and given[0]:
            found.append(_required(given[2]))
    found.append(frozenset([run] if run else []))
    return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=frozenset())
