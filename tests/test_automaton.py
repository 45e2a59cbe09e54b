"""Masking by an automaton is the plain fold, whatever the rules are."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_masking import EDGES, plain
from veilframe.functions.automaton import RuleSet, masked_by_automaton, rule_totals
from veilframe.functions.rules import DEFAULT_RULES, plain_literal, required_texts

LISTS = [DEFAULT_RULES, [], [r"foo\s", "X+"], ["a*"], [r"(a)\1", "é"], [r"(?:company|windows)\.com|xyz", "(ab|cd)+", "(ab|c?)+", "xx", "csv", "XXX"], ["aba", r"\bab", r"cd\b", r"\b1.2\b", r"\b\.com\b", "bab", "csv\n", "2023", "t1t1", r"\babc"], [r"a(?=b)", r"(?:2023){1,3}", "[ab]cd", "t1|", "|t2"]]


def sparse(text, rules):
    masked, counts = plain(text, rules)
    return masked, [(i, n) for i, n in enumerate(counts) if n]


@pytest.mark.parametrize("rules", LISTS)
def test_edges(rules):
    own = RuleSet(rules)
    for text in [*EDGES, "COMPANY.COM abcdab xyz", "İ ſ K csv", "ababab ccc t2 xXx"]:
        assert own.mask(text) == sparse(text, rules), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "x", "1", "aba", "abc", "_", ".com", ".", " ", "\n", "é", "csv", "t1", "2023", "ab", "cd", "xyz", "windows.com", "10.0.0.1"]), max_size=30), st.sampled_from(LISTS))
def test_is_the_fold(parts, rules):
    text = "".join(parts)
    assert RuleSet(rules).mask(text) == sparse(text, rules)


def test_required_texts():
    cases = {r"\\b(?:company\\.com|company\\.org)\\b": {"company."}, "(ab|cd)+e": {"ab", "cd"}, "(ab|c?)+": set(), "a|b": {"a", "b"}, "(?:abc)*d": {"d"}, "[a-z]+": set(), "(": set(), "Ab{2}cd": {"cd"}, "(?=abc)x": {"x"}}
    for rule, texts in cases.items():
        assert required_texts(rule.replace("\\\\", "\\")) == texts, rule
    for rule in DEFAULT_RULES:
        assert required_texts(rule)


def test_plain_literals():
    assert plain_literal(r"\bAndy\b") == ("andy", True, True) and plain_literal("csv") == ("csv", False, False) and plain_literal(r"a\.b\b") == ("a.b", False, True)
    for rule in (r"\b", r"\b\b", "a+", "(a)", "[a]b|c", "é", "(", r"\Bab", "^ab", ""):
        assert plain_literal(rule) is None, rule


def many_rules(n):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(2 * n)})
    rng.shuffle(words)
    forms = [r"\b{}\b", "{}", r"{}\d*", "(?:{}|{}s)", "{}x?", r"[.]{}"]
    return [rng.choice(forms).replace("{}", w) for w in words[:n]], words


def test_two_thousand_rules(spark):
    rules, words = many_rules(2000)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(words) + rng.choice(["", "s", "9", ".", "é"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate([*texts, None, ""])], "i int, text string, place string").repartition(3)
    begun = time.time()
    done = masked_by_automaton(df, "text", rules)
    rows = {r["i"]: r for r in done.collect()}
    took = time.time() - begun
    begun = time.time()
    compiled = [re.compile(r, re.I) for r in rules]
    for i, text in enumerate(texts):
        now, counts = re.subn(r"[^\x20-\x7E\n\r]", "X", text)
        want = [(0, counts)] if counts else []
        for place, pattern in enumerate(compiled, 1):
            now, n = pattern.subn(lambda m: "X" * len(m[0]), now)
            if n:
                want.append((place, n))
        assert (rows[i]["masked"], [tuple(f) for f in rows[i]["found"]], rows[i]["total"]) == (now, want, sum(n for _, n in want))
    print(f"2,000 rules, 150 texts: {took:.2f} s, the plain fold {time.time() - begun:.2f} s")
    assert rows[150]["masked"] is None and rows[150]["found"] is None and rows[150]["total"] is None and rows[151]["masked"] == ""
    totals = {r["place"]: r["n"] for r in rule_totals(done, rules).collect()}
    assert len(totals) == 2001 and sum(totals.values()) == sum(r["total"] or 0 for r in rows.values())


def test_the_plan_does_not_grow(spark):
    df = spark.createDataFrame([("a",)], "text string")
    plans = [masked_by_automaton(df, "text", many_rules(n)[0])._jdf.queryExecution().optimizedPlan().toString() for n in (10, 2000)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) and len(plans[1]) < 2000
