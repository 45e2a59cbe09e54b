import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions.masking import OUTSIDE, hits_by_kind, is_native, mask_ranges, mask_text, masked
from veilframe.functions.rules import DEFAULT_RULES, active_rules, category, edited, fixed_width, invalid_rule, read_rules, required_text, rule_table, translated, write_rules

IPV4 = [DEFAULT_RULES[0]]


def plain(text, rules):
    """The definition, word for word."""
    text, n = re.subn(OUTSIDE, lambda m: "X" * len(m[0]), text)
    counts = [n]
    for rule in rules:
        text, n = re.subn(rule, lambda m: "X" * len(m[0]), text, flags=re.IGNORECASE)
        counts.append(n)
    return text, counts


def test_addresses():
    assert mask_text("src=10.20.30.40 dst=8.8.8.8", IPV4) == ("src=XXXXXXXXXXX dst=XXXXXXX", 2, {"IPv4 Address": 2})
    assert mask_text("1.2.3.4", IPV4)[:2] == ("XXXXXXX", 1)
    assert mask_text("version=1.2.3.4.5", IPV4)[0] == "version=1.XXXXXXX"  # only the place where a match begins is looked behind


@pytest.mark.parametrize("text", ["version=1.2.3.4", "Version 7.4.2.1", "ver:10.2.3.4", "build=3.12.4.1", "release:2.5.6.7", "firmware=4.3.2.1", "fw:6.5.4.3", "v1.2.3.4", "999.999.999.999", "256.1.1.1", "10.20.30.999"])
def test_versions_and_wrong_octets_stay(text):
    assert mask_text(text, IPV4) == (text, 0, {})


EDGES = ["", "a\tb", "andyé", "foo\r\nbar\rbaz\n", "t1 T1 t1t1", "𝄞 csv", "company.com x company.com domain=company.com company.org", "me.you@company.com", "Active Directory", "2023-2023", "csvcsv", " ", "1.2.3.4 5.6.7.8", "version=1.2.3.4.5", "abu dhabi ABU DHABI"]


@pytest.mark.parametrize("rules", [DEFAULT_RULES, [], [r"foo\s", "X+"], [r"[a&&b]", r"[[]", "a{,2}b"], [r"(?P<n>c)sv", r"\bT\d\b", r"[^a-z]o"], ["a*"], [r"(a)\1", "é"], [r"e$", "^a.b"]])
def test_both_paths_follow_the_definition(spark, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*EDGES, None])], "i int, text string")
    for native in [True, False] if is_native(rules) else [False]:
        for row in masked(df, "text", rules, native).collect():
            if row["text"] is None:
                assert row["masked"] is None and row["hits"] is None and row["total"] is None
            else:
                assert (row["masked"], row["hits"]) == plain(row["text"], rules), (row["text"], native)
                assert row["total"] == sum(row["hits"]) and len(row["masked"]) == len(row["text"])


def test_rules_that_stay_in_python():
    for rule in ("a*", r"(a)\1", "é", "(?s)a", "(?=a)", "(a)?(?(1)b|c)d"):
        assert translated(rule) is None, rule
    assert is_native(DEFAULT_RULES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "&", "[", "1", ".", " ", "\n", "é", "csv", "t1", "2023", "10.0.0.1"]), max_size=30))
def test_prefilter_changes_nothing(parts):
    text = "".join(parts)
    got, total, _ = mask_text(text, DEFAULT_RULES)
    want, counts = plain(text, DEFAULT_RULES)
    assert (got, total) == (want, sum(counts))


def test_ranges():
    text, ranges = mask_ranges("é andy 2023", DEFAULT_RULES)
    assert text == "X XXXX XXXX" and [text[a:b] for a, b, _ in ranges] == ["X", "XXXX", "XXXX"]
    assert [k for *_, k in ranges] == ["Non-ASCII Character", "Custom Rule 6", "Custom Rule 7"]


def test_categories(spark):
    rules = [r"a@b", "email", r"\d{1,3}\.", "ipv6", "[0-9a-f]:", "machine", "x{6}:", "TESTSECRET", "api.key", "http", "hosted", "employee", "plain"]
    kinds = ["Email Address", "Email Address", "IPv4 Address", "IPv6 Address", "IPv6 Address", "MAC Address", "MAC Address", "Credential / Secret", "Credential / Secret", "URL", "Hostname / Domain", "Identity", "Custom Rule 13"]
    assert [category(r, i) for i, r in enumerate(rules, 1)] == kinds
    assert [r["kind"] for r in rule_table(spark, rules).orderBy("rule_ix").collect()] == kinds


def test_rule_files(tmp_path):
    path = str(tmp_path / "rules.txt")
    assert read_rules(path) == []
    assert write_rules(path, ["# note", "abc # tail", "", "d#e"]) == ["abc", "d"] == read_rules(path)
    with pytest.raises(ValueError, match="Line 2"):
        write_rules(path, ["ok", "("])
    assert read_rules(path) == ["abc", "d"]
    assert active_rules(["  x  "]) == ["x"] and invalid_rule([(1, "x")]) is None
    assert edited(["a", "b"], "remove", 0) == ["b"] and edited(["a"], "edit", 0, "c") == ["c"] and edited(["a"], "add", rule="b") == ["a", "b"] and edited(["a"], "clear") == []
    with pytest.raises(IndexError):
        edited(["a"], "remove", 1)
    assert fixed_width(r"\bandy\b") == 4 and fixed_width("a+") is None and required_text(r"\bActive Directory\b") == "active directory"


def test_kind_counts_and_plan(spark):
    df = spark.createDataFrame([("é 2023 andy andy",)], "text string")
    done = masked(df, "text", DEFAULT_RULES)
    assert done.select(hits_by_kind(F.col("hits"), DEFAULT_RULES).alias("k")).first()["k"] == {"Non-ASCII Character": 1, "Custom Rule 6": 1, "Custom Rule 7": 2}
    plan = done.filter("total > 0")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filters_on_other_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "TESTSECRET"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    done = masked(spark.read.parquet(str(tmp_path / "t")), "text", DEFAULT_RULES)
    plan = done.filter("doc_id = 2 and total >= 0")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,2)]" in plan
    assert done.filter("total > 0").count() <= 1 and done.filter("doc_id = 2").first()["masked"] is None and len(plan) < 500_000
