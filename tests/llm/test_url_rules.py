"""The URL filter against SQL that enumerates all token combinations, and against plain functions."""

import itertools
import math
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, canonical
from veilframe.llm import url_rules


def plain(url):
    """(host, path, rule, verdict of the list) by the definition."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = re.split("[?#]", rest[at:], maxsplit=1)[0]
    fits = [(h + p, v) for h, p, v in url_rules.LIST if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


ODD = [
    None, "", "no host", "://", "http://", "http:///p", "http://org", "http://org/", "HTTP://ORG/x", "http://Example.ORG/es/1", "http://example.org/es", "http://example.org/en/12", "http://a.b.example.org/en/2",
    "http://notexample.org/es/1", "http://com.au/fr/1", "http://xcom/de/", "http://x.com/fr/?q#f", "http://x.com?/fr/", "http://x.com#/fr/", "http://x.com/de/1?b=2&a=1&a=3", "http://x.net/a://b/c", "http://É.com/fr/É", "http://x.com/\nfr/", "x://y://z.org/",
    "http://user@x.com:80/fr/", "http://x..com/de/", "http://.com/de/", "http://com./de/", "http://x.net/" + "long/" * 50_000, "http://x.com/de/" + "é" * 300_000,
]


def write(folder, urls):
    pq.write_table(pa.table({"page_id": pa.array([i if i != 4 else None for i in range(len(urls))], pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(["x"] * len(urls), pa.string()), "token": pa.array([1] * len(urls)), "told": pa.array(["t"] * len(urls), pa.string())}), f"{folder}/pages.parquet")


def both(spark, folder):
    ours = url_rules.op12_url_rules(spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    columns = sorted(ours.columns)
    return ours, canonical(ours, columns), canonical(con.execute(url_rules.ORACLE_OP12).df(), columns)


def test_odd_urls(spark, tmp_path):
    rng = random.Random(4)
    made = [f"http://{rng.choice(['a.', 'b.', ''])}{rng.choice(['x', 'y'])}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['fr', 'de', 'en'])}/{rng.randrange(99)}{rng.choice(['', '?u=1', '#t', '.html'])}" for _ in range(150)]
    urls = ODD + made + made[:40]
    write(tmp_path, urls)
    ours, a, b = both(spark, str(tmp_path))
    assert a == b and len(ours) == len(urls)
    got = sorted(map(str, zip(ours.host, ours.path, ours.rule.where(ours.rule.notna(), None))))
    assert got == sorted(str(plain(u)[:3]) for u in urls)
    told = {(r.host, r.path): r.verdict for r in ours.itertuples() if isinstance(r.rule, str)}
    assert all(told[plain(u)[:2]] == plain(u)[3] for u in urls if plain(u)[2])


def test_rules_are_all_that_hold(spark):
    """mined() against a loop over all combinations of tokens."""
    rng = random.Random(7)
    rows = [([f"{k}={rng.randrange(3)}" for k in "abcd"[: rng.randrange(1, 5)]], rng.choice(["allow", "block", "block"])) for _ in range(120)]
    rows += [(["a=9", "b=9"], "allow")] * 10
    count = {}
    for tokens, verdict in rows:
        for n in range(len(tokens) + 1):
            for own in itertools.combinations(sorted(tokens), n):
                for what in ((own, None), (own, verdict)):
                    count[what] = count.get(what, 0) + 1
    least = math.ceil(0.05 * len(rows))
    rules = {k: (n / count[k[0], None], n / len(rows)) for k, n in count.items() if k[0] and k[1] and n >= least and n / count[k[0], None] >= 0.7}
    stay = {k: v for k, v in rules.items() if not any((k[0][:i] + k[0][i + 1 :], k[1]) in rules and rules[k[0][:i] + k[0][i + 1 :], k[1]][0] >= v[0] for i in range(len(k[0])))}
    got = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.7).collect()
    assert {(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in got} == stay and stay


def test_few_tokens_a_url(spark):
    urls = spark.createDataFrame([(u,) for u in ODD], "url string")
    made = urls.select(url_rules.tokens(F.col("url"), url_rules.host(F.col("url")), url_rules.path(F.col("url"))).alias("t")).collect()
    assert all(len(r["t"]) <= 10 and len({x.partition("=")[0] for x in r["t"]}) == len(r["t"]) and "=" not in {x[:1] for x in r["t"]} for r in made)


@pytest.mark.parametrize("urls", [[], ["http://x.net/a/b", None], ["http://x.org/"]])
def test_small_tables(spark, tmp_path, urls):
    write(tmp_path, urls)
    ours, a, b = both(spark, str(tmp_path))
    assert a == b and list(ours.verdict) == ["allow"] * len(urls)


def test_query_equals_sql(spark):
    _, a, b = both(spark, SF)
    assert a == b
