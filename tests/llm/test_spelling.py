"""Spelling variants against plain loops, with small indexes, so that groups are cut into blocks."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF, canonical
from veilframe.llm import spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    """(doc_id, text) -> result rows."""
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: sorted((-words[v], v) for v in words if one_apart(w, v)) for w in words}
    form = {w: v[0][1] if v and -v[0][0] >= 2 * words[w] else None for w, v in near.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abéÿ", min_size=1, max_size=9), unique=True, max_size=90))
def test_kernel(words):
    a, b = spelling.near_pairs(words)
    assert len(set(zip(a, b))) == len(a) and set(zip(a.tolist(), b.tolist())) == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_apart(x, y)}


def made_docs(n=400, seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    docs = []
    for i in range(n):
        own = []
        for _ in range(40):
            w = list(rng.choice(base[: rng.randrange(1, 60)]))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "é", "×"])
            own.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        docs.append((i if i % 13 else None, rng.choice([" ", "1", "\n", "ß_"]).join(own)))
    return docs + [(5, None), (6, ""), (7, "12 34 ıĀ")] + docs[:3]


@pytest.mark.parametrize("chunk", [4, 16, 1024])
def test_equals_plain_loops(spark, chunk):
    docs = made_docs()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    assert result(spelling.variants(df, chunk)) == plain(docs)


def test_large_groups_and_chains(spark):
    words = ["axbxc" + c for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö÷øùúûü"]
    docs = [(i, " ".join(words)) for i in range(3)] + [(10, "axbxca " * 500 + "aaaaaaa " * 3 + "aaaaaab " * 6 + "aaaaabb " * 12 + "aaaabbb " * 24 + "aaabbbb " * 48)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (3, 1024):
        got = spelling.variants(df, chunk)
        assert result(got) == plain(docs)
    assert {r["word"]: r["root"] for r in got.collect()}["aaaaaaa"] == "aaabbbb"


def test_long_texts_and_words(spark, tmp_path):
    long = "ab" * 300_000
    docs = [(i, f"{long} {long[:1000]}c{long[1000:]} short {'words and others ' * 60_000}") for i in range(3)]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}), tmp_path / "documents.parquet")
    got = {r["word"][:1005]: r for r in spelling.op13_spelling(spark, str(tmp_path)).collect()}
    assert got["ab" * 500 + "ababa"]["n_near"] == 1 == got["ab" * 500 + "cabab"]["n_near"] and got["others"]["n_near"] == 0


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, "other " * 3)]])
def test_small_tables(spark, docs):
    assert result(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_query_equals_sql_and_loops(spark):
    ours = spelling.op13_spelling(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = sorted(ours.columns)
    assert canonical(ours.toPandas(), columns) == canonical(con.execute(spelling.ORACLE_OP13).df(), columns)
    assert result(ours) == plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
