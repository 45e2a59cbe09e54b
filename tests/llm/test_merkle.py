"""The Merkle manifest against a plain tree, on odd rows and with small blocks, so that few rows make several tiers."""

import hashlib
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veilframe.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """All levels, from the nodes to their root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def way(levels, at):
    """[(siblings before, siblings behind)] from a node to the root."""
    out = []
    for level in levels[:-1]:
        first = at // 2 * 2
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 2])))
        at //= 2
    return out


def plain(rows):
    """(doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            path = way(trees[name], at) + way(top, k)
            changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            now = leaf((*row[:3], row[3] + 1, row[4])) if changed else leaf(row)
            for before, behind in path:
                now = digest(before + now + behind)
            out.append((row[0], leaf(row), trees[name][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(map(str, out))


def rows_of(n, seed=1):
    rng = random.Random(seed)
    langs = [None, "", "en", "en", "en", "en", "é", "z", "\U0001d11e", "￿"]
    rows = [(i if i % 11 else None, rng.choice(["s", None, "é:1"]), rng.choice(langs), rng.choice([i, None, 2**63 - 1]), rng.choice([None, "", "text", "é" * i])) for i in range(n)]
    return rows + [(5, "s", "only", 1, "a")] + [(5, "s", "en", 1, "a")] * 3


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def result(df):
    return sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])) for r in df.collect())


@pytest.mark.parametrize("n,block_levels", [(0, 10), (1, 1), (40, 1), (90, 2), (300, 10)])
def test_equals_a_plain_tree(spark, n, block_levels):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"grp": F.lit(1), "pos": F.lit("x"), "node": F.lit(None).cast("string")})
    assert result(merkle.manifest(df, tampered(), block_levels)) == plain(rows)


def test_without_tampering_all_rows_verify(spark):
    done = merkle.manifest(spark.createDataFrame(rows_of(30), SCHEMA), None, 2)
    assert done.filter("not verified or verified is null").count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == leaf((1, None, None, None, None)) and one["proof_sha256"] == digest("")
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0


def test_long_text_and_query(spark, tmp_path):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(["é" * 2_000_000, "a" * 3_000_000, None])]
    pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "source", "lang", "n_chars", "text"))}), tmp_path / "documents.parquet")
    assert result(merkle.op11_merkle(spark, str(tmp_path))) == plain(rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert result(merkle.op11_merkle(spark, SF)) == plain([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs])
