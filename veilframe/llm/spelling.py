"""Groups of spelling variants: words that differ by one letter, each pointed at the most frequent of its likes.

Words and their counts come from all texts by SQL functions. Words that differ by one inserted, deleted or replaced letter agree in all
letters but those of one of SEGMENTS parts, so each word goes under the hashes of what is left without each part (parts of its own
length, and of the length below, where the longer word's part has one letter more). Inside of such groups a bit-sliced position index finds
the pairs: a bitset over the group's words for each (position, letter), and for all words at once the sets that agree with a query
so far without error or with one, which move on by word-parallel recurrences; the bitsets of the next and of the last position serve
words with a letter more or less. Small groups share an index, up to `chunk` words. Groups of more than twice as many are cut into blocks by a hash, and each
pair of blocks is a group of its own, so no group meets in one task whole and no pair is lost.

Roots are found by pointer jumping over written tables: a form has at least twice the count of its word, so the ways are short and end.

A null text has no words; a null doc_id counts as an empty string in the hash that deletes letters. Repeated rows count as often as they are
there. Of near words with equal counts the first in code-point order is the form. Very long texts and words are taken whole; an empty
table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, give_back, staged, table
from .merkle import SQL_CRC, sql_crc
from .url_rules import LOWER, UPPER

RUN = "[A-Za-zÀ-ÿ]+"
DELETE_EVERY, MIN_LENGTH, MIN_COUNT = 97, 5, 3
SEGMENTS = 3
CHUNK = 1024  # words of an index
CELLS = 1 << 22  # words times letters of the longest one, at most, unless a single group has more


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """doc_id, text -> word, n: words of min_length letters and min_count places at least. In every delete_every-th run, by a hash of its
    document and itself, a letter is deleted."""
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    each = each.filter(F.length("run") >= min_length).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    each = each.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = each.select(F.when(F.col("h") % delete_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def group_keys(word: Column) -> Column:
    """array<struct<size, key>>: the groups in which a word can meet those with one letter replaced, more or less."""
    out = []
    for longer in (0, 1):
        size = F.length(word) - longer
        for k in range(SEGMENTS):
            start, stop = F.floor(size * k / SEGMENTS).cast("int"), F.floor(size * (k + 1) / SEGMENTS).cast("int") + longer
            out.append(F.struct(size.alias("size"), F.xxhash64(size, F.lit(k), F.left(word, start), F.substr(word, stop + 1)).alias("key")))
    return F.array(*out)


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, near word) of all words that differ by one inserted, deleted or replaced letter. The words are different ones."""
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")  # queries that are done leave from the end
    lengths = lengths[order]
    points = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, codes = np.unique(points, return_inverse=True)
    n, longest = len(words), int(lengths[0])
    laid = np.full((longest + 2, n), len(letters), np.int32)  # by position; no letter beyond a word's end
    starts = np.cumsum(lengths) - lengths
    laid[np.arange(len(points)) - np.repeat(starts, lengths), np.repeat(np.arange(n), lengths)] = codes
    width = -(-n // 64) * 64

    def bits(rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((*rows.shape[:-1], width), bool)
        wide[..., :n] = rows
        return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)

    alphabet = np.arange(len(letters))[:, None]
    at = lambda p: bits(laid[p][None, :] == alphabet)  # noqa: E731  a bitset for each letter at the position
    none = np.zeros((len(letters), width // 64), np.uint64)
    before, here = none, at(0)
    exact = np.repeat(bits(np.ones((1, n), bool)), n, axis=0)
    replaced, inserted, deleted = (np.zeros_like(exact) for _ in range(3))
    queries, found = [], []
    for p in range(longest):
        behind = at(p + 1)
        live = int(np.searchsorted(-lengths, -p, side="left"))  # queries longer than p
        exact, replaced, inserted, deleted = exact[:live], replaced[:live], inserted[:live], deleted[:live]
        own = laid[p, :live]
        same, later = here[own], behind[own]
        deleted = (deleted & before[own]) | exact
        replaced = (replaced & same) | (exact & ~same & bits(lengths > p))
        inserted = (inserted | exact) & later
        exact = exact & same
        before, here = here, behind
        first = int(np.searchsorted(-lengths, -(p + 1), side="left"))
        if first < live:  # queries of p + 1 letters end here
            done = slice(first, live)
            hits = (replaced[done] & bits(lengths == p + 1)) | ((inserted[done] | exact[done]) & bits(lengths == p + 2)) | (deleted[done] & bits(lengths == p))
            row, word = np.nonzero(hits)
            each = np.unpackbits(hits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(each)
            queries.append(row[which] + first)
            found.append(word[which] * 64 + bit)
    return order[np.concatenate(queries)], order[np.concatenate(found)]


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, n -> word, near, near_n: a row for each ordered pair of near words, some of them more than once."""
    members = staged(words.select("word", "n", F.explode(group_keys(F.col("word"))).alias("g")).select("word", "n", "g.size", "g.key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("here")).filter("here > 1")
    blocks = F.when(F.col("here") > 2 * chunk, F.ceil(F.col("here") / chunk)).otherwise(1).cast("int")
    dealt = members.join(sizes, "key").select("word", "n", "size", "key", blocks.alias("blocks")).withColumn("own", F.expr("int(pmod(xxhash64(word, 1), blocks))"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = dealt.select("word", "n", "size", "key", "own", other).select("word", "n", "size", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))

    def pairs(group: pa.Table) -> pa.RecordBatch:
        coded = group.column("word").combine_chunks().dictionary_encode()
        known = coded.dictionary
        n = np.zeros(len(known), np.int64)
        n[coded.indices.to_numpy()] = group.column("n").to_numpy()
        a, b = near_pairs(known.to_pylist())
        return pa.RecordBatch.from_arrays([known.take(pa.array(a)), known.take(pa.array(b)), pa.array(n[b])], names=["word", "near", "near_n"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows.cast(rest.schema)])
            cuts, left = _cuts(rest, chunk)
            for start, stop in cuts:
                yield pairs(rest.slice(start, stop - start))
            rest = rest.slice(left)
        if rest is not None and rest.num_rows:
            cuts, left = _cuts(rest, chunk)
            for start, stop in [*cuts, (left, rest.num_rows)]:
                yield pairs(rest.slice(start, stop - start))
        give_back()

    return units.repartition("unit").sortWithinPartitions("size", "unit").mapInArrow(find, "word string, near string, near_n long")


def _cuts(rows: pa.Table, chunk: int) -> tuple[list[tuple[int, int]], int]:
    """Ranges of rows for an index each, made of whole units, and where the rows begin that wait for more: the last unit may go on."""
    unit = rows.column("unit").to_numpy()
    size = rows.column("size").to_numpy()
    ends = np.flatnonzero(np.diff(unit)) + 1
    out, start, last = [], 0, 0
    for end in ends.tolist():
        if last > start and (end - start > chunk or (end - start) * (int(size[end - 1]) + 1) > CELLS):
            out.append((start, last))
            start = last
        last = end
    if last - start >= chunk:
        out.append((start, last))
        start = last
    return out, start


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the end of each word's way over forms. A word has one form at most and no way is a circle."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        dropped(now)
        if further.filter("moved").limit(1).isEmpty():
            return further.drop("moved")
        now = further.drop("moved")
        now.staged_at = further.staged_at


def variants(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text -> word, form, root, n, n_near, form_n."""
    words = staged(word_counts(docs))
    pairs = near_words(words, chunk).repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))  # a word has a bounded number of near ones
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("likely", -F.col("best.less") >= 2 * F.col("n"))
    found = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("likely"), F.col("best.near")).alias("form"), F.when(F.col("likely"), -F.col("best.less")).alias("form_n")))
    dropped(words)
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE_OP13 = f"""
WITH RECURSIVE {SQL_CRC},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{LOWER}') AS run FROM documents),
c AS (SELECT d, run, count(*) AS n FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
h AS (SELECT run, n, {sql_crc("d || ':' || run")} AS h FROM c, crc_table),
w AS (SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
v AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM v a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM v a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, near := near)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * words.n THEN b.near END AS form, CASE WHEN -b.less >= 2 * words.n THEN -b.less END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT way.word, way.next, forms.form FROM way JOIN forms ON forms.word = way.next)
SELECT forms.word, forms.form, way.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN way ON way.word = forms.word AND way.next IS NULL
"""
