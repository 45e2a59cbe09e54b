"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups' roots.

A level of a tree is kept as one string of hex digests, cut into aligned blocks of 2**BLOCK_LEVELS nodes. Inside a block, parents are hashes
of substrings of 128 characters, the sibling of a node is the substring beside its own, and a block ends in one digest. These are the
nodes of the next tier, which is cut into blocks again, and so on to the root. All of it is SQL functions; nothing is gathered but
one block, and the driver learns the size of the largest group only.

The nodes of a group are numbered through a range sort: places within sorted partitions plus what lies before them.

Every 2 consecutive nodes become the hash of both; a last node that stands alone becomes the hash of itself, until one is left. A
group of one leaf has it as its root. Null groups are a group of their own, before all others. Rows of a group ascend by doc_id, null
first; repeated ids by their leaves, and wholly repeated rows in the order in which they are read, which shows in no value. Null
values are told from empty ones. Very long texts are hashed whole. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, staged, table

BLOCK_LEVELS = 10  # levels that are folded inside of a block; 1,024 nodes are 64 kB
TAMPER = 7

# Levels of a tree over n nodes, and how many of them lie in a block of this tier.
DEPTH = "IF(n > 1, length(bin(n - 1)), 0)"
EACH = "IF({0} > 0, sequence(0, {0} - 1), array())"
LEVELS = (
    "aggregate({each}, array(cast(array_join(transform(nodes, x -> x.node), '') AS binary)), (done, i) -> concat(done, array(cast(array_join("
    "transform(sequence(0, (octet_length(element_at(done, -1)) - 1) div 128), k -> sha2(substring(element_at(done, -1), cast(k * 128 + 1 AS int), 128), 256)), '') AS binary))))"
).format(each=EACH.format("steps"))
# The substrings beside a node's own, level by level; there is none beside a last node that stands alone.
SIBLINGS = f"transform(nodes, (x, j) -> struct(x, cast(array_join(transform({EACH.format('steps')}, i -> cast(substring(levels[i], (shiftright(j, i) ^ 1) * 64 + 1, 64) AS string)), '') AS binary) AS own))"


def sized(value: Column) -> Column:
    """A value with its length in front, so that neighbours can't run into each other; null is told from empty."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(sized, (doc_id, source, lang, n_chars, text))), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row in its group `grp` by the given order, and n, the rows of the group. Staged."""
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    by = ["grp", *order, "__salt"]  # equal rows don't have to meet in one partition
    ranged = staged(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("__salt").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    # A row for each group in each partition.
    heads = ranged.groupBy("grp", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__here"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("__here").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("grp", "__part", (before - F.col("__first")).alias("__move"), F.sum("__here").over(group).alias("n"))
    out = ranged.join(heads, ["grp", "__part"]).withColumn("pos", F.col("__at") + F.col("__move")).drop("__at", "__part", "__move")
    out.staged_at = ranged.staged_at
    return out


def blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    """One tier: grp, block, n, steps, nodes (in order, with all columns), levels. Staged."""
    own = [c for c in nodes.columns if c not in ("grp", "n")]
    one = nodes.select("grp", "n", F.shiftright("pos", block_levels).alias("block"), F.struct("pos", *(c for c in own if c != "pos")).alias("x"))
    cut = one.groupBy("grp", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("x")).alias("nodes"))
    cut = cut.withColumn("steps", F.least(F.expr(DEPTH), F.lit(block_levels)).cast("int"))
    return staged(cut.withColumn("levels", F.expr(LEVELS)))


def climb(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The tiers of the trees over nodes (grp, pos, n, node and more columns): the last one has a single block for each group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [blocks(nodes, block_levels)]
    while most > 1 << block_levels:
        most = -(-most >> block_levels)
        above = tiers[-1].select("grp", F.col("block").alias("pos"), F.expr(f"shiftright(n + {(1 << block_levels) - 1}, {block_levels})").alias("n"), F.element_at("levels", -1).cast("string").alias("node"))
        tiers.append(blocks(above, block_levels))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """grp, node: the root of each group's tree."""
    return tiers[-1].select("grp", F.element_at("levels", -1).cast("string").alias("node"))


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the first tier with n and segment: the digests of their siblings up to the root, as binary text. tops has a row for
    each grp, whose columns come along."""
    more = [c for c in tops.columns if c != "grp"]
    above = tops.withColumn("block", F.lit(0).cast("long")).withColumn("rest", F.lit(b""))
    for k in range(len(tiers) - 1, -1, -1):
        each = tiers[k].join(above, ["grp", "block"]).select("grp", "n", "rest", *more, F.explode(F.expr(SIBLINGS)).alias("s"))
        rest = F.concat("s.own", "rest")
        if k:
            above = each.select("grp", F.col("s.x.pos").alias("block"), rest.alias("rest"), *more)
        else:
            out = each.select("grp", "n", "s.x.*", rest.alias("segment"), *more)
    return out


def folded(node: str, segment: str, pos: str, n: str) -> Column:
    """The root that a node and the digests of its siblings lead to (names of columns)."""
    depth = DEPTH.replace("n >", f"{n} >").replace("(n -", f"({n} -")
    sibling = f"substring({segment}, a.at, 64)"
    there = f"((shiftright({pos}, i) ^ 1) <= shiftright({n} - 1, i))"
    pair = f"CASE WHEN NOT {there} THEN cast(a.h AS binary) WHEN shiftright({pos}, i) % 2 = 1 THEN concat({sibling}, cast(a.h AS binary)) ELSE concat(cast(a.h AS binary), {sibling}) END"
    return F.expr(f"aggregate({EACH.format(depth)}, struct({node} AS h, 1 AS at), (a, i) -> struct(sha2({pair}, 256) AS h, a.at + IF({there}, 64, 0) AS at), a -> a.h)")


def manifest(docs: DataFrame, tampered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of documents. Where `tampered` (of doc_id) holds, the
    root is folded from the leaf with 1 added to n_chars, in place of the leaf itself; the siblings are the same."""
    own = ("doc_id", "source", "lang", "n_chars", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    changed = F.col("n_chars").cast("decimal(20,0)") + 1
    given = leaf(*(changed if c == "n_chars" else F.col(c) for c in own))
    held = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    # Groups in the order of their languages: none first, then by bytes.
    leaves = rows.select(F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit("")).alias("grp"), "doc_id", leaf(*map(F.col, own)).alias("node"), F.when(held, given).alias("given"))
    nodes = numbered(leaves, ["doc_id", "node"])
    tiers = climb(nodes, block_levels)
    dropped(nodes)
    groups = numbered(roots(tiers).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
    upper = climb(groups, block_levels)
    dropped(groups)
    tops = descend(upper, roots(upper).withColumnRenamed("node", "root"))
    tops = staged(tops.select(F.col("name").alias("grp"), F.col("node").alias("subroot"), "root", F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), F.col("segment").alias("top_segment")))
    dropped(*upper)
    done = descend(tiers, tops).withColumn("start", F.coalesce("given", "node"))
    done = done.withColumn("middle", folded("start", "segment", "pos", "n")).withColumn("folded_root", folded("middle", "top_segment", "top_pos", "top_n"))
    return done.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(F.concat("segment", "top_segment"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0)


# CRC-32 in SQL: a table of 256 remainders, and a fold over the bytes of a text.
SQL_CRC = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS t FROM range(256) r(k))"""


def sql_crc(text: str) -> str:
    """CRC-32 of a text, where crc_table is joined in."""
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _sql_leaf(n_chars: str) -> str:
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR END"
    return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _sql_tree(name: str, nodes: str, keys: str) -> str:
    """CTEs {name}_up (all nodes by level) and {name}_walk (each node's way to the root) over nodes(grp, pos, n, h, given, keys)."""
    return f"""
{name}_up AS (SELECT grp, 0 AS level, pos, n, h FROM {nodes}
  UNION ALL SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_up WHERE n > 1 GROUP BY grp, level, pos // 2, n),
{name}_all AS MATERIALIZED (SELECT * FROM {name}_up),
{name}_walk AS (SELECT grp, {keys}, 0 AS level, pos, n, given AS h, '' AS proof FROM {nodes}
  UNION ALL SELECT w.grp, {keys}, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
  FROM {name}_walk w LEFT JOIN {name}_all s ON s.grp = w.grp AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
{name}_top AS (SELECT * FROM {name}_walk WHERE n = 1)"""


ORACLE_OP11 = f"""
WITH RECURSIVE {SQL_CRC},
d AS (SELECT coalesce(':' || lang, '') AS grp, doc_id, {_sql_leaf('n_chars')} AS h, CASE WHEN {sql_crc('doc_id::VARCHAR')} % 7 = 0 THEN {_sql_leaf('(n_chars + 1)')} ELSE {_sql_leaf('n_chars')} END AS given FROM documents, crc_table),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_sql_tree('a', 'leaves', 'doc_id, leaf').replace('SELECT grp, doc_id, leaf, 0', 'SELECT grp, doc_id, h AS leaf, 0')},
subroots AS (SELECT grp AS name, h, h AS given FROM a_all WHERE n = 1),
groups AS MATERIALIZED (SELECT '' AS grp, name, h, given, row_number() OVER (ORDER BY encode(name)) - 1 AS pos, count(*) OVER () AS n FROM subroots),
{_sql_tree('b', 'groups', 'name')},
way AS (SELECT b_top.name, groups.h AS subroot, groups.pos, groups.n, b_top.h AS root, b_top.proof FROM b_top JOIN groups USING (name)),
last_walk AS (SELECT a_top.doc_id, a_top.leaf, a_top.proof || way.proof AS proof, way.subroot, way.root, 0 AS level, way.pos, way.n, a_top.h FROM a_top JOIN way ON way.name = a_top.grp
  UNION ALL SELECT w.doc_id, w.leaf, w.proof, w.subroot, w.root, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END)
  FROM last_walk w LEFT JOIN b_all s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM last_walk WHERE n = 1
"""
