"""A Merkle manifest of a dataset: one hash tree for each group of rows, and one over the groups' roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.llm.base import Scratch, ascii_lower, column, query, table

DIGEST, FAN = 64, 16
RUN, STEPS = DIGEST * FAN, 3
BLOCK = FAN ** STEPS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def encoded(*values: Column) -> Column:
    """Values one after another, each as its length in bytes, a colon and its text, or ``-`` if null: no two rows read alike."""

    def part(value):
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[part(v) for v in values])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _numbered(nodes: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows with ``pos``, their place in their group from 0 by ``order``, and ``n``, the group's size; and the slices table.

    Range partitions over (group, order) split a group of any size. A row knows its place in its slice by itself; what stands
    before the slice is a running sum over the group's slices, of which there are at most as many as partitions.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    ordered = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered).withColumn("slice", F.shiftright("at", 33))
    along = Window.partitionBy("grp").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    slices = ordered.groupBy("grp", "slice").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    slices = scratch.keep(slices.select(
        F.col("grp").alias("slice_grp"), F.col("slice").alias("of_slice"),
        (F.coalesce(F.sum("here").over(along), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"),
    ))
    met = ordered.join(slices, _same(F.col("grp"), F.col("slice_grp")) & (F.col("slice") == F.col("of_slice")))
    return met.withColumn("pos", F.col("at") + F.col("shift")).drop("slice_grp", "of_slice", "slice", "shift", "at"), slices


def _parents(level: Column) -> Column:
    """The next level of a level string: each run of 16 digests, the last perhaps shorter, gives one."""
    starts = F.sequence(F.lit(1), F.length(level), F.lit(RUN))
    return F.array_join(F.transform(starts, lambda at: digest(F.substring(level, at, F.lit(RUN)))), "")


def _flanks(run: Column, place: Column) -> Column:
    """The digests of a run to the left and to the right of the one at ``place``."""
    return F.struct(
        F.substring(run, F.lit(1), place * DIGEST).alias("left"), F.substring(run, (place + 1) * DIGEST + 1, F.lit(RUN)).alias("right")
    )


def _blocks(nodes: DataFrame, carried: list[str], scratch: Scratch) -> DataFrame:
    """Each aligned block of 4,096 nodes as one row: its nodes in order and its levels, each one string of digests.

    ``depth`` is the number of levels above the nodes that the group still has, three at most; beyond it a level repeats the
    one below.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))
    blocks = nodes.groupBy("grp", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(members.alias("members"))
    depth = F.when(F.col("n") <= 1, 0).when(F.col("n") <= FAN, 1).when(F.col("n") <= FAN ** 2, 2).otherwise(STEPS)
    blocks = blocks.withColumn("depth", depth).withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for step in range(1, STEPS + 1):
        below = F.col(f"level{step - 1}")
        blocks = blocks.withColumn(f"level{step}", F.when(F.col("depth") >= step, _parents(below)).otherwise(below))
    return scratch.keep(blocks)


def _expanded(blocks: DataFrame, upper: DataFrame, carried: list[str]) -> DataFrame:
    """Every node of the blocks with its path: the flanks in its block, then the path of its block, given by ``upper``.

    The block's row is cut into runs, a run into its nodes, so a level string is copied for neither.
    """
    met = blocks.join(
        upper.withColumnRenamed("grp", "upper_grp").withColumnRenamed("pos", "upper_pos"),
        _same(F.col("grp"), F.col("upper_grp")) & (F.col("block") == F.col("upper_pos")),
    )

    def run(r):
        outer = F.floor(r / FAN).cast("int")
        above = F.array(
            _flanks(F.substring(F.col("level1"), outer * RUN + 1, F.lit(RUN)), r % FAN), _flanks(F.col("level2"), outer)
        )
        return F.struct(
            F.substring(F.col("level0"), r * RUN + 1, F.lit(RUN)).alias("run"), F.slice("members", r * FAN + 1, FAN).alias("nodes"),
            F.slice(above, F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))).alias("inner"), (F.col("depth") > 0).alias("any"),
        )

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / FAN).cast("int")), run)
    cut = met.select("grp", "subroot", "root", "path", F.inline(runs))
    each = cut.select("grp", "subroot", "root", "path", "run", "inner", "any", F.posexplode("nodes").alias("place", "node"))
    first = F.when(F.col("any"), F.array(_flanks(F.col("run"), F.col("place")))).otherwise(F.array())
    names = ["pos", "digest", *carried]
    return each.select("grp", *[F.col("node")[n].alias(n) for n in names], "subroot", "root", F.concat(first, "inner", "path").alias("path"))


def _trees(nodes: DataFrame, largest: int, carried: list[str], scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, from the leaves up, and (grp, digest) of the groups' roots."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, carried if not rounds else [], scratch))
        top = rounds[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col(f"level{STEPS}").alias("digest"))
        if largest <= BLOCK:
            return rounds, top.select("grp", "digest")
        nodes, largest = top, -(-largest // BLOCK)


def _down(rounds: list[DataFrame], upper: DataFrame, carried: list[str], scratch: Scratch) -> DataFrame:
    for place in range(len(rounds) - 1, -1, -1):
        found = _expanded(rounds[place], upper, carried if not place else [])
        if place:
            upper = scratch.keep(found.select("grp", "pos", "subroot", "root", "path"))
    return found


def manifest(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row (key, group, leaf, subroot, root, path) for each row of ``docs``, with the short values of ``carry``.

    A leaf is the SHA-256 of the row's ``columns``. A group's leaves ascend by key; every 16 neighbours, the last ones perhaps
    fewer, become the hash of their digests, until one remains: the subroot. The subroots, by group, give the root in the same
    way. ``path`` has the digests left and right of the row's node at every level, so that ``folded(leaf, path)`` is the root.

    Each aligned block of 4,096 nodes keeps each of its levels as one hex string; fixed-width substrings of it are hashed to
    parents and cut to the siblings of a proof, and the blocks' roots are the nodes of the next round. A group of any size is split
    over range partitions and blocks. Null groups and null keys come first; rows with equal keys stand by their leaves, and rows
    equal throughout each get their row. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    carry = carry or {}
    read = docs.select(
        column(docs, group).alias("grp"), column(docs, key).alias("key"), digest(encoded(*[column(docs, c) for c in columns])).alias("digest"),
        *[value.alias(f"carried_{name}") for name, value in carry.items()],
    )
    carried = ["key", *[f"carried_{name}" for name in carry]]
    leaves, slices = _numbered(scratch.keep(read), ["key", *[c for c in ("digest", *carried[1:])]], scratch)
    largest = slices.agg(F.max("n")).first()[0] or 0
    rounds, roots = _trees(leaves, largest, carried, scratch)
    tops, top_slices = _numbered(scratch.keep(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest")), ["name"], scratch)
    top_rounds, root = _trees(tops, top_slices.agg(F.max("n")).first()[0] or 0, ["name"], scratch)
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = root.select("grp", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("path"))
    of_groups = _down(top_rounds, start, ["name"], scratch)
    upper = scratch.keep(of_groups.select(
        F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("pos"), F.col("digest").alias("subroot"), "root", "path"
    ))
    found = _down(rounds, upper, carried, scratch)
    return found.select(
        F.col("key").alias(key), F.col("grp").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "path",
        *[F.col(f"carried_{name}").alias(name) for name in carry],
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


OP11_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS id, *, CAST(doc_id AS VARCHAR) AS name FROM documents),
crc AS (
  SELECT id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(name) + 1),
    lambda i: [CAST(ascii(substr(name, i, 1)) & 15 AS BIGINT), CAST(ascii(substr(name, i, 1)) >> 4 AS BIGINT)]))),
    lambda c, v: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
      3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][CAST((xor(c, v) & 15) + 1 AS BIGINT)])) AS c
  FROM rows_ WHERE name IS NOT NULL),
lowered AS (
  SELECT r.*, CASE WHEN xor(c, 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM rows_ r LEFT JOIN crc USING (id)),
parts AS (
  SELECT id, doc_id, source, text, changed,
    coalesce(strlen(name) || ':' || name, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM lowered),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS claimed
  FROM parts),
grouped AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
  SELECT 0 AS lvl, g, pos, leaf AS node FROM grouped
  UNION ALL
  SELECT lvl + 1, g, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM tree) WHERE n > 1 GROUP BY lvl, g, pos // 16),
subroots AS (SELECT g, arg_max(node, lvl) AS node FROM tree GROUP BY g),
crown AS (
  SELECT 0 AS lvl, 0 AS g, g - 1 AS pos, node FROM subroots
  UNION ALL
  SELECT lvl + 1, g, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM crown) WHERE n > 1 GROUP BY lvl, g, pos // 16),
root AS (SELECT arg_max(node, lvl) AS root FROM crown),
heights AS (SELECT g, max(lvl) AS height FROM tree GROUP BY g),
steps AS (
  SELECT id, t.lvl, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (16 ** t.lvl)::BIGINT), '') AS lft,
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (16 ** t.lvl)::BIGINT), '') AS rgt
  FROM grouped l JOIN heights h USING (g) JOIN tree t ON t.g = l.g AND t.lvl < h.height AND t.pos // 16 = l.pos // (16 ** (t.lvl + 1))::BIGINT
  GROUP BY id, t.lvl
  UNION ALL
  SELECT id, h.height + t.lvl, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < (l.g - 1) // (16 ** t.lvl)::BIGINT), ''),
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > (l.g - 1) // (16 ** t.lvl)::BIGINT), '')
  FROM grouped l JOIN heights h USING (g)
  JOIN crown t ON t.lvl < (SELECT max(lvl) FROM crown) AND t.pos // 16 = (l.g - 1) // (16 ** (t.lvl + 1))::BIGINT
  GROUP BY id, h.height, t.lvl),
proofs AS (SELECT id, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof FROM steps GROUP BY id),
folds AS (
  SELECT id, 0 AS lvl, claimed AS node FROM leaves
  UNION ALL
  SELECT f.id, f.lvl + 1, sha256(lft || f.node || rgt) FROM folds f JOIN steps s ON s.id = f.id AND s.lvl = f.lvl),
ends_ AS (SELECT id, arg_max(node, lvl) AS node FROM folds GROUP BY id)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.node AS folded_root, e.node = r.root AS verified
FROM grouped l JOIN subroots s USING (g) JOIN ends_ e USING (id) LEFT JOIN proofs p USING (id) CROSS JOIN root r
"""


@query("op11_manifest", OP11_SQL)
def op11_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    head = [F.col(c) for c in COLUMNS[:-1]]
    claimed = F.element_at(F.transform(F.array(ascii_lower(F.col("text"))), lambda t: digest(encoded(*head, t))), 1)
    found = manifest(docs, Scratch(spark, "op11"), carry={"claimed": F.when(tampered, claimed)})
    found = found.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
