"""Prefix tree of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns (role and text); the root is the empty one. A node is named by its depth
and two 64-bit hashes: the exclusive or of hashes of (place, role, text) over its turns, so a node's name follows from
running sums and its parent's from taking one term away again.

- Places come from one sort by ranges, so a conversation of any length is dealt over many tasks.
- A node's members are counted by one aggregate. Its largest child, the one with most members (of equal ones that with
  the smallest member), continues its path; the others begin paths of their own. A light child has at most half of its
  parent's members, so no node has more than log2(conversations) light edges above it.
- Every path ends in a leaf, and the smallest member of that leaf has the path among its own turns. So the leaves'
  smallest members hold every path: the deepest light edge of such a conversation is where its path begins, the number
  of its light edges is the path's level, and the turns from there on are the path as an array by depth.
- Level by level, the deepest first, a path's total is what its nodes hold plus the totals of the paths attached to it.
- Suffix sums along every path, of the nodes and what is attached to them, are the sums over subtrees.

Running sums go in blocks of ``BLOCK`` places, so no window holds a long conversation. Where many rows look up one key
(a first turn that many share, the root's children), the ``HOT`` keys with most rows are broadcast, which is a bound,
and the others are joined; rows already answered are spread.

Turns are ordered by turn (null first), role and text; null roles and texts are empty; rows with a null or no numeric
conv_id take no part; repeated rows are repeated turns; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from motionmill.llm._shared import cut, table

BLOCK = 4096
HOT = 10_000
CHUNK = 4096
NODE = ["depth", "k1", "k2"]


def lookup(many: DataFrame, one: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """``many`` with the columns of ``one``, whose ``keys`` are unique; ``rows`` says how many rows may look a key up.

    The ``HOT`` keys with most rows are broadcast. What they answer gets a key of its own in the join on the others.
    """
    most = one.select(F.col(rows).alias("n")).orderBy(F.desc("n")).limit(HOT + 1).agg(F.count("*"), F.min("n")).first()
    some = one.select(*keys, F.struct(*[c for c in one.columns if c not in keys]).alias("found"))
    if most[0] <= HOT:
        return many.join(F.broadcast(some), keys).select(*many.columns, "found.*")
    near = some.where(F.col(f"found.{rows}") > most[1]).withColumnRenamed("found", "near")
    far = some.where(F.col(f"found.{rows}") <= most[1]).withColumn("slot", F.lit(0))
    asked = many.join(F.broadcast(near), keys, "left")
    slot = F.when(F.col("near").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*many.columns), F.lit(1 << 20)).cast("int"))
    met = asked.withColumn("slot", slot).join(far, [*keys, "slot"], "left").withColumn("found", F.coalesce("near", "found"))
    return met.where("found is not null").select(*many.columns, "found.*")


def running(df: DataFrame, key: list[str], place: str, values: dict, block: int = BLOCK) -> DataFrame:
    """``df`` with running aggregates by ``place`` (0, 1, 2, .. within ``key``), a block of places at a time.

    ``values``: name -> (aggregate, column, how two of its results add up).
    """
    df = df.withColumn("block", F.floor(F.col(place) / block))
    local = df.withColumns({n: f(F.col(c)).over(W.partitionBy(*key, "block").orderBy(place)) for n, (f, c, _) in values.items()})
    ends = local.where(F.col(place) % block == block - 1).select(*key, (F.col("block") + 1).alias("block"), *values)
    before = ends.select(*key, "block", *[f(F.col(n)).over(W.partitionBy(*key).orderBy("block")).alias(f"before_{n}") for n, (f, _, _) in values.items()])
    met = local.join(before, [*key, "block"], "left")
    total = {n: F.when(F.col(f"before_{n}").isNull(), F.col(n)).otherwise(add(F.col(n), F.col(f"before_{n}"))) for n, (_, _, add) in values.items()}
    return met.select(*df.drop("block", *values).columns, *[c.alias(n) for n, c in total.items()])


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, h1, h2, chars): every turn with its place from 1; and (conv_id, n): turns of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = conversations.select(F.col("conv_id").try_cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    # ranges take short keys, since they are sampled to the driver; a text's start may only count where the role is whole
    starts = [F.substring("role", 1, 32), F.when(F.length("role") <= 32, F.substring("text", 1, 64))]
    turn = F.col("turn").asc_nulls_first()
    dealt = named.repartitionByRange("conv_id", turn, *starts).sortWithinPartitions("conv_id", turn, "role", "text")
    rows = cut(dealt.select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars"),
    )).withColumn("part", F.shiftright("at", 33))  # a row's number: its task's above bit 33
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = rows.join(parts.withColumn("before", before), ["conv_id", "part"])
    placed = met.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "h1", "h2", "chars")
    return placed, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def share_openings(turns: DataFrame, sizes: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h = crc32(decimal c) % ``most``. Gives turns (conv_id, depth, h1, h2, chars) and sizes (conv_id, total).
    """
    c = F.col("conv_id")
    known = sizes.select(c.alias("base"), F.col("n").alias("n_base"))
    named = sizes.select("conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % most).alias("h"), (c - c % group).alias("base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = cut(named.join(known, "base", "left").select("conv_id", "n", "h", "base", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    own = lookup(turns, plan.select("conv_id", "n", "h", "k"), ["conv_id"], "n").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "h1", "h2", "chars")
    firsts = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    given = plan.where("k > 0").select("conv_id", "base", "k").join(firsts, "base").where("place <= k")
    return own.unionByName(given.select("conv_id", F.col("place").alias("depth"), "h1", "h2", "chars")), plan.select("conv_id", "total")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and member: up to ``CHUNK`` members of a node in one comma-joined text."""
    for batch in batches:
        rows = []
        new = (batch[NODE] != batch[NODE].shift()).any(axis=1).to_numpy()
        starts = [*new.nonzero()[0].tolist(), len(batch)]
        ids = batch["conv_id"].tolist()
        nodes = list(zip(*(batch[c].tolist() for c in NODE)))
        for begin, end in zip(starts, starts[1:]):
            for i in range(begin, end, CHUNK):
                rows.append((*nodes[i], ids[i], ",".join(map(str, ids[i : min(i + CHUNK, end)]))))
        yield pd.DataFrame(rows, columns=[*NODE, "conv_id", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and first member: a node's chunks run through one digest, in constant memory."""
    node, digest = None, None
    for batch in batches:
        done = []
        for *here, ids in zip(*(batch[c].tolist() for c in (*NODE, "ids"))):
            if here != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = here, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of the comma-joined members, ascending, of ``last`` (conv_id, depth, k1, k2).

    Members are sorted and joined in ranges; the digest itself takes the joined chunks of a node one after another.
    """
    kinds = "depth long, k1 long, k2 long"
    chunks = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id").mapInPandas(_chunks, f"{kinds}, conv_id long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").select(*NODE, "ids").mapInPandas(_digests, f"{kinds}, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns``: (conv_id, depth from 1, h1, h2, chars); ``sizes``: (conv_id, total) of every conversation, turnless ones too.
    """
    xor = lambda a, b: a.bitwiseXOR(b)
    tagged = turns.select("conv_id", "depth", "chars", (F.col("depth") - 1).alias("place"), F.xxhash64("h1", "h2", "depth").alias("t1"), F.xxhash64("depth", "h2", "h1", F.lit(1)).alias("t2"))
    named = running(tagged, ["conv_id"], "place", {"k1": (F.bit_xor, "t1", xor), "k2": (F.bit_xor, "t2", xor)})
    rows = cut(named.select("conv_id", *NODE, xor(F.col("k1"), F.col("t1")).alias("p1"), xor(F.col("k2"), F.col("t2")).alias("p2"), "chars"))

    top = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = [F.lit(0).cast("long").alias(c) for c in (*NODE, "p1", "p2", "chars")]
    counted = rows.groupBy(*NODE).agg(F.min("conv_id").alias("smallest"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "chars")])
    nodes = cut(counted.unionByName(top.select(*none, F.col("conv_id").alias("smallest"), "n_convs")))
    heaviest = F.max(F.struct("n_convs", (-F.col("smallest")).alias("first"), "k1", "k2"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), heaviest.alias("heavy"))
    parents = cut(nodes.select(*NODE, "smallest", "n_convs", "p1", "p2", "chars").join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = parents.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("smallest").alias("parent_conv_id"),
        F.col("heavy.k1").alias("heavy1"), F.col("heavy.k2").alias("heavy2"), F.col("n_children").alias("siblings"),
    )
    own = parents.where("depth > 0").drop("heavy")
    light = ~((F.col("k1") == F.col("heavy1")) & (F.col("k2") == F.col("heavy2")))
    known = cut(lookup(own, above, ["depth", "p1", "p2"], "siblings").withColumn("light", light).drop("heavy1", "heavy2", "siblings"))

    # the smallest member of each leaf, and its turns: every path is the end of one of these
    leaves = known.where("n_children = 0").select(F.col("smallest").alias("conv_id"))
    walked = rows.select("conv_id", *NODE).join(leaves, "conv_id", "left_semi")
    walked = cut(lookup(walked, known, NODE, "n_convs"))
    paths = walked.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("head"), F.max("depth").alias("tail"), F.sum(F.col("light").cast("long")).alias("level"))
    paths = cut(paths.withColumnRenamed("conv_id", "path"))
    on_path = lookup(walked.withColumnRenamed("conv_id", "path"), paths, ["path"], "tail").where("depth >= head")
    root = parents.where("depth = 0").select(*NODE, "smallest", "n_convs", "p1", "p2", "chars", "n_children")
    whole = root.join(paths.where("head = 0").withColumnRenamed("head", "depth"), "depth", "left").select(  # one path at most begins at the root
        F.coalesce("path", "smallest").alias("path"), *root.columns, F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("light"),
        F.lit(0).alias("head"), F.coalesce("tail", F.lit(0)).alias("tail"), F.coalesce("level", F.lit(0)).alias("level"),
    )
    saved = (F.col("n_convs") - 1) * F.col("chars")
    placed = cut(on_path.unionByName(whole).withColumns({"saved": saved, "leaves": (F.col("n_children") == 0).cast("long")}).drop("chars", "light"))

    # totals of paths, the deepest level first
    sums = [F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")]
    heads = placed.where("depth = head and depth > 0").select("path", "level", "depth", "p1", "p2")
    hung = placed.where("n_children > 1").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("path").alias("up"), "n_children")
    heads = lookup(heads, hung, ["depth", "p1", "p2"], "n_children").select("path", "level", "up", (F.col("depth") - 1).alias("at"))
    held = cut(placed.groupBy("path").agg(*sums).join(heads, "path"))
    totals = []
    for level in range(held.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = held.where(F.col("level") == level)
        if totals:
            more = totals[-1].groupBy(F.col("up").alias("path")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("further"))
            here = here.join(more, "path", "left").select("path", "level", "up", "at", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("saved", "more"), ("leaves", "further"))])
        totals.append(cut(here.select("path", "up", "at", "saved", "leaves")))
    for further in totals[1:]:
        totals[0] = totals[0].unionByName(further)

    if totals:
        attached = totals[0].groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("further"))
        placed = placed.join(attached, ["path", "depth"], "left").withColumns(
            {"saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("further", F.lit(0))})
    add = lambda a, b: a + b
    summed = running(placed.withColumn("from_tail", F.col("tail") - F.col("depth")), ["path"], "from_tail", {"saved_tokens": (F.sum, "saved", add), "n_leaves": (F.sum, "leaves", add)})

    turnless = sizes.where("total = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in NODE])
    last = rows.join(sizes.withColumnRenamed("total", "depth"), ["conv_id", "depth"], "left_semi").select("conv_id", *NODE)
    digests = ends(last.unionByName(turnless))
    return summed.join(digests, NODE, "left").select(
        F.col("smallest").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*share_openings(*ordered_turns(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
bits AS (SELECT c, n, CAST(c AS VARCHAR) AS s FROM n),
named AS (SELECT c, n, c - c % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(8 * length(s))),
    lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(s, CAST(i // 8 + 1 AS INT), 1)) AS BIGINT) ELSE 0 END) >> 1,
      3988292384 * (xor(a, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(s, CAST(i // 8 + 1 AS INT), 1)) AS BIGINT) ELSE 0 END) & 1))), 4294967295) % 6 AS h
  FROM bits),
p AS (SELECT named.*, least(h, coalesce(b.n, 0)) AS k FROM named LEFT JOIN n b ON b.c = named.base),
r AS (SELECT p.c, t.place AS depth, said FROM p JOIN t ON t.c = p.base AND t.place <= p.k
  UNION ALL SELECT p.c, t.place - p.h + p.k, said FROM p JOIN t ON t.c = p.c AND t.place > p.h),
pre AS (SELECT c, depth, length(said.x) AS chars, list(said) OVER (PARTITION BY c ORDER BY depth) AS path FROM r
  UNION ALL SELECT c, 0, 0, [] FROM n),
node AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM pre GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
sums AS (SELECT a.path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM whole JOIN pre a ON a.c = whole.conv_id AND a.depth <= whole.depth GROUP BY a.path),
last AS (SELECT c, max(depth) AS depth FROM pre GROUP BY c),
done AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM pre JOIN last USING (c, depth) GROUP BY path)
SELECT whole.conv_id, CAST(whole.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, whole.n_convs, n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM whole JOIN sums USING (path) LEFT JOIN done USING (path)
  LEFT JOIN node up ON whole.depth > 0 AND up.path = whole.path[1:whole.depth - 1]
"""
