"""Conversation prefix trie by parallel tree contraction.

Every distinct sequence of first d turns (role, text) is a node.  Turns become two 64-bit
content hashes as soon as they are read; a prefix is the sum, over its turns, of
hashes of (position, content) -- 128 bits in four 32-bit lanes that cannot overflow -- so
prefix keys are running sums of the sequence scan, and a conversation that holds a third
of all rows is cut into ranges like any other log.

Subtree totals (childless nodes, saved tokens) come from alternating, in join rounds,

* rake: childless nodes hand their totals to their parents and go;
* compress: of every chain of nodes with one child, nodes that are not neighbours
  hand what they have to their parent and link their child to it.  Node and child are
  told apart by one bit of their depths, another bit each round, so a chain halves;

until the root is left: O(log depth + log nodes) rounds.  Then the rounds are undone, the
last first: a compressed node's total is what it had plus its child's total.  All
joins are on keys that are unique on both sides; nodes with many children only meet
partial aggregates.  Every round is a written table.

Defined cases: rows without conv_id belong to no conversation; null role or text is
empty; turns come in order of turn (null first), equal ones by the MD5 of role and text;
repeated rows are separate turns; conv_id % n takes the sign of conv_id; a conversation
without turns ends at the root; an empty table gives an empty result; other columns
are ignored."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtstats.llm.common import materialise, word_count
from courtstats.operators.sequence import scan

LANES = ("s1", "s2", "s3", "s4")
PIECE = 1 << 16  # conversation ids of one piece of an ends list
MANY, MOST_HOT = 10_000, 100_000
LOW32 = 0xFFFFFFFF


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), c1, c2 (content hashes), words: the turns in order, without text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.md5(F.concat(role, F.lit("|"), text).cast("binary")).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("c1"), F.xxhash64(F.lit(2), role, text).alias("c2"),
        word_count(text).alias("words"))
    return scan(d, "conv_id", ["turn", "tie"], number="pos").drop("turn", "tie")


def share_heads(own: DataFrame, heads: int = 4, block: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c: the first h turns of conversation c - c % block, then
    its own turns after its first h; h = crc32(c as text) % heads.  Returns the
    rebuilt turns (with depth) and the conversations (conv_id)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % block)
    first = own.where((F.col("pos") < heads) & (F.col("conv_id") % block == 0)).select(
        F.col("conv_id").alias("_b"), F.col("pos").alias("depth"), "c1", "c2", "words")
    lent = convs.where("h > 0").join(first, (F.col("base") == F.col("_b")) & (F.col("depth") <= F.col("h")))
    short = convs.where("h > 0").join(first.groupBy("_b").agg(F.count("*").alias("_n")), F.col("base") == F.col("_b"), "left").select(
        F.col("conv_id").alias("_c"), (F.col("h") - F.coalesce("_n", F.lit(0))).alias("lack")).where("lack > 0")
    # a long conversation meets its row of `short` in several places
    short = short.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rest = own.withColumn("h", h).where("pos > h")
    rest = rest.join(short, (F.col("conv_id") == F.col("_c")) & (F.pmod("pos", F.lit(16)) == F.col("_p")), "left").withColumn(
        "depth", F.col("pos") - F.coalesce("lack", F.lit(0)))
    cols = ["conv_id", "depth", "c1", "c2", "words"]
    return rest.select(*cols).unionByName(lent.select(*cols)), convs.select("conv_id")


def _key(depth: Column, lanes: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *lanes), F.xxhash64(*lanes, depth)]


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, words, (k1, k2): key of the prefix, (p1, p2): of the one before it."""
    e1, e2 = F.xxhash64("depth", "c1"), F.xxhash64("depth", "c2")
    lanes = [e1.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(e1, 32), e2.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(e2, 32)]
    d = rebuilt.select("conv_id", "depth", "words", *[x.alias("e" + s) for s, x in zip(LANES, lanes)])
    d = scan(d, "conv_id", "depth", sums={s: "e" + s for s in LANES})
    depth = F.col("depth")
    own = _key(depth, [F.col(s) for s in LANES])
    before = _key(depth - 1, [F.col(s) - F.col("e" + s) for s in LANES])
    return d.select("conv_id", "depth", "words", *[x.alias(n) for n, x in zip(("k1", "k2", "p1", "p2"), own + before)])


def _root_key(n: str) -> Column:
    zero = F.lit(0).cast("long")
    return _key(zero, [zero] * len(LANES))[int(n[-1]) - 1].alias(n)


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes``: k1, k2, p1, p2 (null for the one root), depth and longs ``values``.
    Returns k1, k2 and the values summed over every node's subtree."""
    count = nodes.where("p1 is not null").groupBy(F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).agg(F.count("*").alias("m"))
    state = materialise(nodes.join(count, (F.col("k1") == F.col("_p1")) & (F.col("k2") == F.col("_p2")), "left")
                        .select("k1", "k2", "p1", "p2", "depth", *values, F.coalesce("m", F.lit(0)).alias("m")), "trie")
    inner = F.col("p1").isNotNull()
    raked, compressed, at = [], [], 0
    while state.where(inner).limit(1).count():
        if at > 400:
            raise RuntimeError("tree contraction did not settle")
        # rake
        leaf = F.col("m") == 0
        raked.append(state.where(inner & leaf).select("k1", "k2", *values))
        kids = state.where(inner).groupBy(F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).agg(
            *[F.sum(F.when(leaf, F.col(v))).alias("_" + v) for v in values], F.count_if(~leaf).alias("_m"),
            F.min(F.when(~leaf, F.struct("k1", "k2", "depth"))).alias("child"))
        left = state.where(~leaf).join(kids, (F.col("k1") == F.col("_p1")) & (F.col("k2") == F.col("_p2")), "left")
        # compress: a node whose depth has the bit and whose only child's has not (or the reverse)
        bit = at % 32
        mine, its = (F.shiftright(F.col(c), bit).bitwiseAND(F.lit(1).cast("long")) for c in ("depth", "child.depth"))
        want = 1 - (at // 32) % 2
        chosen = inner & (F.col("_m") == 1) & (mine == want) & (its == 1 - want)
        left = left.select("k1", "k2", "p1", "p2", "depth", *[(F.col(v) + F.coalesce("_" + v, F.lit(0))).alias(v) for v in values],
                           F.coalesce("_m", F.lit(0)).alias("m"), F.when(F.col("_m") == 1, F.col("child")).alias("child"),
                           F.coalesce(chosen, F.lit(False)).alias("chosen"))
        left = materialise(left, "trie")
        out = left.where("chosen")
        compressed.append(out.select("k1", "k2", *values, F.col("child.k1").alias("c1"), F.col("child.k2").alias("c2")))
        none = F.lit(None).cast("struct<p1:bigint,p2:bigint>")
        notes = out.select("child.k1", "child.k2", F.struct("p1", "p2").alias("_to"), *[F.lit(0).cast("long").alias("_" + v) for v in values])
        notes = notes.unionByName(out.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), none.alias("_to"),
                                             *[F.col(v).alias("_" + v) for v in values]))
        notes = notes.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(
            F.max("_to").alias("_to"), *[F.sum("_" + v).alias("_" + v) for v in values])
        stay = left.where("not chosen").join(notes, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
        state = materialise(stay.select(
            "k1", "k2", F.coalesce("_to.p1", "p1").alias("p1"), F.coalesce("_to.p2", "p2").alias("p2"), "depth",
            *[(F.col(v) + F.coalesce("_" + v, F.lit(0))).alias(v) for v in values], "m"), "trie")
        at += 1
    # undo the rounds: what went after round r is known when r is undone
    known = state.select("k1", "k2", *values)  # the root
    later = None
    for r in range(len(raked) - 1, -1, -1):
        if later is not None:
            have = later.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), *[F.col(v).alias("_" + v) for v in values])
            back = compressed[r].join(have, (F.col("c1") == F.col("_k1")) & (F.col("c2") == F.col("_k2")))
            back = materialise(back.select("k1", "k2", *[(F.col(v) + F.col("_" + v)).alias(v) for v in values]), "trie")
            later = later.unionByName(back).unionByName(raked[r])
        else:
            later = raked[r]
    return known if later is None else known.unionByName(later)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 per node of its conversation ids, ascending and comma-joined.  Ids are joined in pieces of
    an id range first; a node's pieces then stream through one hash in order, so a node at
    which a third of all conversations end holds one piece in memory at a time."""
    pieces = ends.groupBy("k1", "k2", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches):
        import pyarrow as pa

        at, sha = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"k1": at[0], "k2": at[1], "sha": sha.hexdigest()}],
                                              pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())]))
        for b in batches:
            out = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if at != (k1, k2):
                    if at:
                        out.append(row())
                    at, sha = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if at:
            yield row()

    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece").mapInArrow(
        digest, "k1 long, k2 long, sha string")


def trie(conversations: DataFrame, heads: int = 4, block: int = 20) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (see the head of the module)."""
    rebuilt, convs = share_heads(materialise(turns(conversations), "trie"), heads, block)
    convs = materialise(convs, "trie")
    rows = materialise(prefixes(rebuilt), "trie")
    ends = convs.join(rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("e")), "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col("e." + n), _root_key(n)).alias(n) for n in ("k1", "k2")])
    nodes = rows.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                                         F.count("*").alias("n_convs"), F.max("words").alias("words"),
                                         F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        _root_key("k1"), _root_key("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs",
        F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = nodes.unionByName(root)
    kids = nodes.where("p1 is not null").groupBy(F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).agg(F.count("*").alias("_m"))
    nodes = materialise(nodes.join(kids, (F.col("k1") == F.col("_p1")) & (F.col("k2") == F.col("_p2")), "left").select(
        "k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "words", F.coalesce("_m", F.lit(0)).alias("n_children")), "trie")
    totals = subtree_totals(nodes.select(
        "k1", "k2", "p1", "p2", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    # parents: the at most MOST_HOT ones with very many children are broadcast, all others joined
    many = max(MANY, nodes.count() // MOST_HOT)
    up = nodes.where("n_children > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"),
                                              F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    on = (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    hot = F.broadcast(up.where(F.col("_n") > many))
    linked = nodes.join(hot, on).drop("_k1", "_k2", "_n")
    other = nodes.join(hot, on, "left_anti").join(up.where(F.col("_n") <= many), on, "left").drop("_k1", "_k2", "_n")
    t = totals.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    sha = _digests(ends).withColumnsRenamed({"k1": "_e1", "k2": "_e2"})
    out = linked.unionByName(other).join(t, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).join(
        sha, (F.col("k1") == F.col("_e1")) & (F.col("k2") == F.col("_e2")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda y: [CAST(ord(y) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, y:
      CASE WHEN xor(a, y) % 2 = 1 THEN xor(xor(a, y) >> 1, 3988292384) ELSE xor(a, y) >> 1 END, CAST(4294967295 AS BIGINT)))"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') || '|' || coalesce(text, '') AS m,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
         md5(to_json([coalesce(role, ''), coalesce(text, '')])::VARCHAR) AS item,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || '|' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
rb AS (
  SELECT cs.c, 0 AS part, pos, item, words FROM cs JOIN t ON t.c = cs.c - cs.c % 20 AND pos <= h
  UNION ALL SELECT cs.c, 1, pos, item, words FROM cs JOIN t ON t.c = cs.c AND pos > h),
num AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM rb),
p AS (
  SELECT c, d, words, md5(string_agg(item, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM num
  UNION ALL SELECT c, 0, 0, 'root' FROM cs),
n AS (SELECT k, min(c) AS c, any_value(d) AS d, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY k),
up AS (SELECT n.k, q.k AS parent, m.c AS parent_c FROM n JOIN p q ON q.c = n.c AND q.d = n.d - 1 JOIN n m ON m.k = q.k),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children, parent_c FROM n LEFT JOIN kids USING (k) LEFT JOIN up USING (k)),
total AS (
  SELECT a.k, count_if(f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
  FROM full_n f JOIN p a ON a.c = f.c AND a.d <= f.d GROUP BY a.k),
ends AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha
  FROM (SELECT c, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY k)
SELECT CAST(c AS BIGINT) AS conv_id, CAST(d AS BIGINT) AS depth, CAST(parent_c AS BIGINT) AS parent_conv_id,
  CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_n JOIN total USING (k) LEFT JOIN ends USING (k)"""
