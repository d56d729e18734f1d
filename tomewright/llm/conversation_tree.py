"""Prefix trie of conversations: SQL ROLLUP over columns of turn ids counts all prefixes in one pass.

A turn's id stands for its place, role and text. Conversations are laid out in blocks of ``BLOCK`` columns of
turn ids; ROLLUP over them, with grouping_id as the depth, gives every prefix that ends in the block. A longer
conversation goes on in a further row, keyed by the trie node where the block before ended: the exclusive or of the
128-bit ids of all turns so far, which differ by place. Rows of one node therefore meet under one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.common import small_batches, stored
from tomewright.operators.ordered import row_index

#: Turns in one row, and rows of a conversation summed up by one window before the windows are summed up.
BLOCK = 8
SPAN = 1024

TURN = "struct<a:bigint,b:bigint,chars:bigint>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars) of every row with a conv_id, ``pos`` from 0 by turn, null first.

    Rows of one conversation with the same turn follow by role and then by the digest of role and text, so
    repeated rows are repeated turns. The text itself goes no further than this scan.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    first = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), first.alias("at"), F.col("turn").isNotNull().alias("has_turn"), role.alias("role"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    rows = stored(rows)
    return row_index(rows, ["at", "has_turn", "role", "digest"], "pos", by=["conv_id"]).select("conv_id", "pos", "digest", "chars")


def with_shared_heads(conversations: DataFrame, every: int = 100, longest: int = 5) -> DataFrame:
    """(conv_id, pos, digest, chars), each conversation beginning with turns of another one.

    Conversation c starts with the first h turns of conversation c - c % ``every`` (all, if it has fewer; none, if it
    is absent), h = crc32(c in decimal digits) % (``longest`` + 1), and goes on with its own turns after its
    first h. A conversation that is left without turns has one row with null in the other columns.
    The sign of c % ``every`` is that of c, as in SQL.
    """
    turns = stored(ordered_turns(conversations))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).alias("h"),
    )
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < longest)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count("*").alias("has"))
    convs = stored(convs.join(lengths, "base", "left").withColumn("n_head", F.least("h", F.coalesce("has", F.lit(0)))))
    shared = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "chars")
    own = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "digest", "chars")
    bare = convs.where("n_head = 0 AND own <= h").select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("pos", "bigint"), ("digest", "string"), ("chars", "bigint"))))
    return shared.unionByName(own).unionByName(bare)


def _before(rows: DataFrame, values: dict[str, Column], backwards: bool = False) -> DataFrame:
    """``rows`` (conv_id, block, ...) and, for each value, its aggregate over the conversation's rows before (after, if ``backwards``).

    Rows are summed up in spans of ``SPAN`` and spans in one window, so a conversation of any length is many groups.
    """
    order = F.desc if backwards else F.asc
    frame = (Window.unboundedPreceding, -1)
    rows = rows.withColumn("span", F.floor(F.col("block") / SPAN))
    inner = Window.partitionBy("conv_id", "span").orderBy(order("block")).rowsBetween(*frame)
    outer = Window.partitionBy("conv_id").orderBy(order("span")).rowsBetween(*frame)
    totals = rows.groupBy("conv_id", "span").agg(*(v.alias(f"t_{c}") for c, v in values.items()))
    fold = {c: F.bit_xor if "bit_xor" in str(v) else F.sum for c, v in values.items()}
    spans = totals.select("conv_id", "span", *(F.coalesce(fold[c](f"t_{c}").over(outer), F.lit(0)).alias(f"o_{c}") for c in values))
    inside = rows.select("*", *(F.coalesce(v.over(inner), F.lit(0)).alias(f"i_{c}") for c, v in values.items()))
    both = inside.join(spans, ["conv_id", "span"])
    add = {c: F.col(f"i_{c}").bitwiseXOR(F.col(f"o_{c}")) if fold[c] is F.bit_xor else F.col(f"i_{c}") + F.col(f"o_{c}") for c in values}
    return both.select(*[c for c in rows.columns if c != "span"], *(e.alias(c) for c, e in add.items()))


def turn_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, t1..t8, ka, kb): a row for each ``BLOCK`` turns; ``ka`` and ``kb`` name the node before them."""
    mark = lambda k: F.xxhash64(F.lit(k), F.col("digest"), F.col("pos"))
    turn = F.when(F.col("pos").isNotNull(), F.struct(mark(1).alias("a"), mark(2).alias("b"), F.col("chars").alias("chars")))
    placed = turns.select("conv_id", F.coalesce(F.floor(F.col("pos") / BLOCK), F.lit(0)).alias("block"), (F.col("pos") % BLOCK).alias("slot"), turn.alias("t"))
    columns = [F.max(F.when(F.col("slot") == k, F.col("t"))).alias(f"t{k + 1}") for k in range(BLOCK)]
    folds = [F.coalesce(F.bit_xor(f"t.{x}"), F.lit(0)).alias(f"x{x}") for x in "ab"]
    rows = placed.groupBy("conv_id", "block").agg(*columns, *folds)
    return _before(rows, {"ka": F.bit_xor("xa"), "kb": F.bit_xor("xb")}).drop("xa", "xb")


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """Aggregates of every prefix that ends in a block, with (depth, ka, kb) of its node and ``level`` inside the block."""
    names = [f"t{k + 1}" for k in range(BLOCK)]
    # grouping_id has a bit for each rolled-up column, so level = BLOCK - number of its bits.
    rolled = blocks.sparkSession.sql(
        f"SELECT block, ka, kb, {', '.join(names)}, {BLOCK} - bit_count(grouping_id() & {2**BLOCK - 1}) AS level, {measures} "
        f"FROM {{rows}} GROUP BY block, ka, kb, ROLLUP({', '.join(names)})",
        rows=blocks,
    )
    last = F.get(F.array(*names), (F.col("level") - 1).cast("int"))
    to = lambda k: F.coalesce(F.col(f"t{k}.a"), F.lit(0)), lambda k: F.coalesce(F.col(f"t{k}.b"), F.lit(0))
    key = []
    for name, part in zip(("ka", "kb"), to):
        total = F.col(name)
        for k in range(1, BLOCK + 1):
            total = total.bitwiseXOR(part(k))
        key.append(total)
    ended = rolled.where((F.col("level") > 0) | (F.col("block") == 0)).withColumn("last", F.when(F.col("level") > 0, last))
    return ended.where("level = 0 OR last IS NOT NULL").select(
        (F.col("block") * BLOCK + F.col("level")).alias("depth"), key[0].alias("ka"), key[1].alias("kb"), "last", "level",
        *[c for c in rolled.columns if c not in ("block", "ka", "kb", "level", *names)],
    )


def _digests(ends: DataFrame, piece: int = 50_000) -> DataFrame:
    """(depth, ka, kb, ends_sha256): SHA-256 of each node's ids, ascending and comma-joined.

    Ids are cut by range into pieces of text, whichever node they belong to; a node's pieces then pass one
    hash in order, as a stream, so not even a node with most conversations is held as a list.
    """
    node = ["depth", "ka", "kb"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (*key, ids[0])] + [pa.array([",".join(map(str, ids))])], names=[*node, "first", "ids"]
            )

        out = []
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key or len(ids) >= piece:
                    if ids:
                        out.append(made())
                    key, ids = now, []
                ids.append(conv)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if ids:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def out():
            columns = [pa.array([d[k] for d in done], pa.int64()) for k in range(3)] + [pa.array([d[3] for d in done], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*node, "ends_sha256"])

        for batch in batches:
            for *now, text in zip(*(c.to_pylist() for c in batch.select([*node, "ids"]).columns)):
                if now == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text.encode())
            if len(done) > 10_000:
                yield out()
                done = []
        if state:
            done.append((*key, state.hexdigest()))
            yield out()

    every = [*node, "conv_id"]
    pieces = ends.select(*every).repartitionByRange(*every).sortWithinPartitions(*every).mapInArrow(cut, "depth bigint, ka bigint, kb bigint, first bigint, ids string")
    ordered = small_batches(pieces.repartition(*node).sortWithinPartitions(*node, "first"), 200)
    return ordered.mapInArrow(digest, "depth bigint, ka bigint, kb bigint, ends_sha256 string")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """The trie of ``turns(conv_id, pos, digest, chars)``: a row for each distinct prefix, the empty one included.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the parent's smallest
    member (null at the root), ``n_convs`` the members, ``n_children`` the distinct next turns, ``n_leaves`` the
    childless nodes of the subtree (a childless node counts itself), ``saved_tokens`` the code points that sharing the
    subtree's nodes saves, ``ends_sha256`` the digest of the members that end here.

    Conversations without turns count at the root. No conversations give no rows. Texts are compared by
    128-bit digests, prefixes by 128 bits of their turns' hashes.
    """
    blocks = stored(turn_blocks(turns))
    node = ["depth", "ka", "kb"]
    nodes = stored(
        _rollup(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id").select(
            *node, "n_convs", "conv_id",
            F.col("ka").bitwiseXOR(F.coalesce(F.col("last.a"), F.lit(0))).alias("pa"),
            F.col("kb").bitwiseXOR(F.coalesce(F.col("last.b"), F.lit(0))).alias("pb"),
            ((F.col("n_convs") - 1) * F.coalesce(F.col("last.chars"), F.lit(0))).alias("saved"),
        )
    )
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    tree = stored(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # Each node's own figures stand at its smallest member; the sums over a subtree are a ROLLUP of those.
    slot = F.when(F.col("depth") > 0, (F.col("depth") - 1) % BLOCK)
    marks = tree.select(
        "conv_id", F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / BLOCK)).otherwise(0).alias("block"), slot.alias("slot"), "saved",
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
    )
    marks = marks.groupBy("conv_id", "block").agg(
        *(F.coalesce(F.sum(F.when(F.col("slot") == k, F.col("saved"))), F.lit(0)).alias(f"w{k + 1}") for k in range(BLOCK)),
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("w"),
    )
    marked = blocks.join(marks.select("conv_id").distinct(), "conv_id", "left_semi").join(marks, ["conv_id", "block"], "left")
    marked = marked.na.fill(0, ["leaf", "w", *(f"w{k + 1}" for k in range(BLOCK))])
    marked = _before(stored(marked), {"later": F.sum("w"), "later_leaf": F.sum("leaf")}, backwards=True)
    rest, sums = F.col("later"), {}
    for k in range(BLOCK, 0, -1):
        rest = rest + F.col(f"w{k}")
        sums[k] = rest
    credited = marked.select(
        "block", "ka", "kb", *(f"t{k + 1}" for k in range(BLOCK)), *(sums[k].alias(f"s{k}") for k in sums),
        (F.col("leaf") + F.col("later_leaf")).alias("leaf"),
    ).where("s1 > 0 OR leaf > 0")
    totals = _rollup(credited, ", ".join(f"sum(s{k}) AS s{k}" for k in sorted(sums)) + ", sum(leaf) AS n_leaves")
    at_level = F.get(F.array(*(F.col(f"s{k}") for k in sorted(sums))), F.greatest(F.col("level") - 1, F.lit(0)).cast("int"))
    totals = totals.select(*node, at_level.alias("saved_tokens"), "n_leaves")

    ends = turns.groupBy("conv_id").agg(
        F.count("pos").alias("depth"),
        *(F.coalesce(F.bit_xor(F.when(F.col("pos").isNotNull(), F.xxhash64(F.lit(k), "digest", "pos"))), F.lit(0)).alias(c) for k, c in ((1, "ka"), (2, "kb"))),
    )
    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        tree.join(totals, node, "left").join(_digests(ends), node, "left").join(parents, ["depth", "pa", "pb"], "left")
        .select(
            "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children",
            F.coalesce("n_leaves", F.lit(0)).cast("bigint").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def nodes_sql() -> str:
    """The same in DuckDB for conversations of moderate length: every prefix as a list, counted by joins."""
    return """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda v, x: CASE WHEN x >= 0 THEN xor(xor(v, x) >> 1, (xor(v, x) & 1) * 3988292384) ELSE xor(v >> 1, (v & 1) * 3988292384) END), 4294967295) % 6 AS h
      FROM t GROUP BY conv_id),
h AS (SELECT c.conv_id, count(t.pos) AS n_head FROM c LEFT JOIN t ON t.conv_id = c.base AND t.pos < c.h GROUP BY c.conv_id),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
      UNION ALL SELECT c.conv_id, t.pos - c.h + h.n_head, t.role, t.text FROM c JOIN h USING (conv_id) JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS seq
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM s),
q AS (SELECT conv_id, size, depth, seq[1:depth] AS path FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends,
             CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(path[depth].text) END AS saved FROM q GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT m.saved, m.n_children, unnest(range(0, m.depth + 1)) AS above, m.path FROM m),
v AS (SELECT path[1:above] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       v.n_leaves::BIGINT AS n_leaves, v.saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN v ON v.path = m.path LEFT JOIN m AS o ON m.depth > 0 AND o.depth = m.depth - 1 AND o.path = m.path[1:m.depth - 1]
"""
