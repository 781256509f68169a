"""The trie of conversation prefixes by SQL ROLLUP over positional turn-id columns.

A turn's id is 16 bytes of the SHA-256 of its role and text and its text's length. A conversation is cut into blocks of
WIDTH turns, one row each: the block's number, the name of the node before it, and one column a turn. One ROLLUP over the
columns then aggregates all prefixes of all blocks together; grouping_id() says how many turns a group has. The name of
the node before a block comes from a chain of digests over the blocks before it, built in runs of RUN blocks, runs of runs
and so on, so a conversation of any length is never gathered.

Sums over subtrees need no walk: a node's conversation of least id is the least one of every node below on its path,
so each node's amount is put on that conversation, and a second ROLLUP adds the amounts of the members. What the node's own
least conversation holds above the node is taken off by a running total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import running
from .common import mapped, stored

#: Turns in a block, blocks in a run of the digest chain, turns (or blocks) of one conversation that join as one key.
WIDTH, RUN, TOGETHER = 8, 64, 4096
#: Members of a node whose ids are written into one string, at most.
SPAN = 8192


def _bytes(n: int) -> Column:
    """A binary constant of n zero bytes: none, or the root's name."""
    return F.expr(f"X'{'00' * n}'")


def _digest(raw: Column) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, tid, n): each turn's place from 0, its id, and how many turns the conversation has.

    Turns go by number, null first; equal numbers by the turn's id, so that repeated rows follow one another. Null roles and
    texts are empty. Rows without a conversation id belong to none and take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    marked = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)
    tid = F.unhex(F.concat(F.substring(marked, 1, 32), F.lpad(F.hex(F.length(text).cast("long")), 16, "0")))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), tid.alias("tid")).filter("conv_id is not null")
    placed = running(rows, ["conv_id"], ["turn", "tid"], {"pos": F.lit(1)})
    return stored(placed.select("conv_id", (F.col("pos") - 1).alias("pos"), "tid", F.col("pos_total").alias("n")), "turns")


def by_parts(rows: DataFrame, place: Column, others: DataFrame, n: Column) -> DataFrame:
    """rows joined with others on conv_id, a conversation's rows in parts of TOGETHER places: no key is unbounded. n: its places."""
    rows = rows.withColumn("_part", F.floor(place / TOGETHER))
    others = others.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(n - 1, F.lit(0)) / TOGETHER))))
    return rows.join(others, ["conv_id", "_part"]).drop("_part")


def spliced(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, tid), (conv_id, len)) of rebuilt conversations.

    The first h turns come from conversation conv_id - conv_id % group (fewer if it has fewer, none if there is none),
    the others are its own after its first h, where h is the unsigned crc32 of the decimal conv_id, modulo `most`.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "tid", F.col("n").alias("n_base"))
    sizes = heads.groupBy("base").agg(F.max("n_base").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("nb", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("conv_id", "n", "h", "base", "nb", (F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    own = by_parts(turns.filter(F.col("pos") >= h).select("conv_id", "pos", "tid"), F.col("pos"), convs.select("conv_id", "h", "nb", "n"), F.col("n"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("nb")).alias("pos"), "tid")
    lent = convs.filter("nb > 0").select("conv_id", "base", "nb").join(heads, "base").filter("pos < nb").select("conv_id", "pos", "tid")
    return own.union(lent), convs.select("conv_id", "len")


def _keys(rows: DataFrame, last: int) -> DataFrame:
    """(conv_id, idx, key) of rows (conv_id, idx, digest), idx from 0 to `last` at most: a name of all digests before idx."""
    runs = rows.groupBy("conv_id", F.floor(F.col("idx") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("parts"))
    if last < RUN:
        runs = runs.withColumn("start", _bytes(16))
    else:
        runs = stored(runs, "runs")
        whole = _digest(F.aggregate("parts", _bytes(0), lambda a, p: F.concat(a, p["digest"])))
        above = _keys(runs.select("conv_id", F.col("run").alias("idx"), whole.alias("digest")), last // RUN)
        runs = runs.join(above.select("conv_id", F.col("idx").alias("run"), F.col("key").alias("start")), ["conv_id", "run"])
    step = "substring(unhex(sha2(concat(a.cur, p.digest), 256)), 1, 16)"
    chain = F.expr(f"aggregate(parts, struct(start as cur, cast(array() as array<struct<idx:bigint,key:binary>>) as done), (a, p) -> struct({step} as cur, concat(a.done, array(struct(p.idx as idx, a.cur as key))) as done), a -> a.done)")
    return runs.select("conv_id", F.explode(chain).alias("x")).select("conv_id", "x.idx", "x.key")


def blocks(turns: DataFrame, lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, blk, key, next_key, len, t1..t<width>): a row for every `width` turns, the last one partial or without turns.

    key names the node before the block (16 zero bytes: the root), next_key the one behind a full block.
    """
    slots = {f"t{j + 1}": F.max(F.when(F.col("pos") % width == j, F.col("tid"))) for j in range(width)}
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / width).alias("blk")).agg(*[c.alias(k) for k, c in slots.items()])
    # every conversation also has the block where it ends, which may hold no turn
    ends = lengths.withColumn("blk", F.floor(F.col("len") / width))
    rows = by_parts(rows, F.col("blk"), lengths, F.floor(F.col("len") / width) + 1).unionByName(ends.filter(F.col("len") % width == 0), allowMissingColumns=True)
    rows = stored(rows, "blocks")
    longest = rows.agg(F.max("len")).first()[0] or 0
    few = rows.filter(F.col("len") < width).withColumns({"key": _bytes(16), "next_key": F.lit(None).cast("binary")})
    if longest < width:
        return few
    many = rows.filter(F.col("len") >= width)
    filled = F.concat(*[F.coalesce(F.col(t), _bytes(0)) for t in slots])
    keys = stored(_keys(many.select("conv_id", F.col("blk").alias("idx"), _digest(filled).alias("digest")), longest // width), "keys")
    many = many.join(keys.withColumnRenamed("idx", "blk"), ["conv_id", "blk"]).join(keys.select("conv_id", (F.col("idx") - 1).alias("blk"), F.col("key").alias("next_key")), ["conv_id", "blk"], "left")
    return stored(few.unionByName(many), "keyed")


def _rolled(rows: DataFrame, width: int, totals: str) -> DataFrame:
    """(node, parent, depth, len, <totals>) of all prefixes of all blocks, from one ROLLUP."""
    # the last column also carries the name of the node it leads to: what is aggregated are numbers alone
    rows = rows.withColumn(f"t{width}", F.concat(f"t{width}", "next_key"))
    spark, columns = rows.sparkSession, ", ".join(f"t{j + 1}" for j in range(width))
    level = f"{width} - bit_count(grouping_id())"
    grouped = spark.sql(
        f"SELECT blk, key, {columns}, {level} AS level, {totals} FROM {{rows}} WHERE blk = 0 OR t1 IS NOT NULL GROUP BY blk, key, ROLLUP({columns})", rows=rows
    )
    slot = lambda j: F.col(f"t{j + 1}")
    reached = F.coalesce(*[F.when(F.col("level") == j + 1, slot(j)) for j in range(width)])
    path = lambda upto: F.concat("key", *[F.when(upto > j, slot(j)).otherwise(_bytes(0)) for j in range(width)])
    grouped = grouped.withColumn("_last", reached).filter("_last is not null or (level = 0 and blk = 0)")
    node = F.when(F.col("level") == 0, F.col("key")).when(F.col("level") == width, F.substring(slot(width - 1), 25, 16)).otherwise(_digest(path(F.col("level"))))
    parent = F.when(F.col("level") == 1, F.col("key")).when(F.col("level") > 1, _digest(path(F.col("level") - 1)))
    size = F.coalesce(F.conv(F.hex(F.substring("_last", 17, 8)), 16, 10).cast("long"), F.lit(0))
    names = [c for c in grouped.columns if c not in {"blk", "key", "level", "_last", *columns.split(", ")}]
    return grouped.select(node.alias("node"), parent.alias("parent"), (F.col("blk") * width + F.col("level")).alias("depth"), size.alias("len"), *names)


def _ends(rows: DataFrame, width: int) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end.

    Ids are joined in strings of up to SPAN neighbouring ids side by side; SHA-256 takes them in order, so one task reads a
    node's strings one after the other, sorted, and holds none but the last.
    """
    level = F.col("len") % width
    path = F.concat("key", *[F.coalesce(F.col(f"t{j + 1}"), _bytes(0)) for j in range(width)])
    last = rows.filter(F.col("blk") == F.floor(F.col("len") / width)).select("conv_id", F.when(level == 0, F.col("key")).otherwise(_digest(path)).alias("node"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = last.groupBy("node", F.floor(F.col("conv_id") / SPAN).alias("span")).agg(texts.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if node is not None:
                        done[0].append(node), done[1].append(state.hexdigest())
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return mapped(parts.repartition("node").sortWithinPartitions("node", "span").select("node", "ids"), run, "node binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix.

    turns (conv_id, pos from 0, tid) and lengths (conv_id, len), a row for each conversation, those without turns included,
    which are members of the root alone. conv_id is the least member's; amounts are those of the contract. No conversation
    gives no rows, not even the root. Conversations may be of any length and have any number of copies.
    """
    rows = blocks(turns, lengths, width)
    nodes = stored(_rolled(rows, width, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    shared = nodes.filter("n_convs > 1").select("node", "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("len")).alias("amount"))
    above = stored(running(shared, ["conv_id"], ["depth"], {"upto": F.col("amount")}), "above")
    held = above.groupBy("conv_id").agg(F.max("upto_total").alias("held")).unionByName(nodes.filter("n_children = 0").select("conv_id", F.lit(1).alias("leaf")), allowMissingColumns=True)
    held = held.groupBy("conv_id").agg(F.sum("held").alias("held"), F.max("leaf").alias("leaf"))
    put = lengths.join(held, "conv_id").select("conv_id", "len", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = by_parts(rows.drop("len"), F.col("blk"), put, F.floor(F.col("len") / width) + 1)
    sums = _rolled(marked, width, "sum(leaf) AS total_leaves, sum(held) AS total_held").select("node", "total_leaves", "total_held")

    found = nodes.join(sums, "node", "left").join(above.select("node", (F.col("upto") - F.col("amount")).alias("before")), "node", "left").join(_ends(rows, width), "node", "left")
    found = _with_parents(found, nodes)
    saved = F.when(F.col("n_convs") > 1, F.coalesce("total_held", F.lit(0)) - F.coalesce("before", F.lit(0))).otherwise(F.lit(0))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("total_leaves", F.lit(0)).alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _with_parents(found: DataFrame, nodes: DataFrame, share: int = 10_000) -> DataFrame:
    """found with parent_conv_id. Nodes with over 1 / `share` of all nodes as children, fewer than `share` then, are sent to all tasks; the others are joined."""
    least = max(nodes.count() // share, share)
    owners = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = owners.filter(F.col("n_children") > least).drop("n_children")
    some = found.join(F.broadcast(wide), "parent", "left")
    rest = some.filter("parent_conv_id is null").drop("parent_conv_id").join(owners.filter(F.col("n_children") <= least).drop("n_children"), "parent", "left")
    return some.filter("parent_conv_id is not null").unionByName(rest)


def prefix_trie(conversations: DataFrame, width: int = WIDTH, **columns: str) -> DataFrame:
    """The trie() of conversations (conv_id, turn, role, text) as they are."""
    turns = numbered_turns(conversations, **columns)
    return trie(turns.select("conv_id", "pos", "tid"), turns.groupBy("conv_id").agg(F.max("n").alias("len")), width)


def spliced_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie() of conversations rebuilt by spliced()."""
    return trie(*spliced(numbered_turns(conversations)), width)
