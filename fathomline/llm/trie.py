"""Conversation prefix trie: chained digests of every prefix, nodes by (depth, digest), subtree sums over all ancestors.

A prefix's digest is the SHA-256 of the digest before it and of its last turn, so equal
digests are equal prefixes and one streaming pass over sorted turns names them all; no
conversation is held whole. Nodes are the groups of prefixes by (depth, digest).

Sums over subtrees come from exploding each node to all its ancestors. Done node by
node, a conversation of n turns gives n * n / 2 rows. So runs of nodes that have one
child each are first summed up as one link of the path, and links are exploded to
links: a link ends in a leaf or a fork, there are less than two of them for each
distinct conversation, and one at depth d lies on a path of at least d turns which no
other fork is counted to. All rows of the explosion are thus at most twice the turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import durable, small_batches

#: Ids of one node that are joined to one text before they are hashed.
ENDS = 4096
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, base: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """(family, conv_id, head, later, turn, role_key, said, size): narrow rows of turns, their texts as digests.

    A conversation opens with the first ``borrowed`` turns of conversation ``base``
    (columns over ``conv_id``) in place of its own first ones; without them it is as it
    stands. ``base`` must be its own base.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(conv.isNotNull()).select(
        conv.alias("conv_id"), "turn", role.alias("role_key"), F.unhex(said).alias("said"), F.octet_length(text).cast("long").alias("size"))
    return rows.select(
        (F.col("conv_id") if base is None else base.cast("long")).alias("family"), "conv_id",
        (F.lit(0) if borrowed is None else borrowed.cast("int")).alias("head"), "turn", "role_key", "said", "size")


def _chain(batches):
    """Prefix rows of turns sorted by (family, base first, conv_id, turn); holds the base's first turns and one digest."""
    out = {k: [] for k in ("conv_id", "depth", "digest", "before", "size", "last")}
    state = {"family": None, "conv": None, "opening": [], "seen": 0, "depth": 0, "digest": ROOT}

    def put(said, size):
        before = state["digest"]
        state["digest"], state["depth"] = hashlib.sha256(before + said).digest(), state["depth"] + 1
        for k, v in zip(out, (state["conv"], state["depth"], state["digest"], before, size, False), strict=True):
            out[k].append(v)

    def close():
        """The conversation's own row tells its end: a second row of its last prefix, which no member is counted by."""
        if state["conv"] is not None:
            for k, v in zip(out, (state["conv"], state["depth"], state["digest"], None, 0, True), strict=True):
                out[k].append(v)

    def flush():
        full = pa.RecordBatch.from_arrays([
            pa.array(out["conv_id"], pa.int64()), pa.array(out["depth"], pa.int64()), pa.array(out["digest"], pa.binary()),
            pa.array(out["before"], pa.binary()), pa.array(out["size"], pa.int64()), pa.array(out["last"], pa.bool_())], list(out))
        for v in out.values():
            v.clear()
        return full

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("family", "conv_id", "head", "said", "size")]
        for family, conv, head, said, size in zip(*columns, strict=True):
            if conv != state["conv"] or family != state["family"]:
                close()
                if family != state["family"]:
                    state |= {"family": family, "opening": [], "most": 0}
                state |= {"conv": conv, "seen": 0, "depth": 0, "digest": ROOT}
                if conv != family:
                    for turn in state["opening"][:head]:
                        put(*turn)
            if conv == family:
                if len(state["opening"]) < MOST_BORROWED:
                    state["opening"].append((said, size))
                put(said, size)
            elif state["seen"] >= head:
                put(said, size)
            state["seen"] += 1
            if len(out["depth"]) >= 10_000:
                yield flush()
    close()
    yield flush()


#: Turns that a conversation can borrow at most; so many digests of a base are held.
MOST_BORROWED = 64


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, before, size, last): a row for each prefix of one turn or more, and one row (``last``) for each conversation's end.

    Turns are ordered by turn, null first; ties by role and then by the digest of the
    turn, so any order of the input gives the same prefixes.
    """
    small_batches(turns.sparkSession)
    rows = turns.withColumn("later", F.col("conv_id") != F.col("family")).repartition("family").sortWithinPartitions(
        "family", "later", "conv_id", F.col("turn").asc_nulls_first(), "role_key", "said")
    return rows.select("family", "conv_id", "head", "said", "size").mapInArrow(
        _chain, "conv_id long, depth long, digest binary, before binary, size long, last boolean")


def _joined(batches):
    """Runs of at most ENDS ids of one node, as (digest, least, ids): of rows sorted by (digest, conv_id)."""
    node, ids, out = None, [], []
    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != node or len(ids) >= ENDS:
                if ids:
                    out.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = digest, []
            ids.append(conv)
        if len(out) >= 1000:
            yield _as_batch(out, (("digest", pa.binary()), ("least", pa.int64()), ("ids", pa.string())))
            out = []
    if ids:
        out.append((node, ids[0], ",".join(map(str, ids))))
    yield _as_batch(out, (("digest", pa.binary()), ("least", pa.int64()), ("ids", pa.string())))


def _hashed(batches):
    """(digest, ends_sha256) of runs sorted by (digest, least): a running hash."""
    node, running, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest != node:
                if running:
                    out.append((node, running.hexdigest()))
                node, running = digest, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(out) >= 1000:
            yield _as_batch(out, (("digest", pa.binary()), ("ends_sha256", pa.string())))
            out = []
    if running:
        out.append((node, running.hexdigest()))
    yield _as_batch(out, (("digest", pa.binary()), ("ends_sha256", pa.string())))


def _as_batch(rows, fields):
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of ``ends`` (digest, conv_id): the hash of each node's ids, ascending, comma-joined.

    Ranges over (node, id) split a node that holds a large share of all ends: tasks join
    runs of its ids to texts, and a running hash then reads those, one row for thousands
    of ids. No list of ids is held.
    """
    runs = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_joined, "digest binary, least long, ids string")
    return runs.repartition("digest").sortWithinPartitions("digest", "least").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (see :func:`turn_rows`).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and digest, the node's name.

    Null roles and texts are empty ones; rows without a conv_id belong to no
    conversation and are left out; repeated rows are repeated turns. An empty table has
    no conversations and so no nodes, not even the root. Extra columns are ignored.
    """
    rows = durable(prefixes(turns), "prefixes")
    at = ["depth", "digest"]
    ends = rows.where("last")
    met = rows.where(~F.col("last")).groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least"), F.min("before").alias("before"), F.min("size").alias("size"))
    met = durable(met.withColumn("own", (F.col("n_convs") - 1) * F.col("size")), "nodes")
    below = met.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = met.drop("before", "size").join(below, at, "left").fillna(0, ["n_children"])

    # each link is worked out once, on the path of its last node's smallest member; a conversation that ends inside a link doesn't reach that
    leading = nodes.where(F.col("n_children") != 1).select(F.col("least").alias("conv_id")).distinct()
    path = rows.where(~F.col("last")).select("conv_id", *at).join(leading, "conv_id", "left_semi").join(nodes, at)
    along = W.partitionBy("conv_id").orderBy("depth")
    path = path.withColumn("top", F.coalesce(F.lag("n_children").over(along) != 1, F.lit(True))).withColumn("parent_conv_id", F.lag("least").over(along))
    path = path.withColumn("link", F.sum(F.col("top").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    link = W.partitionBy("conv_id", "link")
    ahead = link.orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    path = path.withColumns({
        "above": F.coalesce(F.sum("own").over(ahead), F.lit(0)), "end": F.max_by(F.when(F.col("n_children") != 1, F.col("least")), "depth").over(link), "leaf": (F.min("n_children").over(link) == 0).cast("long"),
        "sum": F.sum("own").over(link), "first": F.min_by("digest", "depth").over(link)})
    path = durable(path, "paths")
    mine = path.where(F.col("end") == F.col("conv_id"))
    link_sums = mine.where("top").select("conv_id", "link", "leaf", "sum")
    tops = path.where("top").select("conv_id", F.col("link").alias("upper"), "first")
    sums = link_sums.join(tops, "conv_id").where(F.col("upper") <= F.col("link")).groupBy("first").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("sum").alias("total"))
    inner = mine.join(sums, "first").select(
        "least", "depth", "digest", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("above")).alias("saved_tokens"))

    # the root: all conversations are members, and all nodes lie below it
    spark = turns.sparkSession
    whole = ends.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not whole.n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest binary")
    under = nodes.agg(F.sum("own").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum((F.col("depth") == 1).cast("long")).alias("children")).first()
    root = spark.createDataFrame(
        [(whole.least, 0, ROOT, None, whole.n, under.children or 0, under.leaves or 1, under.own or 0)],
        "least long, depth long, digest binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    inner = inner.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(whole.least)).otherwise(F.col("parent_conv_id")))
    return inner.unionByName(root).join(end_hashes(ends.select("digest", "conv_id")), "digest", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "digest")
