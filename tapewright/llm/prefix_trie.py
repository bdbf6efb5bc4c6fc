"""Prefix trie of conversations, kept as a Z-fast trie in tables.

A conversation is a sequence of turns; its prefix of d turns goes by a chained
128-bit hash. The trie's table has one row per compacted node (a branching
point or the end of a conversation): the prefix hashes of its whole sequence,
and the depths of its compacted ancestors (`ups`). The edge into a node covers
the depths (up, depth]; the depth in it with most trailing zero bits is the
edge's two-fattest number, and the prefix of that length is the node's handle.

* Locating: fat binary search. Each round joins the prefix of the two-fattest
  length in the open range with the handles: a hit raises the lower end to the
  node's depth, a miss lowers the upper end. log2(turns) rounds find the
  deepest node whose handle is a prefix; one join by the prefix one turn longer
  finds the exit node below it, and where the conversation leaves its edge.
* Inserting a batch: edges are split where conversations leave them; what is
  below is new, and only these prefixes are counted for branching points.
* Statistics are summed over compacted nodes and then expanded along edges.

All groups are combined before they are shuffled. A conversation is one row
(32 bytes a turn); its text is hashed before the first shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations inserted by each batch, as shares of all; the last takes the rest.
BATCHES = (0.125, 1.0)
#: Ids of one range are joined in one string for the digest of a node's ends.
RANGE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = "struct<a:bigint,b:bigint>"
_TURN = "struct<a:bigint,b:bigint,w:bigint>"


def turns_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv_id, turns: each turn as two hashes of (role, text) and the words of the text; null role or text is empty.

    Turns go by number, null first, equal numbers by the turn's hashes; repeated rows are repeated turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    row = F.struct(F.col(turn_col).cast("long").alias("t"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
                   F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("w"))
    rows = table.select(F.col(conv_col).cast("long").alias("conv_id"), row.alias("r")).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r")).select("conv_id", F.transform("r", lambda x: F.struct(x["a"], x["b"], x["w"])).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Rows conv_id, turns: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    bases = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("lead"))
    own = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("at"))
    met = own.join(bases, F.col("at") == F.col("base"), "left")
    none = F.array().cast(f"array<{_TURN}>")
    lead = F.when(F.col("h") > 0, F.slice(F.coalesce("lead", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(1)))).otherwise(none)
    return met.select("conv_id", F.concat(lead, rest).alias("turns"))


def prefixes(convs: DataFrame) -> DataFrame:
    """Rows conv_id, path: for each depth from 1 the prefix's hash (a, b) and the words of its last text (w)."""
    def step(path: Column, turn: Column) -> Column:
        last = F.element_at(path, -1)
        more = F.struct(F.xxhash64(last["a"], turn["a"]).alias("a"), F.xxhash64(last["b"], turn["b"]).alias("b"), turn["w"].alias("w"))
        return F.concat(path, F.array(more))

    root = F.array(F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.lit(0).cast("long").alias("w")))
    whole = F.aggregate("turns", root.cast(f"array<{_TURN}>"), step)
    return convs.select("conv_id", whole.alias("p")).select("conv_id", F.slice("p", F.lit(2), F.size("p") - 1).alias("path"))


def key_at(path: Column, depth: Column) -> Column:
    """Hash of the prefix of so many turns; the root has one of its own."""
    at = F.get(path, depth - 1)
    return F.when(depth > 0, F.struct(at["a"].alias("a"), at["b"].alias("b"))).otherwise(F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with most trailing zero bits: high without the bits below the first that differs from low."""
    x = low.bitwiseXOR(high)
    for k in (1, 2, 4, 8, 16):
        x = x.bitwiseOR(F.shiftright(x, k))
    # x is now ones up to the first difference; high keeps that bit and all above.
    return high.bitwiseAND(F.bitwise_not(F.shiftright(x, 1)))


def root_trie(spark) -> DataFrame:
    """The trie of no conversation: its root. Rows key, depth, ups, path."""
    return spark.range(1).select(
        F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")).alias("key"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("ups"),
        F.array().cast(f"array<{_TURN}>").alias("path"))


def _up(ups: Column) -> Column:
    return F.coalesce(F.get(ups, F.size(ups) - 1), F.lit(-1))


def locate(trie: DataFrame, strings: DataFrame, longest: int) -> DataFrame:
    """The rows (sid, path) with exit_key, exit_depth (the exit node) and meet (turns shared with it)."""
    below = trie.filter("depth > 0")
    handles = stored(below.select(key_at(F.col("path"), fattest(_up(F.col("ups")), F.col("depth"))).alias("handle"), F.col("depth").alias("n_depth"), "key"), "handles")
    none = F.lit(None).cast(_KEY)
    open_ = strings.select("sid", "path", F.lit(0).alias("lo"), F.size("path").alias("hi"), none.alias("node"))
    done = None
    for _ in range(max(1, longest.bit_length() + 1)):
        probe = open_.withColumn("f", fattest(F.col("lo"), F.col("hi"))).withColumn("probe", key_at(F.col("path"), F.col("f")))
        hit = F.col("n_depth").isNotNull()
        moved = probe.join(handles, F.col("probe") == F.col("handle"), "left").select(
            "sid", "path", F.when(hit, F.col("n_depth")).otherwise(F.col("lo")).alias("lo"), F.when(hit, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
            F.when(hit, F.col("key")).otherwise(F.col("node")).alias("node"))
        moved = stored(moved, "search")
        over = moved.filter("lo >= hi")
        done = over if done is None else done.unionByName(over)
        open_ = moved.filter("lo < hi")
    # lo is the node's depth. If all of it matches, the conversation goes on below it, by the child that begins with its next turn.
    own = key_at(F.col("path"), F.least("lo", F.size("path")))
    whole = (F.col("lo") == 0) | ((F.col("lo") <= F.size("path")) & (own == F.col("node")))
    found = done.withColumn("next", F.when(whole & (F.col("lo") < F.size("path")), key_at(F.col("path"), F.col("lo") + 1)))
    names = below.select(key_at(F.col("path"), _up(F.col("ups")) + 1).alias("name"), F.col("key").alias("child"))
    met = found.join(names, F.col("next") == F.col("name"), "left")
    exit_ = met.select("sid", "path", F.coalesce("child", "node", key_at(F.col("path"), F.lit(0))).alias("exit_key"))
    nodes = trie.select(F.col("key").alias("exit_key"), F.col("depth").alias("exit_depth"), F.col("path").alias("exit_path"))
    both = exit_.join(nodes, "exit_key")
    same = F.filter(F.zip_with("path", "exit_path", lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])), lambda x: F.coalesce(x, F.lit(False)))
    return both.select("sid", "path", "exit_key", "exit_depth", F.size(same).alias("meet"))


def insert(trie: DataFrame, strings: DataFrame, longest: int, first: bool = False) -> DataFrame:
    """The trie with the distinct sequences (sid, path) of a batch; `first`: the trie is only a root."""
    if first:
        at = strings.select("sid", "path", F.lit(0).alias("meet"), F.array(F.lit(0)).alias("base"))
    else:
        at = stored(locate(trie, strings, longest), "located")
        splits = at.filter("meet < exit_depth").select("exit_key", "meet").distinct()
        cut = stored(splits.groupBy("exit_key").agg(F.collect_list("meet").alias("cuts")), "splits")
        # Every node below a split edge gets the places of the cuts as ancestors.
        through = trie.select("key", "path", F.explode(F.array_append("ups", F.col("depth"))).alias("u")).select("key", key_at(F.col("path"), F.col("u")).alias("above"))
        more = through.join(cut, F.col("above") == F.col("exit_key")).groupBy("key").agg(F.flatten(F.collect_list("cuts")).alias("more"))
        ups = F.when(F.col("more").isNull(), F.col("ups")).otherwise(F.array_sort(F.concat("ups", "more")))
        trie = stored(trie.join(more, "key", "left").select("key", "depth", ups.alias("ups"), "path"), "split")
        here = cut.join(trie, F.col("exit_key") == F.col("key")).select("ups", "path", F.explode("cuts").alias("depth")).select(
            key_at(F.col("path"), F.col("depth")).alias("key"), "depth", F.filter("ups", lambda j: j < F.col("depth")).alias("ups"), F.slice("path", F.lit(1), F.col("depth")).alias("path"))
        # The place where a conversation leaves the trie is a node now.
        at = at.join(trie.select(F.col("key").alias("exit_key"), "ups"), "exit_key").select(
            "sid", "path", "meet", F.array_append(F.filter("ups", lambda j: j < F.col("meet")), F.col("meet")).alias("base"))
        trie = trie.unionByName(here)
    leaves = at.filter(F.col("meet") < F.size("path"))
    steps = leaves.select("sid", F.explode(F.expr("sequence(meet + 1, size(path))")).alias("j"), "path").select(
        "sid", "j", key_at(F.col("path"), F.col("j")).alias("key"), (F.col("j") == F.size("path")).alias("ends"), F.get("path", F.col("j"))["b"].alias("next"))
    steps = stored(steps, "steps")
    # Nodes are ends and prefixes with more than one next turn; each is written by the least of its conversations.
    branching = steps.groupBy("key").agg(F.max("ends").alias("ends"), F.min("next").alias("low"), F.max("next").alias("high"), F.min("sid").alias("first")).filter(
        F.col("ends") | (F.col("low") != F.col("high"))).select("key", "first")
    marks = steps.join(branching, "key").groupBy("sid").agg(F.array_sort(F.collect_list("j")).alias("js"), F.collect_set(F.when(F.col("first") == F.col("sid"), F.col("j"))).alias("own"))
    new = leaves.join(marks, "sid").select("path", "base", "js", F.explode("own").alias("depth")).select(
        key_at(F.col("path"), F.col("depth")).alias("key"), "depth", F.concat("base", F.filter("js", lambda j: j < F.col("depth"))).alias("ups"), F.slice("path", F.lit(1), F.col("depth")).alias("path"))
    return stored(trie.unionByName(new), "trie")


def build(strings: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """The trie of the distinct sequences (sid, path), inserted in batches by a hash of the sequence."""
    spark = strings.sparkSession
    longest = strings.agg(F.max(F.size("path"))).first()[0] or 0
    draw = F.pmod(F.xxhash64("sid", F.lit("batch")), F.lit(1 << 20))
    trie, done = root_trie(spark), 0
    for k, share in enumerate(batches):
        upto = 1 << 20 if k == len(batches) - 1 else int(share * (1 << 20))
        trie = insert(trie, strings.filter((draw >= done) & (draw < upto)), longest, first=k == 0)
        done = upto
    return trie


def ends_digests(members: DataFrame) -> DataFrame:
    """Rows key, ends_sha256: SHA-256 of the ids of a table (key, conv_id) that end at each node, ascending, joined by commas.

    Ids of one range are sorted and joined together; the few nodes with more
    than one range are digested from their ranges in order, as a stream.
    """
    ranges = members.groupBy("key", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    ranges = stored(ranges, "ends")
    counts = ranges.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))
    single = counts.filter("n = 1").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = ranges.join(counts.filter("n > 1").select("key"), "key").select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), "range", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], ["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if at != (a, b):
                    if at:
                        yield out()
                    at, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if at:
            yield out()

    spark = members.sparkSession
    streamed = many.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "range").mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")
    return single.unionByName(streamed.select(F.struct("a", "b").alias("key"), "ends_sha256"))


def nodes_of(convs: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """One row per node of the trie of a table (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = prefixes(convs).withColumn("key", key_at(F.col("path"), F.size("path")))
    paths = stored(paths, "paths")
    # Equal conversations are one sequence; they have equal paths.
    strings = stored(paths.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("path").alias("path")), "strings")
    trie = build(strings.filter(F.size("path") > 0).select(F.col("conv_id").alias("sid"), "path"), batches)
    trie = stored(trie.join(strings.select("key", F.col("conv_id").alias("own_id"), F.col("n").alias("own_n")), "key", "left"), "nodes")
    up = F.explode(F.array_append("ups", F.col("depth"))).alias("u")
    members = trie.filter("own_id is not null").select("path", "own_id", "own_n", up).groupBy(key_at(F.col("path"), F.col("u")).alias("m_key")).agg(
        F.min("own_id").alias("conv_id"), F.sum("own_n").alias("n_convs"))
    children = trie.filter("depth > 0").groupBy(key_at(F.col("path"), _up(F.col("ups"))).alias("c_key")).agg(F.count(F.lit(1)).alias("n_children"))
    full = trie.join(members, F.col("key") == F.col("m_key")).join(children, F.col("key") == F.col("c_key"), "left").select(
        "key", "depth", "ups", "path", "own_id", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    full = stored(full, "full")
    edge = F.slice("path", _up(F.col("ups")) + 1, F.col("depth") - _up(F.col("ups")))
    words = F.when(F.col("depth") > 0, F.aggregate(edge, F.lit(0).cast("long"), lambda s, x: s + x["w"])).otherwise(F.lit(0))
    below = full.select("path", ((F.col("n_convs") - 1) * words).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.explode("ups").alias("u")).groupBy(
        key_at(F.col("path"), F.col("u")).alias("b_key")).agg(F.sum("saved").alias("below"), F.sum("leaf").alias("leaves"))
    top = full.select(F.col("key").alias("p_key"), F.col("conv_id").alias("p_id"))
    ends = ends_digests(paths.select("key", "conv_id")).withColumnRenamed("key", "e_key")
    wide = full.withColumn("above", F.when(F.col("depth") > 0, key_at(F.col("path"), _up(F.col("ups"))))).join(below, F.col("key") == F.col("b_key"), "left").join(
        top, F.col("above") == F.col("p_key"), "left").join(ends, F.col("key") == F.col("e_key"), "left")
    # Along an edge only the last node branches or has ends; saved words add up from below.
    spread = wide.withColumn("d", F.explode(F.when(F.col("depth") > 0, F.sequence(_up(F.col("ups")) + 1, F.col("depth"))).otherwise(F.array(F.lit(0)))))
    last = F.col("d") == F.col("depth")
    rest = F.when(F.col("d") > 0, F.aggregate(F.slice("path", F.greatest("d", F.lit(1)), F.col("depth") - F.col("d") + 1), F.lit(0).cast("long"), lambda s, x: s + x["w"])).otherwise(F.lit(0))
    return spread.select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.when(F.col("d") == _up(F.col("ups")) + 1, F.col("p_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(0))).cast("long").alias("n_leaves"),
        (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * rest).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"))


def trie(table: DataFrame, batches: tuple[float, ...] = BATCHES, **columns: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (see `rebuilt`), as `nodes_of` returns them.

    Rows without a conversation id belong to none and are left out. Null roles
    and texts are empty; turns go by number, null first, equal numbers by hash;
    repeated rows are turns of their own. A conversation without turns after
    rebuilding is a member of the root. An empty table has no nodes.
    """
    return nodes_of(rebuilt(stored(turns_of(table, **columns), "turns")), batches)
