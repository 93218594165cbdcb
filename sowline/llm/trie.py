"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is a sequence of turns; a node is a distinct sequence of the
first d turns.  Sequences are cut into blocks of ``BLOCK`` turns and each block
hangs under the prefix before it (its ``pkey``), so a conversation of any
length is many bounded rows.

1. Copies of a block under one prefix are one class with a weight.
2. Classes are sorted by (prefix, turns) over range partitions.  A partition
   joins its neighbours by union-find over their common prefixes (LCP), the
   longest first: joining two components makes a branching node, or widens the
   one that stands at that depth.
3. What may continue in the next partition are the nodes above its first and
   its last class, ``2 * BLOCK`` at most.  Each partition's forest is contracted
   to these; the contracted forests are merged by the same union-find over the
   boundaries' common prefixes.  The driver sees nothing else.
4. Nodes between two branching nodes are written out depth by depth.

Sums over subtrees need no walk: with P(d) the code points of a node's first d
texts, a node's ``dead`` is the sum of P over the depths at which its members,
but for the smallest, stop being the smallest of their node.  Then the code
points that a cache saves in its subtree are ``dead - (members - 1) * P(d - 1)``.
Both ``dead`` and the number of leaves add up over members, so those of later
blocks are joined to the block that they continue.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.llm.common import stored
from sowline.operators.ordered import row_numbers
from sowline.operators.scan import block_scan
from sowline.operators.skew import split_lookup

BLOCK = 64              # turns of a block
WIDTH = 32              # hex digits of a turn's digest
SPAN = 1024             # blocks of one conversation that one window sees
IDS = 4096              # conversation ids hashed at a time
ROOT = "root"


# ---------------------------------------------------------------- sequences

def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``digest`` and ``chars`` of every turn.

    Turns are ordered by turn (NULL first), then role, then text (its first
    64 characters, then its digest).  NULL roles and texts are empty; rows
    without a conv_id belong to no conversation and are left out.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"), F.length(text).cast("long").alias("chars"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("digest").asc()]
    return row_numbers(rows, order, out="nth", within=["conv_id"]).select("conv_id", (F.col("nth") - 1).alias("pos"), "digest", "chars")


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(turns, lengths)`` of the rebuilt conversations.

    Conversation c is the first h turns of conversation ``c - c % group`` and
    then its own after its first h, with ``h = crc32(c) % most``.  ``turns``
    has conv_id, pos, digest, chars and len; ``lengths`` conv_id and len of
    every conversation, turnless ones included.
    """
    own = stored(turns_of(conversations), "turns")
    sizes = stored(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")), "lengths")
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    each = sizes.select("conv_id", "n_own", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(bases, "base", "left")
    each = each.withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    each = stored(each.withColumn("len", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
                  .select("conv_id", "base", "h", "n_head", "len"), "plans")
    # at most `most` turns of a base go to at most 2 * group conversations
    first = own.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    heads = each.where("n_head > 0").join(first, "base").where("pos < n_head").select("conv_id", "pos", "digest", "chars", "len")
    rest = split_lookup(own, each.select("conv_id", "h", "n_head", "len"), ["conv_id"], "inner").where("pos >= h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "digest", "chars", "len")
    return heads.union(rest), each.select("conv_id", "len")


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block of ``block`` turns: conv_id, blk, seq (digests in a
    row), chars, base (code points before it), pkey and ckey (the prefix before
    it and with it), ends (the conversation stops here)."""
    blk = F.floor(F.col("pos") / block).cast("long")
    rows = turns.groupBy("conv_id", blk.alias("blk"), "len").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    rows = rows.select("conv_id", "blk", F.array_join("t.digest", "").alias("seq"), F.col("t.chars").alias("chars"),
                       (F.col("len") <= (F.col("blk") + 1) * block).alias("ends"))
    # the hash of a prefix is the sum of its blocks' hashes, each with its place
    mark = F.md5(F.concat(F.col("blk").cast("string"), F.lit(":"), F.col("seq")).cast("binary"))
    part = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(38,0)")
    rows = rows.withColumns({"h1": part(1), "h2": part(17), "all_chars": F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)})
    run = block_scan(rows.where((F.col("blk") > 0) | ~F.col("ends")), ["conv_id"], ["blk"], F.floor(F.col("blk") / SPAN),
                     sums={"s1": F.col("h1"), "s2": F.col("h2"), "base": F.col("all_chars")}, inclusive=False)
    alone = rows.where((F.col("blk") == 0) & F.col("ends")).withColumns(
        {"s1": F.lit(None).cast("decimal(38,0)"), "s2": F.lit(None).cast("decimal(38,0)"), "base": F.lit(None).cast("long")})
    both = run.select(*alone.columns).unionByName(alone)
    zero = lambda c: F.coalesce(c, F.lit(0))
    key = lambda a, b: F.concat(a.cast("decimal(38,0)").cast("string"), F.lit(":"), b.cast("decimal(38,0)").cast("string"))
    full = F.length("seq") == block * WIDTH
    return both.select("conv_id", "blk", "seq", "chars", "all_chars", zero(F.col("base")).alias("base"), "ends",
                       F.when(F.col("blk") == 0, ROOT).otherwise(key(zero(F.col("s1")), zero(F.col("s2")))).alias("pkey"),
                       F.when(full, key(zero(F.col("s1")) + F.col("h1"), zero(F.col("s2")) + F.col("h2"))).alias("ckey"))


# ---------------------------------------------------------------- union-find

class Forest:
    """Nodes of a forest that grows by joining components at ever smaller depths.

    A node has depth, members n, least (smallest member), dead and leaves of
    its children so far, reps (children and members that end here), kids
    (children), ends (it is a leaf of the trie if it gets no child), path (P by
    depth; index 0 is its block's start), meta (block number, prefix, smallest
    member above the block), cls (the class that ends here) and its parent.
    """

    def __init__(self):
        self.up: list[int] = []             # components
        self.top: list[int] = []            # a component's highest node
        self.same: list[int] = []           # nodes that turned out to be one
        self.depth, self.n, self.least, self.dead, self.leaves = [], [], [], [], []
        self.reps, self.kids, self.ends, self.path, self.meta, self.cls, self.parent = [], [], [], [], [], [], []

    def add(self, depth: int, n: int, least: int, dead: int, leaves: int, reps: int, kids: int, ends: bool, path: list, meta: tuple, cls) -> int:
        for values, v in ((self.depth, depth), (self.n, n), (self.least, least), (self.dead, dead), (self.leaves, leaves), (self.reps, reps),
                          (self.kids, kids), (self.ends, ends), (self.path, path), (self.meta, meta), (self.cls, cls), (self.parent, -1)):
            values.append(v)
        i = len(self.same)
        self.same.append(i)
        self.up.append(i)
        self.top.append(i)
        return i

    @staticmethod
    def _find(of: list[int], i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def node(self, i: int) -> int:
        return self._find(self.same, i)

    def total(self, i: int) -> tuple[int, int]:
        """``dead`` and leaves of a node whose children are complete."""
        return (self.dead[i] + (self.reps[i] - 1) * self.path[i][self.depth[i]] if self.reps[i] else self.dead[i],
                self.leaves[i] + (1 if self.ends[i] and not self.kids[i] else 0))

    def _hang(self, child: int, node: int) -> None:
        dead, leaves = self.total(child)
        self.parent[child] = node
        self.n[node] += self.n[child]
        self.least[node] = min(self.least[node], self.least[child])
        self.dead[node] += dead
        self.leaves[node] += leaves
        self.reps[node] += 1
        self.kids[node] += 1

    def join(self, a: int, b: int, depth: int) -> None:
        """The components of nodes a and b share exactly ``depth`` turns;
        calls come in falling depth."""
        a, b = self._find(self.up, a), self._find(self.up, b)
        if a == b:
            return
        x, y = self.node(self.top[a]), self.node(self.top[b])
        if self.depth[x] != depth and self.depth[y] == depth:
            a, b, x, y = b, a, y, x
        if self.depth[x] != depth:
            new = self.add(depth, 0, self.least[x], 0, 0, 0, 0, False, self.path[x], self.meta[x], None)
            self.up[new] = a
            self.top[a] = new
            self._hang(x, new)
            x = new
        if self.depth[y] == depth:          # two parts of one node
            self.same[y] = x
            for values in (self.n, self.dead, self.leaves, self.reps, self.kids):
                values[x] += values[y]
            self.least[x] = min(self.least[x], self.least[y])
            self.ends[x] = self.ends[x] or self.ends[y]
            self.cls[x] = self.cls[y] if self.cls[x] is None else self.cls[x]
        else:
            self._hang(y, x)
        self.up[b] = a
        self.top[a] = x

    def above(self, i: int) -> list[int]:
        """The node and its ancestors."""
        out = [self.node(i)]
        while self.parent[out[-1]] >= 0:
            out.append(self.node(self.parent[out[-1]]))
        return out


def _common(a: str, b: str) -> int:
    """Turns that two sequences of digests begin with alike."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k:k + WIDTH] == b[k:k + WIDTH]:
        k += WIDTH
    return k // WIDTH


ITEM_FIELDS = ["depth", "n", "least", "dead", "leaves", "reps", "kids", "ends", "path", "meta", "cls"]
NODE_FIELDS = ["conv_id", "blk", "pkey", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "dead", "before", "cls"]
NODE_SCHEMA = ("conv_id long, blk long, pkey string, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "dead long, before long, cls long, spine string, payload binary")
NODE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _written(forest: Forest, i: int, block: int, hidden=()) -> Iterator[tuple]:
    """Rows of node i and of the unbranched ones above it, top first.  The
    smallest member of a parent in ``hidden`` is not known yet."""
    blk, pkey, above = forest.meta[i]
    start, p = 0, forest.parent[i]
    if p >= 0:
        p = forest.node(p)
        start, above = forest.depth[p], None if p in hidden else forest.least[p]
    dead, leaves = forest.total(i)
    path = forest.path[i]
    for d in range(start + 1, forest.depth[i] + 1):
        last = d == forest.depth[i]
        yield (forest.least[i], blk, pkey, blk * block + d, above if d == start + 1 else forest.least[i], forest.n[i],
               forest.kids[i] if last else 1, leaves, dead, path[d - 1], forest.cls[i] if last else None)


def forest_nodes(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes below the blocks' starts: ``NODE_FIELDS``.

    ``classes`` has pkey, blk, seq, cls (a number of its own), chars, base,
    n, least, parent_least, and for classes that others continue (``goes_on``)
    dead and leaves of what follows.  Depths count from the root; ``cls`` is
    the class that ends at the node.
    """
    spark = classes.sparkSession
    keyed = classes.repartitionByRange("pkey", "seq").sortWithinPartitions("pkey", "seq")
    keyed = keyed.select("pkey", "blk", "seq", "cls", "chars", "base", "n", "least", "parent_least", "goes_on", "dead", "leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        forest, edges, first, last = Forest(), [], None, (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                path = [r["base"]]
                for c in r["chars"]:
                    path.append(path[-1] + c)
                on = bool(r["goes_on"])
                i = forest.add(len(r["chars"]), r["n"], r["least"], r["dead"] if on else 0, r["leaves"] if on else 0,
                               0 if on else r["n"], 0, not on, path, (r["blk"], r["pkey"], r["parent_least"]), r["cls"])
                depth = _common(last[1], r["seq"]) if last[0] == r["pkey"] else 0
                if depth:
                    edges.append((depth, i))
                last = (r["pkey"], r["seq"])
                first = first or last
        if first is None:
            return
        m = len(forest.same)
        for depth, i in sorted(edges, key=lambda e: (-e[0], e[1])):
            forest.join(i - 1, i, depth)
        # contracted: the nodes above the first and the last class
        left, right = forest.above(0), forest.above(m - 1)
        spine = {node: k for k, node in enumerate(dict.fromkeys(left + right))}
        items = [[getattr(forest, f)[node] for f in ITEM_FIELDS] for node in spine]
        parents = [spine[forest.node(forest.parent[node])] if forest.parent[node] >= 0 else None for node in spine]
        for node, p in zip(spine, parents):     # a spine node hangs itself again in the merge
            if p is not None:
                dead, leaves = forest.total(node)
                for f, v in (("n", forest.n[node]), ("dead", dead), ("leaves", leaves), ("reps", 1), ("kids", 1)):
                    items[p][ITEM_FIELDS.index(f)] -= v
        payload = pickle.dumps({"pid": pid, "items": items, "parents": parents, "first": first, "last": last,
                                "left": spine[left[0]], "right": spine[right[0]]})
        rows, refs = [], []
        for i in range(len(forest.same)):
            if i in spine:
                continue
            out = list(_written(forest, i, block, spine))
            p = forest.node(forest.parent[i]) if forest.parent[i] >= 0 else -1
            rows += out
            refs += [f"{pid}:{spine[p]}" if p in spine and k == 0 else None for k in range(len(out))]
            if len(rows) >= 8192:
                yield _batch(rows, refs, None)
                rows, refs = [], []
        yield _batch([*rows, (None,) * len(NODE_FIELDS)], [*refs, None], payload)

    found = stored(keyed.mapInArrow(run, NODE_SCHEMA), "forest")
    # one contracted forest a partition
    payloads = sorted((pickle.loads(bytes(r.payload)) for r in found.where("payload is not null").select("payload").collect()),
                      key=lambda p: p["pid"])
    rows, least = _merged(payloads, block)
    closed = found.where("payload is null").drop("payload")
    schema = closed.select(*NODE_FIELDS).schema
    known = spark.createDataFrame(least, "spine string, spine_least long")
    # a few nodes a partition
    closed = closed.join(F.broadcast(known), "spine", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "spine_least"))
    return closed.select(*NODE_FIELDS).union(spark.createDataFrame(rows, schema))


def _batch(rows: list[tuple], refs: list, payload) -> pa.RecordBatch:
    arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(NODE_TYPES)]
    last = [None] * (len(rows) - 1) + [payload] if rows else []
    return pa.RecordBatch.from_arrays([*arrays, pa.array(refs, pa.string()), pa.array(last, pa.binary())],
                                      names=[*NODE_FIELDS, "spine", "payload"])


def _merged(payloads: list[dict], block: int) -> tuple[list[tuple], list[tuple]]:
    """Nodes of the contracted forests joined over the partitions' boundaries,
    and the smallest member of each by ``pid:place``."""
    forest, edges, at = Forest(), [], {}
    for p in payloads:
        for k, x in enumerate(p["items"]):
            at[p["pid"], k] = forest.add(*x)
        for k, parent in enumerate(p["parents"]):
            if parent is not None:
                edges.append((p["items"][parent][0], at[p["pid"], parent], at[p["pid"], k]))
    for a, b in zip(payloads, payloads[1:]):
        if a["last"][0] == b["first"][0]:
            depth = _common(a["last"][1], b["first"][1])
            if depth:
                edges.append((depth, at[a["pid"], a["right"]], at[b["pid"], b["left"]]))
    for depth, a, b in sorted(edges, key=lambda e: -e[0]):
        forest.join(a, b, depth)
    rows = [r for i in range(len(forest.same)) if forest.same[i] == i for r in _written(forest, i, block)]
    return rows, [(f"{pid}:{k}", forest.least[forest.node(i)]) for (pid, k), i in at.items()]


# ---------------------------------------------------------------- the trie

def ends_digests(ends: DataFrame) -> DataFrame:
    """``cls, ends_sha256``: SHA-256 of the comma-joined conv_ids, ascending.

    Ids are sorted over range partitions and joined in runs of ``IDS``; a
    class' runs then pass through its digest one after another, never held
    together."""
    keyed = ends.repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, ids = batch.column("cls").to_numpy(zero_copy_only=False), batch.column("conv_id").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(cls)) + 1
            spans = [(x, min(x + IDS, b)) for a, b in zip([0, *cuts], [*cuts, len(cls)]) for x in range(a, b, IDS)] if len(cls) else []
            yield pa.RecordBatch.from_arrays([pa.array([cls[a] for a, _ in spans], pa.int64()), pa.array([ids[a] for a, _ in spans], pa.int64()),
                                              pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in spans], pa.string())],
                                             names=["cls", "least", "ids"])

    joined = keyed.mapInArrow(runs, "cls long, least long, ids string").repartition("cls").sortWithinPartitions("cls", "least")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cls, state = None, None
        for batch in batches:
            out = []
            for c, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist()):
                if c != open_cls:
                    if state is not None:
                        out.append((open_cls, state.hexdigest()))
                    open_cls, state = c, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())],
                                             names=["cls", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_cls], pa.int64()), pa.array([state.hexdigest()], pa.string())],
                                             names=["cls", "ends_sha256"])

    return joined.mapInArrow(digests, "cls long, ends_sha256 string")


def _with_parents(classes: DataFrame, root_least: int) -> DataFrame:
    """``parent_least``: the smallest member of the node above the block."""
    tops = classes.where("ckey is not null").select(F.col("ckey").alias("pkey"), F.col("least").alias("parent_least"))
    later = split_lookup(classes.where("blk > 0"), tops, ["pkey"], "left")
    first = classes.where("blk = 0").withColumn("parent_least", F.lit(root_least).cast("long"))
    return first.unionByName(later)


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 6, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    The root (depth 0) has every conversation as a member, turnless ones too.
    NULL roles and texts are empty, NULL turns come first, rows without a
    conv_id are left out, repeated rows are turns of their own, other columns
    are not read.  An empty table has no nodes, not even a root.
    """
    turns, lengths = rebuilt(conversations, group, most)
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not totals.n:
        return conversations.sparkSession.createDataFrame([], TRIE_SCHEMA)
    blocks = stored(blocks_of(turns, block), "blocks")
    one = blocks.groupBy("pkey", "blk", "seq").agg(
        F.any_value("chars").alias("chars"), F.any_value("base").alias("base"), F.any_value("ckey").alias("ckey"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.max(~F.col("ends")).alias("goes_on"))
    # two classes differ in prefix or turns, so the pair names one; the number is its stored place
    classes = stored(_with_parents(stored(one, "classes"), totals.least).withColumn("cls", F.monotonically_increasing_id()), "classes")
    # what follows a full block: found in the later blocks' forests
    blank = {"dead": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")}
    later = stored(forest_nodes(classes.where("blk > 0").withColumns(blank), block), "later")
    dead = later.where("conv_id <> parent_conv_id").select("conv_id", F.col("before").alias("died"))
    tips = later.where("n_children = 0 and n_leaves = 1")
    marks = (dead.select("conv_id", "died", F.lit(0).alias("tip"))
             .union(tips.select("conv_id", F.lit(None).cast("long"), F.lit(1)))
             .groupBy("conv_id").agg(F.max("died").alias("died"), F.sum("tip").alias("tip")))
    wide = blocks.where("ckey is not null")
    spent = blocks.groupBy("conv_id").agg(F.sum("all_chars").alias("spent"))
    each = wide.select("conv_id", "ckey").join(spent, "conv_id").join(marks, "conv_id", "left")
    died = F.coalesce("died", "spent")
    sums = each.groupBy("ckey").agg((F.sum(died) - F.min_by(died, "conv_id")).alias("dead"),
                                    F.sum(F.coalesce("tip", F.lit(0))).alias("leaves"))
    full = classes.where("ckey is not null").join(sums, "ckey")
    rest = classes.where("ckey is null").withColumns(blank)
    nodes = stored(forest_nodes(full.select(*rest.columns).unionByName(rest), block), "nodes")

    # children of a full block's node stand in the next block's forest
    tops = nodes.where((F.col("depth") - F.col("blk") * block) == 1)
    below = tops.where("blk > 0").groupBy(F.col("pkey").alias("ckey")).agg(F.count(F.lit(1)).alias("more"))
    more = classes.where("goes_on").select("cls", "ckey").join(below, "ckey").select("cls", "more")
    ended = ends_digests(split_lookup(blocks.where("ends").select("conv_id", "pkey", "seq"), classes.select("pkey", "seq", "cls"),
                                      ["pkey", "seq"], "inner").select("cls", "conv_id"))
    at_class = more.join(ended, "cls", "full")
    none = hashlib.sha256(b"").hexdigest()
    inner = nodes.where("cls is null").withColumns({"more": F.lit(0).cast("long"), "ends_sha256": F.lit(none)})
    outer = nodes.where("cls is not null").join(at_class, "cls", "left")
    rows = inner.unionByName(outer.select(*inner.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), "n_leaves",
        (F.col("dead") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    return rows.union(_root(conversations.sparkSession, nodes.where("depth = 1"), lengths, totals))


TRIE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "saved_tokens long, ends_sha256 string")


def _root(spark, tops: DataFrame, lengths: DataFrame, totals) -> DataFrame:
    sums = tops.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("dead").alias("dead")).first()
    turnless = ends_digests(lengths.where("len = 0").select(F.lit(0).cast("long").alias("cls"), "conv_id")).first()
    none = hashlib.sha256(b"").hexdigest()
    return spark.createDataFrame([(totals.least, 0, None, totals.n, sums.n_children, sums.leaves if sums.n_children else 1,
                                   sums.dead or 0, turnless.ends_sha256 if turnless else none)], TRIE_SCHEMA)
