"""A prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns.  It is known by its depth and a
124-bit hash: each turn's SHA-256 gives four numbers, and a prefix is their sum
times powers of fixed bases, modulo four primes.  Sums along a conversation
need no task to hold it: rows are sorted over all tasks, summed in each, and
what a task's first conversation had in the tasks before is added (`running`).

Each node's smallest member stands for it: (conv_id, depth) names a node.

The rollup splits the tree by centroids.  Each node has a weight that grouping
gives at once: its members' turns from the node on, which is the sum of
members over its subtree.  In a component with a top of weight t, the nodes of
weight t/2 or more are a path from the top down to the centroid.  What hangs
below the centroid is summed up (the component totals), and the sum is added
to every node of that path; weights on the path lose the centroid's weight.
The centroid is done, its children become tops of components, the rest stays
one: weights halve, so every row takes part in as many rounds as a logarithm
of the weight.  Components over ``LIMIT`` go through rounds of joins, smaller
ones are split to the end in one task by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huetide.llm.frames import table, written

#: Weight, and so rows at most, of a component that one task splits.
LIMIT = 1 << 16
#: Characters of listed members in a row.
LISTED = 1 << 16

#: Primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = tuple(int.from_bytes(hashlib.sha256(b"base %d" % p).digest()[:8]) % p for p in PRIMES)


def running(df: DataFrame, key: str, order: list[str], values: list[str], keep: list[str], moduli: tuple[int, ...] | None = None) -> DataFrame:
    """The columns of ``keep``, and ``sum_x`` for each of ``values``: its sum over the rows of ``key`` up to this one, in ``order``.

    ``order`` begins with the key, a long.  Tasks sum what they hold; of each
    task only the sums of its last key go to the driver, to be added to the
    first key of the tasks after.  Of equal rows any may come first.
    """
    keep = [key, *(c for c in keep if c != key)]
    moduli = moduli or (1 << 62,) * len(values)
    made = [*(f"sum_{v}" for v in values), "_place", "_part"]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*dict.fromkeys([*keep, *values]))
    schema = T.StructType([*(ordered.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in made)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, place = TaskContext.get().partitionId(), None, [0] * len(values), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            new = np.ones(n, dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            goes_on = begin == 0 if keys[0] == last else np.zeros(n, dtype=bool)
            sums = []
            for k, (v, m) in enumerate(zip(values, moduli, strict=True)):
                total = np.concatenate(([0], np.cumsum(batch.column(v).to_numpy())))
                own = (total[1:] - total[begin] + np.where(goes_on, carry[k], 0)) % m
                carry[k] = int(own[-1])
                sums.append(own)
            last = keys[-1]
            extra = [pa.array(x, pa.int64()) for x in (*sums, np.arange(place, place + n), np.full(n, part))]
            place += n
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + extra, names=schema.names)

    summed = written(ordered.mapInArrow(work, schema), "running")
    tail = F.max_by(F.struct(*[f"sum_{v}" for v in values]), "_place").alias("tail")
    rows, held, had = [], None, [0] * len(values)
    for r in summed.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), tail).orderBy("_part").collect():  # a row a task
        before = had if r.first == held else [0] * len(values)
        rows.append((r["_part"], r.first, *before))
        had = [(t + (b if r.first == r.last else 0)) % m for t, b, m in zip(r.tail, before, moduli, strict=True)]
        held = r.last
    carried = df.sparkSession.createDataFrame(rows, "_part long, _first long" + "".join(f", _had_{v} long" for v in values))
    whole = [((F.col(f"sum_{v}") + F.when(F.col(key) == F.col("_first"), F.col(f"_had_{v}")).otherwise(0)) % m).alias(f"sum_{v}") for v, m in zip(values, moduli, strict=True)]
    return summed.join(F.broadcast(carried), "_part").select(*keep, *whole)


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as conv_id, i (1, 2, ... in each conversation), digest and bytes of the text.

    By turn, null first; turns of one number by role and then text as far as
    their first 64 characters tell, then by digest.  Null role and text are
    empty; repeated rows are turns of their own; rows with null conv_id are in
    no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.concat(role, F.lit("\0"), text), 1, 64).alias("begins"),
        F.substring(F.unhex(F.sha2(F.encode(said, "UTF-8"), 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("row"),  # deals out rows that repeat
    )
    out = running(rows, "conv_id", ["conv_id", "turn", "begins", "digest", "row"], ["one"], ["digest", "bytes"])
    return out.withColumnRenamed("sum_one", "i")


def terms(turns: DataFrame) -> DataFrame:
    """conv_id, i, bytes and what each turn adds to the hashes of the prefixes that hold it."""
    names = [f"t{k}" for k in range(len(PRIMES))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype=">u4").astype(np.int64).reshape(-1, 4)
            out = []
            for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                made, left = digest[:, k] % p, batch.column("i").to_numpy().copy()
                while left.any():
                    made = np.where(left & 1, made * base % p, made)
                    base, left = base * base % p, left >> 1
                out.append(pa.array(made))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "i", "bytes")] + out, names=["conv_id", "i", "bytes", *names])

    return turns.select("conv_id", "i", "bytes", "digest").mapInArrow(work, "conv_id long, i long, bytes long, " + ", ".join(f"{t} long" for t in names))


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each conversation and each of its prefixes with turns: conv_id, depth, n (its turns), bytes, hash (a, b) and that of the prefix before (pa, pb)."""
    t = [f"t{k}" for k in range(len(PRIMES))]
    summed = running(terms(turns), "conv_id", ["conv_id", "i"], t, ["i", "bytes", *t], PRIMES)
    before = [(F.col(f"sum_{x}") - F.col(x) + p) % p for x, p in zip(t, PRIMES, strict=True)]
    two = lambda x, y: F.shiftleft(x, 31) + y
    summed = written(
        summed.select(
            "conv_id",
            F.col("i").alias("depth"),
            "bytes",
            two(F.col("sum_t0"), F.col("sum_t1")).alias("a"),
            two(F.col("sum_t2"), F.col("sum_t3")).alias("b"),
            two(before[0], before[1]).alias("pa"),
            two(before[2], before[3]).alias("pb"),
        ),
        "prefixes",
    )
    return summed.join(summed.groupBy("conv_id").agg(F.max("depth").alias("n")), "conv_id")


def _split(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """``sums`` with each row's subtree sum of ``values`` added, for components of which a task has all rows.

    Rows come by depth; ``parent`` is a row, or -1 for a component's top, and
    ``weight`` what the rows of a subtree add up to.  The steps are those of ``rollup``.
    """
    n = len(parent)
    rows, sums, weight = np.arange(n), sums.copy(), weight.copy()
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(depth)) + 1, [n]))
    top = rows.copy()
    for lo, hi in zip(cuts[1:-1], cuts[2:], strict=True):
        own = rows[lo:hi]
        top[lo:hi] = np.where(parent[lo:hi] < 0, own, top[parent[lo:hi]])
    active = np.ones(n, dtype=bool)
    while active.any():
        path = np.flatnonzero(active & (2 * weight >= weight[top]))
        centre = np.full(n, -1)
        centre[top[path]] = path  # of a path's rows the deepest, as later ones take the place of earlier ones
        below = active & (centre[top] == rows)
        found = np.flatnonzero(below)
        new = top.copy()
        for lo, hi in zip(cuts[1:-1], cuts[2:], strict=True):
            own = lo + np.flatnonzero(active[lo:hi] & (parent[lo:hi] >= 0))
            own = own[below[parent[own]]]
            new[own] = np.where(centre[top[parent[own]]] == parent[own], own, new[parent[own]])
            below[own] = True
        total = np.zeros_like(sums)
        np.add.at(total, top[below], values[below])
        lost = np.zeros(n, dtype=np.int64)
        lost[top[found]] = weight[found]
        sums[path] += total[top[path]]
        weight[path] -= lost[top[path]]
        active[found] = False
        top = new
    return sums


def _split_all(pool: DataFrame, limit: int) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens of components of at most ``limit`` rows each."""

    def done(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).sort_by([("depth", "ascending"), ("conv_id", "ascending")])
        col = {c: rows.column(c).to_numpy() for c in rows.column_names}
        _, conv = np.unique(np.concatenate((col["conv_id"], col["parent_conv_id"])), return_inverse=True)
        n, steps = len(rows), int(col["depth"].max(initial=0)) + 2
        own, up = conv[:n] * steps + col["depth"], conv[n:] * steps + col["depth"] - 1
        order = np.argsort(own)
        at = order[np.minimum(np.searchsorted(own, up, sorter=order), n - 1)]
        is_top = (col["conv_id"] == col["top_conv"]) & (col["depth"] == col["top_depth"])
        parent = np.where(is_top, -1, at)
        out = _split(parent, col["depth"], col["weight"], np.stack((col["leaf"], col["saved"]), axis=1), np.stack((col["n_leaves"], col["saved_tokens"]), axis=1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (col["conv_id"], col["depth"], out[:, 0], out[:, 1])], names=["conv_id", "depth", "n_leaves", "saved_tokens"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size + batch.num_rows > limit:  # what comes before the last component is whole
                tops = [batch.column(c).to_numpy() for c in ("top_conv", "top_depth")]
                changes = np.flatnonzero((np.diff(tops[0]) != 0) | (np.diff(tops[1]) != 0)) + 1
                cut = int(changes[-1]) if len(changes) else 0
                if not cut and held:
                    last = held[-1].slice(held[-1].num_rows - 1)
                    cut = -1 if any(last.column(c)[0] != batch.column(c)[0] for c in ("top_conv", "top_depth")) else 0
                if cut:
                    cut = max(cut, 0)
                    yield done([*held, batch.slice(0, cut)])
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield done(held)

    columns = ["top_conv", "top_depth", "conv_id", "depth", "parent_conv_id", "weight", "leaf", "saved", "n_leaves", "saved_tokens"]
    filled = pool.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in columns])
    dealt = filled.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth")
    return dealt.mapInArrow(work, "conv_id long, depth long, n_leaves long, saved_tokens long")


def rollup(nodes: DataFrame, steps: Callable[[], DataFrame], limit: int = LIMIT, rounds: list[int] | None = None) -> DataFrame:
    """Subtree sums of ``leaf`` and ``saved`` as conv_id, depth, n_leaves, saved_tokens.

    ``nodes`` is one tree: conv_id, depth, parent_conv_id, weight (sum over the
    subtree of whole numbers of 1 or more), leaf, saved; ``steps`` gives conv_id
    (of each node), depth and, for that conversation's prefix of that depth,
    node_conv and parent_conv.  ``rounds``, if given, gets the number of
    components split in each round of joins.
    """
    top = ["top_conv", "top_depth"]
    is_top = "conv_id = top_conv and depth = top_depth"
    root = nodes.where("depth = 0").select("conv_id", "weight").first()
    if root is None:
        return nodes.select("conv_id", "depth", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    state = nodes.select(F.lit(root.conv_id).alias("top_conv"), F.lit(0).cast("long").alias("top_depth"), "conv_id", "depth", "parent_conv_id", "weight", "leaf", "saved", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    if root.weight <= limit:
        return _split_all(state, limit)
    columns = state.columns
    # written, so that the one component's name is no constant that would make joins on it cross joins
    large, small, done, walked = written(state.withColumn("total", F.lit(root.weight)), "left"), [], [], written(steps(), "steps")
    while True:
        path = F.col("weight") * 2 >= F.col("total")
        centres = large.where(path).groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("centre"))
        met = large.join(centres, top).withColumn("path", path)
        is_centre = (F.col("depth") == F.col("centre.depth")) & (F.col("conv_id") == F.col("centre.conv_id"))
        may = ~F.col("path") & (F.col("depth") > F.col("centre.depth"))
        # the child of the centroid that a node's conversation goes through, if it goes through the centroid
        through = walked.select(F.col("conv_id").alias("conv_id"), (F.col("depth") - 1).alias("at"), "node_conv", "parent_conv")
        looked = met.where(may).withColumn("at", F.col("centre.depth")).join(through, ["conv_id", "at"])
        under = F.col("parent_conv") == F.col("centre.conv_id")
        same = [F.col(c) for c in top]
        named = looked.select(*columns, "path", "centre", under.alias("below"), F.when(under, F.col("node_conv")).otherwise(F.col("top_conv")).alias("next_conv"), F.when(under, F.col("at") + 1).otherwise(F.col("top_depth")).alias("next_depth"))
        others = met.where(~may).select(*columns, "path", "centre", is_centre.alias("below"), same[0].alias("next_conv"), same[1].alias("next_depth"))
        split = written(named.unionByName(others), "split")
        totals = split.where("below").groupBy(*top).agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = split.join(totals, top)
        more = lambda c, by: F.when(F.col("path"), F.col(c) + F.col(by)).otherwise(F.col(c)).alias(c)
        lighter = F.when(F.col("path"), F.col("weight") - F.col("centre.weight")).otherwise(F.col("weight"))
        moved = summed.select(
            F.col("next_conv").alias("top_conv"), F.col("next_depth").alias("top_depth"), "conv_id", "depth", "parent_conv_id", lighter.alias("weight"), "leaf", "saved",
            more("n_leaves", "more_leaves"), more("saved_tokens", "more_saved"), is_centre.alias("is_centre"),
        )
        moved = written(moved, "moved")
        done.append(moved.where("is_centre").select("conv_id", "depth", "n_leaves", "saved_tokens"))
        left = moved.where("not is_centre")
        left = written(left.join(left.where(is_top).select(*top, F.col("weight").alias("total")), top).select(*columns, "total"), "left")
        small.append(left.where(F.col("total") <= limit).drop("total"))
        large = left.where(F.col("total") > limit)
        if rounds is not None:
            rounds.append(moved.where("is_centre").count())
        if large.isEmpty():
            break
    pool = small[0]
    for more_rows in small[1:]:
        pool = pool.unionByName(more_rows)
    out = _split_all(pool, limit)
    for rows in done:
        out = out.unionByName(rows)
    return out


def _listed(ends: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of every node with conversations that end there, in order of conv_id; no task holds a list whole."""
    node = ["depth", "a", "b"]

    def list_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, first, texts):
            return pa.RecordBatch.from_pylist([dict(zip(node, key, strict=True), first=first, said=",".join(texts))], schema=pa.schema([*((c, pa.int64()) for c in (*node, "first")), ("said", pa.string())]))

        key, first, texts, size = None, 0, [], 0
        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*node, "conv_id")), strict=True):
                if own != key or size > LISTED:
                    if texts:
                        yield out(key, first, texts)
                    key, first, texts, size = own, conv, [], 0
                texts.append(str(conv))
                size += len(texts[-1]) + 1
        if texts:
            yield out(key, first, texts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, shas = [], []
            for *own, said in zip(*(batch.column(c).to_pylist() for c in (*node, "said")), strict=True):
                if own == key:
                    state.update(b"," + said.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = own, hashlib.sha256(said.encode())
            yield made(keys, shas)
        if state is not None:
            yield made([key], [state.hexdigest()])

    def made(keys, shas):
        return pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int64()) for j in range(3)), pa.array(shas, pa.string())], names=[*node, "ends_sha256"])

    key = ", ".join(f"{c} long" for c in node)
    order = [*node, "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(list_up, f"{key}, first long, said string")
    return rows.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, limit: int = LIMIT, rounds: list[int] | None = None) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, i, digest, bytes), with their subtrees' sums.

    ``conversations`` has every conv_id once, those without turns too.  Returns
    conv_id (the smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, members but
    one times bytes of the last text) and ends_sha256 (of the conversations
    that end at the node, listed).  Without conversations there is no root and
    no row.
    """
    spark = turns.sparkSession
    node = ["depth", "a", "b"]
    rows = written(prefixes(turns), "members")
    members = conversations.join(rows.where("depth = n").select("conv_id", "n"), "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") + 1).alias("weight")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", "weight", zero.alias("bytes"), zero.alias("pa"), zero.alias("pb"))
    grouped = rows.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"), *[F.max(c).alias(c) for c in ("bytes", "pa", "pb")]
    )
    nodes = written(root.unionByName(grouped), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    first = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    high, deep = nodes.where("depth <= 1"), nodes.where("depth > 1")
    high = high.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first and first.conv_id).cast("long")))
    tree = high.unionByName(deep.join(parents, ["depth", "pa", "pb"]), allowMissingColumns=False).join(children, node, "left")
    tree = written(
        tree.select(
            *node, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "weight",
            F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        ),
        "tree",
    )

    def steps() -> DataFrame:
        own = rows.join(tree.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", *node)
        return own.join(tree.select(*node, F.col("conv_id").alias("node_conv"), F.col("parent_conv_id").alias("parent_conv")), node).select("conv_id", "depth", "node_conv", "parent_conv")

    sums = rollup(tree, steps, limit, rounds)
    ends = rows.where("depth = n").select(*node, "conv_id").unionByName(members.where("n = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    out = tree.join(sums, ["conv_id", "depth"]).join(_listed(ends), node, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of conversations given as conv_id, turn, role, text; other columns are ignored (see ``numbered`` and ``trie``)."""
    turns = written(numbered(conversations), "turns")
    return trie(turns, turns.select("conv_id").distinct(), limit)


#: Of each five conversations, the four others begin with up to so many turns less one of the first.
GROUP, HEADS = 5, 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """The query's conversations: c has the first h turns of c - c % 5, then its own after its first h; h = CRC-32 of c % 9."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    from_ = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", head.alias("h"), from_.alias("from"))
    others = convs.where(F.col("conv_id") != F.col("from"))
    heads = turns.where((F.col("conv_id") == from_) & (F.col("i") < HEADS)).select(F.col("conv_id").alias("from"), "i", "digest", "bytes")
    lent = heads.join(others.select("from", "conv_id", "h"), "from").where(F.col("i") <= F.col("h")).select("conv_id", "i", "digest", "bytes")
    # own turns move up where the first conversation is shorter than h
    lengths = convs.where(F.col("conv_id") == F.col("from")).select("from", F.col("n").alias("has"))
    moved = others.join(lengths, "from", "left").select("conv_id", F.greatest(F.lit(0).cast("long"), F.col("h") - F.coalesce("has", F.lit(0).cast("long"))).alias("up")).where("up > 0")
    own = turns.where((F.col("conv_id") == from_) | (F.col("i") > head)).join(moved, "conv_id", "left")
    own = own.select("conv_id", (F.col("i") - F.when(F.col("conv_id") == from_, F.lit(0)).otherwise(F.coalesce("up", F.lit(0)))).alias("i"), "digest", "bytes")
    return own.unionByName(lent)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that those of a group share their first turns."""
    turns = written(numbered(table(spark, sf_dir, "conversations")), "turns")
    return trie(rebuilt(turns), turns.select("conv_id").distinct())
