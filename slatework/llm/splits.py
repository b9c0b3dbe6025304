"""Splits that keep related records together: components, then subset sums over their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.session import dropped, small, written

#: Rounds after which components must have converged; hooking with shortcutting needs about log2 of the longest path.
MOST_ROUNDS = 60
#: Bits of reachable sums that are kept at once when a choice is read back (64 MB); the choice doesn't depend on it.
BITS = 1 << 29


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of (a, b) edges, the component being its least node.

    Every node has a parent. In a round the roots of neighbouring trees hook to
    the least neighbouring root, then every node's parent becomes its
    grandparent until trees are stars. Both steps are joins of tables; each round
    is written to the shared folder. Loops and repeated edges do no harm.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = written(e, "components-edges")
    loops = edges.where("a is not null and a <=> b").select(F.col("a").alias("node"))
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).union(loops).distinct()
    parents = written(nodes.select("node", F.col("node").alias("parent")), "components-parents")
    for _ in range(MOST_ROUNDS):
        p = parents.withColumnRenamed("node", "n")
        # Edges between roots; those inside a tree are spent.
        roots = live.join(p.select(F.col("n").alias("a"), F.col("parent").alias("ra")), "a").join(p.select(F.col("n").alias("b"), F.col("parent").alias("rb")), "b")
        before, live = live, written(roots.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "components-edges")
        dropped(before)
        if live.isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
        # Hook: each larger root to its least smaller neighbour; parents only fall, so no cycle arises.
        hooks = written(live.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("to")), "components-hooks")
        while True:  # shortcut: pointer doubling among the hooked roots
            up = hooks.select(F.col("n").alias("to"), F.col("to").alias("top"))
            before, hooks = hooks, written(hooks.select("n", "to").join(up, "to", "left").select("n", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "components-hooks")
            dropped(before)
            if hooks.where("moved").isEmpty():
                break
        before, parents = parents, written(parents.join(hooks, parents["parent"] == hooks["n"], "left").select("node", F.coalesce("to", "parent").alias("parent")), "components-parents")
        dropped(before, hooks)
    raise RuntimeError(f"no convergence in {MOST_ROUNDS} rounds")


def choose(sizes: list[tuple[int, int]], goal: int) -> dict[int, int]:
    """How many of each size to take so that the total is as close to ``goal`` as can be.

    sizes: (size, number of components). A bitset of reachable sums grows by the
    powers of two in each multiplicity; the choice is read back from the bitsets
    before each step. More than BITS of them are not kept, but made again by halves
    of the steps. Ties go to the smaller total. Sums above twice the goal never
    help and are cut off.
    """
    if goal <= 0 or not sizes:
        return {}
    most = 2 * goal
    mask = (1 << (most + 1)) - 1
    steps: list[tuple[int, int]] = []  # size, copies
    for size, copies in sorted(sizes, reverse=True):
        left, part = copies, 1
        while left > 0 and size > 0:
            take = min(part, left)
            steps.append((size, take))
            left -= take
            part *= 2

    def grown(reach: int, step: tuple[int, int]) -> int:
        by = step[0] * step[1]
        return reach | ((reach << by) & mask) if by <= most else reach

    reach = 1
    for step in steps:
        reach = grown(reach, step)
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = reach >> (goal + 1)
    above = goal + (over & -over).bit_length() if over else None
    total = below if above is None or goal - below <= above - goal else above
    out: dict[int, int] = {}
    keep = max(1, BITS // (most + 1))
    parts = [(0, len(steps), 1)]  # steps from, to; sums reachable before the first
    while parts:
        low, high, reach = parts.pop()
        if high - low > keep:
            half, mid = reach, (low + high) // 2
            for step in steps[low:mid]:
                half = grown(half, step)
            parts += [(low, mid, reach), (mid, high, half)]
            continue
        before = [reach]
        for step in steps[low : high - 1]:
            before.append(grown(before[-1], step))
        for (size, take), known in zip(reversed(steps[low:high]), reversed(before), strict=False):
            if not known >> total & 1:
                out[size] = out.get(size, 0) + take
                total -= size * take
    return out


def assign(sizes: dict[int, int], shares: list[tuple[str, float]]) -> dict[str, dict[int, int]]:
    """Per split how many components of each size it takes.

    Splits are served from the smallest share up, each by the subset sum closest
    to its goal; the split with the largest share takes the rest. Sums are in
    records, whatever the size.
    """
    total = sum(s * n for s, n in sizes.items())
    whole = sum(share for _, share in shares) or 1.0
    left = dict(sizes)
    out: dict[str, dict[int, int]] = {}
    order = sorted(shares, key=lambda x: (x[1], x[0]))
    for name, share in order[:-1]:
        out[name] = choose([(s, n) for s, n in left.items() if n], round(total * share / whole))
        for s, n in out[name].items():
            left[s] -= n
    if order:
        out[order[-1][0]] = {s: n for s, n in left.items() if n}
    return out


def grouped_splits(rows: DataFrame, id_col: str, keys: list[str], shares: list[tuple[str, float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, component, split, keep...) such that rows that share any of the keys are in one split.

    Null keys connect nothing, nor does a key that one row alone holds; a row without any other is a component of its own.
    Components are found over key values, not rows, so a value held by a third of
    all rows is one node. The driver sees how many components have each size: with n
    records at most sqrt(2n) numbers. Ids should be unique. A component's name is
    the number of its key and the value.
    """
    d = rows.select(F.col(id_col).alias("id"), *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("_kept"))
    for i in range(len(keys)):  # keys of one row are dropped before any link is made
        shared = d.where(F.col(f"k{i}").isNotNull()).groupBy(f"k{i}").count().where("count > 1").select(F.concat(F.lit("k"), f"k{i}").alias("_shared"), F.lit(True).alias(f"s{i}"))
        # Rows without the key go by their ids, so that they don't meet in one task.
        d = d.join(small(written(shared, "split-shared")), F.coalesce(F.concat(F.lit("k"), f"k{i}"), F.concat(F.lit("n"), F.col("id").cast("string"))) == F.col("_shared"), "left").drop("_shared")
    tagged = [F.when(F.col(f"s{i}"), F.concat(F.lit(f"{i}:"), F.col(f"k{i}"))) for i in range(len(keys))]
    d = d.select("id", "_kept", F.array_compact(F.array(*tagged)).alias("k")).withColumn("first", F.coalesce(F.try_element_at("k", F.lit(1)), F.concat(F.lit("id:"), F.col("id").cast("string"))))
    d = written(d, "split-rows")
    # A row links its first key to its other keys; links are distinct before they are counted or joined.
    links = d.select("first", F.explode(F.when(F.size("k") > 0, F.col("k")).otherwise(F.array("first"))).alias("b")).distinct().select(F.col("first").alias("a"), "b")
    comp = components(links)
    weights = d.groupBy("first").count()
    per = weights.join(comp, weights["first"] == comp["node"]).groupBy("component").agg(F.sum("count").alias("size"))
    per = written(per, "split-sizes")
    sizes = {r["size"]: r["count"] for r in per.groupBy("size").count().collect()}  # one row per distinct size
    plan = assign(sizes, shares)
    spans = []
    for size in sizes:
        at = 0
        for name, _ in sorted(shares, key=lambda x: (x[1], x[0])):
            n = plan.get(name, {}).get(size, 0)
            if n:
                spans.append((int(size), at, at + n, name))
                at += n
    spark = rows.sparkSession
    table = spark.createDataFrame(spans, "size long, low long, high long, split string")
    # Components of a size are numbered in ranges of a hash, so one size shared by very many is no single task.
    numbered = _numbered(per, max(64, sum(sizes.values()) // 20_000))
    placed = numbered.join(small(table), "size").where("no >= low and no < high").select("component", "split")
    node = comp.join(placed, "component").select(F.col("node").alias("first"), "component", "split")
    return d.select("id", "first", "_kept").join(small(node), "first").select("id", "component", "split", *[F.col("_kept")[c].alias(c) for c in keep])


def _numbered(per: DataFrame, buckets: int) -> DataFrame:
    """(component, size, no): numbers from 0 within each size, by hash order."""
    from pyspark.sql import Window

    p = per.withColumn("b", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int"))
    counts = p.groupBy("size", "b").count()
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("size", "b").orderBy(F.xxhash64("component"), "component")) - 1
    return p.withColumn("i", inner).join(ahead, ["size", "b"]).select("component", "size", (F.col("ahead") + F.col("i")).alias("no"))
