"""Mixing sources to target weights with a hierarchical token budget and seeded epochs.

The tree has a level for each of the given columns, say domain, language and source. A budget of tokens is
passed down by the weights of the children. A node can take no more than its tokens times ``max_epochs``;
what a child can't take goes to its siblings by their weights, and only what no sibling can take goes to the
siblings of its parent, and so on (a node's capacity is the sum of its children's). Children of weight 0 get what
all others can't take, in equal parts. Up to MAX_LEAVES leaves are planned on the driver, more by the same rule level by
level as tables: children in order of capacity to weight fill up first, and running sums tell how many do.

A leaf whose budget is k times its tokens and a rest gives k whole epochs, and of epoch k the documents in
the order of a seeded hash as long as their tokens fit the rest. The place where the rest ends is found by
narrowing the hash range ten bits at a time with partial sums, so that a leaf with any share of all rows is
never brought together in one task.

Defined results: a null level counts as the empty name; a null text has no tokens; equal names of one path
are one leaf; rows equal in id and text go together; without rows or with a budget of 0 nothing is selected.
Columns ``n_tokens`` and ``epoch`` are added or replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.functions.order import running
from siftwire.llm.sized import sized
from siftwire.session import checkpointed, stored

#: Leaves of the tree that the driver plans for; the budgets of more are found as tables.
MAX_LEAVES = 100_000
_BITS, _STEP = 60, 10
Path = tuple[str, ...]


def share_out(budget: float, weights: Mapping[Path, float], capacity: Mapping[Path, float]) -> dict[Path, float]:
    """The budget of every leaf; ``capacity`` holds the leaves, ``weights`` any nodes (1 where absent)."""
    total: dict[Path, float] = {}
    children: dict[Path, set[Path]] = {}
    for leaf, most in capacity.items():
        for k in range(len(leaf) + 1):
            total[leaf[:k]] = total.get(leaf[:k], 0.0) + most
            if k:
                children.setdefault(leaf[: k - 1], set()).add(leaf[:k])
    out: dict[Path, float] = {}
    open_nodes = [((), min(budget, total.get((), 0.0)))]
    while open_nodes:
        node, left = open_nodes.pop()
        rest = sorted(children.get(node, ()))
        if not rest:
            if node in capacity:
                out[node] = min(left, capacity[node])
            continue
        given: dict[Path, float] = {}
        while rest:
            own = {c: weights.get(c, 1.0) for c in rest}
            weight = sum(own.values())
            if not weight:  # only children of weight 0 are left
                own, weight = dict.fromkeys(rest, 1.0), float(len(rest))
            full = [c for c in rest if (own[c] or not any(own.values())) and total[c] <= left * own[c] / weight]
            if not full:
                given |= {c: left * own[c] / weight for c in rest}
                break
            for c in full:
                given[c] = total[c]
                left -= total[c]
            rest = [c for c in rest if c not in full]
        open_nodes += given.items()
    return out


def planned(leaves: DataFrame, weights: Mapping[Path, float], budget: float, max_epochs: float, depth: int) -> DataFrame:
    """(leaf, b): ``share_out`` of any number of ``leaves`` (leaf, path, n), of ``depth`` levels, as tables."""
    spark = leaves.sparkSession
    listed = [(list(path), float(w)) for path, w in weights.items()]
    given = F.broadcast(spark.createDataFrame(listed, "path array<string>, weight double"))  # as many as the caller named
    nodes = {depth: stored(leaves.select("path", (F.col("n") * max_epochs).alias("total")), "leaves")}
    for k in range(depth - 1, -1, -1):
        nodes[k] = stored(nodes[k + 1].groupBy(F.slice("path", 1, k).alias("path")).agg(F.sum("total").alias("total")), "nodes")
    shares = nodes[0].select("path", F.least(F.col("total"), F.lit(float(budget))).alias("b"))
    for k in range(1, depth + 1):
        children = nodes[k].join(given, "path", "left").select("path", F.slice("path", 1, k - 1).alias("up"), "total", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        # Children of weight 0 come after all others and share alike.
        late = (F.col("weight") <= 0).cast("int")
        children = children.select("path", "up", "total", late.alias("late"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"))
        children = children.withColumn("ratio", F.col("total") / F.col("weight"))
        block = F.struct("late", F.floor(F.log2(F.col("ratio") + 1e-9)).alias("size"))
        order = ["ratio", "path"]
        placed = running(children, ["up"], block, order, F.col("total"), "taken", "double")
        placed = stored(running(placed, ["up", "late"], block, order, F.col("weight"), "weighed", "double"), "placed")
        sums = placed.groupBy("up", "late").agg(F.sum("weight").alias("all"))
        budgets = shares.select(F.col("path").alias("up"), "b")
        rest = placed.join(sums, ["up", "late"]).join(budgets, "up").withColumn("left", F.col("b") - (F.col("taken") - F.col("total")))
        full = F.col("total") * (F.col("all") - F.col("weighed") + F.col("weight")) <= F.col("left") * F.col("weight")
        judged = stored(rest.withColumn("full", full), "judged")
        # The level at which those that don't fill up share what is left: that of the first of them.
        first = F.min(F.when(~F.col("full"), F.struct("late", "ratio", "path", F.greatest(F.col("left"), F.lit(0.0)).alias("left"), (F.col("all") - F.col("weighed") + F.col("weight")).alias("weights"))))
        levels = judged.groupBy("up").agg(first.alias("x")).select("up", F.col("x.late").alias("at"), (F.col("x.left") / F.col("x.weights")).alias("level"))
        open_share = F.when(F.col("late") == F.col("at"), F.least("total", F.col("level") * F.col("weight"))).otherwise(F.when(F.col("late") < F.col("at"), F.col("total")).otherwise(0.0))
        shares = stored(judged.join(levels, "up").select("path", F.when(F.col("full"), F.col("total")).otherwise(open_share).alias("b")), "shares")
    return leaves.select("leaf", "path").join(shares, "path").select("leaf", "b")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id), F.xxhash64(text))


def place(seed: int, epoch: Column, key: Column) -> Column:
    """The place of a row in an epoch: 60 bits of a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, key), 64 - _BITS)


def _ends(rows: DataFrame, plan: DataFrame, wide: bool) -> DataFrame:
    """(leaf, end, bits): rows of the partial epoch whose place, its first ``bits`` bits, is below ``end`` fit the rest."""
    open_plan = plan.where("rest > 0").select("leaf", "rest", F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("before"))
    open_plan = checkpointed(open_plan)
    hint = sized if wide else F.broadcast
    for bits in range(_STEP, _BITS + 1, _STEP):
        near = rows.join(hint(open_plan), "leaf").where(F.shiftright("place", _BITS - bits + _STEP) == F.col("end"))
        sums = near.groupBy("leaf", "rest", "before", F.shiftright("place", _BITS - bits).alias("bucket")).agg(
            F.sum("n_tokens").alias("tokens"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        # At most 2 ** _STEP rows of a leaf.
        upto = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", F.col("before") + upto).where("upto > rest")
        first = over.groupBy("leaf", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"), (F.col("low") < F.col("high")).alias("more"))).alias("x"))
        found = checkpointed(first.select("leaf", "rest", F.col("x.bucket").alias("end"), F.col("x.before").alias("before"), F.col("x.more").alias("more")))
        open_plan = found.drop("more")
        if not found.where("more").limit(1).count():
            break
    return open_plan.select("leaf", "end", F.lit(bits).alias("bits"))


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[Path, float],
    budget: float,
    *,
    max_epochs: float = 4.0,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The selected rows of ``docs`` with n_tokens and epoch, a row for each epoch that takes the document.

    ``budget`` counts tokens (words); up to 1.0 it is the share of all tokens. ``weights`` maps paths, such
    as ("web",) or ("web", "en"), to the weight of that node among its siblings.
    """
    spark = docs.sparkSession
    leaf = F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels)))
    slim = docs.select(leaf.alias("leaf"), row_key(doc_id, text).alias("key"), word_count(F.col(text)).alias("n_tokens"))
    slim = stored(slim, "tokens")
    names = F.from_json("leaf", "array<string>").alias("path")
    counted = slim.groupBy("leaf").agg(F.sum("n_tokens").alias("n")).select("leaf", names, "n")
    leaves = counted.limit(MAX_LEAVES + 1).collect()
    wide = len(leaves) > MAX_LEAVES
    if wide:
        counted = stored(counted, "leaves")
        most = budget if budget > 1 else budget * counted.agg(F.sum("n")).first()[0]
        given = planned(counted, weights, most, max_epochs, len(levels)).join(counted.select("leaf", "n"), "leaf").withColumn("b", F.col("b") + 1e-6)
        whole = F.when(F.col("n") > 0, F.floor(F.col("b") / F.col("n"))).otherwise(0).cast("int")
        plan = given.select("leaf", whole.alias("whole"), F.when(F.col("n") > 0, F.floor(F.col("b") - whole * F.col("n"))).otherwise(0).cast("long").alias("rest"))
        plan = stored(plan, "plan")
    else:
        have = {tuple(r["path"]): r["n"] for r in leaves}
        wanted = share_out(budget if budget > 1 else budget * sum(have.values()), weights, {p: n * max_epochs for p, n in have.items()})
        rows = []
        for r in leaves:
            n, b = r["n"], wanted.get(tuple(r["path"]), 0.0) + 1e-6
            full = int(b // n) if n else 0
            rows.append((r["leaf"], full, int(b - full * n) if n else 0))
        plan = spark.createDataFrame(rows, "leaf string, whole int, rest long")

    hint = sized if wide else F.broadcast
    placed = slim.join(hint(plan.select("leaf", "whole")), "leaf").select("leaf", "n_tokens", place(seed, F.col("whole"), F.col("key")).alias("place"))
    ends = plan.join(_ends(placed, plan, wide), "leaf", "left").select(F.col("leaf").alias("__leaf"), "whole", "end", "bits")
    kept = [c for c in docs.columns if c not in ("n_tokens", "epoch")]
    rows = docs.select(*kept, leaf.alias("__own"), row_key(doc_id, text).alias("__key"), word_count(F.col(text)).alias("n_tokens"))
    rows = rows.join(hint(ends), F.col("__own") == F.col("__leaf"))
    inside = F.expr(f"shiftright({{}}, {_BITS} - bits)".format("__place")) < F.col("end")
    rows = rows.withColumn("__place", place(seed, F.col("whole"), F.col("__key")))
    copies = F.col("whole") + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return rows.where(copies > 0).select(*kept, "n_tokens", F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch"))
