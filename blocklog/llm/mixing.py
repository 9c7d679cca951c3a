"""Mixing sources to target weights by hierarchical budgeting.

Weights run down a tree of domain, language and source. A leaf can give its
tokens ``max_epochs`` times at most; what it falls short of goes to its
siblings by weight, and only what they cannot give goes to their ancestors'
siblings. Each leaf then takes a token prefix of its documents, epoch after
epoch, each epoch in a seeded order of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

LEVELS = ("domain", "lang", "source")
#: Buckets that cut a leaf's order; only one bucket of a leaf is summed row by row.
BUCKETS = 4096
#: Leaves and epochs up to which their plan is broadcast; beyond, it is joined by shuffle.
LEAVES = 100_000


def fill(budget: float, nodes: dict, weights: dict) -> dict:
    """Share ``budget`` among nodes (name: capacity) by weight, none over its capacity."""
    given = dict.fromkeys(nodes, 0.0)
    left, free = budget, sorted(n for n in nodes if nodes[n] > 0 and weights[n] > 0)
    while free:
        unit = left / sum(weights[n] for n in free)
        full = [n for n in free if unit * weights[n] >= nodes[n]]
        for n in full or free:
            given[n] = float(nodes[n]) if full else unit * weights[n]
            left -= given[n]
        free = [n for n in free if n not in full] if full else []
    return given


def budgets(tokens: dict[tuple, int], total: float, weights: dict[tuple, float], max_epochs: float) -> dict[tuple, int]:
    """Whole tokens for each leaf (a path of names).

    ``weights`` gives a path's weight among its siblings, 1 where it has none.
    A node's capacity is what its leaves can give, so a shortage below a node is
    met inside it before anything leaves it.
    """
    out: dict[tuple, int] = {}

    def share(prefix: tuple, leaves: list[tuple], budget: float) -> None:
        if len(leaves) == 1 and leaves[0] == prefix:
            out[prefix] = int(budget + 1e-6)
            return
        below: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            below.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        capacity = {n: sum(tokens[x] for x in group) * max_epochs for n, group in below.items()}
        given = fill(budget, capacity, {n: float(weights.get(n, 1.0)) for n in below})
        for n in sorted(below):
            share(n, below[n], given[n])

    if tokens:
        share((), sorted(tokens), total)
    return out


def word_count(text):
    """Words split at ASCII white space, as the tokens of a budget; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def mix(docs: DataFrame, total: float | None = None, share: float = 0.5, weights: dict[tuple, float] | None = None, max_epochs: int = 2, seed: int = 42, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(row columns of ``docs``, n_tokens, epoch) of the selected documents, once per epoch.

    ``docs`` has doc_id, ``n_tokens`` and the ``levels``. ``total`` is the budget
    in tokens, else ``share`` of all there are. A document is taken if the tokens
    before it in its leaf and epochs are below the leaf's budget, so a leaf
    exceeds its budget by less than one document.

    Null levels are the empty name. Documents without tokens are taken where
    budget is left. Repeated rows count each for itself; rows that tie in an
    epoch's order (equal doc_id and tokens) share one place: all or none of them
    is taken. Other columns may have any name and pass unchanged, but ``epoch`` is
    replaced. An empty table gives no rows. The driver holds one total per leaf.
    """
    names = [f"_{c}" for c in levels]
    kept = [c for c in docs.columns if c != "epoch"]
    rows = docs.select(F.struct(*kept).alias("row"), "doc_id", "n_tokens", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels, strict=True)])
    small = staged(rows.drop("row"), "mix-rows")
    sums = small.groupBy(*names).agg(F.sum("n_tokens").alias("n")).collect()
    tokens = {tuple(r[:-1]): int(r[-1]) for r in sums}
    target = share * sum(tokens.values()) if total is None else total
    given = budgets(tokens, target, weights or {}, max_epochs)
    spark = docs.sparkSession
    plan = [(*leaf, e, max(0, min(given[leaf] - e * n, n)), given[leaf] - e * n >= n) for leaf, n in sorted(tokens.items()) for e in range(max_epochs) if given[leaf] > e * n or (n == 0 and e == 0)]
    fields = ", ".join(f"{n} string" for n in names) + ", epoch int, budget long, whole boolean"
    leaves = spark.createDataFrame(plan, fields)
    side = F.broadcast if len(plan) <= LEAVES else lambda df: df

    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "doc_id"), 1)
    bucket = F.shiftright("place", 63 - BUCKETS.bit_length() + 1).cast("int")
    own = F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    keyed = small.join(side(leaves), names).where("NOT whole").withColumn("place", order)
    keyed = keyed.withColumn("bucket", bucket)
    leaf = [*names, "epoch"]
    tops = keyed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("budget").alias("budget"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.withColumn("before", before).where(F.col("before") < F.col("budget"))
    tops = staged(tops.withColumn("edge", F.col("before") + F.col("n") > F.col("budget")), "mix-buckets")
    edge = keyed.join(side(tops.where("edge").select(*leaf, "bucket", "before")), [*leaf, "bucket"])
    ties = edge.groupBy(*leaf, "budget", "before", "bucket", "place", "doc_id").agg(F.sum("n_tokens").alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf, "bucket").orderBy("place", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ties.withColumn("upto", F.col("before") + upto).where(F.col("upto") < F.col("budget"))
    limits = staged(ends.groupBy(*leaf).agg(F.max(own).alias("last")), "mix-ends")
    full = tops.where("NOT edge").groupBy(*leaf).agg(F.max("bucket").alias("last_bucket"))
    cut = leaves.join(full, leaf, "left").join(limits, leaf, "left")

    chosen = rows.join(side(cut), names).withColumn("place", order)
    chosen = chosen.withColumn("bucket", bucket)
    chosen = chosen.where(F.col("whole") | (F.col("bucket") <= F.coalesce("last_bucket", F.lit(-1))) | F.coalesce(own <= F.col("last"), F.lit(False)))
    return chosen.select("row.*", "epoch")


def with_domain(docs: DataFrame) -> DataFrame:
    """Documents with n_tokens and a domain: sources by the last digit of their name, in three."""
    digit = F.coalesce(F.regexp_extract(F.col("source"), r"(\d)$", 1).try_cast("int"), F.lit(0))
    return docs.withColumns({"n_tokens": word_count(F.col("text")), "domain": F.concat(F.lit("domain"), (digit % 3).cast("string"))})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return mix(staged(docs, "mix-docs")).select("doc_id", "epoch", "domain", "lang", "source", "n_tokens")
