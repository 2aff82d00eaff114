"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LEVELS = ("domain", "lang", "source")
SEED = 17
MAX_EPOCHS = 4
NONE = "(none)"
_LEAF = [f"leaf_{x}" for x in LEVELS]


@dataclass(frozen=True)
class Tree:
    """The domain-language-source tree. ``domains``: sources of each domain, all others are of the domain ``rest``. ``weights``: by level,
    weights among siblings; what is not named weighs ``other`` of its level. A weight of 0 takes nothing."""

    domains: dict[str, list[str]] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    other: dict[str, float] = field(default_factory=dict)
    rest: str = "reference"

    def domain(self, source: Column) -> Column:
        out = F.lit(self.rest)
        for name, members in self.domains.items():
            out = F.when(source.isin(members), name).otherwise(out)
        return out

    def weight(self, level: str, name: Column) -> Column:
        out = F.lit(float(self.other.get(level, 1.0)))
        for k, w in self.weights.get(level, {}).items():
            out = F.when(name == k, float(w)).otherwise(out)
        return out


def budgets(leaves: DataFrame, total: float, tree: Tree, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves(domain, lang, source, n)`` with the whole tokens of each one's ``budget``, ``total`` being propagated from the root.

    A subtree can take ``max_epochs`` times its tokens. Level by level, siblings share their parent's budget by weight;
    what one cannot take goes to its siblings by their weights, and up to the ancestors' siblings only once all of a subtree is
    used up. In the order of capacity over weight, siblings are full as long as their capacity is within the level that
    the rest of the budget allows; from the first one that isn't, that level holds. Running sums in windows find it.
    """
    parent, above = None, []
    for level in LEVELS:
        keys = [*above, level]
        x = leaves.groupBy(*keys).agg((F.sum("n") * max_epochs).cast("double").alias("cap")).withColumn("w", tree.weight(level, F.col(level)))
        x = x.where("w > 0")
        x = x.join(parent, above) if above else x.withColumn("budget", F.lit(float(total)))
        group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))  # the domains that a tree names
        before = group.orderBy(F.col("cap") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumns({"taken": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all": F.sum("w").over(group)})
        x = x.withColumn("share", (F.col("budget") - F.col("taken")) / (F.col("all") - F.col("gone")))
        brim = F.min(F.when(F.col("cap") > F.col("share") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("at"), level, "share"))).over(group)  # of equal ones the first
        x = x.withColumn("brim", brim)
        full = F.col("brim").isNull() | (F.col("cap") / F.col("w") < F.col("brim.at"))
        parent = x.select(*keys, F.when(full, F.col("cap")).otherwise(F.col("w") * F.col("brim.share")).alias("budget"))
        above = keys
    return leaves.join(parent, list(LEVELS), "left").select(*LEVELS, "n", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, tree: Tree, ratio: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED, with_epoch: bool = False, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``docs``, each as often as it is drawn, so that tokens follow the target weights of ``tree``.

    The budget is ``ratio`` times all tokens (words between white space, counted over whole texts). Each leaf is gone through in a seeded
    order, another one each epoch: whole epochs first, then the longest prefix of the next that stays within the
    leaf's budget. The order is that of md5(seed:epoch:id:md5(text)). Where a prefix ends is found on rows of an id, a length and
    a digest: the first 16 bits cut each leaf into ranges, whose totals tell the one that holds the end, and only
    that range is sorted. No leaf, however large, is one task, and texts are never shuffled while leaves are few enough to broadcast.

    A null language or source, or a missing column, is the branch ``(none)``; null and blank texts have no tokens and come with each
    whole epoch of their leaf, or in the prefix. Rows equal in id and text have one place in the order: a prefix holds
    all of them or none, and they are drawn one by one. An empty table gives an empty table. ``with_epoch`` adds the
    column ``epoch``, counted from 1, in place of one called so; other columns of any name are kept.
    """
    tok, dig, place, ep, *leaf = c.fresh(docs, "tokens", "digest", "place", "epoch", *_LEAF)
    branch = lambda name: F.coalesce(c.col(name).cast("string"), F.lit(NONE)) if name.lower() in {x.lower() for x in docs.columns} else F.lit(NONE)
    told = lambda full, id_, digest: F.md5(F.concat_ws(":", F.lit(str(seed)), (full + 1).cast("string"), id_, digest))
    own = F.coalesce(c.col(doc_id).cast("string"), F.lit(""))
    named = docs.withColumns({leaf[0]: tree.domain(branch(source)), leaf[1]: branch(lang), leaf[2]: branch(source), dig: F.md5(F.coalesce(c.col(text).cast("binary"), F.lit(b"")))})
    narrow = named.select(*(c.col(x).alias(k) for x, k in zip(leaf, LEVELS)), c.word_count(c.col(text)).alias("tok"), own.alias("id"), c.col(dig).alias("digest"))
    narrow = c.checkpoint(narrow, "lengths")
    leaves = c.checkpoint(narrow.groupBy(*LEVELS).agg(F.sum("tok").alias("n")), "leaves")
    total = leaves.agg(F.sum("n")).first()[0] or 0
    plan = budgets(leaves, ratio * total, tree, max_epochs).where("n > 0")
    plan = c.checkpoint(plan.select(*LEVELS, F.expr("budget div n").alias("full"), F.expr("budget % n").alias("room")), "plan")
    rows = narrow.join(c.small(plan.where("room > 0")), list(LEVELS)).select(*LEVELS, "tok", "room", told(F.col("full"), F.col("id"), F.col("digest")).alias("place"))
    rows = rows.withColumn("range", F.substring("place", 1, 4))
    by = Window.partitionBy(*LEVELS).orderBy("range")
    sums = rows.groupBy(*LEVELS, "range", "room").agg(F.sum("tok").alias("sum")).withColumn("cum", F.sum("sum").over(by))
    edges = sums.where(F.col("cum") > F.col("room")).groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("cum") - F.col("sum")).alias("before"))).alias("edge"))
    edges = c.checkpoint(edges.select(*LEVELS, "edge.range", "edge.before"), "edges")
    run = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.join(c.small(edges), [*LEVELS, "range"]).withColumn("used", F.col("before") + F.sum("tok").over(run))
    ends = last.where(F.col("used") <= F.col("room")).groupBy(*LEVELS).agg(F.max("place").alias("end"))
    # where nothing of the range fits, its name is before all its places and behind all those of the ranges before
    cuts = edges.join(ends, list(LEVELS), "left").select(*LEVELS, F.coalesce("end", "range").alias("end"))
    told_leaf = [F.col(k).alias(x) for x, k in zip(leaf, LEVELS)]
    plan = c.checkpoint(plan.join(cuts, list(LEVELS), "left").where("full > 0 or end is not null").select(*told_leaf, "full", "end"), "plan")
    full, end = c.fresh(named, "full", "end")
    drawn = named.join(c.small(plan.withColumnsRenamed({"full": full, "end": end})), leaf)
    drawn = drawn.withColumn(place, told(c.col(full), own, c.col(dig)))
    drawn = drawn.withColumn(ep, c.col(full) + F.when(c.col(place) <= c.col(end), 1).otherwise(0)).where(c.col(ep) > 0)
    each = F.explode(F.sequence(F.lit(1).cast("long"), c.col(ep)))
    if with_epoch:
        return drawn.select(*c.cols(docs, "epoch"), each.alias("epoch"))
    return drawn.withColumn(ep, each).select(*c.cols(docs))
