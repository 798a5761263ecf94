"""Mixing sources to target weights by hierarchical budgeting.

A tree domain - language - source has a weight at every node, relative to its
siblings.  A token budget is shared out from the root: each node passes its
amount to its children by weight, no child takes more than its subtree can
supply (the tokens times ``max_epochs`` of its leaves that are reached by weights
above 0), and what a short child leaves goes to its siblings.  Only a node whose
whole subtree is short leaves anything to its own siblings, so shortages are
settled among siblings before ancestors.  Amounts are whole tokens; fractions go
to the largest remainders.

Each leaf then takes whole epochs and of the last one a token-prefix: documents
in the seeded order of that epoch, as long as their running token sum stays
within the budget.  An epoch's order is a hash of seed, epoch and identifier.
The prefix is found by two levels of 256 hash buckets and a last look into one
bucket, so that no leaf, however large, meets in one task.

All of it is DataFrame work.  Tokens are the words between ASCII spaces.

Defined results: a null text has no tokens, a null language or source is a leaf
of its own; nodes without a weight weigh 1, weights of 0 get nothing; documents
without tokens come with every epoch and prefix that reaches their place; rows that tie in the
order (repeated identifiers) go by token count and then together; an empty
table gives an empty table; input columns named like the outputs give way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import put, stored, text_of

LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mix:
    """Weights of nodes by name, for each level; a budget as a share of all tokens (or in tokens)."""

    domain: Column
    language: Column
    source: Column
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    budget_share: float = 1.0
    budget_tokens: int | None = None
    max_epochs: int = 4
    seed: int = 42


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    table = mix.weights.get(level, {})
    if not table:
        return F.lit(1.0)
    found = F.lit(None).cast("double")
    for name, w in table.items():
        found = F.when(F.col(level) == name, float(w)).otherwise(found)
    return F.coalesce(found, F.lit(1.0))


def _fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Share ``amount`` among siblings by ``w``, none above ``supply``: adds ``given``.

    In order of supply / weight, a child is full as long as all that remains, shared over
    the weights that remain, would give it at least its supply.  The others get the whole
    tokens of their shares, and the tokens left over go one each to the largest fractions
    (to six places; of equal ones by name), so none is lost.  A window sees the children of one node, which
    are rows of the tree, not documents.
    """
    by = Window.partitionBy(*parents)
    order = by.orderBy("fullness", "node").rowsBetween(Window.unboundedPreceding, -1)
    fullness = F.when(F.col("w") > 0, F.col("supply") / F.col("w")).otherwise(F.lit(float("inf")))
    nodes = nodes.withColumn("fullness", fullness)
    nodes = nodes.withColumn("supply_before", F.coalesce(F.sum("supply").over(order), F.lit(0))).withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    nodes = nodes.withColumn("full", (F.col("w") > 0) & ((F.col("amount") - F.col("supply_before")) * F.col("w") >= F.col("supply") * F.col("w_left")))
    open_ = ~F.col("full") & (F.col("w") > 0)
    nodes = nodes.withColumn("rest", F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(by), F.lit(0)))
    nodes = nodes.withColumn("share", F.when(open_, F.col("rest") * F.col("w") / F.sum(F.when(open_, F.col("w"))).over(by)))
    nodes = nodes.withColumn("whole", F.floor("share").cast("long"))
    nodes = nodes.withColumn("over", F.col("rest") - F.sum("whole").over(by))
    nodes = nodes.withColumn("nth", F.row_number().over(by.orderBy(F.desc_nulls_last(F.round(F.col("share") - F.col("whole"), 6)), "node")))
    one = F.when(F.col("nth") <= F.col("over"), 1).otherwise(0)
    given = F.when(F.col("full"), F.col("supply")).when(open_, F.least(F.col("whole") + one, F.col("supply"))).otherwise(F.lit(0))
    return nodes.withColumn("given", given.cast("long")).drop("fullness", "supply_before", "w_left", "full", "rest", "share", "whole", "over", "nth")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, language, source, tokens) with ``budget`` tokens each.

    A leaf below a weight of 0 supplies nothing to any node above it.
    """
    reached = F.lit(True)
    for level in LEVELS:
        reached = reached & (_weight(level, mix) > 0)
    leaves = leaves.withColumn("supply", F.when(reached, F.col("tokens") * mix.max_epochs).otherwise(0).cast("long"))
    every = F.sum("tokens").over(Window.partitionBy("root"))
    amount = F.lit(mix.budget_tokens) if mix.budget_tokens is not None else F.floor(every * mix.budget_share)
    given = None
    for k, level in enumerate(LEVELS):
        path = list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("supply").cast("long").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(level, mix)).withColumn("node", F.coalesce(F.col(level), F.lit("")))
        if given is None:
            nodes = nodes.withColumn("root", F.lit(0)).withColumn("amount", amount.cast("long"))
        else:
            same = [nodes[c].eqNullSafe(given[f"p_{c}"]) for c in path[:-1]]
            on = same[0]
            for s in same[1:]:
                on = on & s
            nodes = nodes.join(given, on).drop(*[f"p_{c}" for c in path[:-1]])
        filled = _fill(nodes, path[:-1] or ["root"])
        if k < 2:
            given = filled.select(*[F.col(c).alias(f"p_{c}") for c in path], F.col("given").alias("amount"))
    return filled.select(*LEVELS, F.col("given").alias("budget"))


def _order(epoch: Column, identity: Column, seed: int) -> Column:
    """Place of a document in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(identity.cast("string"), F.lit("null"))))


class Mixed:
    """``plan`` (leaves with tokens and budget) and ``sample`` (documents by epoch)."""

    def __init__(self, docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs, self.mix, self.id_col = docs, mix, id_col
        self.text = text_of(docs, text_col)
        slim = docs.select(docs[id_col].cast("long").alias("doc_id"), *[getattr(mix, n).cast("string").alias(n) for n in LEVELS], words(self.text).alias("n_tokens"))
        self.slim = stored(slim, "mix-tokens")
        leaves = self.slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
        leaves = stored(leaves, "mix-leaves")
        given = budgets(leaves, mix).select(*[F.col(n).alias(f"b_{n}") for n in LEVELS], "budget")
        on = leaves["domain"].eqNullSafe(given["b_domain"]) & leaves["language"].eqNullSafe(given["b_language"]) & leaves["source"].eqNullSafe(given["b_source"])
        full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
        plan = leaves.join(given, on).select(*LEVELS, "tokens", "documents", "budget", full.alias("epochs"))
        plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        leaf = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(n), F.lit("\x1e")) for n in LEVELS]))
        self.plan = stored(plan.withColumn("leaf", leaf), "mix-plan")
        self.limits = stored(self._prefix(), "mix-prefix")

    def _placed(self, docs: DataFrame) -> DataFrame:
        """Documents with leaf, epochs, rest and place in the last epoch."""
        leaf = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(n), F.lit("\x1e")) for n in LEVELS]))
        keyed = docs.withColumn("leaf", leaf)
        joined = keyed.join(self.plan.select("leaf", "epochs", "rest", "tokens"), "leaf")
        return joined.withColumn("place", _order(F.col("epochs"), F.col("doc_id"), self.mix.seed))

    def _prefix(self) -> DataFrame:
        """For each leaf, the place up to which the last epoch is taken: leaf, upto, upto_tokens.

        Two levels of bucket sums narrow the search to about one document in 65,536.
        """
        placed = stored(self._placed(self.slim).where("rest > 0").select("leaf", "place", "n_tokens", "rest"), "mix-places")
        inside = placed.withColumn("before", F.lit(0).cast("long"))
        for level in (0, 1):
            bucket = F.substring("place", 1 + 2 * level, 2)
            sums = inside.groupBy("leaf", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
            # at most 256 rows for each leaf; the first bucket that does not fit holds the border
            rows = sums.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("all"), F.first("rest").alias("rest"), F.first("before").alias("before"))
            start = F.struct(F.col("before").alias("sum"), F.lit(None).cast("string").alias("edge"))

            def step(done: Column, b: Column) -> Column:
                fits = done["sum"] + b["n"] <= F.col("rest")
                more = F.struct((done["sum"] + b["n"]).alias("sum"), F.lit(None).cast("string").alias("edge"))
                stop = F.struct(done["sum"].alias("sum"), b["bucket"].alias("edge"))
                return F.when(done["edge"].isNotNull(), done).when(fits, more).otherwise(stop)

            edges = rows.select("leaf", F.aggregate("all", start, step).alias("e")).select("leaf", F.col("e.sum").alias("before"), F.col("e.edge").alias("edge")).where("edge is not null")
            inside = inside.drop("before").join(edges, "leaf").where(bucket == F.col("edge")).drop("edge")
            inside = stored(inside, "mix-edge")
        running = Window.partitionBy("leaf").orderBy("place", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        over = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where(F.col("upto") > F.col("rest"))
        return over.groupBy("leaf").agg(F.min(F.struct("place", "n_tokens")).alias("border"))

    def chosen(self, docs: DataFrame) -> DataFrame:
        """Documents with their leaf columns, once for each epoch that takes them."""
        placed = self._placed(docs).join(self.limits, "leaf", "left")
        last = (F.col("rest") > 0) & (F.col("border").isNull() | (F.struct("place", "n_tokens") < F.col("border")))
        times = F.col("epochs") + F.when(last, 1).otherwise(0)
        return placed.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))

    def decisions(self) -> DataFrame:
        """doc_id, domain, language, source, n_tokens, epoch: a row for each time a document is taken."""
        return self.chosen(self.slim).select("doc_id", *LEVELS, "n_tokens", "epoch")

    def sample(self) -> DataFrame:
        """The documents themselves, with their own columns, once for each epoch that takes them."""
        own = [F.col(f"`{c}`") for c in self.docs.columns]
        keyed = self.docs.select(F.struct(*own).alias("row"), self.docs[self.id_col].cast("long").alias("doc_id"), *[getattr(self.mix, n).cast("string").alias(n) for n in LEVELS], words(self.text).alias("n_tokens"))
        return self.chosen(keyed).select("row.*")
