"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

The tree has three levels: domain, language, source; a source of a language
is a leaf.  A token budget flows from the root: among siblings it is shared by
weight, but no node gets more than its leaves can give (their tokens times
``max_epochs``).  What a node cannot take is shared among its siblings, and
only what a whole subtree cannot take reaches the level above.

A leaf with budget b and t tokens is read ``b div t`` times in full; one more
epoch, in its own seeded order, gives the longest prefix of at most ``b mod t`` tokens.

No leaf's rows ever meet in one task: prefixes are found from sums by
ranges of the seeded order, and only the range that holds the cut is ordered.

Defined cases: a null domain, language or source counts as ''; nodes without
a weight of their own get weight 1; leaves without tokens take no budget and
give no rows; rows without tokens before the cut come along; repeated rows are
rows of their own (ties in the order are broken by token count); extra
columns pass through, names of helper columns may clash; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, stored
from .components import join_by_key

LEVELS = ("domain", "lang", "source")
RANGE_DIGITS = 3  # hex digits of the order's hash that name a range: 4,096 of them


@dataclass(frozen=True)
class Targets:
    """Integer weights by level (a name counts alike under every parent) and the budget.

    The budget is ``percent`` of all tokens unless ``tokens`` gives it.
    """
    domain: dict = field(default_factory=dict)
    lang: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    percent: int = 100
    tokens: int | None = None
    max_epochs: int = 4
    seed: int = 1

    def weight(self, level: str) -> Column:
        out = F.lit(1)
        for name, w in getattr(self, level).items():
            out = F.when(F.col(f"__{level}") == name, F.lit(w)).otherwise(out)
        return out.cast("decimal(38,0)")


def n_tokens(text: str) -> Column:
    """Tokens of a text, counted as words."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_RE)), F.lit(0)).cast("long")


def _order(targets: Targets, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(targets.seed)), epoch.cast("string"),
                             F.coalesce(F.col("__id").cast("string"), F.lit(""))))


def _shared(nodes: DataFrame, parents: list[str], level: str, targets: Targets) -> DataFrame:
    """``nodes`` (cap, parent budget ``b``) with their own budget in ``b``.

    Siblings in order of cap per weight: a node is full when the budget covers the
    caps up to its own plus the same level for all the rest.
    """
    w = targets.weight(level)
    siblings = Window.partitionBy(*(parents or [F.lit(0)]))
    ordered = siblings.orderBy((F.col("cap") / F.col("w")).cast("double"), f"__{level}")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    after = ordered.rowsBetween(1, Window.unboundedFollowing)
    n = nodes.withColumn("w", w)
    n = n.withColumns({"caps": F.sum("cap").over(upto).cast("decimal(38,0)"),
                       "rest": F.coalesce(F.sum("w").over(after), F.lit(0)).cast("decimal(38,0)")})
    big = lambda e: e.cast("decimal(38,0)")
    n = n.withColumn("full", big(F.col("cap") * F.col("rest")) + big(F.col("w") * F.col("caps"))
                     <= big(F.col("b") * F.col("w")))
    n = n.withColumns({
        "taken": big(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0))),
        "open": big(F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings), F.lit(0)))})
    share = F.expr("CAST(CASE WHEN full THEN cap ELSE least(cap, CAST(CAST((b - taken) AS DECIMAL(38,0)) * w "
                   "AS DECIMAL(38,0)) div open) END AS DECIMAL(38,0))")
    return n.withColumn("b", share).drop("w", "caps", "rest", "full", "taken", "open")


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """``leaves`` (__domain, __lang, __source, tokens) with the budget of each in ``budget`` (long)."""
    names = [f"__{x}" for x in LEVELS]
    cap = (F.col("tokens") * targets.max_epochs).cast("decimal(38,0)")
    at = leaves.withColumn("cap", cap)
    total = targets.tokens
    if total is None:
        total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * targets.percent // 100
    root = None
    for depth, level in enumerate(LEVELS):
        nodes = at.groupBy(*names[:depth + 1]).agg(F.sum("cap").cast("decimal(38,0)").alias("cap"))
        if depth:
            nodes = nodes.join(root, names[:depth])
        else:
            nodes = nodes.withColumn("b", F.lit(total).cast("decimal(38,0)"))
        root = _shared(nodes, names[:depth], level, targets).drop("cap")
    return leaves.join(root, names).withColumn("budget", F.col("b").cast("long")).drop("b")


def mixed(rows: DataFrame, targets: Targets, domain: Column, row_id: str = "doc_id", lang: str = "lang",
          source: str = "source", tokens: Column | None = None, text: str = "text") -> DataFrame:
    """The chosen rows with ``domain``, ``n_tokens`` and ``copies`` (epochs they are read in).

    ``rows`` is read twice and must give the same rows each time.
    """
    names = [c for c in rows.columns if c.lower() not in ("domain", "n_tokens", "copies")]
    leaf = [f"__{x}" for x in LEVELS]
    t = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{row_id}`").alias("__id"),
                    F.coalesce(domain.cast("string"), F.lit("")).alias("__domain"),
                    *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"__{x}")
                      for c, x in ((lang, "lang"), (source, "source"))],
                    (n_tokens(text) if tokens is None else tokens.cast("long")).alias("__tokens"))
    slim = stored(t.drop("__row"), "mix-rows")
    sums = stored(slim.groupBy(*leaf).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("__n")), "mix-leaves")
    per_leaf = budgets(sums.where("tokens > 0"), targets)
    per_leaf = stored(per_leaf.withColumns({"epochs": F.expr("budget div tokens"), "left": F.expr("budget % tokens")}),
                      "mix-budgets").drop("budget", "tokens")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    key = F.struct(*leaf)
    per_leaf = per_leaf.withColumn("__leaf", key).drop(*leaf)

    def with_order(df):
        out = join_by_key(df.withColumn("__leaf", key), per_leaf, "__leaf", total)
        out = out.withColumn("__order", _order(targets, F.col("epochs")))
        return out.withColumn("__range", F.substring("__order", 1, RANGE_DIGITS))

    # tokens by range of the order, and the range in which the last epoch's prefix ends
    ranges = with_order(slim).groupBy("__leaf", "__range", "left").agg(F.sum("__tokens").alias("tokens"))
    running = Window.partitionBy("__leaf").orderBy("__range")
    ranges = ranges.withColumn("upto", F.sum("tokens").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = ranges.where("upto > left").groupBy("__leaf").agg(
        F.min(F.struct("__range", (F.col("upto") - F.col("tokens")).alias("before"))).alias("cut"))
    per_leaf = stored(per_leaf.join(cuts, "__leaf"), "mix-cuts")

    t = with_order(t)
    inside = F.sum("__tokens").over(Window.partitionBy("__leaf", "__range").orderBy("__order", "__tokens")
                                    .rowsBetween(Window.unboundedPreceding, 0))
    at_cut = F.col("__range") == F.col("cut.__range")
    clear = t.where(~at_cut).withColumn("copies", F.col("epochs") + (F.col("__range") < F.col("cut.__range")).cast("long"))
    cut = t.where(at_cut).withColumn("copies", F.col("epochs") + (
        F.col("cut.before") + inside <= F.col("left")).cast("long"))
    return clear.unionByName(cut).where("copies > 0").select(
        *[F.col("__row").getField(c).alias(c) for c in names], F.col("__domain").alias("domain"),
        F.col("__tokens").alias("n_tokens"), F.col("copies").cast("long").alias("copies"))


def repeated(chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen rows, as often as their copies say."""
    return (chosen.withColumn("__copy", F.explode(F.expr("sequence(1L, copies)")))
            .select(*[F.col(f"`{c}`") for c in columns]))


# The mix of the registered query and the pipeline: three domains by a rule on the source's number.
TARGETS = Targets(domain={"web": 5, "reference": 3, "forum": 2}, lang={"en": 6, "de": 2, "fr": 2, "es": 1},
                  percent=100, max_epochs=4, seed=20240229)
DOMAIN_SQL = ("CASE CAST(coalesce(nullif(right(regexp_extract({source}, '([0-9]+)', 1), 9), ''), '0') AS BIGINT) % 3 "
              "WHEN 0 THEN 'web' WHEN 1 THEN 'reference' ELSE 'forum' END")


def domain_of(source: str = "source") -> Column:
    return F.expr(DOMAIN_SQL.format(source=f"`{source}`"))
