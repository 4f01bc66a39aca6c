"""Mixing sources to target weights: hierarchical budgets and seeded epochs.

Documents are leaves' members in a tree domain - language - source. A budget of tokens is dealt from the root down: a node's
children share its budget by their weights, but none gets more than it can give (its tokens times EPOCHS), and what one
cannot take goes to its siblings by their weights. A child's capacity is the sum of its leaves', so a shortage leaves a
subtree, for the ancestors' siblings, only when the subtree can give no more.

A leaf with budget b of t tokens gives each document b div t times, and in one more epoch the documents of a prefix, in an
order seeded by epoch, whose tokens up to and with each document do not exceed the rest. The order is by an md5 of seed,
epoch and doc_id, so it is the same in every engine. The prefix is found without a sort of the leaf: documents are counted
in ranges of the order, the sums of ranges say where the budget ends, and only the ids of that range are sorted. The number of
ranges grows with the documents, about PER_RANGE in each.

Tokens are words [^\\x20\\x09-\\x0D]+. Token counts and shares are exact: budgets are rounded down to whole tokens.

Defined results. Null domain parts, languages and sources are names of their own (''). A null or wordless text has no tokens and is
given as often as whole epochs say. Rows of equal doc_id in one leaf (null ids are equal) share their place in the order; they go in or
stay out together, and in another leaf by that one's budget. Unknown names have weight 1; nodes of weight 0 get nothing. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common

SEED, EPOCHS, PER_RANGE, LEVEL = 11, 2, 4096, 3
LEAF = ["domain", "lang", "source"]
#: a plan of at most so many bytes is broadcast
BROADCAST_BYTES = 32 << 20
#: production weights: languages by name, all else equal; the budget as hundredths of all tokens
WEIGHTS: dict[str, dict[str, int]] = {"domain": {}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
HUNDREDTHS = 60


def domain_of(source: Column) -> Column:
    """The domain of a source: sources with an even number at the end are `web`, those with an odd one `books`, others `other`."""
    last = F.substring(F.coalesce(source, F.lit("")), -1, 1)
    return F.when(last.isin("0", "2", "4", "6", "8"), "web").when(last.isin("1", "3", "5", "7", "9"), "books").otherwise("other")


def words(text: Column) -> Column:
    """The number of words of a text; 0 for a null one."""
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(gone)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1).cast("long")


def weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level, {})
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, v)])[F.col(level)], F.lit(1)).cast("double") if given else F.lit(1.0)


def dealt(nodes: DataFrame, parent: list[str], level: str, weights: Mapping[str, Mapping[str, int]], budget: str = "budget") -> DataFrame:
    """`nodes` (one row a node, with capacity cap and its parent's budget) with column share: the node's own budget.

    The children that take all they can are those of the smallest capacity for their weight; running sums over that order give
    the level at which the budget is used up."""
    one = Window.partitionBy(*parent).orderBy(F.expr("case when w > 0 then cap / w else double('infinity') end"), level) if parent else Window.orderBy(F.expr("case when w > 0 then cap / w else double('infinity') end"), level)
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    after = one.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("w", weight(level, weights)).withColumns({"taken": F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).over(before), F.lit(0)), "left": F.sum("w").over(after)})
    # tokens a unit of weight: at each place, what the rest would get were all before it full; the true level is the largest
    level_at = F.expr(f"case when left > 0 then greatest({budget} - taken, 0) / left else 0D end")
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy()
    out = out.withColumn("level", F.max(level_at).over(whole))
    return out.withColumn("share", F.expr("least(cap, cast(floor(level * w) as long))")).drop("w", "taken", "left", "level")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, share) from (domain, lang, source, tokens); total: the whole budget, of tokens in `every`.

    One row a leaf; each window is over the children of one node, the first one over the domains."""
    cap = leaves.withColumn("cap", F.col("tokens") * epochs)
    by_lang = cap.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    every = leaves.agg(F.sum("tokens").alias("every"))
    first = by_domain.crossJoin(F.broadcast(every)).withColumn("budget", total)  # one row broadcast
    domains = dealt(first, [], "domain", weights).select("domain", F.col("share").alias("budget"))
    langs = dealt(by_lang.join(domains, "domain"), ["domain"], "lang", weights).select("domain", "lang", F.col("share").alias("budget"))
    return dealt(cap.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", weights).select("domain", "lang", "source", "tokens", "share")


def named(df: DataFrame, domain: Callable[[Column], Column] = domain_of) -> dict[str, Column]:
    """The columns of a row's leaf and its id, by name."""
    return {"doc_id": F.col("doc_id").cast("long"), "domain": F.coalesce(domain(F.col("source")), F.lit("")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}


def by_leaf(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with the columns of their leaf's row. A checkpointed plan of at most BROADCAST_BYTES goes to all executors; a larger one is
    joined by leaf, where Spark splits large keys."""
    held = plan.agg(F.sum(sum((F.octet_length(c) for c in LEAF), F.lit(128)))).first()[0] or 0
    return docs.join(F.broadcast(plan) if held <= BROADCAST_BYTES else plan, LEAF)


def order_of(seed: int) -> Column:
    """A document's place in its leaf's epoch `whole`."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def copies_of(seed: int) -> Column:
    """How often a row is taken: its leaf's whole epochs, and one more up to the place `last`."""
    return (F.col("whole") + F.coalesce(order_of(seed) <= F.col("last"), F.lit(True)).cast("int")).cast("long")


def planned(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], hundredths: int, epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, whole, last), one row a leaf: its whole epochs, and the last place in the order that one more epoch takes.

    `docs` is a checkpointed (doc_id, domain, lang, source, n_tokens). The place is looked for from the front of the order, LEVEL digits at a
    time, among the sums of ranges; no window holds more than 16**LEVEL of a leaf's. In the range where the budget ends, rows that share an id are
    summed before they are sorted, so that the sort holds about PER_RANGE ids however many rows one id has."""
    plan = budgets(docs.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), F.expr(f"cast(floor(every * {hundredths} / 100) as long)"), weights, epochs)
    plan = common.checkpoint(plan.select(*LEAF, F.expr("case when tokens > 0 then share div tokens else 0 end").alias("whole"), F.expr("case when tokens > 0 then share % tokens else 0 end").alias("rest")))
    rows, digits = docs.count(), 1
    while 16**digits * PER_RANGE < rows:
        digits += 1
    placed = by_leaf(docs, plan).withColumn("order", order_of(seed)).withColumn("range", F.substring("order", 1, digits))
    sums = common.checkpoint(placed.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("n")))
    at = plan.select(*LEAF, "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    for level in [*range(LEVEL, digits, LEVEL), digits]:
        inside = sums.join(at, LEAF).filter(F.col("range").startswith(F.col("cut")))
        parts = inside.groupBy(*LEAF, "rest", "before", F.substring("range", 1, level).alias("part")).agg(F.sum("n").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = parts.withColumn("upto", upto).filter("upto > rest").groupBy(*LEAF, "rest").agg(F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("before"))).alias("first"))
        at = over.select(*LEAF, "rest", F.col("first.part").alias("cut"), F.col("first.before").alias("before"))
    at = common.checkpoint(at)
    close = by_leaf(placed.select(*LEAF, "order", "range", "n_tokens"), at).filter("range = cut").groupBy(*LEAF, "rest", "cut", "before", "order").agg(F.sum("n_tokens").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a range's digits alone come after all places of the ranges before it and before all of its own
    last = close.withColumn("upto", upto).groupBy(*LEAF, "cut").agg(F.coalesce(F.max(F.expr("case when upto <= rest then order end")), F.col("cut")).alias("last")).drop("cut")
    return common.checkpoint(plan.join(last, LEAF, "left").select(*LEAF, "whole", "last"))


def counted(df: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    return common.checkpoint(df.select(*[c.alias(n) for n, c in named(df, domain).items()], words(F.col("text")).alias("n_tokens")))


def mix(
    df: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, hundredths: int = HUNDREDTHS, epochs: int = EPOCHS, seed: int = SEED, domain: Callable[[Column], Column] = domain_of
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of every row; copies: how often the mixture takes it, 0 included."""
    docs = counted(df, domain)
    return by_leaf(docs, planned(docs, weights, hundredths, epochs, seed)).select("doc_id", *LEAF, "n_tokens", copies_of(seed).alias("copies"))


def mixed(
    df: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, hundredths: int = HUNDREDTHS, epochs: int = EPOCHS, seed: int = SEED, domain: Callable[[Column], Column] = domain_of
) -> DataFrame:
    """The documents of the mixture, with the columns of the table: each as often as the mixture takes it.

    A row's copies follow from its id and its leaf's row of the plan, so texts are read twice and neither sorted nor matched by id."""
    plan = planned(counted(df, domain), weights, hundredths, epochs, seed)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named(df, domain).items()])
    each = by_leaf(rows, plan).select("row", copies_of(seed).cast("int").alias("copies")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(*[F.col("row")[c].alias(c) for c in df.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN right(coalesce(source, ''), 1) IN ('0','2','4','6','8') THEN 'web' WHEN right(coalesce(source, ''), 1) IN ('1','3','5','7','9') THEN 'books' ELSE 'other' END AS domain,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap FROM d GROUP BY ALL),
bl AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY ALL),
bd AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap FROM bl GROUP BY ALL),
d1 AS (SELECT domain, cap, (SELECT CAST(floor(sum(tokens) * 60 / 100) AS BIGINT) FROM leaf) AS budget,
  coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, count(*) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
  FROM bd WINDOW o AS (ORDER BY cap, domain)),
d2 AS (SELECT domain, least(cap, CAST(floor(max(greatest(budget - taken, 0)::DOUBLE / rest) OVER ()) AS BIGINT)) AS budget FROM d1),
l1 AS (SELECT bl.domain, lang, cap, w, budget, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM bl JOIN d2 ON bl.domain = d2.domain WINDOW o AS (PARTITION BY bl.domain ORDER BY cap / w, lang)),
l2 AS (SELECT domain, lang, least(cap, CAST(floor(max(greatest(budget - taken, 0)::DOUBLE / rest) OVER (PARTITION BY domain) * w) AS BIGINT)) AS budget FROM l1),
s1 AS (SELECT leaf.domain, leaf.lang, source, tokens, cap, budget, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, count(*) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM leaf JOIN l2 ON leaf.domain = l2.domain AND leaf.lang = l2.lang WINDOW o AS (PARTITION BY leaf.domain, leaf.lang ORDER BY cap, source)),
s2 AS (SELECT domain, lang, source, tokens, least(cap, CAST(floor(max(greatest(budget - taken, 0)::DOUBLE / rest) OVER (PARTITION BY domain, lang)) AS BIGINT)) AS share FROM s1),
s3 AS (SELECT *, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS over FROM s2),
p AS (SELECT doc_id, d.domain, d.lang, d.source, n_tokens, whole, over, md5('11:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM d JOIN s3 ON d.domain = s3.domain AND d.lang = s3.lang AND d.source = s3.source)
SELECT doc_id, domain, lang, source, n_tokens,
  CAST(whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= over THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM p
"""
