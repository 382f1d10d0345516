"""Mixing sources to target weights by hierarchical budgeting.

The token budget runs down a tree domain -> language -> source.  Every node
shares its budget among its children in proportion to their weights, but no
child gets more than its subtree can supply (its tokens times the allowed
epochs); what a child cannot use goes to its siblings, and only what all of a
node's children cannot use went to the node's own siblings in the first
place.  That is water-filling with subtree capacities, in closed form: order
the siblings by capacity / weight and find with running sums which of them
are full.  A leaf's budget is spent on whole epochs and then on a token
prefix of one more epoch; each epoch orders the leaf's documents by its own
seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import col, fresh, materialise, never_sent

SEED, EPOCHS, FRACTION = 11, 2, 0.5
#: A leaf's documents are cut by hash into ranges of about this many; running sums are taken over ranges, then within the range that the budget ends in.
RANGE_ROWS = 4096
#: Fixed targets of the production mix; a node that is not named weighs 1.
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
DOMAIN_WEIGHTS = {"a": 3, "b": 2}
SOURCE_WEIGHTS = {"src0": 4}


def domain_of(source: Column) -> Column:
    """Domain of a source: ``a`` for an even last digit of its name, ``b`` for an odd one, ``none`` otherwise."""
    last = F.substring(source, -1, 1)
    return F.when(last.isin(*"02468"), "a").when(last.isin(*"13579"), "b").otherwise("none")


def word_tokens(text: Column) -> Column:
    """Tokens of a text: runs of characters other than ASCII white space."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    gap = F.length(F.regexp_replace(flat, "[^ ]+", "x")) - F.length(F.regexp_replace(flat, "[^ ]+", ""))
    return F.coalesce(gap, F.lit(0)).cast("bigint")


def _weight(name: str, table: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(1).cast("bigint"))
    for k, w in sorted(table.items()):
        if w <= 0 or int(w) != w:
            raise ValueError("weights are positive integers")
        out = out.when(F.col(name) == k, F.lit(int(w)).cast("bigint"))
    return out.otherwise(F.lit(1).cast("bigint"))


def water_fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``share`` to ``nodes(parent..., key, cap, w, budget)``: the integer part of each node's share of its parent's budget.

    A node is full if, with all siblings of no larger cap / w full as well,
    its proportional part of the rest reaches its cap.
    """
    up = [F.col(p) for p in parent] or [F.lit(1)]
    order = Window.partitionBy(*up).orderBy("ratio", key)
    every = Window.partitionBy(*up)
    got = nodes.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    got = got.withColumns({"c_sum": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                           "w_rest": F.sum("w").over(every) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    got = got.withColumn("full", F.col("c_sum").cast("double") + F.col("ratio") * F.col("w_rest").cast("double") <= F.col("budget").cast("double"))
    got = got.withColumns({"c_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)),
                           "w_open": F.sum(F.when(~F.col("full"), F.col("w"))).over(every)})
    level = (F.col("budget") - F.col("c_full")).cast("double") / F.col("w_open").cast("double")
    open_ = F.greatest(F.lit(0), F.least(F.col("cap"), F.floor(F.col("w").cast("double") * level).cast("bigint")))
    return got.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(open_)).drop("ratio", "c_sum", "w_rest", "full", "c_full", "w_open")


def leaf_budgets(leaves: DataFrame, epochs: int, fraction: float, domain_weights: dict, language_weights: dict, source_weights: dict) -> DataFrame:
    """``leaves(domain, lang, source, tokens, docs)`` -> the same with ``budget``; tables of one row per leaf."""
    leaves = leaves.withColumns({"cap": F.col("tokens") * epochs, "one": F.lit(1)})
    langs = leaves.groupBy("one", "domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("one", "domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("one"))
    domains = domains.withColumn("budget", F.floor(total.cast("double") * fraction).cast("bigint"))
    d = water_fill(domains.withColumn("w", _weight("domain", domain_weights)), ["one"], "domain")
    lg = langs.join(d.select("domain", F.col("share").alias("budget")), "domain").withColumn("w", _weight("lang", language_weights))
    lg = water_fill(lg, ["domain"], "lang")
    lf = leaves.join(lg.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"]).withColumn("w", _weight("source", source_weights))
    lf = water_fill(lf, ["domain", "lang"], "source")
    return lf.select("domain", "lang", "source", "tokens", "docs", F.col("share").alias("budget"))


def select_epochs(keyed: DataFrame, epochs: int = EPOCHS, fraction: float = FRACTION, seed: int = SEED, domain_weights: dict | None = None,
                  language_weights: dict | None = None, source_weights: dict | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``keyed(domain, lang, source, id, row, tokens)`` (no nulls in the first three) -> ``(id, row, n, epoch)`` of every row picked, by epoch.

    In each epoch a leaf takes, in hash order, the documents that begin
    before its budget ends (the last one may overrun it).  ``n`` numbers rows
    alike in id and row hash.
    """
    leaf = ["domain", "lang", "source"]
    sums = materialise(keyed.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    budget = leaf_budgets(sums, epochs, fraction, domain_weights or DOMAIN_WEIGHTS, language_weights or LANGUAGE_WEIGHTS, source_weights or SOURCE_WEIGHTS)
    plan = budget.select(*leaf, F.greatest(F.lit(1), F.ceil(F.col("docs") / range_rows)).cast("bigint").alias("ranges"),
                         F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"),
                         "tokens", "budget").withColumn("want", F.col("budget") - (F.col("epoch") - 1) * F.col("tokens")).where("want > 0")
    plan = materialise(plan.withColumn("whole", F.col("want") >= F.col("tokens")), "mix-plan")
    drawn = keyed.join(plan.select(*leaf, "epoch", "ranges", "want", "whole"), leaf)
    whole = drawn.where("whole").select("id", "row", "epoch")
    part = drawn.where("not whole").withColumn("pos", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.col("id"))))
    # equal steps of the hash's first 32 bits: ranges in hash order
    step = F.conv(F.substring("pos", 1, 8), 16, 10).cast("bigint") * F.col("ranges")
    part = part.withColumn("range", F.shiftright(step, 32))
    by = part.groupBy(*leaf, "epoch", "range").agg(F.sum("tokens").alias("t"), F.first("want").alias("want"))
    run = Window.partitionBy(*leaf, "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).where("before < want")
    by = materialise(by.select(*leaf, "epoch", "range", "before", (F.col("before") + F.col("t") <= F.col("want")).alias("inside")), "mix-ranges")
    cut = part.join(by, [*leaf, "epoch", "range"])
    inside = cut.where("inside").select("id", "row", "epoch")
    order = Window.partitionBy(*leaf, "epoch", "range").orderBy("pos", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = cut.where("not inside").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("at < want")
    return whole.union(inside).union(edge.select("id", "row", "epoch"))


def keys(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, row: Column) -> DataFrame:
    lang, source = F.coalesce(col(lang_col), F.lit("")), F.coalesce(col(source_col), F.lit(""))
    return docs.select(domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), col(id_col).alias("id"),
                       row.alias("row"), word_tokens(col(text_col)).alias("tokens"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: ``id_col, domain, lang, source, n_tokens, copies`` (epochs that pick it, 0 to ``epochs``).

    A null source or language is the empty name; a null or empty text has no
    tokens; documents that tie in everything but their row share one fate
    for each repeat.  An empty table gives no rows; other columns are ignored.
    """
    row = F.xxhash64(col(id_col), col(text_col), col(lang_col), col(source_col))
    keyed = materialise(keys(docs, id_col, text_col, lang_col, source_col, row), "mix-keys")
    got = select_epochs(keyed, **options).groupBy("id", "row").agg(F.count("*").alias("picked")).toDF("pid", "prow", "picked")
    twins = keyed.groupBy("id", "row").count().toDF("tid", "trow", "twins").where("twins > 1")
    out = keyed.join(got, F.col("id").eqNullSafe(F.col("pid")) & (F.col("row") == F.col("prow")), "left")
    out = out.join(twins, F.col("id").eqNullSafe(F.col("tid")) & (F.col("row") == F.col("trow")), "left")
    each = F.ceil(F.coalesce("picked", F.lit(0)) / F.coalesce("twins", F.lit(1))).cast("bigint")
    return out.select(F.col("id").alias(id_col), "domain", F.col("lang").alias(lang_col), F.col("source").alias(source_col),
                      F.col("tokens").alias("n_tokens"), each.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """``docs`` drawn to the target weights: each row once for each epoch that picks it; all columns stay."""
    cols = docs.columns
    row, pid, prow, pn, pe = fresh(docs, "row", "pick_id", "pick_row", "pick_n", "pick_e")
    tagged = docs.withColumn(row, F.xxhash64(*map(col, cols)))
    keyed = materialise(keys(tagged, id_col, text_col, lang_col, source_col, F.col(row)), "mix-keys")
    got = select_epochs(keyed, **options).groupBy("id", "row").agg(F.count("*").alias("picked"))
    twins = keyed.groupBy("id", "row").count().withColumnRenamed("count", "twins")
    same = got["id"].eqNullSafe(twins["id"]) & (got["row"] == twins["row"])
    each = got.join(never_sent(twins), same).select(got["id"].alias(pid), got["row"].alias(prow),
                                        F.ceil(F.col("picked") / F.col("twins")).cast("int").alias(pn))
    each = materialise(each, "mix-picked")
    out = tagged.join(never_sent(each), col(id_col).eqNullSafe(F.col(pid)) & (F.col(row) == F.col(prow)))
    return out.withColumn(pe, F.explode(F.sequence(F.lit(1), F.col(pn)))).select(*map(col, cols))
