"""Chance-corrected agreement from long tables (item, rater, label): contingency counts, then margins. Nulls are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chance_corrected(observed: Column, chance: Column) -> Column:
    return F.when(chance >= 1, F.when(observed >= 1, 1.0).otherwise(0.0)).otherwise((observed - chance) / (1 - chance))


def long_labels(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, rater, label) from one column per rater; rater counts from 1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("rater"), F.col(c).alias("label")) for i, c in enumerate(columns, 1)]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.rater", "p.label")


def rater_pairs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, rater_1 < rater_2, label_1, label_2) where both are there, within the row."""
    n = len(columns)
    both = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rater_1"), F.lit(j + 1).alias("rater_2"), F.col(columns[i]).alias("label_1"), F.col(columns[j]).alias("label_2")) for i in range(n) for j in range(i + 1, n)]))
    return df.select(*keys, both.alias("p")).select(*keys, "p.*").where("label_1 is not null and label_2 is not null")


def pairwise(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Observed agreement, AC1 (chance term without 1/(K-1), and textbook), and Cohen's kappa of (label_1, label_2) pairs.

    Two passes of small tables: the contingency, then its margins. Groups without pairs give no row.
    """
    cells = pairs.groupBy(*by, "label_1", "label_2").agg(F.count(F.lit(1)).alias("n"))
    margins = cells.select(*by, F.explode(F.array(F.struct(F.col("label_1").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("label_2").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("m")).select(*by, "m.*")
    margins = margins.groupBy(*by, "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label_1") == F.col("label_2"), F.col("n")).otherwise(0)).alias("agreements"))
    q = (F.col("a") + F.col("b")) / (2 * F.col("n"))
    chance = margins.join(totals.select(*by, "n"), by).groupBy(*by).agg(F.sum(q * (1 - q)).alias("pe_ac1"), F.sum(F.col("a") / F.col("n") * F.col("b") / F.col("n")).alias("pe_kappa"), F.count(F.lit(1)).alias("n_categories"))
    pa = F.col("agreements") / F.col("n")
    textbook = F.when(F.col("n_categories") > 1, F.col("pe_ac1") / (F.col("n_categories") - 1)).otherwise(F.lit(0.0))
    return totals.join(chance, by).select(*by, "n", "agreements", "n_categories", pa.alias("pa"), _chance_corrected(pa, F.col("pe_ac1")).alias("ac1_ref"), _chance_corrected(pa, textbook).alias("ac1"), _chance_corrected(pa, F.col("pe_kappa")).alias("kappa"))


def fleiss(labels: DataFrame, by: list[str], item: str = "item") -> DataFrame:
    """Fleiss' kappa over (by, item, label) with missing ratings.

    Items with fewer than two ratings count in n_items and their labels in n_categories, but not in the statistics. NULL
    statistics where no item is valid.
    """
    cells = labels.groupBy(*by, item, "label").agg(F.count("label").alias("c"))
    items = cells.groupBy(*by, item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    per = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("n") >= 2).alias("valid_items"), F.avg(F.when(F.col("n") >= 2, (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))).alias("p_bar"))
    counted = cells.join(items.select(*by, item, "n"), [*by, item])
    cats = counted.where("label is not null").groupBy(*by, "label").agg(F.sum(F.when(F.col("n") >= 2, F.col("c")).otherwise(0)).alias("t"))
    chance = cats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_categories"), F.sum("t").alias("total"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    pe = F.when(F.col("total") > 0, F.col("tt") / (F.col("total") * F.col("total")))
    return per.join(chance, by, "left").select(*by, "n_items", "valid_items", F.coalesce("n_categories", F.lit(0)).alias("n_categories"), "p_bar", pe.alias("p_e"), _chance_corrected(F.col("p_bar"), pe).alias("fleiss_kappa"))


def entity_micro(sets: DataFrame, predicted: str, raters: str, majority: int = 3, distinct: bool = False) -> DataFrame:
    """Micro precision, recall and F1 of predicted entity sets against those named `majority` times or more.

    raters holds an array of entity arrays. Mentions are counted, so that one rater naming an entity three times makes it a
    majority, unless distinct.
    """
    named = F.flatten(F.transform(F.coalesce(F.col(raters), F.array()), lambda x: F.array_distinct(F.coalesce(x, F.array())) if distinct else F.coalesce(x, F.array())))
    gold = F.filter(F.array_distinct(named), lambda e: F.size(F.filter(named, lambda x: x == e)) >= majority)
    told = F.array_distinct(F.coalesce(F.col(predicted), F.array()))
    rows = sets.select(F.size(F.array_intersect(told, gold)).alias("tp"), F.size(F.array_except(told, gold)).alias("fp"), F.size(F.array_except(gold, told)).alias("fn"))
    s = rows.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def entity_pairs(sets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per item the exact matches and the mean F1 over all pairs of raters' entity sets (both empty: 1; one empty: 0)."""
    clean = [F.array_distinct(F.coalesce(F.col(c), F.array())) for c in columns]
    n = len(columns)
    exact, f1 = [], []
    for i in range(n):
        for j in range(i + 1, n):
            a, b = clean[i], clean[j]
            both = F.size(F.array_intersect(a, b))
            exact.append(((F.size(a) == F.size(b)) & (both == F.size(a))).cast("double"))
            f1.append(F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2 * both / (F.size(a) + F.size(b))))
    total = len(exact)
    mean = lambda cols: sum(cols[1:], cols[0]) / total
    return sets.select(key, mean(exact).alias("exact_match"), mean(f1).alias("pairwise_f1"))


def entity_binary(sets: DataFrame, item: str, first: str, second: str) -> DataFrame:
    """(label_1, label_2) pairs: whether each of two raters names an entity, over the union per item."""
    a, b = (F.array_distinct(F.coalesce(F.col(c), F.array())) for c in (first, second))
    rows = sets.select(item, F.explode(F.array_union(a, b)).alias("e"), a.alias("a"), b.alias("b"))
    return rows.select(item, F.array_contains("a", F.col("e")).cast("int").alias("label_1"), F.array_contains("b", F.col("e")).cast("int").alias("label_2"))


def entity_fleiss(sets: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """Fleiss' kappa of entity naming: every entity of an item's union is a yes-no decision of each rater."""
    arrays = [F.array_distinct(F.coalesce(F.col(c), F.array())) for c in columns]
    union = F.array_distinct(F.flatten(F.array(*arrays)))
    rows = sets.select(item, F.array(*arrays).alias("r"), F.explode(union).alias("e"))
    yes = F.size(F.filter("r", lambda x: F.array_contains(x, F.col("e"))))
    n = len(columns)
    per = rows.select(yes.alias("y")).agg(F.count(F.lit(1)).alias("n_decisions"), F.avg((F.col("y") * F.col("y") + (n - F.col("y")) * (n - F.col("y")) - n) / (n * (n - 1))).alias("p_bar"), F.avg(F.col("y") / n).alias("share"))
    pe = F.col("share") * F.col("share") + (1 - F.col("share")) * (1 - F.col("share"))
    return per.select("n_decisions", "p_bar", pe.alias("p_e"), _chance_corrected(F.col("p_bar"), pe).alias("fleiss_kappa"))
