"""Community scores and purity, binary metrics with exact AUC, archetypes and representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In the order in which the rules are tried; the last is what remains.
ARCHETYPES = ("Pure human macro-communities", "Compact bot communities", "Sparse peripheral communities", "Mixed transitional communities")


def normalize_assignments(assignments: DataFrame, labels: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Assignments (user_id, community_id, split, label) with label and split looked up, falling back to the row's own; blank ids go."""
    out = assignments.where("trim(coalesce(user_id, '')) <> '' and trim(coalesce(community_id, '')) <> ''")
    for extra, column in ((labels, "label"), (splits, "split")):
        if extra is not None:
            found = extra.groupBy("user_id").agg(F.max(column).alias(f"_{column}"))
            out = out.join(found, "user_id", "left").withColumn(column, F.coalesce(f"_{column}", column)).drop(f"_{column}")
    return out


def _bot(split: str | None = None) -> Column:
    hit = F.col("label") == "bot"
    return F.count_if(hit if split is None else hit & (F.col("split") == split))


def _human(split: str | None = None) -> Column:
    hit = F.col("label") == "human"
    return F.count_if(hit if split is None else hit & (F.col("split") == split))


def train_prior(rows: DataFrame) -> DataFrame:
    """One row: the share of bots among labelled train rows, 0.5 without any."""
    return rows.agg(F.coalesce(_bot("train") / F.nullif(_bot("train") + _human("train"), F.lit(0)), F.lit(0.5)).alias("prior"))


def community_profiles(rows: DataFrame, threshold: float = 0.5, alpha: float = 1.0) -> DataFrame:
    """Per community: counts, bot ratio, purity over all members, smoothed train score, and labels by score and by train majority.

    A community without labelled train members gets the prior. Purity's denominator is the size, unlabelled members included.
    """
    c = rows.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("community_size"), _human("train").alias("train_human"), _bot("train").alias("train_bot"), _human().alias("all_human"), _bot().alias("all_bot"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in ("train", "valid", "test")],
    )
    c = c.join(F.broadcast(train_prior(rows)))  # one row
    seen = F.col("train_human") + F.col("train_bot")
    score = F.when(seen > 0, (F.col("train_bot") + alpha * F.col("prior")) / (seen + alpha)).otherwise(F.col("prior"))
    c = c.withColumn("bot_score", score).withColumn("predicted_label", F.when(F.col("bot_score") >= threshold, "bot").otherwise("human"))
    c = c.withColumn("score_source", F.when(seen > 0, "train_members").otherwise("global_train_prior"))
    majority = F.when(F.col("train_bot") > F.col("train_human"), "bot").when(F.col("train_bot") < F.col("train_human"), "human").otherwise(F.col("predicted_label"))
    source = F.when(seen == 0, "global_train_prior").when(F.col("train_bot") != F.col("train_human"), "train_majority").otherwise("train_tie_break_bot_score")
    ratio = F.coalesce(F.col("all_bot") / F.nullif(F.col("all_bot") + F.col("all_human"), F.lit(0)), F.lit(0.0))
    c = c.withColumn("majority_label", majority).withColumn("label_source", source).withColumn("bot_ratio", ratio)
    return c.withColumn("purity", F.greatest("all_human", "all_bot") / F.col("community_size")).drop("prior")


def global_purity(profiles: DataFrame) -> DataFrame:
    """One row: purity weighted by size."""
    return profiles.agg((F.sum(F.col("community_size") * F.col("purity")) / F.sum("community_size")).alias("global_purity"))


def project(rows: DataFrame, profiles: DataFrame, label: str = "predicted_label") -> DataFrame:
    """Members with their community's score and label."""
    return rows.select("user_id", "split", "label", "community_id").join(profiles.select("community_id", "community_size", "bot_score", F.col(label).alias("predicted_label"), "score_source"), "community_id")


def auc(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve by average ranks: ties count half. 0.0 where one class is missing. rows: label, bot_score.

    Rows are counted per distinct score first, so the running sum is over scores, not rows.
    """
    per = rows.where(F.col("label").isin("bot", "human")).groupBy(*by, "bot_score").agg(_bot().alias("p"), _human().alias("n"))
    below = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("bot_score").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0))
    return per.groupBy(*by).agg(F.coalesce(wins / F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("auc"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """Per split and for all: counts, accuracy, precision, recall, F1, share predicted as bots and AUC, over labelled rows."""
    used = rows.where(F.col("label").isin("bot", "human")).withColumn("split", F.explode(F.array(F.col("split"), F.lit("all"))))
    p, y = F.col("predicted_label") == "bot", F.col("label") == "bot"
    c = used.groupBy("split").agg(F.count(F.lit(1)).alias("labeled"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("labeled")
    c = c.withColumns({"accuracy": ratio(tp + F.col("tn"), n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "predicted_bot_rate": ratio(tp + fp, n)})
    return c.join(auc(used, ["split"]), "split")


def evaluate_partition(rows: DataFrame, threshold: float = 0.5, alpha: float = 1.0, by_majority: bool = True) -> dict[str, DataFrame]:
    """The whole evaluation of assignments: profiles, predictions, metrics and global purity."""
    profiles = community_profiles(rows, threshold, alpha)
    predictions = project(rows, profiles, "majority_label" if by_majority else "predicted_label")
    return {"profiles": profiles, "predictions": predictions, "metrics": binary_metrics(predictions), "purity": global_purity(profiles)}


def archetype(size: Column, bot_ratio: Column, purity: Column, density: Column, average_degree: Column) -> Column:
    human, compact, sparse, mixed = ARCHETYPES
    return (
        F.when((size >= 75) & (purity >= 0.85) & (bot_ratio <= 0.15), human)
        .when((size <= 80) & (purity >= 0.7) & (bot_ratio >= 0.55), compact)
        .when((size <= 20) & ((density < 0.25) | (average_degree < 3.5)), sparse)
        .otherwise(mixed)
    )


def representatives(rows: DataFrame, top: int = 3) -> DataFrame:
    """The first `top` communities of each archetype, by an order of its own. rows: archetype, community_id, community_size, bot_ratio, purity, density, average_degree."""
    human, compact, sparse, _ = ARCHETYPES
    kind = F.col("archetype")
    size, ratio, purity, density = F.col("community_size").cast("double"), F.col("bot_ratio"), F.col("purity"), F.col("density")
    pick = lambda a, b, c, d: F.when(kind == human, a).when(kind == compact, b).when(kind == sparse, c).otherwise(d)
    keys = [
        pick(-size, -ratio, density, F.abs(ratio - 0.5)), pick(-purity, -purity, F.col("average_degree"), purity),
        pick(F.lit(0.0), -density, size, -size), F.col("community_id"),
    ]
    return rows.withColumn("selection_rank", F.row_number().over(Window.partitionBy("archetype").orderBy(*keys))).where(F.col("selection_rank") <= top)


def errors(predictions: DataFrame) -> DataFrame:
    """Labelled predictions with error_type: FP, FN or null, and the score's margin to one half."""
    wrong = F.when((F.col("predicted_label") == "bot") & (F.col("label") == "human"), "FP").when((F.col("predicted_label") == "human") & (F.col("label") == "bot"), "FN")
    return predictions.where(F.col("label").isin("bot", "human")).withColumn("error_type", wrong).withColumn("margin", F.abs(F.col("bot_score") - 0.5))
