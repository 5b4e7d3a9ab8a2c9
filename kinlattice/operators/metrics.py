"""Heads, losses and metrics. Higher is better: losses are negated as metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dot
from ..plans.shape import with_position

#: Classes that one row gathers, and rows of such blocks that may be broadcast.
CLASS_BLOCK, CLASS_BLOCKS = 1_000, 16
METRICS = ("rmse", "mae", "hr@1", "retrieval_auroc", "retrieval_logloss")


def drop_padding(rows: DataFrame, label: str = "label", classes: bool = False) -> DataFrame:
    """Without rows whose label is NaN or null, or, of a class task, negative."""
    there = F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))
    return rows.where(there & (F.col(label) >= 0) if classes else there)


def class_candidates(rows: DataFrame, key: str, number: int) -> DataFrame:
    """The first number rows of the seeds' type as classes."""
    return rows.where(F.col(key) < number)


def _meet_blocks(seeds: DataFrame, classes: DataFrame) -> DataFrame:
    """seeds beside each block of classes (array<struct<class_id, c>>): some CLASS_BLOCK classes a block, a few blocks are broadcast."""
    blocks = max(1, -(-classes.count() // CLASS_BLOCK))
    table = classes.groupBy(F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("__block")).agg(F.collect_list(F.struct("class_id", F.col("emb").alias("c"))).alias("classes"))
    each = seeds.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return each.join(F.broadcast(table) if blocks <= CLASS_BLOCKS else table, "__block")


def class_scores(seeds: DataFrame, classes: DataFrame) -> DataFrame:
    """row_id, class_id, score for every seed and class (class_id, emb): the product that the head asks for.

    A row per seed and class; class_folds answers the best class and the losses without them.
    """
    met = _meet_blocks(seeds.select("row_id", "emb"), classes)
    return met.select("row_id", "emb", F.explode("classes").alias("x")).select("row_id", F.col("x.class_id").alias("class_id"), dot(F.col("emb"), F.col("x.c")).alias("score"))


def class_folds(seeds: DataFrame, classes: DataFrame) -> DataFrame:
    """row_id, class_id, top, log_total, label, own for seeds (row_id, emb, label): the best class (the smallest on ties) and its score, the log-sum-exp of all scores, the label's score.

    A seed and a block of classes fold into one row (best class, its score, the sum of exponentials below it), and these rows into one per
    seed; the fold doesn't depend on their order. No row per seed and class is made. own is null if the label has no class.
    """
    scored = F.transform("classes", lambda x: F.struct(dot(F.col("emb"), x["c"]).alias("score"), (-x["class_id"]).alias("less")))
    met = _meet_blocks(seeds.select("row_id", "emb", "label"), classes).select("row_id", "label", scored.alias("s"))
    met = met.select("row_id", "label", "s", F.array_max("s").alias("best"))
    own = F.get(F.filter("s", lambda x: -x["less"] == F.col("label")), F.lit(0))["score"]
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + F.exp(x["score"] - F.col("best.score")))
    parts = met.select("row_id", "label", "best", total.alias("total"), own.alias("own"))
    rows = parts.groupBy("row_id").agg(F.max("best").alias("best"), F.sort_array(F.collect_list(F.struct(F.col("best.score").alias("top"), "total"))).alias("parts"), F.max("label").alias("label"), F.max("own").alias("own"))
    whole = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["total"] * F.exp(p["top"] - F.col("best.score")))
    return rows.select("row_id", (-F.col("best.less")).alias("class_id"), F.col("best.score").alias("top"), (F.col("best.score") + F.log(whole)).alias("log_total"), "label", "own")


def _scored(score: Column) -> Column:
    return F.coalesce(score, F.raise_error(F.lit("a label's class has no score")).cast("double"))


def folded_hit_rate(folds: DataFrame) -> DataFrame:
    """One row: the share of rows whose best class is their label, from class_folds."""
    return folds.agg(F.avg((F.col("class_id") == F.col("label")).cast("double")).alias("hr1"))


def folded_log_loss(folds: DataFrame) -> DataFrame:
    """One row: the mean of score of the label minus log-sum-exp, from class_folds; a label without a class is an error."""
    return folds.agg(F.avg(_scored(F.col("own")) - F.col("log_total")).alias("logloss"))


def rmse(o: Column, y: Column) -> Column:
    return -F.sqrt(F.avg((o - y) * (o - y)))


def mae(o: Column, y: Column) -> Column:
    return -F.avg(F.abs(o - y))


def best_class(scores: DataFrame) -> DataFrame:
    """row_id, class_id of the largest score, the smallest class on ties."""
    return scores.groupBy("row_id").agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("class_id"))


def hit_rate(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of rows whose best class is their label. labels: row_id, label."""
    return best_class(scores).join(labels, "row_id").agg(F.avg((F.col("class_id") == F.col("label")).cast("double")).alias("hr1"))


def log_loss(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean of score of the label minus log-sum-exp of the scores; a label whose class has no score is an error."""
    top = scores.groupBy("row_id").agg(F.max("score").alias("top"))
    each = scores.join(top, "row_id").join(labels, "row_id")
    own = F.sum(F.when(F.col("class_id") == F.col("label"), F.col("score") - F.col("top")))
    rows = each.groupBy("row_id").agg(own.alias("own"), F.log(F.sum(F.exp(F.col("score") - F.col("top")))).alias("below"))
    return rows.agg(F.avg(_scored(F.col("own")) - F.col("below")).alias("logloss"))


def cross_entropy(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """The loss of a class head: the log-loss metric with its sign turned."""
    return log_loss(scores, labels).select((-F.col("logloss")).alias("loss"))


def log_softmax(scores: DataFrame) -> DataFrame:
    """row_id, class_id, log_p: the logarithm of the soft-max probability, exact where the probability itself is too small to tell from others."""
    parts = scores.groupBy("row_id").agg(F.max("score").alias("top"), F.sort_array(F.collect_list("score")).alias("all"))
    total = parts.select("row_id", (F.col("top") + F.log(F.aggregate("all", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top"))))).alias("log_total"))
    return scores.join(total, "row_id").select("row_id", "class_id", (F.col("score") - F.col("log_total")).alias("log_p"))


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc, from rows of keys, score, positive (0 or 1): the rank sum with ties at their mean rank.

    Rows are first counted per distinct score; ranks are running sums over all keys and scores, less what comes before the key, so
    a key isn't one task.
    Keys without positives or without negatives are left out.
    """
    per = scored.groupBy(*keys, "score").agg(F.sum("positive").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    ranked = with_position(per, *keys, "score", position="__pos", before={"__below": "n"})
    # of what lies below all of a key's rows, each positive has the same share in its rank
    rank = F.col("__below") + (F.col("n") + 1) / 2
    s = ranked.groupBy(*keys).agg((F.sum(F.col("p") * rank) - F.sum("p") * F.min("__below")).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return s.where("pos > 0 and neg > 0").select(*keys, ((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auroc"))


def multiclass_auroc(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean over classes of one against the rest.

    Scores that all lie in 0 to 1 are probabilities and rank as they are; others rank by the logarithm of their soft-max probability, without rounding.
    """
    ends = scores.agg(F.min("score"), F.max("score")).first()
    ranked = scores.select("row_id", "class_id", "score") if ends[0] is None or ends[0] >= 0 and ends[1] <= 1 else log_softmax(scores).withColumnRenamed("log_p", "score")
    rows = ranked.join(labels, "row_id").select("class_id", "score", (F.col("class_id") == F.col("label")).cast("int").alias("positive"))
    return auroc(rows, ["class_id"]).agg(F.avg("auroc").alias("auroc"))


def compute(rows: DataFrame, metric: str, labels: DataFrame | None = None) -> DataFrame:
    """One row, one column: rows are (output, label) for regression, scores (row_id, class_id, score) otherwise."""
    if metric == "rmse":
        return rows.agg(rmse(F.col("output"), F.col("label")).alias("rmse"))
    if metric == "mae":
        return rows.agg(mae(F.col("output"), F.col("label")).alias("mae"))
    if metric == "hr@1":
        return hit_rate(rows, labels)
    if metric == "retrieval_auroc":
        return multiclass_auroc(rows, labels)
    if metric == "retrieval_logloss":
        return log_loss(rows, labels)
    raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")


def compute_folded(seeds: DataFrame, classes: DataFrame, metric: str) -> DataFrame:
    """hr@1 or retrieval_logloss of seeds (row_id, emb, label) against classes (class_id, emb), without a row per seed and class."""
    if metric not in ("hr@1", "retrieval_logloss"):
        raise ValueError(f"{metric} isn't a fold over classes")
    folds = class_folds(seeds, classes)
    return folded_hit_rate(folds) if metric == "hr@1" else folded_log_loss(folds)


def metric_average(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.agg(F.avg(value).alias("average"))


def best_epoch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, epoch, value of the largest value, the first epoch on ties."""
    return rows.groupBy(*keys).agg(F.max_by("epoch", F.struct("value", -F.col("epoch"))).alias("epoch"), F.max("value").alias("value"))


def squared_loss(o: Column, y: Column) -> Column:
    return F.avg((o - y) * (o - y))
