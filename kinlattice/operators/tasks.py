"""Tasks: splits, masks, batches and reproducible downsampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_number, hash_text, one_hot
from ..plans.shape import cut, with_position
from ..plans.specs import BatchSpec, TaskSpec

SPLITS = ("train", "valid", "test")
#: Draws with replacement that one row lists, and groups whose rows may be broadcast.
DRAWS, GROUPS = 100_000, 100_000


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of all splits with a split column."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(s)) for s, df in parts.items()])


def split_of(key: Column, seed: object = 42, train: int = 80, valid: int = 10) -> Column:
    """A split from a seeded hash, in hundredths."""
    h = F.pmod(hash_number(seed, key), F.lit(100))
    return F.when(h < train, "train").when(h < train + valid, "valid").otherwise("test")


def split_offsets(rows: DataFrame) -> DataFrame:
    """task, split, n, first: where each split starts if they are laid end to end. One row per task and split."""
    n = rows.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"))
    rank = F.element_at(F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(i))]), F.col("split"))
    before = Window.partitionBy("task").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return n.select("task", "split", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))


def split_lookup(rows: DataFrame, split: str, positions: DataFrame) -> DataFrame:
    """The rows of a split at the given positions in it."""
    return rows.where(F.col("split") == split).join(positions, "pos")


def positive_pairs(rows: DataFrame) -> DataFrame:
    """All of train; of the other splits only pairs labelled 1."""
    return rows.where("split = 'train' or label = 1")


def matching_types(tasks: DataFrame) -> DataFrame:
    """Without regression tasks whose target isn't on the seeds' own type."""
    return tasks.where("task_type <> 'regression' or target_type = seed_type")


def swap_roles(tasks: DataFrame) -> DataFrame:
    """Seed and target type exchanged for regression."""
    r = F.col("task_type") == "regression"
    return tasks.withColumns({"seed_type": F.when(r, F.col("target_type")).otherwise(F.col("seed_type")), "target_type": F.when(r, F.col("seed_type")).otherwise(F.col("target_type"))})


def masked_features(every: Column, allowed: Column, target: Column, prefix: str = "text_") -> Column:
    """All features but the allowed ones, and both versions of the target column, sorted."""
    both = F.array(target, F.concat(F.substring_index(target, "___", 1), F.lit("___"), F.lit(prefix), F.substring_index(target, "___", -1)))
    return F.sort_array(F.array_union(F.array_except(every, allowed), F.array_intersect(every, both)))


def mask_rows(values: DataFrame, masked: Column) -> DataFrame:
    """Long-form features (…, name, …) without masked ones."""
    return values.where(~F.array_contains(masked, F.col("name")))


def mask_sampled(values: DataFrame, masked: Column, scope: str = "root") -> DataFrame:
    """Long-form features of sampled instances (hop, name, …) without masked ones of the roots, or of all instances.

    With scope "root" a root's row that is reached again through a cycle keeps its columns.
    """
    if scope not in ("root", "all"):
        raise ValueError(f"scope {scope}")
    hidden = F.array_contains(masked, F.col("name"))
    return values.where(~hidden if scope == "all" else ~hidden | (F.col("hop") > 0))


def drop_columns(df: DataFrame, masked: list[str]) -> DataFrame:
    """The variant that projects masked columns away."""
    return df.drop(*masked)


def completion_types(features: DataFrame) -> DataFrame:
    """node_type, n: types with more than one feature."""
    return features.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completion_mask(rows: DataFrame, row_id: str, columns: list[str], seed: object = 42) -> DataFrame:
    """row_id, hidden (name), value of the hidden column as text, mask: one seeded column per row."""
    at = F.pmod(hash_number(seed, row_id), F.lit(len(columns))).cast("int")
    values = F.array(*[F.col(c).cast("string") for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    return rows.select(F.col(row_id).cast("long").alias("row_id"), F.get(names, at).alias("hidden"), F.get(values, at).alias("target"), one_hot(at, len(columns)).alias("mask"))


def completion_mask_sampled(values: DataFrame, instance: str = "inst_id", name: str = "name", value: str = "value", seed: object = 42) -> DataFrame:
    """instance, hidden (name), target (value as text): one seeded feature of every sampled instance, not of the roots only.

    values: long-form features of sampled instances. mask_hidden takes what is hidden out of them.
    """
    drawn = F.min_by(F.struct(name, F.col(value).cast("string").alias("v")), F.struct(hash_text(seed, instance, name), name)).alias("h")
    return values.groupBy(instance).agg(drawn).select(instance, F.col(f"h.{name}").alias("hidden"), F.col("h.v").alias("target"))


def mask_hidden(values: DataFrame, hidden: DataFrame, instance: str = "inst_id", name: str = "name") -> DataFrame:
    """Long-form features without those that completion_mask_sampled hid."""
    return values.join(hidden.select(instance, F.col("hidden").alias(name)), [instance, name], "left_anti")


def select_tasks(tasks: DataFrame, selector: str, groups: DataFrame | None = None) -> DataFrame:
    """ALLTASK, RETTASK, REGTASK, EXCEPT__name, a group of the group table (group_name, task), or names with commas."""
    if selector == "ALLTASK":
        return tasks
    if selector in ("RETTASK", "REGTASK"):
        return tasks.where(F.col("task_type") == ("retrieval" if selector == "RETTASK" else "regression"))
    if selector.startswith("EXCEPT__"):
        return tasks.where(F.col("task") != selector[len("EXCEPT__") :])
    named = tasks.where(F.col("task").isin(*selector.split(",")))
    if groups is None:
        return named
    members = tasks.join(groups.where(F.col("group_name") == selector).select("task"), "task", "left_semi")
    return members.unionByName(named).dropDuplicates(["task"])


def task_table(specs: list[TaskSpec], spark) -> DataFrame:
    """Task metadata, one row per spec."""
    rows = [(s.name, s.task_type, s.seed_type, s.target_type, s.metric, list(s.all_features), list(s.allowed_features), s.time_column) for s in specs]
    return spark.createDataFrame(rows, "task string, task_type string, seed_type string, target_type string, metric string, all_features array<string>, allowed_features array<string>, time_column string")


def _batched(rows: DataFrame, order: list[Column], group: str, size: int) -> DataFrame:
    """batch_id within a group and slot; batches never mix groups.

    Rows are numbered over the whole table, and a group's first number is taken off, so a group isn't one task.
    """
    numbered = with_position(rows, F.col(group), *order, position="__pos")
    first = numbered.groupBy(group).agg(F.min("__pos").alias("__first"))
    at = F.col("__pos") - F.col("__first")
    return numbered.join(first, group).withColumn("batch_id", F.floor(at / size).cast("long")).withColumn("slot", (at % size).cast("long")).drop("__pos", "__first")


def batches(rows: DataFrame, spec: BatchSpec, group: str = "task", key: str = "row_id") -> DataFrame:
    """Rows with batch_id and slot; with spec.ratio or spec.number, of a fixed-seed sample of each group."""
    if spec.ratio is not None:
        rows = downsample_ratio(rows, spec.ratio, spec.seed, group, key)
    if spec.number is not None:
        rows = downsample_absolute(rows, spec.number, spec.seed, group, key)
    order = [hash_text(spec.seed, group, key), F.col(key)] if spec.shuffle else [F.col(key)]
    return _batched(rows, order, group, spec.size)


def batch_order(batched: DataFrame, seed: object = 42, group: str = "task") -> DataFrame:
    """group, batch_id, place: batches of all groups in a seeded order."""
    each = batched.select(group, "batch_id").distinct().withColumn("h", hash_text(seed, group, "batch_id"))
    return with_position(each, "h", group, "batch_id", position="place").select(group, "batch_id", "place")


#: Rows of a group's last bucket that may be ranked in one task, and digits of the hash that a round looks at.
LAST_BUCKET, DIGITS = 50_000, 3


def _smallest(rows: DataFrame, wanted: DataFrame, seed: object, group: str, key: str) -> DataFrame:
    """Of each group (group, n_wanted) the rows with the smallest hashes, without sorting rows.

    Hashes are counted by their leading digits; the bucket in which the count is reached is looked at by its next digits, until it is small. The last row
    wanted is found there, and rows up to it are kept by one filter against a row per group.
    """
    hashed = rows.withColumn("__h", hash_text(seed, group, key))
    per_group = lambda df: df.withColumnRenamed(group, "__g")
    at = cut(per_group(wanted.select(group, "n_wanted")).where("n_wanted > 0").select("__g", F.col("n_wanted").cast("long").alias("left"), F.lit("").alias("prefix")))
    beside = (lambda df: F.broadcast(df)) if at.count() <= GROUPS else (lambda df: df)
    places = 0
    while True:
        inside = hashed.join(beside(at), F.col(group).eqNullSafe(F.col("__g")) & F.col("__h").startswith(F.col("prefix")))
        places += DIGITS
        counts = inside.groupBy("__g", "left", F.substring("__h", 1, places).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("__g").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand rows a group
        run = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        at = cut(run.where("below < left and left <= below + n").select("__g", (F.col("left") - F.col("below")).alias("left"), "prefix", "n"))
        largest = at.agg(F.max("n")).first()[0]
        if largest is None or largest <= LAST_BUCKET or places >= 30:
            break
        at = at.drop("n")
    inside = hashed.join(beside(at.drop("n")), F.col(group).eqNullSafe(F.col("__g")) & F.col("__h").startswith(F.col("prefix")))
    order = Window.partitionBy("__g").orderBy("__h", key)
    last = cut(inside.select("__g", "left", "__h", key).withColumn("__rank", F.row_number().over(order)).where("__rank = left").select("__g", F.struct("__h", F.col(key).alias("k")).alias("__last")))
    kept = hashed.join(beside(last), F.col(group).eqNullSafe(F.col("__g")) & (F.struct("__h", F.col(key).alias("k")) <= F.col("__last")))
    return kept.select(*rows.columns)


def _sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))


def downsample_ratio(rows: DataFrame, ratio: float, seed: object = 42, group: str = "task", key: str = "row_id") -> DataFrame:
    """Exactly floor(n * ratio) rows of each group, without replacement; keys are distinct within a group."""
    return _smallest(rows, _sizes(rows, group).select(group, F.floor(F.col("__n") * ratio).alias("n_wanted")), seed, group, key)


def downsample_absolute(rows: DataFrame, number: int, seed: object = 42, group: str = "task", key: str = "row_id") -> DataFrame:
    """Exactly that number of rows of each group; a smaller group is an error. Keys are distinct within a group."""
    few = F.raise_error(F.concat(F.lit(f"fewer than {number} rows in "), F.coalesce(F.col(group), F.lit("null")))).cast("int")
    return _smallest(rows, _sizes(rows, group).select(group, F.when(F.col("__n") < number, few).otherwise(F.lit(number)).alias("n_wanted")), seed, group, key)


def sample_with_replacement(rows: DataFrame, ratios: dict[str, float], default: float | None = None, seed: object = 42, group: str = "task", key: str = "row_id") -> DataFrame:
    """draw, and a row of its group, floor(n * ratio) times per group, with replacement."""
    numbered = with_position(rows, F.col(group), F.col(key), position="__pos")
    sizes = numbered.groupBy(group).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    given = F.coalesce(F.element_at(F.create_map(*[x for g, r in ratios.items() for x in (F.lit(g), F.lit(float(r)))]), F.col(group)) if ratios else F.lit(None), F.lit(default))
    ratio = F.when(given.isNotNull(), given).otherwise(F.raise_error(F.concat(F.lit("no ratio for "), F.col(group))))
    wanted = F.floor(F.col("__n") * ratio)
    # a group's draws are dealt out in blocks before they are listed
    blocks = sizes.where(wanted > 0).select(group, "__first", "__n", wanted.alias("__wanted"), F.explode(F.sequence(F.lit(0).cast("long"), wanted - 1, F.lit(DRAWS).cast("long"))).alias("__from")).repartition(group, "__from")
    draws = blocks.select(group, "__first", "__n", F.explode(F.sequence("__from", F.least(F.col("__from") + DRAWS, "__wanted") - 1)).alias("draw"))
    drawn = draws.select("draw", (F.col("__first") + hash_number(seed, group, "draw") % F.col("__n")).alias("__pos"))
    return numbered.join(drawn, "__pos").select("draw", *rows.columns)
