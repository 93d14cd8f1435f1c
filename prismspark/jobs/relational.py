"""Queries over predictions, trials, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismspark.functions.hashrand import order_key, order_key_sql, place_key_sql
from prismspark.operators import evaluate, sampling, scoring
from prismspark.sources import predictions, stores
from prismspark.sources.tables import CHANNELS, pixels, spectra, table, trials

BUDGET, RATIO = 200, 0.3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("user_id").cast("long").alias("core"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))


def waterfill_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.water_fill(_events(spark, sf_dir), "label", "core", "event_id", BUDGET, 1).select("label", "core", "event_id")


def waterfill_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.water_fill_quotas(_events(spark, sf_dir), "label", "core", "event_id", BUDGET, 1)


def hyperspectral_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.hyperspectral_sample(_events(spark, sf_dir), "label", "core", "event_id", "value", 150, 60.0, 20.0, 2)
    return found.select("class", "core", "event_id")


def signal_background_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.pools(pixels(spark, sf_dir), F.col("value"), 40.0, 10.0)
    return found.groupBy("class", "pool").agg(F.count(F.lit(1)).alias("n"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("image"), F.col("o_custkey").cast("long").alias("patient"), F.col("o_orderstatus").alias("label"))


def patient_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.patient_split(_orders(spark, sf_dir), "patient", RATIO, 4).select("image", "patient", "part")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients on both sides of the split: none."""
    split = sampling.patient_split(_orders(spark, sf_dir), "patient", RATIO, 4)
    both = split.filter("part = 'train'").select("patient").intersect(split.filter("part = 'test'").select("patient"))
    return both.agg(F.count(F.lit(1)).alias("shared_patients"))


def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.label_split(_orders(spark, sf_dir), "label", "image", 0.7, 5).select("image", "label", "part")


def test_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.test_subsample(_orders(spark, sf_dir), "label", "image", 0.1, 6).select("label", "image")


def balanced_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_batches(spectra(spark, sf_dir), "y", "vec_id", 5, 8, 7, 3)


def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dominant_class(pixels(spark, sf_dir), "image", "class")


def class_histogram_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.histogram(pixels(spark, sf_dir), "class")
    return found.select("class", "n", F.round("pct", 6).alias("pct"))


def class_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each class per image, and which images hold a wanted class."""
    p = pixels(spark, sf_dir)
    return p.groupBy("image").agg(*[F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c.lower()}") for c in "ANR"], F.arrays_overlap(F.collect_set("class"), F.array(F.lit("A"), F.lit("R"))).alias("wanted"))


def accuracy_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).groupBy("n", "gt").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(evaluate.hit()), 6).alias("accuracy"))


def accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = trials(spark, sf_dir).groupBy("n", "seed", "arm").agg(F.avg(F.when(F.col("pred") != 0, evaluate.hit())).alias("accuracy"))
    s = evaluate.summary(per, "accuracy")
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean", "least", "largest", "std")], "n_ok", "n_failed")


def accuracy_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_size(trials(spark, sf_dir)).select("n", "trials", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.paired_delta(trials(spark, sf_dir))
    return found.select("n", "pairs", (F.round("mean_delta", 6) + F.lit(0.0)).alias("mean_delta"), F.round("std_delta", 6).alias("std_delta"))


def confusion_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.confusion(trials(spark, sf_dir).select("gt", "pred"))
    return found.select("gt", "pred", "n", F.round("pct", 6).alias("pct"))


def normalised_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw error of each size over that of the smallest one both arms have, with
    no law fitted; ``scaling_law_normalised_error`` has that of the fitted law."""
    error = trials(spark, sf_dir).groupBy("arm", "n").agg(F.avg(1 - evaluate.hit()).alias("error"))
    first = error.groupBy("arm").agg(F.min("n").alias("n0")).agg(F.max("n0").alias("n0"))
    base = error.join(F.broadcast(first), F.col("n") == F.col("n0")).select("arm", F.col("error").alias("e0"))  # a row an arm
    return error.join(base, "arm").select("arm", "n", F.round(F.try_divide("error", "e0"), 6).alias("relative_error"))


def median_core_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("image").count().agg(F.median("count").alias("median"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 equal bins between the least and the largest value."""
    p = pixels(spark, sf_dir)
    ends = p.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    place = F.floor(F.try_divide((F.col("value") - F.col("lo")) * 100, F.col("hi") - F.col("lo")))  # null where all are alike
    place = F.when(F.col("value").isNotNull(), F.least(F.coalesce(place, F.lit(0)), F.lit(99))).cast("long")
    return p.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def early_stop_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return evaluate.early_stop_wait(log, "series", "step", "value").select("series", "step", F.round("best", 6).alias("best"), "wait")


def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best trials by accuracy."""
    per = trials(spark, sf_dir).groupBy("n", "seed", "arm").agg(F.avg(evaluate.hit()).alias("a"))
    return per.select("n", "seed", "arm", F.round("a", 6).alias("accuracy")).orderBy(F.desc("accuracy"), "n", "seed", "arm").limit(10)


def schedule_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trials(spark, sf_dir).select("n").distinct()
    raw = 1 / F.log2(F.col("n") / 64 + 1)
    return n.select("n", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw)), 6).alias("strength"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.translate("c_name", " /", "__").alias("safe_name"))


def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested images that the store lacks: customers without an open order."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("image"))
    return asked.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("long").alias("image")), "image", "left_anti")


def trial_id_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.with_trial_ids(trials(spark, sf_dir).select("n", "seed", "arm").distinct())


def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.list_images(_orders(spark, sf_dir).select(F.col("image").cast("string").alias("image"), F.when(F.col("label") != "P", F.col("label")).alias("label")))


def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.shapes(pixels(spark, sf_dir))


def pixel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.pixel_range(spectra(spark, sf_dir), 3, 9, width=4).select("image", "px", "row", "col", "vec_id")


def class_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of some classes, with their place in the given order."""
    order = spark.createDataFrame([(7, 0), (2, 1), (5, 2)], "y long, new_y long")
    return spectra(spark, sf_dir).join(F.broadcast(order), "y").select("vec_id", "y", "new_y")  # as many rows as classes asked for


def background_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the pixels whose background share is at most a threshold."""
    t = trials(spark, sf_dir).withColumn("bg", (F.col("event_id") * 37 % 100) / 100.0)
    kept = F.col("bg") <= 0.4
    return t.groupBy("n").agg(F.count(F.when(kept, 1)).alias("kept"), F.round(F.avg(F.when(kept, evaluate.hit())), 6).alias("accuracy"))


def augmentation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sampling.random_mask(F.col("vec_id"), 0.35, 9, F.col("y") > 0)
    return spectra(spark, sf_dir).select("vec_id", m.alias("masked"))


def search_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of a search: one per order status and a seeded draw per trial."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("trial"))
    u = (order_key(F.col("trial"), 11) + 0.5) / 4_294_967_296.0
    v = (order_key(F.col("trial"), 12) + 0.5) / 4_294_967_296.0
    rate = F.exp(F.log(F.lit(1e-5)) + u * (F.log(F.lit(1e-2)) - F.log(F.lit(1e-5))))
    return base.select("trial", F.round(rate, 9).alias("learning_rate"), F.element_at(F.array(F.lit(16), F.lit(32), F.lit(64)), (F.floor(v * 3) + 1).cast("int")).cast("long").alias("batch"))


def param_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = trials(spark, sf_dir).groupBy("n", "seed", "arm").agg(F.avg(evaluate.hit()).alias("accuracy"))
    return scoring.parameter_importance(per, ["n", "seed", "arm"], "accuracy")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value and best value of each metric in a log."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return log.groupBy("key").agg(F.round(F.max_by("value", "step"), 6).alias("last"), F.round(F.max("value"), 6).alias("best"), F.count(F.lit(1)).alias("n"))


def smoothed_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxcar mean over five steps of each series."""
    log = table(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return evaluate.boxcar(log, "event_type", "step", "value", 2).select("step", F.round("smooth", 6).alias("smooth"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each label in each part of the split."""
    split = sampling.label_split(_orders(spark, sf_dir), "label", "image", 0.7, 5)
    return split.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by optional attribute lists; a missing attribute fails."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("image"), F.col("c_mktsegment").alias("rock"), F.col("c_nationkey").cast("long").alias("condition"))
    return c.filter(F.col("rock").isin("BUILDING", "MACHINERY") & F.col("condition").isin(1, 2, 3, 5, 8))


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each image's label in a vocabulary; unknown labels have none."""
    vocabulary = spark.createDataFrame([("F", 0), ("O", 1)], "label string, idx long")
    return _orders(spark, sf_dir).join(F.broadcast(vocabulary), "label", "left").select("image", "label", "idx")  # a row a class


def prediction_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined to truth by image and pixel, with images whose counts differ marked."""
    from prismspark.functions import native

    rows = spectra(spark, sf_dir)
    pred = rows.filter(F.get("x", F.lit(0)) > -0.2).select("image", "px", native.argmax(F.slice("x", 1, 10)).cast("long").alias("pred"))
    return evaluate.matched(pred, rows.select("image", "px", F.col("y").alias("gt")))


def image_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("image", "patient", F.col("class").alias("gt"), F.when(F.col("value") > 25, "N").otherwise("A").alias("pred"))
    return p.groupBy("image").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(evaluate.hit()), 6).alias("accuracy"))


def name_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a patient's images of their accuracies."""
    p = pixels(spark, sf_dir).select("image", "patient", F.col("class").alias("gt"), F.when(F.col("value") > 25, "N").otherwise("A").alias("pred"))
    per = p.groupBy("patient", "image").agg(F.avg(evaluate.hit()).alias("a"))
    return per.groupBy("patient").agg(F.round(F.avg("a"), 6).alias("accuracy"), F.count(F.lit(1)).alias("images"))


def class_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that only one of two vocabularies has, or that stand elsewhere in it."""
    p = pixels(spark, sf_dir)
    one = p.filter("value < 25").select("class").distinct().withColumn("i", F.row_number().over(Window.orderBy("class")))  # classes are few
    two = p.filter("value >= 10").select("class").distinct().withColumn("j", F.row_number().over(Window.orderBy("class")))
    both = one.join(two, "class", "full")
    return both.agg(F.count(F.when(~F.col("i").eqNullSafe(F.col("j")), 1)).alias("differences"), F.count(F.lit(1)).alias("classes"))


def sampled_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows available and taken for each label."""
    rows = _events(spark, sf_dir)
    taken = sampling.water_fill(rows, "label", "core", "event_id", BUDGET, 1).groupBy("label").agg(F.count(F.lit(1)).alias("taken"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("available")).join(taken, "label", "left").select("label", "available", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shared_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, seed) that both arms have."""
    t = trials(spark, sf_dir)
    return t.filter("arm = 0").select("n", "seed").intersect(t.filter("arm = 1").select("n", "seed"))


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each arm that it never predicts."""
    t = trials(spark, sf_dir)
    return t.select("arm", F.col("gt").alias("class")).distinct().exceptAll(t.select("arm", F.col("pred").alias("class")).distinct())


def fit_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pool of 45 spectra, at most 5 a class, by a seed of its own."""
    even = sampling.water_fill(spectra(spark, sf_dir), "y", "image", "vec_id", 5, 21)
    return even.orderBy(order_key(F.col("vec_id"), 22), "vec_id").limit(45).select("vec_id", "y")


def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of predictions: best class, background share, best three."""
    from prismspark.functions import native

    rows = spectra(spark, sf_dir).select(F.lit("t").alias("trial_id"), "image", "px", "vec_id", "y", native.softmax(F.slice("x", 1, 10)).alias("probs"))
    kept = predictions.records(rows, 3)
    top = F.transform("top_k", lambda s: s["cls"].cast("string"))
    return kept.select("image", "px", F.col("argmax").cast("long").alias("argmax"), F.round(F.col("bg_prob").cast("double"), 4).alias("bg_prob"), F.array_join(top, ",").alias("top"), F.col("true_label").cast("long").alias("true_label"))


def study_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's finished trials with plain column names, the best first."""
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("params_id"), F.col("event_type").alias("params_kind"), F.col("value").cast("double").alias("value"), F.col("user_id").alias("datetime_start"))
    named = raw.filter("params_kind != 'error'").drop("datetime_start").withColumnsRenamed({c: c.removeprefix("params_") for c in raw.columns if c != "datetime_start"})
    return named.orderBy(F.desc("value"), "id").limit(10).select("id", "kind", F.round("value", 6).alias("value"))


def failed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with spectra that cannot be scored: some null, some cut short."""
    rows = spectra(spark, sf_dir)
    broken = F.when(F.col("vec_id") % 97 == 0, None).when(F.col("vec_id") % 89 == 0, F.slice("x", 1, 50)).otherwise(F.col("x"))
    scored = scoring.score(rows.withColumn("x", broken), scoring.seeded_network(CHANNELS, 10), channels=CHANNELS)
    return scoring.failed_images(scored)


def trial_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials by optional lists of sizes, seeds and arms."""
    found = evaluate.filter_trials(trials(spark, sf_dir), n=[64, 128], seed=None, arm=[1])
    return found.groupBy("n", "seed").agg(F.count(F.lit(1)).alias("pixels"))


def paired_delta_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the arms by size and seed token; a trial that ran again counts once."""
    t = predictions.with_trial_ids(trials(spark, sf_dir).select("n", "seed", "arm").distinct())
    per = trials(spark, sf_dir).withColumn("run", (F.col("event_id") / 1000).cast("long")).groupBy("n", "seed", "arm", "run").agg(F.avg(evaluate.hit()).alias("accuracy"))
    found = evaluate.paired_by_token(per.join(t.select("n", "seed", "arm", "seed_token"), ["n", "seed", "arm"]), "n", "seed_token", "arm", "accuracy", "run")
    return found.select("n", "pairs", (F.round("mean_delta", 6) + F.lit(0.0)).alias("mean_delta"))


def core_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores that hold wanted classes, by the most frequent of these, split by patient."""
    found = sampling.split_cores(_orders(spark, sf_dir), pixels(spark, sf_dir).select("image", "class"), "patient", "image", "class", ["A", "R"], RATIO, 14)
    return found.select("image", "patient", "dominant", "part")


def spectra_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of some classes, re-numbered and in seeded order."""
    found = sampling.sample_classes(spectra(spark, sf_dir), "y", "image", "vec_id", list(range(10)), [7, 2, 5, 0], 12, 31)
    return found.select("place", "vec_id", F.col("new_y").cast("long").alias("new_y"))


def accuracy_per_class_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each class of an image that its truth holds."""
    p = pixels(spark, sf_dir).select("image", F.col("class").alias("gt"), F.when(F.col("value") > 25, "N").otherwise("A").alias("pred"))
    return p.groupBy("image", "gt").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(evaluate.hit()), 6).alias("accuracy"))


def resolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a store with two layouts has each image that is asked for."""
    orders = _orders(spark, sf_dir).select(F.col("patient").alias("image"), "label")
    return stores.resolve(orders.filter("label != 'P'"), orders.filter("label = 'F'"), orders)


def label_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of images that lack one: a word, the image's name, another attribute."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("image"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("label"), "c_name", F.col("c_nationkey").cast("string").alias("rock"))
    word, name, other = (stores.labelled(c, d).select("image", F.col("label").alias(k)) for k, d in (("word", F.lit("unknown")), ("name", F.col("c_name")), ("other", F.coalesce("rock", "c_name"))))
    return word.join(name, "image").join(other, "image")


QUERIES = {f.__name__: f for f in (
    waterfill_sample, waterfill_quota, hyperspectral_sample, signal_background_filter, patient_split, split_leakage, label_split, test_subsample, balanced_batch,
    dominant_class, class_histogram_pct, class_per_image, accuracy_per_class, accuracy_summary, accuracy_by_n, paired_delta, confusion_pct, normalised_error,
    median_core_size, value_histogram, early_stop_wait, sweep_best, schedule_strength, safe_names, missing_images, trial_id_build, image_listing, image_shapes,
    pixel_range, class_subset, background_exclusion, augmentation_mask, search_space, param_importance, metric_log, smoothed_metric,
    label_counts, attribute_filter, label_lookup, prediction_truth, image_accuracy, name_accuracy, class_order_check, sampled_counters, shared_seeds,
    missing_classes, fit_pool, prediction_records, study_columns, failed_images, trial_filters, paired_delta_token,
    core_split, spectra_sample, accuracy_per_class_image, resolved_images, label_defaults,
)}

_EV = "ev as (select event_type as label, cast(user_id as bigint) as core, cast(event_id as bigint) as event_id, cast(value as double) as value from events)"
_PX = "px as (select l_orderkey as image, cast(l_linenumber as bigint) as px, l_returnflag as class, cast(l_quantity as double) as value, o_custkey as patient from lineitem join orders on l_orderkey = o_orderkey)"
_OR = "o as (select cast(o_orderkey as bigint) as image, cast(o_custkey as bigint) as patient, o_orderstatus as label from orders)"
_TR = """t as (select cast(pow(2, 5 + event_id % 5) as bigint) as n, cast(user_id % 3 as bigint) as seed, cast(event_id % 2 as bigint) as arm,
  cast(floor(event_id / 3.0) as bigint) % 4 as gt, cast(event_id % 4 as bigint) as pred, cast(event_id as bigint) as event_id from events)"""
_HIT = "case when pred = gt then cast(1 as double) else cast(0 as double) end"
_GUESS = "(case when value > 25 then 'N' else 'A' end)"
_PER = f"p as (select n, seed, arm, avg({_HIT}) as a from t group by all)"
_TEST = f"q as (select patient, row_number() over (order by {order_key_sql('patient', 4)}, patient) as r, count(*) over () as n from (select distinct patient from o))"
_PART = f"{_OR}, {_TEST}, s as (select image, o.patient, case when r <= greatest(1, round_even(n * cast({RATIO} as double), 0)) then 'test' else 'train' end as part from o join q using (patient))"


def _fill(rows: str, budget: int, seed: int) -> str:
    return f"""w1 as (select *, row_number() over (partition by label, core order by {order_key_sql("event_id", seed)}, event_id) as r from {rows}),
      w2 as (select *, row_number() over (partition by label order by r, {order_key_sql("core", seed)}, core) as k from w1)"""


ORACLE_SQL = {
    "waterfill_sample": f"with {_EV}, {_fill('ev', BUDGET, 1)} select label, core, event_id from w2 where k <= {BUDGET}",
    "waterfill_quota": f"with {_EV}, {_fill('ev', BUDGET, 1)} select label, core, count(*) as quota from w2 where k <= {BUDGET} group by all",
    "hyperspectral_sample": f"""with {_EV}, pool as (select label, core, event_id from ev where value > 60 union all select 'bkg', core, event_id from ev where value < 20),
      {_fill("pool", 150, 2)} select label as class, core, event_id from w2 where k <= 150""",
    "signal_background_filter": f"with {_PX} select class, 'signal' as pool, count(*) as n from px where value > 40 group by class union all select class, 'bkg', count(*) from px where value < 10 group by class",
    "patient_split": f"with {_PART} select image, patient, part from s",
    "split_leakage": f"with {_PART} select count(*) as shared_patients from (select patient from s where part = 'train' intersect select patient from s where part = 'test')",
    "label_split": f"""with {_OR}, r as (select *, row_number() over (partition by label order by {order_key_sql("image", 5)}, image) as r, count(*) over (partition by label) as n from o)
      select image, label, case when r <= round_even(n * cast(0.7 as double), 0) then 'train' else 'test' end as part from r""",
    "test_subsample": f"""with {_OR}, r as (select *, row_number() over (partition by label order by {order_key_sql("image", 6)}, image) as r, count(*) over (partition by label) as n from o)
      select label, image from r where r <= greatest(1, round_even(n * cast(0.1 as double), 0))""",
    "balanced_batch": f"""with e as (select vec_id, cast(label as bigint) as y from embeddings),
      i as (select *, row_number() over (partition by y order by {order_key_sql("vec_id", 7)}, vec_id) - 1 as i from e),
      c as (select y, n, row_number() over (order by y) - 1 as k, cast(sum(n) over (order by y) - n as bigint) as start, cast(sum(n) over () as bigint) as total from (select y, count(*) as n from e group by y)),
      d as (select b as batch, y, k * 8 + s as d, {order_key_sql("b * 8 + s + 1", 7)} % n as i from c, unnest(range(0, 5)) as x(b), unnest(range(0, 8)) as z(s)
        union all select b, y, -1 - s, {order_key_sql("b * 3 + s + 1", 8)} % total - start as i from c, unnest(range(0, 5)) as x(b), unnest(range(0, 3)) as z(s)
        where {order_key_sql("b * 3 + s + 1", 8)} % total - start between 0 and n - 1),
      o as (select *, row_number() over (partition by batch order by {place_key_sql("d", "batch", 9)}, d) - 1 as slot from d)
      select batch, slot, o.y, vec_id from o join i on i.y = o.y and i.i = o.i""",
    "dominant_class": f"""with {_PX}, c as (select image, class, count(*) as n from px group by all), r as (select *, row_number() over (partition by image order by n desc, class) as r from c)
      select image, class as dominant, n from r where r = 1""",
    "class_histogram_pct": f"with {_PX} select class, count(*) as n, round(cast(100 as double) * count(*) / sum(count(*)) over (), 6) as pct from px group by class",
    "class_per_image": f"""with {_PX} select image, count(*) filter (class = 'A') as n_a, count(*) filter (class = 'N') as n_n, count(*) filter (class = 'R') as n_r,
      bool_or(class in ('A', 'R')) as wanted from px group by image""",
    "accuracy_per_class": f"with {_TR} select n, gt, count(*) as pixels, round(avg({_HIT}), 6) as accuracy from t group by n, gt",
    "accuracy_summary": f"""with {_TR}, p as (select avg({_HIT}) filter (pred != 0) as a from t group by n, seed, arm)
      select round(avg(a), 6) as mean, round(min(a), 6) as least, round(max(a), 6) as largest, round(stddev_pop(a), 6) as std, count(a) as n_ok, count(*) - count(a) as n_failed from p""",
    "accuracy_by_n": f"with {_TR}, {_PER} select n, count(*) as trials, round(avg(a), 6) as mean, round(stddev_pop(a), 6) as std from p group by n",
    "paired_delta": f"""with {_TR}, {_PER}, d as (select x.n, y.a - x.a as d from p x join p y on x.n = y.n and x.seed = y.seed where x.arm = 0 and y.arm = 1)
      select n, count(*) as pairs, round(avg(d), 6) + cast(0 as double) as mean_delta, round(stddev_samp(d), 6) as std_delta from d group by n""",
    "confusion_pct": f"with {_TR} select gt, pred, count(*) as n, round(cast(100 as double) * count(*) / sum(count(*)) over (partition by gt), 6) as pct from t group by gt, pred",
    "normalised_error": f"""with {_TR}, e as (select arm, n, avg(1 - {_HIT}) as e from t group by arm, n), f as (select max(n0) as n0 from (select min(n) as n0 from e group by arm))
      select e.arm, e.n, round(e.e / b.e, 6) as relative_error from e join e b on b.arm = e.arm join f on b.n = f.n0""",
    "median_core_size": f"with {_PX} select cast(median(c) as double) as median from (select count(*) as c from px group by image)",
    "value_histogram": f"""with {_PX}, m as (select min(value) as lo, max(value) as hi from px)
      select cast(least(floor((value - lo) * 100 / (hi - lo)), 99) as bigint) as bin, count(*) as n from px, m group by 1""",
    "early_stop_wait": f"""with {_EV}, b as (select label as series, event_id as step, value, max(value) over w as best, max(value) over (partition by label order by event_id rows between unbounded preceding and 1 preceding) as old,
      row_number() over (partition by label order by event_id) as i from ev window w as (partition by label order by event_id rows unbounded preceding))
      select series, step, round(best, 6) as best, i - max(case when old is null or value > old then i end) over (partition by series order by step rows unbounded preceding) as wait from b""",
    "sweep_best": f"with {_TR}, {_PER} select n, seed, arm, round(a, 6) as accuracy from p order by accuracy desc, n, seed, arm limit 10",
    "schedule_strength": f"with {_TR} select distinct n, round(greatest(cast(0.1 as double), least(cast(1 as double), 1 / log2(cast(n as double) / 64 + 1))), 6) as strength from t",
    "safe_names": "select cast(c_custkey as bigint) as id, translate(c_name, ' /', '__') as safe_name from customer",
    "missing_images": "select cast(c_custkey as bigint) as image from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "trial_id_build": f"""with {_TR} select distinct n, seed, arm, 'N' || n || '_seed' || lpad(cast(seed as varchar), 2, '0') || '_' || case when arm = 1 then 'noise+shift' else 'raw' end as trial_id,
      'seed' || lpad(cast(seed as varchar), 2, '0') as seed_token from t""",
    "image_listing": f"with {_OR} select cast(image as varchar) as image, coalesce(case when label != 'P' then label end, '—') as label from o",
    "image_shapes": f"with {_PX} select image, count(*) as pixels, max(px) as last_px, case when count(*) = 1 then 'flat' else 'spatial' end as layout from px group by image",
    "pixel_range": """with s as (select vec_id % 25 as image, vec_id // 25 as px, vec_id from embeddings)
      select image, px, px // 4 as row, px % 4 as col, vec_id from s where px >= 3 and px < 9""",
    "class_subset": "select vec_id, cast(label as bigint) as y, cast(case label when 7 then 0 when 2 then 1 else 2 end as bigint) as new_y from embeddings where label in (7, 2, 5)",
    "background_exclusion": f"with {_TR}, b as (select *, (event_id * 37 % 100) / cast(100 as double) as bg from t) select n, count(*) filter (bg <= cast(0.4 as double)) as kept, round(avg({_HIT}) filter (bg <= cast(0.4 as double)), 6) as accuracy from b group by n",
    "augmentation_mask": f"select vec_id, {order_key_sql('vec_id', 9)} < {int(0.35 * 4_294_967_296)} and label > 0 as masked from embeddings",
    "search_space": f"""with d as (select cast(o_orderkey as bigint) as trial, ({order_key_sql("o_orderkey", 11)} + cast(0.5 as double)) / cast(4294967296 as double) as u,
      ({order_key_sql("o_orderkey", 12)} + cast(0.5 as double)) / cast(4294967296 as double) as v from orders)
      select trial, round(exp(ln(cast(0.00001 as double)) + u * (ln(cast(0.01 as double)) - ln(cast(0.00001 as double)))), 9) as learning_rate, cast([16, 32, 64][cast(floor(v * 3) as bigint) + 1] as bigint) as batch from d""",
    "metric_log": f"with {_EV} select label as key, round(max_by(value, event_id), 6) as last, round(max(value), 6) as best, count(*) as n from ev group by label",
    "smoothed_metric": "select cast(event_id as bigint) as step, round(avg(cast(value as double)) over (partition by event_type order by event_id rows between 2 preceding and 2 following), 6) as smooth from events",
    "label_counts": f"""with {_OR}, r as (select *, row_number() over (partition by label order by {order_key_sql("image", 5)}, image) as r, count(*) over (partition by label) as n from o)
      select case when r <= round_even(n * cast(0.7 as double), 0) then 'train' else 'test' end as part, label, count(*) as n from r group by 1, 2""",
    "attribute_filter": "select cast(c_custkey as bigint) as image, c_mktsegment as rock, cast(c_nationkey as bigint) as condition from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey in (1, 2, 3, 5, 8)",
    "label_lookup": f"with {_OR} select image, label, cast(case label when 'F' then 0 when 'O' then 1 end as bigint) as idx from o",
    "prediction_truth": """with e as (select vec_id % 25 as image, vec_id // 25 as px, cast(label as bigint) as gt, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings),
      n as (select image, count(*) != count(*) filter (x[1] > cast(-0.2 as double)) as count_differs from e group by image)
      select image, px, gt, cast(list_position(x[1:10], list_max(x[1:10])) - 1 as bigint) as pred, count_differs from e join n using (image) where x[1] > cast(-0.2 as double)""",
    "image_accuracy": f"with {_PX} select image, count(*) as pixels, round(avg(case when class = {_GUESS} then cast(1 as double) else cast(0 as double) end), 6) as accuracy from px group by image",
    "name_accuracy": f"""with {_PX}, i as (select patient, image, avg(case when class = {_GUESS} then cast(1 as double) else cast(0 as double) end) as a from px group by all)
      select patient, round(avg(a), 6) as accuracy, count(*) as images from i group by patient""",
    "class_order_check": f"""with {_PX}, a as (select class, row_number() over (order by class) as i from (select distinct class from px where value < 25)),
      b as (select class, row_number() over (order by class) as j from (select distinct class from px where value >= 10))
      select count(*) filter (i is distinct from j) as differences, count(*) as classes from a full join b using (class)""",
    "sampled_counters": f"""with {_EV}, {_fill('ev', BUDGET, 1)}, k as (select label, count(*) as taken from w2 where k <= {BUDGET} group by label)
      select label, count(*) as available, coalesce(max(taken), 0) as taken from ev left join k using (label) group by label""",
    "shared_seeds": f"with {_TR} select n, seed from t where arm = 0 intersect select n, seed from t where arm = 1",
    "missing_classes": f"with {_TR} select arm, gt as class from t except select arm, pred from t",
    "fit_pool": f"""with e as (select vec_id, cast(label as bigint) as label, vec_id % 25 as core, vec_id as event_id from embeddings), {_fill('e', 5, 21)}
      select vec_id, label as y from w2 where k <= 5 order by {order_key_sql("vec_id", 22)}, vec_id limit 45""",
    "prediction_records": """with e as (select vec_id % 25 as image, vec_id // 25 as px, vec_id, label, list_transform(embedding[1:10], lambda v: cast(v as double)) as x from embeddings),
      l as (select image, px, label, x, unnest(range(0, 10)) as c, unnest(list_transform(x, lambda v: exp(v - list_max(x)))) as s from e),
      r as (select *, s / sum(s) over (partition by image, px) as p, row_number() over (partition by image, px order by s desc, c) as r from l)
      select image, px, max(c) filter (r = 1) as argmax, round(max(cast(cast(p as float) as double)) filter (c = 0), 4) as bg_prob,
        string_agg(cast(c as varchar), ',' order by r) filter (r <= 3) as top, cast(max(label) as bigint) as true_label from r group by image, px""",
    "study_columns": "select cast(event_id as bigint) as id, event_type as kind, round(cast(value as double), 6) as value from events where event_type != 'error' order by cast(value as double) desc, event_id limit 10",
    "failed_images": """select vec_id % 25 as image, count(*) as pixels, count(*) filter (vec_id % 97 = 0 or vec_id % 89 = 0) as failed from embeddings
      group by 1 having count(*) filter (vec_id % 97 = 0 or vec_id % 89 = 0) > 0""",
    "trial_filters": f"with {_TR} select n, seed, count(*) as pixels from t where n in (64, 128) and arm = 1 group by n, seed",
    "paired_delta_token": f"""with {_TR}, r as (select n, seed, arm, event_id // 1000 as run, avg({_HIT}) as a from t group by all),
      l as (select n, seed, arm, a from (select *, row_number() over (partition by n, seed, arm order by run desc) as k from r) where k = 1)
      select x.n, count(*) as pairs, round(avg(y.a - x.a), 6) + cast(0 as double) as mean_delta from l x join l y on x.n = y.n and x.seed = y.seed and x.arm = 0 and y.arm = 1 group by x.n""",
    "core_split": f"""with {_PX}, {_OR}, c as (select image, class, count(*) as n from px where class in ('A', 'R') group by all),
      b as (select image, class as dominant from (select *, row_number() over (partition by image order by n desc, class) as r from c) where r = 1), k as (select o.*, dominant from o join b using (image)),
      q as (select patient, row_number() over (order by {order_key_sql("patient", 14)}, patient) as r, count(*) over () as n from (select distinct patient from k))
      select image, patient, dominant, case when r <= greatest(1, round_even(n * cast({RATIO} as double), 0)) then 'test' else 'train' end as part from k join q using (patient)""",
    "spectra_sample": f"""with e as (select vec_id, cast(label as bigint) as label, vec_id % 25 as core, vec_id as event_id from embeddings where label in (7, 2, 5, 0)), {_fill('e', 12, 31)}
      select row_number() over (order by {order_key_sql("vec_id", 32)}, vec_id) - 1 as place, vec_id, cast(list_position([7, 2, 5, 0], label) - 1 as bigint) as new_y from w2 where k <= 12""",
    "accuracy_per_class_image": f"with {_PX} select image, class as gt, count(*) as pixels, round(avg(case when class = {_GUESS} then cast(1 as double) else cast(0 as double) end), 6) as accuracy from px group by image, class",
    "resolved_images": f"with {_OR} select patient as image, case when count(*) filter (label = 'F') > 0 then 'nested' else 'top' end as layout from o group by patient having count(*) filter (label != 'P') > 0",
    "label_defaults": """select cast(c_custkey as bigint) as image, case when c_custkey % 3 > 0 then c_mktsegment else 'unknown' end as word, case when c_custkey % 3 > 0 then c_mktsegment else c_name end as name,
      case when c_custkey % 3 > 0 then c_mktsegment else cast(c_nationkey as varchar) end as other from customer""",
}
