"""Queries that train, search, and read stores of other kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.config import Model, Trainer
from prismspark.functions import sql
from prismspark.functions.hashrand import order_key_sql, place_key_sql, text_key_sql
from prismspark.jobs.spectral import ORACLE_SQL as SPECTRAL_SQL
from prismspark.jobs.spectral import values_of
from prismspark.operators import axes, complexity, evaluate, sampling, scoring, search, training
from prismspark.sources import array_store, predictions, study
from prismspark.sources.scratch import folder
from prismspark.sources.tables import AXIS, CHANNELS, spectra, trials

#: The steps that ``training_first_steps`` takes: one batch of ``SIZE`` each.
STEPS, SIZE, SEED, RATE, DECAY, CLIP, GAMMA = 3, 60, 31, 0.05, 0.01, 0.5, 1.0


def training_first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(epoch, step, loss, grad_norm) of a linear model's first steps."""
    rows = spectra(spark, sf_dir).select("vec_id", "y", "x").filter("y is not null")
    classes = [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]  # a row a class
    model, path = Model(lr=RATE, weight_decay=DECAY, gamma=GAMMA), folder(spark, "training")
    # An epoch of one batch each, so that every step has a row.
    trainer = Trainer(batch_size=SIZE, max_epochs=STEPS, min_epochs=STEPS, gradient_clip_val=CLIP)
    log = training.train(rows, rows.limit(0), "vec_id", CHANNELS, path, model, trainer, SEED, class_labels=classes, batches=1)
    return log.select("epoch", "step", F.round("train_loss", 6).alias("loss"), F.round("grad_norm", 6).alias("grad_norm"))


def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an epoch of a classifier with hidden units, on a seeded half of the
    spectra and validated on the other."""
    rows = spectra(spark, sf_dir).select("vec_id", "y", "x")
    parts = sampling.label_split(rows, "y", "vec_id", 0.5, SEED)
    train, held = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")
    trainer = Trainer(batch_size=250, max_epochs=4, min_epochs=2)
    return training.train(train, held, "vec_id", CHANNELS, folder(spark, "training"), Model(hidden=16, lr=0.01), trainer, SEED)


def array_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra written as a chunked store, and a range of pixels read back from
    the chunks that hold it."""
    path = folder(spark, "store")
    array_store.write_store(spectra(spark, sf_dir).select("image", "px", "x"), path, chunk=8)
    found = array_store.read_store(spark, path).filter("px >= 4 and px < 12")
    return found.select("image", "px", F.size("x").cast("long").alias("channels"), F.round(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v), 6).alias("total"))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial for each size, seed and arm, with its accuracy."""
    return trials(spark, sf_dir).groupBy("n", "seed", "arm").agg(F.avg(evaluate.hit()).alias("accuracy"), F.count(F.lit(1)).alias("pixels"))


def study_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials kept in a study file and read back, a column a parameter."""
    path = f"{folder(spark, 'study')}.db"
    study.write_study(_arms(spark, sf_dir).orderBy("n", "seed", "arm"), path, ["n", "seed", "arm"], ["accuracy", "pixels"])
    found = study.read_study(spark, path)
    return found.select("number", F.col("params_n").cast("long").alias("n"), F.col("params_seed").cast("long").alias("seed"), F.col("params_arm").cast("long").alias("arm"), F.round("value", 6).alias("accuracy"), F.col("value_1").cast("long").alias("pixels"))


def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight trials to run next, by those in the table."""
    space = {"n": ("log", 16.0, 1024.0), "seed": (0.0, 2.0), "arm": [0, 1]}
    rows = search.suggest(_arms(spark, sf_dir), space, "accuracy", 8, SEED)
    return spark.createDataFrame([(i, r["n"], r["seed"], r["arm"]) for i, r in enumerate(rows)], "place long, n double, seed double, arm long")


def named_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients whose ids are names, split so that none is on both sides."""
    rows = spectra(spark, sf_dir).select(F.concat(F.lit("patient-"), F.col("vec_id") % 23).alias("patient"), "vec_id")
    return sampling.patient_split(rows, "patient", 0.3, SEED).groupBy("patient", "part").agg(F.count(F.lit(1)).alias("n"))


def named_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 12 spectra of each class, even over images, by the seeded order of
    their names."""
    rows = spectra(spark, sf_dir).select("y", "image", F.concat(F.lit("s"), "vec_id").alias("name"))
    return sampling.water_fill(rows, "y", "image", "name", 12, SEED)


def principal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal variances and their running share, up to 0.95 of the total."""
    return complexity.cumulative_share(spectra(spark, sf_dir))


def _axes(rows: DataFrame) -> DataFrame:
    """An axis for each image: every third falls, and no two start alike."""
    places = rows.select("image").distinct().select("image", F.posexplode(F.array(*[F.lit(v) for v in AXIS])).alias("ch", "wn"))
    down = F.lit(AXIS[0] + AXIS[-1]) - F.col("wn")
    return places.withColumn("wn", F.when(F.col("image") % 3 == 0, down).otherwise(F.col("wn")) + 7.5 * F.col("image"))


#: Wavenumbers that all images are brought to, some beyond either end.
COMMON = [300.0 + 190.0 * k for k in range(20)]


def image_axes_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of images that differ in axis, brought to one of their own each."""
    rows = spectra(spark, sf_dir).select("image", "vec_id", "x")
    target = rows.select("image").distinct().select("image", F.posexplode(F.array(*[F.lit(v) for v in COMMON])).alias("ch", "wn"))
    target = target.withColumn("wn", F.col("wn") + F.col("image"))
    return values_of(axes.resample(rows, _axes(rows), target, "image"))


def window_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra cut to their image's windows, which overlap: channels kept, and
    the sum of what they hold."""
    rows = spectra(spark, sf_dir).select("image", "vec_id", "x")
    windows = rows.select("image").distinct().select("image", F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in WINDOWS])).alias("w"))
    windows = windows.select("image", (F.col("w.low") + 11.0 * F.col("image")).alias("low"), "w.high")
    found = axes.crop(rows, _axes(rows), windows, "image")
    return found.select("image", "vec_id", F.size("x").cast("long").alias("channels"), F.round(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v), 6).alias("total"))


#: Windows before they move with the image; the first two overlap.
WINDOWS = [(700.0, 1500.0), (1200.0, 1900.0), (2750.0, 3100.0)]


def clustered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions kept in sorted files, and a range of one image's pixels read
    from those that hold it."""
    rows = spectra(spark, sf_dir).select(F.lit("t1").alias("trial_id"), "image", "px", (F.col("y") % 3).alias("argmax"))
    path = folder(spark, "clustered")
    predictions.save_clustered(rows, rows.select("trial_id").distinct(), path, 64)
    return predictions.load_range(spark, path, "t1", 7, 3, 11).select("image", "px", "argmax")


def anova_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of accuracy's variance that each setting of the trials explains."""
    return scoring.functional_anova(_arms(spark, sf_dir), ["n", "seed", "arm"], "accuracy", folder(spark, "forest"))


def exponent_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the arms' exponents and its deviation."""
    return evaluate.exponent_difference(evaluate.learning_curve(trials(spark, sf_dir)))


def _by_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the table ``{spectra}``, with the SQL functions registered."""
    sql.register(spark)
    return spark.sql(text, spectra=spectra(spark, sf_dir))


def sql_snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(_by_sql(spark, sf_dir, "select vec_id, spectrum_snv(x) as x from {spectra}"))


def sql_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class of the softmax of differences, and its probability."""
    text = """select vec_id, spectrum_argmax(p) as best, round(array_max(p), 6) as prob, round(spectrum_mean(spectrum_unit(x)), 6) as mean
      from (select vec_id, x, spectrum_softmax(spectrum_differences(x)) as p from {spectra})"""
    return _by_sql(spark, sf_dir, text)


def sql_top_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sql(spark, sf_dir, "select vec_id, t.rank, t.ch, round(t.value, 6) as value from {spectra}, lateral top_channels(x, 4) t")


def sql_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sql(spark, sf_dir, "select vec_id, round(t.w0, 6) as w0, round(t.w1, 6) as w1, round(t.w2, 6) as w2 from {spectra}, lateral resampled(x, 2.5D, 70D, 3) t")


QUERIES = {f.__name__: f for f in (
    training_first_steps, training_history, array_store_range, study_file, search_suggestions, named_split, named_sample, principal_shares,
    image_axes_resampled, window_channels, clustered_range, anova_importance, exponent_differences, sql_snv, sql_softmax, sql_top_channels, sql_resampled,
)}


def _steps_sql() -> str:
    """The same steps as a chain of tables: probabilities, gradients and moments
    of each class and channel; channel -1 is the bias."""
    k, n = "(select count(*) from c)", "cast(n as double)"
    per, seed = f"({SIZE} // {k})", SEED
    extra = f"({SIZE} % {k})"
    parts = [
        "e as (select vec_id, cast(label as bigint) as y, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings where label is not null)",
        f"i as (select *, row_number() over (partition by y order by {order_key_sql('vec_id', seed)}, vec_id) - 1 as i from e)",
        "c as (select y, n, row_number() over (order by y) - 1 as k, cast(sum(n) over (order by y) - n as bigint) as start, cast(sum(n) over () as bigint) as total from (select y, count(*) as n from e group by y))",
        f"""d as (select b as batch, y, k * {per} + s as d, {order_key_sql(f"b * {per} + s + 1", seed)} % n as i from c, unnest(range(0, {STEPS})) as x(b), unnest(range(0, {per})) as z(s)
          union all select b, y, -1 - s, {order_key_sql(f"b * {extra} + s + 1", seed + 1)} % total - start from c, unnest(range(0, {STEPS})) as x(b), unnest(range(0, {extra})) as z(s)
          where {order_key_sql(f"b * {extra} + s + 1", seed + 1)} % total - start between 0 and n - 1)""",
        f"o as (select batch, d.y, d, row_number() over (partition by batch order by {place_key_sql('d', 'batch', seed + 2)}, d) as slot, x from d join i on i.y = d.y and i.i = d.i)",
        f"r as materialized (select batch, slot, y, unnest(range(-1, {CHANNELS})) as ch, unnest(list_prepend(cast(1 as double), x)) as v from o)",
        f"p0 as (select c.y as cls, ch, cast(0 as double) as w, cast(0 as double) as m, cast(0 as double) as v from c, unnest(range(-1, {CHANNELS})) as z(ch))",
    ]
    for s in range(STEPS):
        parts += [
            f"z{s} as (select slot, r.y, p.cls, sum(r.v * p.w) as z from r join p{s} p on p.ch = r.ch where batch = {s} group by slot, r.y, p.cls)",
            f"s{s} as (select slot, y, cls, exp(z - max(z) over (partition by slot)) / sum(exp(z - m)) over (partition by slot) as q from (select *, max(z) over (partition by slot) as m from z{s}))",
            f"t{s} as (select *, max(case when cls = y then q end) over (partition by slot) as own from s{s})",
            f"""h{s} as materialized (select slot, cls, y, own, -pow(1 - own, {GAMMA}) - {GAMMA} * pow(1 - own, {GAMMA} - 1) * own * -ln(own) as pull, q from t{s})""",
            f"n{s} as (select count(distinct slot) as n, sum(pow(1 - own, {GAMMA}) * -ln(own)) / count(*) as loss from h{s} where cls = y)",
            f"g{s} as materialized (select cls, r.ch, sum(pull * (case when cls = h.y then 1 else 0 end - q) * v) / (select n from n{s}) as g from h{s} h join r on r.slot = h.slot and r.batch = {s} group by cls, r.ch)",
            f"l{s} as (select {s} as epoch, {s + 1} as step, loss, (select sqrt(sum(g * g)) from g{s}) as norm from n{s})",
            f"""p{s + 1} as materialized (select cls, ch, w * (1 - cast({RATE * DECAY!r} as double)) - cast({RATE!r} as double) * (m / (1 - pow(cast(0.9 as double), {s + 1}))) / (sqrt(v / (1 - pow(cast(0.999 as double), {s + 1}))) + cast(1e-8 as double)) as w, m, v from (
              select p.cls, p.ch, w, cast(0.9 as double) * m + (1 - cast(0.9 as double)) * g as m, cast(0.999 as double) * v + (1 - cast(0.999 as double)) * g * g as v from p{s} p join (
                select cls, ch, g * least(cast(1 as double), cast({CLIP} as double) / (norm + cast(1e-6 as double))) as g from g{s}, l{s}) g on g.cls = p.cls and g.ch = p.ch))""",
        ]
    logs = " union all ".join(f"select cast(epoch as bigint) as epoch, cast(step as bigint) as step, round(loss, 6) as loss, round(norm, 6) as grad_norm from l{s}" for s in range(STEPS))
    return f"with {', '.join(parts)} {logs}"


_TRIALS = """t as (select cast(pow(2, 5 + event_id % 5) as bigint) as n, cast(user_id % 3 as bigint) as seed, cast(event_id % 2 as bigint) as arm,
  cast(floor(event_id / 3.0) as bigint) % 4 as gt, cast(event_id % 4 as bigint) as pred from events)"""
_NAMED = "concat('patient-', cast(vec_id % 23 as varchar))"

_AXES = f"""v as (select vec_id, vec_id % 25 as image, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings),
  b as (select unnest(range(0, {CHANNELS})) as ch, unnest([{", ".join(f"cast({w!r} as double)" for w in AXIS)}]) as wn),
  a as (select image, ch, case when image % 3 = 0 then cast({AXIS[0] + AXIS[-1]!r} as double) - wn else wn end + cast(7.5 as double) * image as wn from b, (select distinct image from v))"""

_SPECTRA = "e as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings)"

ORACLE_SQL = {
    "sql_snv": SPECTRAL_SQL["snv_embeddings"],
    "sql_softmax": f"""with {_SPECTRA}, d as (select vec_id, x, list_transform(range(1, {CHANNELS}), lambda i: x[i + 1] - x[i]) as d from e), p as (select *, list_transform(d, lambda v: exp(v - list_max(d))) as s from d)
      select vec_id, cast(list_position(d, list_max(d)) - 1 as bigint) as best, round(1 / list_sum(s), 6) as prob, round(list_avg(x) / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) as mean from p""",
    "sql_top_channels": f"""with {_SPECTRA}, l as (select vec_id, unnest(x) as v, unnest(range(0, {CHANNELS})) as ch from e), r as (select *, row_number() over (partition by vec_id order by v desc, ch) as rank from l)
      select vec_id, rank, ch, round(v, 6) as value from r where rank <= 4""",
    "sql_resampled": f"""with {_SPECTRA} select vec_id, round(x[3] + cast(0.5 as double) * (x[4] - x[3]), 6) as w0, round(x[37] + cast(0.25 as double) * (x[38] - x[37]), 6) as w1, round(x[{CHANNELS}], 6) as w2 from e""",
    "image_axes_resampled": f"""with {_AXES}, t as (select image, unnest(range(0, {len(COMMON)})) as ch, unnest([{", ".join(f"cast({w!r} as double)" for w in COMMON)}]) + image as wn from (select distinct image from v)),
      n as (select t.image, t.ch, t.wn, arg_max(a.ch, a.wn) filter (a.wn <= t.wn) as low, arg_min(a.ch, a.wn) filter (a.wn > t.wn) as high, max(a.wn) filter (a.wn <= t.wn) as wl, min(a.wn) filter (a.wn > t.wn) as wh from t join a on a.image = t.image group by all)
      select vec_id, cast(ch as bigint) as ch, round(case when low is null then x[high + 1] when high is null then x[low + 1] else x[low + 1] + (wn - wl) / (wh - wl) * (x[high + 1] - x[low + 1]) end, 6) + 0 as value from v join n on n.image = v.image""",
    "window_channels": f"""with {_AXES}, w as (select image, unnest([{", ".join(f"cast({p[0]!r} as double)" for p in WINDOWS)}]) + cast(11 as double) * image as low, unnest([{", ".join(f"cast({p[1]!r} as double)" for p in WINDOWS)}]) as high from (select distinct image from v)),
      k as (select * from a where exists (select 1 from w where w.image = a.image and a.wn between low and high))
      select v.image, vec_id, count(*) as channels, round(sum(x[ch + 1]), 6) as total from v join k on k.image = v.image group by v.image, vec_id""",
    "clustered_range": "select cast(vec_id % 25 as bigint) as image, cast(vec_id // 25 as bigint) as px, cast(label % 3 as bigint) as argmax from embeddings where vec_id % 25 = 7 and vec_id // 25 between 3 and 10",
    "training_first_steps": _steps_sql(),
    "array_store_range": f"""select cast(vec_id % 25 as varchar) as image, cast(vec_id // 25 as bigint) as px, cast({CHANNELS} as bigint) as channels,
      round(list_sum(list_transform(embedding, lambda v: cast(v as double))), 6) as total from embeddings where vec_id // 25 between 4 and 11""",
    "study_file": f"""with {_TRIALS} select row_number() over (order by n, seed, arm) - 1 as number, n, seed, arm, round(avg(case when pred = gt then cast(1 as double) else cast(0 as double) end), 6) as accuracy, count(*) as pixels
      from t group by n, seed, arm""",
    "named_split": f"""with p as (select {_NAMED} as patient, count(*) as n from embeddings group by 1),
      r as (select *, row_number() over (order by {order_key_sql(text_key_sql('patient'), SEED)}, patient) - 1 as i, count(*) over () as k from p)
      select patient, case when i < greatest(1, round_even(k * cast(0.3 as double), 0)) then 'test' else 'train' end as part, n from r""",
    "named_sample": f"""with e as (select cast(label as bigint) as y, cast(vec_id % 25 as bigint) as image, concat('s', cast(vec_id as varchar)) as name from embeddings),
      a as (select *, row_number() over (partition by y, image order by {order_key_sql(text_key_sql('name'), SEED)}, name) as r from e),
      b as (select *, row_number() over (partition by y order by r, {order_key_sql('image', SEED)}, image) as k from a where r <= 12)
      select y, image, name from b where k <= 12""",
}
