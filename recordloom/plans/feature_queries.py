"""Queries over member records, training rows and scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import embed_letters
from ..operators import features, model, prepare
from ..operators.pairs import self_pairs
from ..session import durable
from . import oracle, standins
from .matching import supervised_matching
from .registry import query


def keys(spark, sf_dir):
    return features.member_keys(standins.members(spark, sf_dir), embed_letters)


def compared(spark, sf_dir):
    return features.pair_features(keys(spark, sf_dir))


# -- keys and features -----------------------------------------------------------------


@query(
    f"WITH {oracle.MEMBER_KEYS} SELECT task_id, mcid, fn_ln_mi, fn_ln_mi_sprsd_vwl, gender, dob,"
    " response_final, CAST(list_sum(v) AS BIGINT) AS letters FROM embedded"
)
def member_keys(spark, sf_dir):
    letters = F.aggregate("fn_ln_mi_vector", F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))
    return keys(spark, sf_dir).withColumn("letters", letters).drop("fn_ln_mi_vector")


_MEASURES = ("fn_ln_mi_smlrty_score", "fn_ln_mi_jw", "fn_ln_mi_jd", "fn_ln_mi_sprs_vwl_jw")


@query(
    f"WITH {oracle.FEATURES} SELECT * REPLACE ("
    + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)
    + ", CAST(fn_ln_mi_ed AS INTEGER) AS fn_ln_mi_ed"
    ", CAST(fn_ln_mi_sprs_vwl_ed AS INTEGER) AS fn_ln_mi_sprs_vwl_ed) FROM features"
)
def pair_features(spark, sf_dir):
    return compared(spark, sf_dir).withColumns({m: F.round(m, 6) for m in _MEASURES})


_STATISTICS = {
    "avg": "avg({m})",
    "median": "median({m})",
    "max": "max({m})",
    "min": "min({m})",
    "stddev": "coalesce(stddev_samp({m}), 0)",
}


def _statistics_sql(metrics, statistics, name) -> str:
    return ", ".join(
        f"round(CAST({sql.format(m=m)} AS DOUBLE), 6) AS {name.format(s=s, m=m)}"
        for m in metrics
        for s, sql in statistics.items()
    )


@query(
    f"WITH {oracle.FEATURES},"
    f" stats AS (SELECT task_id, {_statistics_sql(features.PAIR_METRICS, _STATISTICS, '{s}_{m}')}"
    " FROM features GROUP BY task_id),"
    " resp AS (SELECT DISTINCT task_id, response_final FROM members)"
    " SELECT s.*, r.response_final FROM stats s JOIN resp r ON s.task_id = r.task_id"
)
def task_features(spark, sf_dir):
    table = features.task_features(compared(spark, sf_dir), standins.members(spark, sf_dir))
    numbers = model.feature_columns(table)
    return table.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in numbers})


_GRID_STATISTICS = {
    "mean": "avg({m})",
    "min": "min({m})",
    "max": "max({m})",
    "sd": "coalesce(stddev_samp({m}), 0)",
}


def _grid_sql() -> str:
    fields = ("first_name", "last_name", "fn_ln_mi")
    measured = []
    for name, (left, right) in features.GRID_PAIRS.items():
        a, b = f"a.{left}", f"b.{right}"
        measured += [
            f"{oracle.cosine(f'{a}_v', f'{b}_v')} AS {name}",
            f"{oracle.jaccard(a, b)} AS {name}_jd",
            f"{oracle.jaro_winkler(a, b)} AS {name}_jw",
        ]
    metrics = [f"{n}{m}" for n in features.GRID_PAIRS for m in ("", "_jd", "_jw")]
    return (
        f"WITH {oracle.MEMBERS}, named AS (SELECT DISTINCT task_id, mcid, first_name, last_name,"
        " first_name || last_name || middle_initial AS fn_ln_mi FROM members),"
        f" vectors AS MATERIALIZED (SELECT *, {', '.join(f'{oracle.letters(c)} AS {c}_v' for c in fields)}"
        " FROM named),"
        f" measured AS (SELECT a.task_id, {', '.join(measured)} FROM vectors a JOIN vectors b"
        " ON a.task_id = b.task_id AND a.mcid < b.mcid)"
        f" SELECT task_id, {_statistics_sql(metrics, _GRID_STATISTICS, '{m}_{s}')}"
        " FROM measured GROUP BY task_id"
    )


@query(_grid_sql())
def feature_grid(spark, sf_dir):
    grid = features.feature_grid(standins.members(spark, sf_dir), embed_letters)
    return grid.withColumns({c: F.round(c, 6) for c in grid.columns if c != "task_id"})


@query(f"WITH {oracle.MEMBERS} SELECT DISTINCT task_id, response_final FROM members")
def task_labels(spark, sf_dir):
    return features.task_labels(standins.members(spark, sf_dir))


@query(
    f"WITH {oracle.MEMBERS} SELECT task_id, count(DISTINCT response_final) AS labels,"
    " count(*) AS records FROM members GROUP BY task_id HAVING count(DISTINCT response_final) > 1"
)
def label_conflicts(spark, sf_dir):
    return features.label_conflicts(standins.members(spark, sf_dir))


@query(
    f"WITH {oracle.MEMBERS} SELECT a.mcid AS mcid_a, b.mcid AS mcid_b,"
    + ", ".join(
        f" CASE WHEN {p}(a.dob) = {p}(b.dob) THEN 1 ELSE 0 END AS {p}_match"
        for p in ("month", "year", "day")
    )
    + ", CAST(b.dob - a.dob AS INTEGER) AS days FROM members a"
    " JOIN members b ON a.task_id = b.task_id AND a.mcid < b.mcid"
)
def date_agreements(spark, sf_dir):
    rows = standins.members(spark, sf_dir).select("task_id", "mcid", "dob")
    return self_pairs(rows, ["task_id"], "mcid").select(
        F.col("a.mcid").alias("mcid_a"),
        F.col("b.mcid").alias("mcid_b"),
        *[
            text.date_part_agreement(p, "a.dob", "b.dob").alias(f"{p}_match")
            for p in ("month", "year", "day")
        ],
        text.days_between("a.dob", "b.dob").alias("days"),
    )


# -- preparation -----------------------------------------------------------------------


def _mode_sql(column: str) -> str:
    return (
        f"mode_{column} AS (SELECT user_id, {column} AS m FROM (SELECT user_id, {column},"
        f" row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {column}) AS place"
        f" FROM training WHERE {column} IS NOT NULL GROUP BY user_id, {column}) WHERE place = 1)"
    )


@query(
    f"WITH {oracle.TRAINING_ROWS}, {_mode_sql('event_type')}, {_mode_sql('tens')}"
    " SELECT t.event_id, t.user_id, coalesce(t.event_type, e.m) AS event_type,"
    " coalesce(t.tens, n.m) AS tens FROM training t LEFT JOIN mode_event_type e USING (user_id)"
    " LEFT JOIN mode_tens n USING (user_id) WHERE t.user_id IS NOT NULL"
)
def mode_filled(spark, sf_dir):
    return prepare.fill_with_mode(
        standins.training_rows(spark, sf_dir), "user_id", ["event_type", "tens"]
    )


@query(
    f"WITH {oracle.TRAINING_ROWS} SELECT CAST(count(DISTINCT event_type)"
    " + max(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_keys FROM training"
)
def distinct_keys(spark, sf_dir):
    return prepare.distinct_keys(standins.training_rows(spark, sf_dir), "event_type")


# -- the classifier --------------------------------------------------------------------


@query(
    f"WITH {oracle.FEATURES} SELECT DISTINCT m.task_id, m.response_final, 1.0::DOUBLE AS probabilities,"
    " true AS most_probable FROM members m JOIN features f ON f.task_id = m.task_id"
)
def predictions(spark, sf_dir):
    """Training and scoring; per row the probabilities sum to 1 and the class is the likelier."""
    table = task_table(spark, sf_dir)
    scored = model.unpack(model.predict(model.train(table), table))
    return scored.select(
        "task_id",
        "response_final",
        F.round(F.col("probability_false") + F.col("probability_true"), 6).alias("probabilities"),
        (F.col("class") == (F.col("probability_true") > F.col("probability_false"))).alias("most_probable"),
    )


def task_table(spark, sf_dir):
    members = standins.members(spark, sf_dir)
    return durable(features.task_features(compared(spark, sf_dir), members))


_RATE_NAMES = [f"{k}_{r}" for k in ("macro", "weighted") for r in ("precision", "recall", "f1")]
_HEX = (
    "list_reduce(list_transform(string_split(substr(md5('17|' || task_id), 1, 8), ''),"
    " lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b)"
)


@query(
    f"WITH {oracle.FEATURES}, held AS (SELECT DISTINCT m.task_id, m.response_final FROM members m"
    f" JOIN features f ON f.task_id = m.task_id WHERE {_HEX.replace('task_id', 'm.task_id')} % 1000 >= 800)"
    " SELECT response_final AS class, count(*) AS support, count(DISTINCT task_id) AS tasks,"
    " true AS recomputed FROM held GROUP BY response_final"
)
def holdout_evaluation(spark, sf_dir):
    """The tasks held out by class, and whether the reports follow from their predictions."""
    found = model.evaluation(model.train(task_table(spark, sf_dir)))
    found.scored.selectExpr(
        "task_id", "response_final AS label", "int(class) AS predicted", "probability_true AS p"
    ).createOrReplaceTempView("recordloom_holdout")
    again = spark.sql(
        """SELECT label AS class, count(*) AS rows, count(DISTINCT task_id) AS tasks,
          avg(int(predicted = label)) AS recall FROM recordloom_holdout GROUP BY label"""
    )
    overall = spark.sql(
        """SELECT avg(int(predicted = label)) AS plain_accuracy,
          avg(-ln(greatest(IF(label = 1, p, 1 - p), 1e-15))) AS plain_loss FROM recordloom_holdout"""
    )
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return (
        found.classes.withColumnsRenamed({"recall": "reported"})
        .join(again, "class")
        .withColumn("all", F.lit(1))
        .join(found.overall.withColumn("all", F.lit(1)).drop(*_RATE_NAMES), "all")  # one row
        .join(overall.withColumn("all", F.lit(1)), "all")
        .select(
            F.col("class").cast("long").alias("class"),
            "support",
            "tasks",
            (
                same("reported", "recall")
                & same("accuracy", "plain_accuracy")
                & same("log_loss", "plain_loss")
                & (F.col("rows") == F.col("support"))
            ).alias("recomputed"),
        )
    )


_ID_HEX = _HEX.replace("task_id", "p_partkey")


@query(
    f"""WITH training AS (SELECT count(*) AS rows FROM part WHERE {_ID_HEX} % 1000 < 800)
    SELECT 1 AS position, 'signal' AS feature, 1.0::DOUBLE AS score, rows FROM training
    UNION ALL SELECT 2, 'noise', 0.0, rows FROM training"""
)
def signal_importance(spark, sf_dir):
    """One feature tells the class and one does not: the first has all the importance."""
    parts = standins.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"),
        (F.col("p_size") % 2).cast("int").alias("response_final"),
        (F.col("p_size") % 2 * 10.0 + F.col("p_size") / 100).alias("signal"),
        F.lit(1.0).alias("noise"),
    )
    trained = model.train(parts, rounds=1)
    rows = model.split_by_key(parts)[0].count()
    return model.feature_importance(trained, spark).withColumns(
        {"score": F.round("score", 6), "rows": F.lit(rows).cast("long")}
    )


@query()
def feature_importance(spark, sf_dir):
    """Shares of the features in the trained model, first to last."""
    trained = model.train(task_table(spark, sf_dir))
    return model.feature_importance(trained, spark)


@query()
def supervised_predictions(spark, sf_dir):
    """The whole supervised plan with the n-gram embedder."""
    result = supervised_matching(standins.members(spark, sf_dir))
    return model.unpack(result.predictions).select(
        "task_id", "class", F.round("probability_true", 6).alias("probability_true")
    )


@query(
    f"WITH {oracle.SCORED_DOCUMENTS} SELECT doc_id, probability > 0.5 AS class,"
    " round(1 - probability, 6) AS probability_false, round(probability, 6) AS probability_true"
    " FROM scored"
)
def prediction_fields(spark, sf_dir):
    scored = standins.scored_documents(spark, sf_dir)
    objects = scored.select("doc_id", model.prediction_object(F.col("probability")).alias("prediction"))
    return model.unpack(objects).select(
        "doc_id", "class", *[F.round(f"probability_{c}", 6).alias(f"probability_{c}") for c in ("false", "true")]
    )


_CLASS_SQL = f"""WITH {oracle.SCORED_DOCUMENTS},
counts AS (
  SELECT c.class, sum(CASE WHEN label = class AND predicted = class THEN 1 ELSE 0 END) AS hits,
    sum(CASE WHEN predicted = class THEN 1 ELSE 0 END) AS guessed,
    sum(CASE WHEN label = class THEN 1 ELSE 0 END) AS support
  FROM scored, (VALUES (0), (1)) c(class) GROUP BY ALL),
rates AS (
  SELECT class, support, coalesce(hits / nullif(guessed, 0), 0.0) AS precision,
    coalesce(hits / nullif(support, 0), 0.0) AS recall FROM counts),
by_class AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM rates)"""


@query(
    f"{_CLASS_SQL} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM by_class"
)
def class_metrics(spark, sf_dir):
    table = model.class_metrics(standins.scored_documents(spark, sf_dir), "label", "predicted")
    return table.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_RATES = ("precision", "recall", "f1")


@query(
    f"{_CLASS_SQL},"
    " averages AS (SELECT "
    + ", ".join(f"avg({r}) AS macro_{r}, sum({r} * support) / sum(support) AS weighted_{r}" for r in _RATES)
    + " FROM by_class),"
    " overall AS (SELECT avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS accuracy,"
    "   avg(-CASE WHEN label = 1 THEN ln(greatest(probability, 1e-15::DOUBLE))"
    "        ELSE ln(1 - least(probability, 1 - 1e-15::DOUBLE)) END) AS log_loss FROM scored),"
    " ranked AS (SELECT label, rank() OVER (ORDER BY probability)"
    "   + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS place FROM scored),"
    " auc AS (SELECT (sum(CASE WHEN label = 1 THEN place END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)"
    "   / (sum(label) * sum(1 - label)) AS auc FROM ranked)"
    " SELECT "
    + ", ".join(
        f"round(CAST({c} AS DOUBLE), 6) AS {c}"
        for c in (*[f"{k}_{r}" for k in ("macro", "weighted") for r in _RATES], "accuracy", "log_loss", "auc")
    )
    + " FROM averages, overall, auc"
)
def global_metrics(spark, sf_dir):
    scored = standins.scored_documents(spark, sf_dir)
    table = model.global_metrics(scored, "label", "predicted", "probability")
    return table.select(*[F.round(c, 6).alias(c) for c in table.columns])


@query(
    f"WITH {oracle.SCORED_DOCUMENTS},"
    " levels AS (SELECT i / 10::DOUBLE AS threshold FROM range(11) t(i)),"
    " counts AS (SELECT threshold, sum(CASE WHEN probability >= threshold THEN label ELSE 0 END) AS tp,"
    "   sum(CASE WHEN probability >= threshold THEN 1 - label ELSE 0 END) AS fp,"
    "   sum(label) AS pos, sum(1 - label) AS neg FROM scored, levels GROUP BY threshold),"
    " rates AS (SELECT threshold, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,"
    "   coalesce(tp / nullif(pos, 0), 0.0) AS recall, coalesce(fp / nullif(neg, 0), 0.0) AS fpr FROM counts)"
    " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1,"
    " round(fpr, 6) AS false_positive_rate FROM rates"
)
def threshold_metrics(spark, sf_dir):
    scored = standins.scored_documents(spark, sf_dir)
    table = model.threshold_metrics(scored, "label", "probability")
    return table.select(
        "threshold", *[F.round(c, 6).alias(c) for c in table.columns if c != "threshold"]
    )


@query(
    f"WITH {oracle.SCORED_DOCUMENTS} SELECT label AS actual_class, predicted AS predicted_class,"
    " count(*) AS count FROM scored GROUP BY ALL"
)
def confusion_matrix(spark, sf_dir):
    return model.confusion_matrix(standins.scored_documents(spark, sf_dir), "label", "predicted")


@query(
    f"WITH {oracle.SCORED_DOCUMENTS} SELECT doc_id, CASE"
    " WHEN probability < 0.07 OR probability >= 0.95 THEN 'HIGH'"
    " WHEN probability >= 0.30 AND probability < 0.70 THEN 'LOW' ELSE 'MEDIUM' END AS band FROM scored"
)
def confidence_bands(spark, sf_dir):
    return standins.scored_documents(spark, sf_dir).select(
        "doc_id", model.confidence_band().alias("band")
    )
