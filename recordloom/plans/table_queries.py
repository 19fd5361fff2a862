"""Queries over tables: ids, columns, filters, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..functions import text
from ..functions.vectors import embed_letters
from ..operators.prepare import fill_with_mode
from ..schemas import INPUT_RECORDS, RECORD_VECTORS
from ..session import shared_folder
from ..sources import readers, writers
from . import oracle, standins
from .feature_queries import compared
from .matching import ORIGINAL_COLUMNS
from .registry import query


def written(spark, sf_dir, name, write):
    """Let ``write`` fill a table of its own in the shared folder, and read it back."""
    table = f"recordloom_{name}_{uuid.uuid4().hex[:8]}"
    write(table, f"{shared_folder(spark)}/{table}")
    return spark.table(table)


_RECORD_COLUMNS = "id, firstname, lastname, address, dob, gender, country, task_id"


@query(
    f"WITH {oracle.RECORDS} SELECT row_number() OVER (ORDER BY lastname, firstname, id) AS id,"
    " id AS source_id, firstname, lastname FROM records"
)
def generated_ids(spark, sf_dir):
    rows = standins.records(spark, sf_dir).select("id", "firstname", "lastname")
    return writers.with_dense_id(rows, "lastname", "firstname", "id").select(
        "id", "source_id", "firstname", "lastname"
    )


@query(f"WITH {oracle.RECORDS} SELECT id + 1 AS id, id AS source_id, lastname FROM records")
def uploaded(spark, sf_dir):
    """Written with generated ids, replacing the table, then scanned."""
    rows = standins.records(spark, sf_dir)

    def write(table, path):
        writers.upload(rows, table, "id", path=path)
        writers.upload(rows, table, "id", path=path)

    return written(spark, sf_dir, "uploaded", write).select("id", "source_id", "lastname")


@query(f"WITH {oracle.RECORDS} SELECT {_RECORD_COLUMNS} FROM records UNION ALL SELECT {_RECORD_COLUMNS} FROM records")
def appended(spark, sf_dir):
    """A typed empty table, filled by an insert by name and an insert by position."""
    rows = standins.records(spark, sf_dir)
    typed = T.StructType([f for f in INPUT_RECORDS if f.name not in RECORD_VECTORS.values()])

    def write(table, path):
        writers.create_table(spark, table, typed, path=path)
        writers.append(rows, table)
        writers.insert_select(rows.select(*typed.names), table)

    return written(spark, sf_dir, "appended", write)


@query(f"WITH {oracle.RECORDS} SELECT id, 26 AS size, lastname FROM records")
def embedded_columns(spark, sf_dir):
    """Missing vector columns added, then set for all rows, and the table written."""
    kinds = {f.name: f.dataType for f in INPUT_RECORDS if f.name in RECORD_VECTORS.values()}
    rows = writers.add_missing_columns(standins.records(spark, sf_dir), kinds)
    rows = writers.embed_columns(writers.add_missing_columns(rows, kinds), embed_letters)
    table = written(spark, sf_dir, "embedded", lambda t, path: writers.overwrite(rows, t, path=path))
    return table.select("id", F.size("lastname_vector").alias("size"), "lastname")


@query(
    f"""WITH {oracle.VECTORS} SELECT id, lastname, CAST(list_sum(lv) AS BIGINT) AS letters,
    array_to_string(list_transform(lv, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS counts FROM vectors"""
)
def embedded_in_place(spark, sf_dir):
    """A table's vector columns set from its own rows, the table read and replaced."""
    kinds = {f.name: f.dataType for f in INPUT_RECORDS if f.name in RECORD_VECTORS.values()}
    rows = writers.add_missing_columns(standins.records(spark, sf_dir), kinds)

    def write(table, path):
        writers.overwrite(rows, table, path=path)
        writers.embed_table(spark, table, embed_letters)

    whole = F.transform("lastname_vector", lambda x: x.cast("bigint"))
    return written(spark, sf_dir, "in_place", write).select(
        "id",
        "lastname",
        F.aggregate(whole, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("letters"),
        F.array_join(whole.cast("array<string>"), ",").alias("counts"),
    )


@query(f"WITH {oracle.RECORDS} SELECT id, task_id, firstname, lastname, dob, gender, country FROM records")
def original_columns(spark, sf_dir):
    writers.create_view(standins.records(spark, sf_dir), "recordloom_records")
    return readers.read_table_columns(spark, "recordloom_records", ORIGINAL_COLUMNS)


@query(f"WITH {oracle.RECORDS} SELECT id, lastname, firstname FROM records ORDER BY id LIMIT 5")
def preview(spark, sf_dir):
    return readers.preview(standins.records(spark, sf_dir).select("id", "lastname", "firstname"), "id")


@query(f"WITH {oracle.RECORDS} SELECT id, firstname, lastname, address, dob FROM records")
def renamed_columns(spark, sf_dir):
    """Columns under other names, brought back by the synonym map."""
    rows = standins.records(spark, sf_dir).select(
        F.col("id").alias("ORDER_ID"),
        F.col("firstname").alias("First Name"),
        F.col("lastname").alias("surname"),
        F.col("address").alias("city"),
        F.col("dob").alias("Birthdate"),
    )
    return readers.rename_synonyms(rows)


@query(f"WITH {oracle.RECORDS} SELECT DISTINCT task_id FROM records")
def task_list(spark, sf_dir):
    return standins.records(spark, sf_dir).select("task_id").distinct()


@query(f"WITH {oracle.RECORDS} SELECT {_RECORD_COLUMNS} FROM records WHERE task_id = 7")
def one_task(spark, sf_dir):
    return standins.records(spark, sf_dir).filter("task_id = 7")


@query(
    f"WITH {oracle.MEMBERS} SELECT * FROM members WHERE task_id IN ('3', '14', '15') ORDER BY task_id, mcid"
)
def chosen_tasks(spark, sf_dir):
    members = standins.members(spark, sf_dir)
    return members.filter(F.col("task_id").isin("3", "14", "15")).orderBy("task_id", "mcid")


@query(
    f"WITH {oracle.FEATURES} SELECT task_id, round(avg(fn_ln_mi_jw), 6) AS avg_fn_ln_mi_jw,"
    " count(*) AS pairs FROM features GROUP BY task_id ORDER BY task_id LIMIT 10"
)
def unlabelled_preview(spark, sf_dir):
    """Ten rows of the feature table without its label, as a view."""
    table = compared(spark, sf_dir).groupBy("task_id").agg(
        F.round(F.avg("fn_ln_mi_jw"), 6).alias("avg_fn_ln_mi_jw"),
        F.count("*").alias("pairs"),
        F.lit(0).alias("response_final"),
    )
    writers.create_view(table.drop("response_final").orderBy("task_id").limit(10), "recordloom_test")
    return spark.sql("SELECT * FROM recordloom_test")


@query(
    f"WITH {oracle.RECORDS} SELECT id, task_id AS object_task, lastname AS object_lastname,"
    " dob IS NOT NULL AS has_dob FROM records"
)
def row_objects(spark, sf_dir):
    """Every row as one object; fields of an object are reached by path."""
    rows = standins.records(spark, sf_dir)
    objects = rows.select("id", F.struct("*").alias("o"), F.to_json(F.struct("*")).alias("j"))
    return objects.select(
        "id",
        F.col("o.task_id").alias("object_task"),
        F.get_json_object("j", "$.lastname").alias("object_lastname"),
        F.get_json_object("j", "$.dob").isNotNull().alias("has_dob"),
    )


@query(
    "SELECT event_id, CAST(ts AS DATE) AS day FROM events"
    " WHERE DATE '2024-03-31' - CAST(ts AS DATE) BETWEEN 0 AND 89"
)
def recent_rows(spark, sf_dir):
    events = standins.table(spark, sf_dir, "events")
    recent = events.filter(text.is_recent("ts", F.lit("2024-03-31").cast("date")))
    return recent.select("event_id", F.col("ts").cast("date").alias("day"))


@query(
    f"WITH {oracle.TRAINING_ROWS} SELECT user_id, count(*) AS rows FROM training"
    " WHERE user_id IS NOT NULL GROUP BY user_id"
)
def imputed_table(spark, sf_dir):
    """Training rows with gaps filled, written over the table and counted per key."""
    rows = fill_with_mode(standins.training_rows(spark, sf_dir), "user_id", ["event_type", "tens"])
    table = written(spark, sf_dir, "imputed", lambda t, path: writers.overwrite(rows, t, path=path))
    return table.groupBy("user_id").agg(F.count("*").alias("rows"))



def _as_file(df, separator):
    """``df`` written as delimited files with headers, in the shared folder: their path."""
    path = f"{shared_folder(df.sparkSession)}/recordloom_file_{uuid.uuid4().hex[:8]}"
    writer = df.write.options(header=True, sep=separator, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False)
    writer.options(ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scanned_csv(spark, sf_dir):
    """Texts with quotes, separators and line breaks, written as files and scanned in splits."""
    rows = standins.table(spark, sf_dir, "documents")
    return readers.read_delimited(spark, _as_file(rows, ","), rows.schema, on_bad="raise")


@query(
    "SELECT o_orderkey AS task_id, CAST(o_totalprice AS DOUBLE) AS probability, o_orderpriority AS"
    " confidence_score, 0 AS bad FROM orders"
)
def scanned_scores(spark, sf_dir):
    """Scores in files with bars between values; what does not fit is counted."""
    rows = standins.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("Confidence_Score"),
        F.col("o_orderkey").alias("TASK_ID"),
        F.col("o_totalprice").cast("double").alias("PROBABILITY"),
    )
    wanted = T.StructType(
        [
            T.StructField("task_id", rows.schema["TASK_ID"].dataType),
            T.StructField("probability", T.DoubleType()),
            T.StructField("confidence_score", T.StringType()),
        ]
    )
    got = readers.read_delimited(spark, _as_file(rows, "|"), wanted, "|", on_bad="column")
    return got.withColumn("bad", F.size("bad_values")).drop("bad_values")
