"""Operators on workers that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver's alone: workers start in another folder
from pyspark.sql import functions as F
from recordloom.session import build_session

spark = build_session(2, shuffle_partitions=2, **{{"spark.checkpoint.dir": {shared!r}}})

def missing(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        gone = importlib.util.find_spec("recordloom") is None
        yield pa.RecordBatch.from_arrays([pa.array([gone])], ["gone"])

assert spark.range(1).mapInArrow(missing, "gone boolean").first().gone

import public_tokenizers
from recordloom.llm import (bpe, collocations, conversations, decontamination, html_extract,
    line_dedup, metric_join, minhash, repeats, toxicity, url_filters)

words = "one two three four five six seven eight nine ten eleven twelve"
docs = spark.createDataFrame([(i, f"{{words}} {{i % 3}}. bad" if i % 2 else words) for i in range(12)], "doc_id long, text string")
docs = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("x"))
labels = docs.selectExpr("doc_id", "doc_id % 2 AS toxic")
assert toxicity.scored(docs, labels).count() == 12
bench = spark.createDataFrame([(1, words)], "item_id long, text string")
assert decontamination.contaminated(docs, bench).count() > 0
assert minhash.near_duplicates(docs).count() == 12
assert metric_join.similar_documents(docs).count() == 12
assert collocations.collocations(docs, least=4).count() > 0
talk = spark.createDataFrame([(1, t, "user", f"{{t}}.") for t in range(9)], "conv_id long, turn long, role string, text string")
assert conversations.damage_and_repair(talk).count() == 1
assert repeats.without_repeats(docs).count() == 12
pages = spark.createDataFrame([(1, "http://a.b/c", "<html><body><p>" + words + "</p></body></html>")], "page_id long, url string, html string")
assert url_filters.judged(pages).count() == 1
assert html_extract.extracted(pages).count() == 1
assert bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).count() == 12
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    shared = tmp_path / "shared"
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO), shared=str(shared)))
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]
