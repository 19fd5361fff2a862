"""The pipeline's rows against plain Python on the smallest given tables."""

import re
from pathlib import Path

import pytest

from recordloom.llm import toxicity

from .test_operators import PATH, brute_copies, brute_near

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scored = toxicity.scored(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in scored.where("predicted = 0").collect()]
    stay = {c[1] for c in brute_copies(rows)}
    rows = [r for r in rows if r[0] in stay]
    stay = {r[0] for r in brute_near(rows, 5, 80) if r[3]}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = [r for r in rows if r[0] in stay and not any(x in plain(r[1]) for x in items)]
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want and len(want) < docs.count()
