"""Defined results for odd rows: NULLs, repeats, empty tables, clashing names, very long texts."""

import pytest
from pyspark.sql import functions as F

from recordloom.llm import (
    bpe,
    components,
    decontamination,
    exact_dedup,
    line_dedup,
    minhash,
    repeats,
    sharding,
    toxicity,
    url_filters,
)

from .test_operators import PATH, brute_near, brute_repeats

DOCS = "doc_id long, text string"


def clashing(df, *names):
    return df.withColumns({n: F.lit(n) for n in names})


def test_components_of_odd_links(spark):
    got = components.components(spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long"))
    assert got.count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(500, 560)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 300), 0), **dict.fromkeys(range(501, 561), 500)}


def test_near_duplicates_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)  # lists are cut into several tiles
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        own = list(base)
        own[k % 60] = f"x{k}"
        own[(7 * k + 3) % 60] = f"y{k % 9}"
        rows.append((k, " ".join(own)))
    long = " ".join(f"v{i}" for i in range(50_000))
    rows += [(100, long), (101, long + " end"), (102, "")]
    got = minhash.near_duplicates(clashing(spark.createDataFrame(rows, DOCS), "node", "token", "component", "lone"))
    assert sorted(map(tuple, got.collect())) == brute_near(rows)
    odd = [(None, "alone here now"), (None, rows[0][1]), (0, rows[0][1]), (7, "p q r s"), (7, "t u v w"), (8, None)]
    out = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(odd, DOCS)).collect()), key=repr)
    assert out == sorted(
        [(None, 1, None, True), (None, 58, 0, False), (0, 58, 0, True), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True)],
        key=repr,
    )


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "vile word" if i % 2 else "fine word") for i in range(40)]
    rows += [(None, None), (50, ""), (50, ""), (51, "vile " * 60_000)]
    docs = clashing(spark.createDataFrame(rows, DOCS), "score", "held_out", "predicted", "label_id")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels)
    assert got.count() == len(rows) and got.columns.count("score") == 1
    assert dict(got.dtypes)["score"] == "double" and got.where("score IS NULL").count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("score = 'score'").count() == kept.count()
    assert kept.where("text = 'vile word'").count() == 0 and kept.where("text = 'fine word'").count() == 20
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_codes_of_odd_rows(spark):
    tokenizers = pytest.importorskip("tokenizers")
    want = tokenizers.Tokenizer.from_file(PATH).encode("word " * 30_000, add_special_tokens=False).ids
    rows = [(1, "word " * 30_000), (1, "word " * 30_000), (None, "word " * 30_000), (2, None)]
    docs = clashing(spark.createDataFrame(rows, DOCS), "ids", "decoded", "text_key", "part_number", "code")
    got = bpe.encoded(docs, PATH)
    assert sorted(got.columns) == sorted(docs.columns)
    sizes = [len(r.ids) // 4 for r in got.where("text IS NOT NULL").collect()]
    assert sizes == [len(want)] * 3 and got.where("text IS NULL").first().decoded == ""


def test_lines_of_odd_rows(spark):
    for pages, dropped in ((2, 0), (3, 1), (49, 1), (50, 1)):  # judged alike on hosts of every size
        rows = [(i, f"menu\nown {i}") for i in range(pages)]
        docs = spark.createDataFrame(rows, DOCS).withColumn("source", F.lit("host"))
        got = line_dedup.without_common_lines(docs).collect()
        assert {r.n_dropped for r in got} == {dropped} and len(got) == pages
    rows = [(i % 3, "menu") for i in range(12)] + [(None, "menu"), (None, None), (9, "menu\n" + "x\n" * 100_000)]
    docs = clashing(spark.createDataFrame(rows, DOCS), "n_lines", "n_dropped", "host", "key", "salt")
    docs = docs.withColumn("source", F.lit("host"))
    got = line_dedup.without_common_lines(docs)
    assert got.count() == len(rows) and dict(got.dtypes)["n_lines"] == "bigint"
    assert got.where("contains(text, 'menu')").count() == 0
    assert line_dedup.without_common_lines(docs.limit(0)).count() == 0


def test_passages_of_odd_rows(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    items = [(1, passage), (1, passage), (None, passage), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(100_000))
    rows = [(1, passage), (1, passage), (None, passage), (3, filler + " " + passage), (4, filler), (5, None)]
    docs = clashing(spark.createDataFrame(rows, DOCS), "item_id", "similarity", "own_key")
    got = decontamination.contaminated(docs, bench)
    assert {r.doc_id for r in got.collect()} == {1, None, 3}
    left = decontamination.without_contaminated(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5] and left.columns == docs.columns
    dated = bench.where("item_id = 1").selectExpr("date'2024-01-01' AS doc_id", "text").distinct()
    same = decontamination.contaminated(docs, dated, item_column="doc_id")
    assert {(r.doc_id, str(r.item_doc_id)) for r in same.collect()} == {(d, "2024-01-01") for d in (1, None, 3)}


def test_repeats_across_blocks(spark, monkeypatch):
    """Texts longer than a block of the scan, with passages that lie across its ends."""
    monkeypatch.setattr(repeats, "BLOCK", 4096)
    import random

    rng = random.Random(3)
    made = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = made(9_000)
    rows = [(1, made(4_000) + shared), (2, made(300) + shared[200:] + made(5_000)), (2, shared[:70]), (None, shared[:100])]
    docs = clashing(spark.createDataFrame(rows, DOCS), "spans", "kept", "n_bytes")
    got = repeats.without_repeats(docs).collect()
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=repr)
    assert have == brute_repeats(rows, 50)


def test_urls_and_shards_of_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a.net/es/x"), (1, "http://a.net/es/x"), (None, None), (2, "x" * 100_000), (3, "http://" + "y/" * 50_000)],
        "page_id long, url string",
    )
    pages = clashing(pages, "host", "path", "rule", "verdict", "token")
    got = url_filters.judged(pages).collect()
    assert len(got) == 5 and [r.verdict for r in got if r.page_id == 1] == ["block"] * 2
    assert url_filters.judged(pages.limit(0)).count() == 0
    docs = spark.createDataFrame([(i % 7 or None, "t") for i in range(50)], DOCS)
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.with_shards(docs), path)
    back = spark.read.parquet(path)
    assert back.count() == 50 and back.select("doc_id", "shard").distinct().groupBy("doc_id").count().where("count > 1").count() == 0


def test_copies_of_long_texts(spark):
    long = "é " * 200_000
    docs = spark.createDataFrame([(2, long), (1, "é" * 200_000), (3, long + "x")], DOCS)
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_copies(docs).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_unsplit_text_is_joined_in_rounds(spark, monkeypatch):
    """Texts without white space, of several parts and rounds, as the library encodes them."""
    import random
    import struct

    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "SHORT", 24)
    monkeypatch.setattr(bpe, "FAN", 3)
    library = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(9)
    kinds = ["abcdefghijklmnop", "漢字仮名交じり文", "aB9+/=", "éà'sn't!?", "x'", "　é漢1", "<|endoftext|>a"]
    rows = [(i, "".join(rng.choices(kinds[i % 7], k=rng.choice([40, 700, 3000])))) for i in range(40)]
    rows += [(100, "the" * 900), (101, "word " + "unsplit" * 300 + " end"), (102, "a" * 2000), (103, "'" * 500 + "s")]
    got = bpe.encoded(spark.createDataFrame(rows, DOCS), PATH, part=50, leaf=16)
    have = {r.doc_id: (bytes(r.ids), r.decoded) for r in got.collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert have[i] == (struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)), t[:40]
