"""Corpus operators against plain Python, on small tables with NULLs, ties and repeats."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from recordloom.llm import (
    bpe,
    components,
    decontamination,
    exact_dedup,
    html_extract,
    line_dedup,
    minhash,
    repeats,
    sharding,
    toxicity,
    url_filters,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
WHITE = re.compile(r"[\x20\x09-\x0D]")
DOCS = "doc_id long, text string"


def docs_of(spark, rows):
    """A table with columns whose names clash with those of operators."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({n: F.lit(n) for n in ("lang", "source", "node", "kept", "shard", "place")})


def odd_rows():
    return [(None, "null id"), (1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (5, "é " * 4000)]


# --- sharding


def turns(names, size):
    """The table, one claim at a time."""
    owner, orders = {}, []
    for name in names:
        start, step = sharding.preference(name, size)
        orders.append([(start + k * step) % size for k in range(size)])
    turn = 0
    while len(owner) < size:
        shard = turn % len(names)
        owner[next(s for s in orders[shard] if s not in owner)] = shard
        turn += 1
    return tuple(owner[s] for s in range(size))


def test_shards_take_turns():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 211)
    assert table == turns(names, 211)
    counts = [table.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 211 // 4
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 210)


def test_sharding_of_odd_rows(spark):
    got = sharding.with_shards(docs_of(spark, odd_rows())).collect()
    assert len(got) == 7 and all(r.shard.startswith("shard-") for r in got)
    assert len({r.shard for r in got if r.doc_id == 4}) == 1
    assert sharding.with_shards(docs_of(spark, [])).count() == 0


# --- exact dedup


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((i, len(t or "")))
    keep = {b: min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0)) for b, g in groups.items()}
    out = []
    for i, t in rows:
        body = WHITE.sub("", t or "")
        out.append((i, keep[body][0], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda c: F.length(c).cast("string")])
def test_exact_copies(spark, hashed):
    rows = [*odd_rows(), (9, "a b"), (8, "ab"), (7, "a  b"), (6, "a  b"), (10, "ba"), (None, "ab")]
    got = exact_dedup.exact_copies(docs_of(spark, rows), hashed=hashed)
    cells = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=repr)
    assert cells == sorted(brute_copies(rows), key=repr)
    assert sorted(r.doc_id for r in got.where("kept AND doc_id IS NOT NULL").collect()) == [3, 4, 5, 6, 10]
    left = exact_dedup.without_copies(docs_of(spark, rows), hashed=hashed)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 3, 4, 5, 6, 10]
    assert left.columns == docs_of(spark, []).columns
    assert exact_dedup.exact_copies(docs_of(spark, [])).count() == 0


# --- lines


def test_common_lines(spark):
    rows = [(i, f"menu\nown {i}\n\nmenu ") for i in range(60)] + [(99, None), (98, "menu")]
    df = docs_of(spark, rows).withColumn("source", F.when(F.col("doc_id") < 90, "big").otherwise("small"))
    df = df.unionByName(df.where("doc_id = 1").withColumn("source", F.lit(None)))
    got = {(r.doc_id, r.source): r for r in line_dedup.without_common_lines(df, min_pages=50).collect()}
    assert got[1, "big"].text == "own 1\n" and got[1, "big"].n_dropped == 2
    assert got[1, None].n_dropped == 0 and got[98, "small"].text == "menu"
    assert (got[99, "small"].text, got[99, "small"].n_lines) == ("", 1)


# --- near duplicates


def brute_near(rows, width=3, similarity=85):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        runs = [tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        sets.append(frozenset(runs))
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if x and y and 100 * len(x & y) >= similarity * len(x | y):
                    low = min(label[rows[a][0]], label[rows[b][0]])
                    label[rows[a][0]] = label[rows[b][0]] = low
        if all(label[v] == v for v in label.values()):
            break
    return sorted((i, len(s), label[i], label[i] == i) for (i, _), s in zip(rows, sets, strict=True))


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(0, ""), (1, None), (2, "One"), (3, "one"), (4, "two words")]
    for _ in range(3):
        base = rng.choices(words, k=rng.choice([5, 60, 120]))
        for _ in range(25):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    got = minhash.near_duplicates(docs_of(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_near(rows)
    if seed == 1:
        left = minhash.one_of_each(docs_of(spark, [*rows, (None, "one")]))
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [
            r[0] for r in brute_near(rows) if r[3]
        ]
        assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 50), (60, 61)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(2, 21), 1), 61: 60}


# --- toxicity


def test_toxicity_learns(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bdfgklm" for b in "aeiou"]
    rows = []
    for i in range(400):
        text = rng.choices(words, k=rng.randint(3, 60))
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["vile" + w for w in words[:6]])
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(3, None)], "doc_id long, toxic int")
    docs = docs_of(spark, [*rows, (None, None), (1000, "")])
    got = toxicity.scored(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 402
    none = toxicity.scored(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.0}


# --- BPE


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(2)
    parts = ["the", "ing", "A", "é", "é", "'s", "!", "1", " ", "　", "漢", "<|endoftext|>", "\n"]
    rows = [*odd_rows(), *((i, "".join(rng.choices(parts, k=rng.choice([3, 50, 600])))) for i in range(10, 30))]
    rows.append((40, "".join(rng.choices("abt", k=900))))
    got = bpe.encoded(docs_of(spark, rows), PATH, part=100, leaf=16)
    have = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got.collect()), key=repr)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert have == sorted(want, key=repr)
    assert bpe.encoded(docs_of(spark, []), PATH).count() == 0


# --- decontamination


def test_benchmark_passages(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(n)) for k, n in enumerate([3, 5, 8, 15, 30, 45, 59])] + [(90, None), (91, "")]
    rows = [*odd_rows()]
    for k, item in items[:7]:
        rows.append((100 + k, f"{text(37)} {item.upper()}, {text(11)}"))
    one = items[6][1].split()
    one[30] = "zzz"
    rows += [(200, text(20) + " " + " ".join(one)), (201, text(400)), (100, rows[-1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs_of(spark, rows), bench)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(100 + k, k) for k in range(7)} | {(200, 6)} <= found
    assert not any(d in (201, 1, 2, 3, 5, None) for d, _ in found)
    small = decontamination.contaminated(docs_of(spark, rows), bench, max_words=20)
    assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    left = decontamination.without_contaminated(docs_of(spark, rows), bench)
    assert 201 in {r.doc_id for r in left.collect()} and left.where("doc_id = 200").count() == 0
    assert decontamination.contaminated(docs_of(spark, rows), bench.where("false")).count() == 0


def brute_passages(rows, items, width=5, least=0.8):
    """Best similarity of all windows of an item's size, also those cut at a text's ends."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def weights(w):
        return Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)) if w)

    out = {}
    for d, t in rows:
        words = split(t)
        for i, item in items:
            own = split(item)
            want = weights(own)
            for at in range(1 - len(own), len(words)):
                have = weights(words[max(0, at) : at + len(own)])
                got = (have & want).total() / (have | want).total()
                if got >= least and got > out.get((d, i), (0.0, 0))[0]:
                    out[d, i] = (got, max(0, at))
    return sorted((d, i, place, round(got, 9)) for (d, i), (got, place) in out.items())


def test_every_window_of_an_item_is_compared(spark):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    pick = lambda n: rng.choices(words, k=n)
    items = [(k, pick(n)) for k, n in enumerate([2, 4, 5, 7, 30, 60, 100, 200])]
    items += [(20, pick(3) * 20), (21, items[6][1][:40] + pick(60))]
    rows = []
    for _, item in items:
        n = len(item)
        halves = item[n // 2 :] + item[: n // 2]
        thirds = item[2 * n // 3 :] + item[n // 3 : 2 * n // 3] + item[: n // 3]
        cut, changed = item[n // 12 :], list(item)
        for _ in range(n // 50):
            changed[rng.randrange(n)] = "zzz"
        for text in (halves, thirds, cut, changed, changed + pick(3) + halves):
            rows.append((len(rows), " ".join(pick(rng.randrange(40)) + text + pick(rng.randrange(40)))))
            rows.append((len(rows), " ".join(text)))
    items = [(k, " ".join(x)) for k, x in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs_of(spark, rows), bench).collect()
    have = sorted((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got)
    assert have == brute_passages(rows, items)
    swapped = {rows[10 * k][0] for k in (6, 7)}  # halves of the items of 100 and 200 words
    assert swapped <= {d for d, _, _, _ in have}


# --- repeated passages


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else ():
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((i, len(b), sum(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("letters, length, anchor", [("ab", 6, 2), ("abcdefghé ", 50, 24)])
def test_repeated_passages(spark, letters, length, anchor):
    rng = random.Random(length)
    base = ["".join(rng.choices(letters, k=200)) for _ in range(4)]
    rows = [*odd_rows(), (6, "a" * 150), (7, "a" * 120 + "b")]
    for _ in range(50):
        cut = rng.randrange(100)
        own = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        rows.append((rng.randint(8, 60), own + rng.choice(base)[cut : cut + rng.randint(0, 120)] + own))
    got = repeats.without_repeats(
        docs_of(spark, rows), length=length, anchor=anchor, shard_bytes=2000, bucket_bytes=1500
    ).collect()
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=repr)
    assert have == brute_repeats(rows, length)
    assert repeats.without_repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("shard_crowd, crowd", [(2, 10_000), (10_000, 3), (4, 8)])
def test_a_phrase_with_many_surroundings_is_dealt(spark, shard_crowd, crowd):
    rng = random.Random(crowd)
    own = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    phrase, again = own(30), [own(60) for _ in range(6)]
    rows = [*odd_rows()]
    for _ in range(120):
        near = rng.choice(again)
        rows.append((rng.randint(8, 90), own(40) + phrase + rng.choice([near, own(50)])))
        rows.append((rng.randint(8, 90), near + phrase + near))
    got = repeats.without_repeats(
        docs_of(spark, rows), shard_bytes=4000, bucket_bytes=1500,
        shard_crowd=shard_crowd, crowd=crowd,
    ).collect()
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=repr)
    assert have == brute_repeats(rows, 50)


def test_a_crowd_of_runs_is_one_entry_and_its_parts_are_bounded():
    rng = random.Random(5)
    own = lambda: "".join(rng.choices("abcdefgh", k=40))
    phrase, how = "the same phrase in every document of all", ("doc_id", "text", 50, 24, 64, 4096)
    ids = list(range(1000))
    texts = [own() + phrase + own() for _ in ids]
    table = pa.table({"doc_id": ids, "text": texts, "shard": [0] * len(ids)})
    two = table.set_column(0, "doc_id", pa.array([i + 1000 for i in ids])).set_column(
        2, "shard", pa.array([1] * len(ids))
    )
    asked = pa.concat_tables([repeats._ask(t, 1, how) for t in (table, two)])
    flags = repeats._flag(asked)
    seen = pa.concat_tables(
        [repeats._see(t, flags.filter(pc.equal(flags["shard"], k)), 1, how) for k, t in enumerate((table, two))]
    )
    told = repeats._tell(seen, how, 500)
    first = told.filter(pc.equal(told["shard"], 0))
    pieces = repeats._deal(table, first, 1, how)
    sizes = [len(x) // 8 for x in pieces["hashes"].to_pylist()]
    assert sum(sizes) > 10_000 and max(sizes) < 500
    listed = repeats.Seen(seen, how)
    assert np.bincount(np.unique(listed.key, return_inverse=True)[1]).max() <= 2 * 64


# --- urls and pages


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.net/es/", "http://net/fr/",
            "https://m.casino-win.example.org/x", "https://xcasino-win.org/", "http://example.org?q=/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filters.judged(pages).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == (
        "www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert [got[i].verdict for i in range(9)] == [
        "allow", "allow", "allow", "allow", "block", "block", "block", "allow", "allow"]
    assert (got[8].host, got[8].path) == ("example.org", "")
    assert url_filters.judged(pages.where("false")).count() == 0


def test_main_text(spark):
    page = (
        "<html><head><title>no</title></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;four."
        "<div class=ad>Buy now</div><script>x='</p>'</script><p>Five.</p></article><aside>Related</aside>"
        "<section id=comments><p>First! I was here before all of you.</p></section><footer>&copy; me</footer>"
    )
    assert html_extract.main_text(page) == "A & B\n\nOne two.\n\nThree four.\n\nFive."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    pages = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (2, None, "t")], "page_id long, html string, text string")
    assert [len(r.text) for r in html_extract.extracted(pages).collect()] == [35, 0, 0]


def test_minimum_cut_is_least():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        score = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side, score=score, edges=edges):
            own = sum(abs(s) for s, c in zip(score, side, strict=True) if (s > 0) != c)
            return own + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.minimum_cut(score, edges)) == pytest.approx(best)
