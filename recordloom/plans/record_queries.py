"""Queries over person records: pairs, labels, groups, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, vectors
from ..functions.vectors import embed_letters
from ..operators import candidates, groups, pairs, rules, search, tiles
from ..schemas import RECORD_VECTORS
from . import oracle, standins
from .matching import match_and_group, name_similarity
from .registry import query

SCORES_SQL = ", ".join(f"round({s}, 6) AS {s}" for s in rules.SCORES)


def rounded(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


def labelled(spark, sf_dir) -> DataFrame:
    return rules.match_pairs(standins.embedded_records(spark, sf_dir))


# -- pair relations --------------------------------------------------------------------


@query(f"WITH {oracle.PAIRS} SELECT match_type, count(*) AS pairs FROM pairs GROUP BY ALL")
def match_type_counts(spark, sf_dir):
    return candidates.match_type_counts(standins.records(spark, sf_dir), embed_letters)


@query(
    f"WITH {oracle.RECORDS} SELECT a.task_id, a.id AS id_a, b.id AS id_b"
    " FROM records a JOIN records b ON a.task_id = b.task_id AND a.id < b.id"
)
def block_pairs(spark, sf_dir):
    return pairs.self_pairs(standins.records(spark, sf_dir).select("task_id", "id")).select(
        "a.task_id", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")
    )


@query(
    f"WITH {oracle.PAIRS} SELECT task_id, id_a, id_b, dob_a, dob_b, gender_a, gender_b,"
    " firstname_a, firstname_b, lastname_a, lastname_b, first_record AS \"First Record\","
    f" second_record AS \"Second Record\", match_type AS \"Match Type\", {SCORES_SQL} FROM pairs"
)
def match_pairs(spark, sf_dir):
    return rules.with_display_names(labelled(spark, sf_dir)).withColumns(rounded(*rules.SCORES))


@query(
    f"WITH {oracle.PAIRS} SELECT task_id, id_a, id_b, match_type, {SCORES_SQL}"
    " FROM pairs WHERE match_type <> 'No Match'"
)
def matched_pairs(spark, sf_dir):
    found = candidates.matched_pairs(standins.embedded_records(spark, sf_dir))
    return found.select("task_id", "id_a", "id_b", "match_type", *rules.SCORES).withColumns(
        rounded(*rules.SCORES)
    )


@query(
    f"WITH {oracle.scored()} SELECT id_a, id_b, "
    + ", ".join(f"coalesce({t}, false) AS {n}" for n, t in oracle.TESTS.items())
    + " FROM scored"
)
def rule_tests(spark, sf_dir):
    scored = rules.scored_pairs(standins.embedded_records(spark, sf_dir), with_text=False)
    tests = dict(zip(oracle.TESTS, rules.rule_tests().values()))
    return scored.select(
        "id_a", "id_b", *[F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()]
    )


@query(
    f"WITH {oracle.pairs('')} SELECT match_type, count(*) AS pairs FROM pairs GROUP BY ALL"
)
def unblocked_match_counts(spark, sf_dir):
    """Labels of all n(n-1)/2 pairs, counted without forming them."""
    return candidates.match_type_counts(standins.records(spark, sf_dir), embed_letters, block=())


_FULL = (
    "list_transform(range(1, 27), lambda i: fv[i] / fnorm + lv[i] / lnorm + av[i] / anorm)"
)


@query(
    f"""WITH {oracle.VECTORS},
    summed AS (SELECT firstname, {_FULL} AS v FROM normed),
    unit AS MATERIALIZED (
      SELECT firstname, v, {oracle.norm('v')} AS n, count(*) AS copies FROM summed GROUP BY ALL),
    compared AS (
      SELECT a.firstname AS first_record, b.firstname AS second_record,
        list_dot_product(a.v, b.v) / (a.n * b.n) AS score, a.copies * b.copies AS pairs
      FROM unit a JOIN unit b ON a.firstname <> b.firstname)
    SELECT first_record, second_record, round(score, 6) AS similarity_score,
      CASE WHEN round(score, 6) > 0.9 THEN 'High' ELSE 'Medium' END AS pattern_group,
      CAST(sum(pairs) AS BIGINT) AS pairs
    FROM compared WHERE round(score, 6) > 0.8 GROUP BY ALL"""
)
def different_name_scores(spark, sf_dir):
    """Both orientations of records with other first names; equal rows carry a count."""
    return name_similarity(standins.records(spark, sf_dir), embed_letters, digits=6)


@query(
    f"WITH {oracle.RECORDS} SELECT task_id, count(*) AS records,"
    " CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM records GROUP BY ALL"
)
def pair_counts(spark, sf_dir):
    return pairs.block_sizes(standins.records(spark, sf_dir), ["task_id"])


@query(
    f"WITH {oracle.scored()} SELECT task_id, id_a, id_b FROM scored"
    " WHERE firstname_a = firstname_b AND ln_similarity_score > 0.85 AND "
    + oracle.SAME_DOB
)
def custom_rule_first_name(spark, sf_dir):
    """A user's rule: equal first name, birth date and country, similar last name."""
    return _custom(
        spark,
        sf_dir,
        "a.firstname = b.firstname"
        " AND vector_cosine_similarity(a.lastname_vector, b.lastname_vector) > 0.85"
        " AND coalesce(a.dob, '11110101') = coalesce(b.dob, '11110101')"
        " AND a.country = b.country;",
    )


@query(
    f"WITH {oracle.scored()} SELECT task_id, id_a, id_b FROM scored"
    " WHERE fn_similarity_score > 0.9 AND lastname_a = lastname_b"
)
def custom_rule_last_name(spark, sf_dir):
    """A user's rule: similar first name, equal last name."""
    return _custom(
        spark,
        sf_dir,
        "vector_cosine_similarity(a.firstname_vector, b.firstname_vector) > 0.9"
        " AND a.lastname = b.lastname",
    )


@query(
    f"WITH {oracle.RECORDS} SELECT a.task_id, a.id AS id_a, b.id AS id_b"
    " FROM records a JOIN records b ON a.task_id = b.task_id AND a.id < b.id WHERE "
    + oracle.jaro_winkler("a.firstname", "b.firstname")
    + " > 0.8 AND levenshtein(a.lastname, b.lastname) < 3 AND "
    + oracle.jaccard("a.address", "b.address")
    + " = 0 AND translate(a.lastname, 'aeiouAEIOU', '') = translate(b.lastname, 'aeiouAEIOU', '')"
)
def custom_rule_functions(spark, sf_dir):
    """A user's rule that calls the registered text functions."""
    return _custom(
        spark,
        sf_dir,
        "jaro_winkler_distance(a.firstname, b.firstname) > 0.8"
        " AND editdistance(a.lastname, b.lastname) < 3"
        " AND jaccard_distance(a.address, b.address) = 0"
        " AND suppress_vowels(a.lastname) = suppress_vowels(b.lastname)",
    )


def _custom(spark, sf_dir, predicate):
    found = rules.rule_pairs(standins.embedded_records(spark, sf_dir), predicate)
    return found.select("a.task_id", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


@query(
    f"WITH {oracle.PAIRS} SELECT id_a, id_b, CASE match_type"
    " WHEN 'Exact firstname+lastname+dob+gender' THEN 'exact'"
    " WHEN 'hc-firstname+hc-lastname | Exact DOB+gender' THEN 'hc'"
    " WHEN 'lc firstname+lastname + hc-address  | Exact DOB+gender' THEN 'lc'"
    " ELSE 'other' END AS tier FROM pairs"
)
def match_tiers(spark, sf_dir):
    return labelled(spark, sf_dir).select("id_a", "id_b", rules.tier().alias("tier"))


@query(f"WITH {oracle.PAIRS} SELECT id_a, id_b, round(total_score, 6) AS total_score FROM pairs")
def total_scores(spark, sf_dir):
    scored = rules.scored_pairs(standins.embedded_records(spark, sf_dir), with_text=False)
    return groups.total_score(scored).select("id_a", "id_b", "total_score").withColumns(
        rounded("total_score")
    )


_COMBINED = " || '|' || ".join(
    f"CAST(CAST(round({s}, 10) AS DECIMAL(12, 10)) AS VARCHAR)" for s in rules.SCORES
)


@query(f"WITH {oracle.PAIRS} SELECT id_a, id_b, {_COMBINED} AS combined FROM pairs")
def combined_scores(spark, sf_dir):
    scored = rules.scored_pairs(standins.embedded_records(spark, sf_dir), with_text=False)
    return scored.select("id_a", "id_b", rules.combined_scores().alias("combined"))


# -- groups ----------------------------------------------------------------------------


@query(f"WITH {oracle.WALK} SELECT * FROM numbers")
def group_numbers(spark, sf_dir):
    return groups.group_numbers(labelled(spark, sf_dir))


@query(
    f"WITH {oracle.WALK} SELECT p.task_id, p.id_a, p.id_b, n.group_id FROM pairs p"
    " JOIN numbers n ON n.task_id = p.task_id AND n.match_type = p.match_type"
)
def numbered_pairs(spark, sf_dir):
    return groups.with_group_id(labelled(spark, sf_dir)).select(
        "task_id", "id_a", "id_b", "group_id"
    )


@query(
    f"WITH RECURSIVE {oracle.GROUPS} SELECT task_id, id, match_type,"
    " round(total_score, 6) AS total_score, group_id FROM grouped"
)
def selected_groups(spark, sf_dir):
    return groups.selected_groups(labelled(spark, sf_dir)).withColumns(rounded("total_score"))


@query(
    f"WITH RECURSIVE {oracle.GROUPS} SELECT task_id, match_type, round(total_score, 6) AS total_score,"
    " group_id, 0::BIGINT AS page, array_to_string(list(id ORDER BY id), ',') AS \"group\" FROM grouped"
    " GROUP BY task_id, match_type, total_score, group_id,"
    " CASE WHEN match_type = 'Singleton' THEN id END"
)
def group_lists(spark, sf_dir):
    lists = groups.group_lists(groups.selected_groups(labelled(spark, sf_dir)))
    return lists.withColumns({**rounded("total_score"), "group": as_text("group")})


def as_text(column: str) -> Column:
    return F.array_join(column, ",")


@query(
    f"WITH RECURSIVE {oracle.GROUPS} SELECT task_id, id, match_type, round(total_score, 6) AS total_score, group_id"
    " FROM grouped"
)
def exploded_groups(spark, sf_dir):
    """Lists of ids, also in their text form, back to one row per record."""
    lists = groups.group_lists(groups.selected_groups(labelled(spark, sf_dir)))
    written = lists.withColumn("group", as_text("group")).drop("page")
    return groups.explode_groups(written).withColumns(rounded("total_score"))


_ORIGINALS = (
    "r.id AS id_original, r.task_id AS task_id_original, r.firstname, r.lastname, r.dob, r.gender, r.country"
)


@query(
    f"WITH RECURSIVE {oracle.GROUPS} SELECT g.task_id, g.id, g.match_type,"
    f" round(g.total_score, 6) AS total_score, g.group_id, {_ORIGINALS}"
    " FROM grouped g LEFT JOIN records r ON r.task_id = g.task_id AND r.id = g.id"
)
def grouped_records(spark, sf_dir):
    """The whole rule matching, from records to grouped originals."""
    records = standins.records(spark, sf_dir)
    return match_and_group(records, embed_letters).withColumns(rounded("total_score"))


@query(
    f"WITH {oracle.COUPLES} SELECT task_id, id_a, id_b, match_type,"
    " round(total_score, 6) AS total_score FROM walk WHERE id_a IS NOT NULL".replace(
        "WITH", "WITH RECURSIVE", 1
    )
)
def matched_couples(spark, sf_dir):
    return groups.matched_couples(labelled(spark, sf_dir)).withColumns(rounded("total_score"))


# -- reports by label ------------------------------------------------------------------


@query(f"WITH {oracle.WALK} SELECT DISTINCT match_type, id FROM typed")
def ids_by_match_type(spark, sf_dir):
    return groups.ids_by_match_type(labelled(spark, sf_dir))


@query(
    f"WITH {oracle.WALK} SELECT match_type, task_id, 0::BIGINT AS page,"
    " array_to_string(list(id ORDER BY id), ',') AS distinct_ids FROM typed GROUP BY ALL"
)
def task_id_lists(spark, sf_dir):
    lists = groups.id_lists_by_match_type(labelled(spark, sf_dir), "task_id")
    return lists.withColumn("distinct_ids", as_text("distinct_ids"))


@query(
    f"WITH {oracle.WALK} SELECT match_type, id, 0::BIGINT AS page,"
    " array_to_string(list(DISTINCT partner ORDER BY partner), ',') AS partners"
    " FROM sides GROUP BY ALL"
)
def partner_lists(spark, sf_dir):
    return groups.partner_lists(labelled(spark, sf_dir)).withColumn(
        "partners", as_text("partners")
    )


_BY_PLACE = """
  placed AS (SELECT DISTINCT match_type, id_a, id_b FROM pairs),
  paged AS (
    SELECT *, (row_number() OVER (PARTITION BY match_type ORDER BY id_a, id_b) - 1) // 10000 AS page FROM placed)
  SELECT match_type, page,
    array_to_string(list(id_a || '-' || id_b ORDER BY id_a, id_b), ',') AS id_pairs
  FROM paged GROUP BY ALL"""


@query(f"WITH {oracle.PAIRS}, {_BY_PLACE}")
def pair_lists(spark, sf_dir):
    lists = groups.pair_lists(labelled(spark, sf_dir))
    pair = lambda p: F.concat_ws("-", p[0].cast("string"), p[1].cast("string"))
    return lists.withColumn("id_pairs", F.array_join(F.transform("id_pairs", pair), ","))


@query(
    f"WITH {oracle.PAIRS} SELECT id_a, 0::BIGINT AS page,"
    " array_to_string(list(DISTINCT match_type ORDER BY match_type), ',') AS match_types,"
    " array_to_string(list(DISTINCT id_b ORDER BY id_b), ',') AS partners FROM pairs GROUP BY id_a"
)
def lists_by_first_id(spark, sf_dir):
    lists = groups.lists_by_first_id(labelled(spark, sf_dir))
    return lists.withColumns({c: as_text(c) for c in ("match_types", "partners")})


@query(
    f"WITH {oracle.WALK} SELECT task_id, 0::BIGINT AS page,"
    " array_to_string(list(DISTINCT id ORDER BY id), ',') AS ids FROM sides GROUP BY ALL"
)
def merged_sets(spark, sf_dir):
    sets = labelled(spark, sf_dir).select("task_id", F.array("id_a", "id_b").alias("ids"))
    return groups.merged_sets(sets, "task_id", "ids").withColumn("ids", as_text("ids"))


_FIRSTS = """
  firsts AS MATERIALIZED (
    SELECT id, min((id_a, id_b)) AS f FROM (
      SELECT id_a AS id, id_a, id_b FROM pairs UNION ALL SELECT id_b, id_a, id_b FROM pairs)
    GROUP BY id),
  first_rows AS (
    SELECT f.id, p.* EXCLUDE (task_id, match_type) FROM firsts f
    JOIN pairs p ON p.id_a = f.f[1] AND p.id_b = f.f[2])"""


@query(
    f"WITH {oracle.WALK}, {_FIRSTS} SELECT DISTINCT t.id, t.match_type,"
    " CASE WHEN t.id = f.id_a THEN f.first_record ELSE f.second_record END AS first_record,"
    f" {_COMBINED} AS similarity_score_fn_ln_adrs FROM typed t JOIN first_rows f ON f.id = t.id"
)
def record_rows(spark, sf_dir):
    shown = labelled(spark, sf_dir).withColumn("combined_scores", rules.combined_scores())
    return groups.record_rows(shown)


@query(
    f"WITH {oracle.WALK}, {_FIRSTS},"
    " task_first AS (SELECT task_id, min((id_a, id_b)) AS f FROM pairs GROUP BY ALL),"
    f" task_scores AS (SELECT t.task_id, {SCORES_SQL} FROM task_first t"
    "   JOIN pairs p ON p.task_id = t.task_id AND p.id_a = t.f[1] AND p.id_b = t.f[2])"
    " SELECT t.id, t.task_id, t.match_type,"
    + ", ".join(
        f"CASE WHEN t.id = f.id_a THEN f.{c}_a ELSE f.{c}_b END AS {c}"
        for c in ("firstname", "lastname", "dob")
    )
    + ", CASE WHEN t.id = f.id_a THEN f.first_record ELSE f.second_record END AS first_record, "
    + ", ".join(f"s.{c}" for c in rules.SCORES)
    + " FROM typed t JOIN first_rows f ON f.id = t.id JOIN task_scores s ON s.task_id = t.task_id"
)
def task_record_rows(spark, sf_dir):
    return groups.task_record_rows(labelled(spark, sf_dir)).withColumns(rounded(*rules.SCORES))


# -- vectors ---------------------------------------------------------------------------


@query(
    "WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
    " SELECT a.label AS task_id, a.vec_id AS id_a, b.vec_id AS id_b,"
    f" round({oracle.cosine('a.e', 'b.e')}, 6) AS cosine,"
    " round(list_dot_product(a.e, b.e), 6) AS dot"
    " FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id"
)
def vector_scores(spark, sf_dir):
    sided = standins.vectors(spark, sf_dir).withColumn("norm", vectors.vector_norm("embedding"))
    found = tiles.similar_pairs(sided, ["task_id"], "id", {"cosine": "embedding"})
    dot = F.col("cosine") * F.col("norm_a") * F.col("norm_b")
    return found.select(
        "task_id",
        "id_a",
        "id_b",
        F.round("cosine", 6).alias("cosine"),
        F.round(F.coalesce(dot, F.lit(0.0)), 6).alias("dot"),
    )


@query(
    f"WITH {oracle.VECTORS} SELECT id, array_to_string(list_transform(range(1, 27),"
    " lambda i: CAST(CAST(fv[i] + lv[i] + av[i] AS BIGINT) AS VARCHAR)), ',') AS total FROM vectors"
)
def vector_sums(spark, sf_dir):
    summed = vectors.vector_sum(*RECORD_VECTORS.values())
    return standins.embedded_records(spark, sf_dir).select(
        "id", F.array_join(F.transform(summed, lambda x: x.cast("bigint").cast("string")), ",").alias("total")
    )


_BUCKET = (
    "list_reduce(list_transform(string_split(substr(md5({g}), 1, 8), ''),"
    " lambda d: CAST(strpos('0123456789abcdef', d) - 1 AS BIGINT)), lambda x, y: x * 16 + y) % 768"
)


@query(
    f"""WITH {oracle.RECORDS},
    framed AS (SELECT id, ' ' || lower(trim(lastname)) || ' ' AS t FROM records),
    grams AS (SELECT id, substr(t, CAST(unnest(range(1, length(t) - 1)) AS BIGINT), 3) AS g FROM framed),
    counted AS (SELECT id, {_BUCKET.format(g='g')} AS bucket, count(*) AS n FROM grams GROUP BY ALL),
    scaled AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM counted)
    SELECT id, array_to_string(list(bucket ORDER BY bucket), ',') AS buckets,
      round(sum(w * bucket), 2) AS weighted, round(sum(w), 2) AS total FROM scaled GROUP BY id"""
)
def text_embeddings(spark, sf_dir):
    """Every record's name as hashed n-grams: the buckets, and two sums over the dense vector."""
    rows = standins.records(spark, sf_dir).select("id", "lastname")
    rows = vectors.portable_ngrams()(rows, {"lastname": "v"})
    weighted = F.zip_with("v", F.sequence(F.lit(0), F.lit(767)), lambda x, i: x.cast("double") * i)
    add = lambda acc, x: acc + x.cast("double")
    buckets = F.array_sort(F.array_distinct(vectors.ngram_buckets("lastname")))
    return rows.select(
        "id",
        F.array_join(buckets.cast("array<string>"), ",").alias("buckets"),
        F.round(F.aggregate(weighted, F.lit(0.0), add), 2).alias("weighted"),
        F.round(F.aggregate("v", F.lit(0.0), add), 2).alias("total"),
    )


_TOP = 5


@query(
    f"""WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    scored AS (SELECT q.vec_id AS query_id, r.vec_id, round({oracle.cosine('q.e', 'r.e')}, 6) AS similarity
      FROM v q JOIN v r ON q.vec_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER)
      AS rank FROM scored WHERE similarity IS NOT NULL)
    SELECT query_id, rank, vec_id, similarity FROM ranked WHERE rank <= {_TOP}"""
)
def similar_rows_of_each(spark, sf_dir):
    """The five most similar rows for every row whose id is divisible by 50, among all rows."""
    rows = standins.table(spark, sf_dir, "embeddings")
    return search.similar_rows_of_each(rows, rows.where("vec_id % 50 = 0"), "embedding", "vec_id", _TOP, digits=6)


_CHECKED = {
    "same name": "a.lastname = b.lastname",
    "near name": "levenshtein(a.lastname, b.lastname) < 2;",
    "unknown column": "a.surname = b.surname",
    "statement": "a.id IN (SELECT id FROM records)",
    "unfinished": "a.id =",
    "not listed": "rand() < 0.5",
}


@query(
    f"""WITH {oracle.RECORDS},
    pairs AS (SELECT a.lastname AS x, b.lastname AS y FROM records a JOIN records b
      ON a.task_id = b.task_id AND a.id < b.id)
    SELECT 'same name' AS rule, true AS valid, count(*) AS pairs FROM pairs WHERE x = y
    UNION ALL SELECT 'near name', true, count(*) FROM pairs WHERE levenshtein(x, y) < 2
    UNION ALL SELECT unnest(['unknown column', 'statement', 'unfinished', 'not listed']), false, 0"""
)
def checked_rules(spark, sf_dir):
    """Users' rules tested before any job runs, and the pairs of those that pass."""
    records = standins.records(spark, sf_dir)
    out = None
    for name, rule in _CHECKED.items():
        valid, _ = rules.validate_rule(records, rule)
        found = rules.rule_pairs(records, rule) if valid else spark.range(0)
        row = found.agg(F.count("*").alias("pairs")).select(F.lit(name).alias("rule"), F.lit(valid).alias("valid"), "pairs")
        out = row if out is None else out.union(row)
    return out


@query(
    f"""WITH {oracle.RECORDS}, sizes AS (SELECT task_id, count(*) AS n FROM records GROUP BY task_id),
    blocked AS (SELECT sum(n) AS rows, sum(n * (n - 1) // 2) AS pairs, max(n) AS largest_block FROM sizes),
    open AS (SELECT sum(n) AS n FROM sizes)
    SELECT 'task' AS block, CAST(rows AS BIGINT) AS rows, CAST(pairs AS BIGINT) AS pairs,
      CAST(largest_block AS BIGINT) AS largest_block FROM blocked
    UNION ALL SELECT 'none', CAST(n AS BIGINT), CAST(n * (n - 1) // 2 AS BIGINT), CAST(n AS BIGINT) FROM open"""
)
def pair_costs(spark, sf_dir):
    """What pair joins of the records would form, with and without blocks, known beforehand."""
    records = standins.records(spark, sf_dir)
    found = {"task": pairs.pair_cost(records, ["task_id"]), "none": pairs.pair_cost(records)}
    rows = [(name, c.rows, c.pairs, c.largest_block) for name, c in found.items()]
    return spark.createDataFrame(rows, "block string, rows long, pairs long, largest_block long")


_DATED = "DATE '2024-01-01' + CAST(vec_id % 365 AS INTEGER)"


@query(
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,"
    f" {_DATED} AS issue_date FROM embeddings),"
    " q AS (SELECT e FROM v WHERE vec_id = 0),"
    f" s AS (SELECT vec_id, issue_date, {oracle.cosine('v.e', 'q.e')} AS similarity FROM v, q"
    "   WHERE DATE '2024-06-30' - issue_date BETWEEN 0 AND 89)"
    " SELECT vec_id, issue_date, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.1"
    " ORDER BY similarity DESC, vec_id LIMIT 5"
)
def similar_rows(spark, sf_dir):
    """The five most similar rows of the last 90 days."""
    rows = standins.table(spark, sf_dir, "embeddings").withColumn(
        "issue_date",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 365).cast("int")),
    )
    wanted = rows.filter("vec_id = 0").first()["embedding"]
    recent = text.is_recent("issue_date", F.lit("2024-06-30").cast("date"))
    found = search.similar_rows(rows, "embedding", wanted, "vec_id", above=0.1, recent=recent)
    return found.select("vec_id", "issue_date", F.round("similarity", 6).alias("similarity"))


# -- text and date columns over all pairs of a block -----------------------------------


@query(
    f"WITH {oracle.RECORDS} SELECT a.id AS id_a, b.id AS id_b,"
    " CAST(levenshtein(a.firstname, b.firstname) AS INTEGER) AS edits,"
    f" round({oracle.jaro_winkler('a.firstname', 'b.firstname')}, 6) AS jaro_winkler,"
    f" round({oracle.jaccard('a.dob', 'b.dob')}, 6) AS dob_jaccard,"
    " CASE WHEN length(a.firstname) = length(b.firstname)"
    "   THEN CAST(hamming(a.firstname, b.firstname) AS INTEGER) END AS hamming,"
    " translate(a.firstname, 'aeiouAEIOU', '') AS bare_name,"
    " coalesce(a.dob, '11110101') = coalesce(b.dob, '11110101') AS same_dob"
    " FROM records a JOIN records b ON a.task_id = b.task_id AND a.id < b.id"
)
def text_distances(spark, sf_dir):
    a, b = "a.firstname", "b.firstname"
    return pairs.self_pairs(standins.records(spark, sf_dir)).select(
        F.col("a.id").alias("id_a"),
        F.col("b.id").alias("id_b"),
        text.edit_distance(a, b).alias("edits"),
        F.round(text.jaro_winkler_similarity(a, b), 6).alias("jaro_winkler"),
        F.round(text.jaccard_distance("a.dob", "b.dob"), 6).alias("dob_jaccard"),
        text.hamming_distance(a, b, strict=False).alias("hamming"),
        text.suppress_vowels(a).alias("bare_name"),
        (text.known_dob("a.dob") == text.known_dob("b.dob")).alias("same_dob"),
    )


@query(
    f"WITH {oracle.RECORDS} SELECT id, firstname || ' ' || lastname || ' ' || dob || ' ' || gender"
    " || ' ' || country AS record FROM records"
)
def record_texts(spark, sf_dir):
    return standins.records(spark, sf_dir).select("id", rules.record_text().alias("record"))
