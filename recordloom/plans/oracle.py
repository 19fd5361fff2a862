"""The stand-in views and pair relations in plain SQL, to check the queries against."""

from __future__ import annotations

_LETTERS = "['" + "','".join("abcdefghijklmnopqrstuvwxyz") + "']"


def letters(text: str) -> str:
    return (
        f"list_transform({_LETTERS}, lambda c: "
        f"CAST(length(lower({text})) - length(replace(lower({text}), c, '')) AS DOUBLE))"
    )


def norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


def cosine(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / nullif({norm(a)} * {norm(b)}, 0)"


def jaro_winkler(a: str, b: str) -> str:
    """Jaro with the prefix bonus spelled out."""
    prefix = " + ".join(
        f"CASE WHEN least(length({a}), length({b})) >= {n} AND left({a}, {n}) = left({b}, {n})"
        " THEN 1 ELSE 0 END"
        for n in range(1, 5)
    )
    jaro = f"jaro_similarity({a}, {b})"
    return f"({jaro} + ({prefix}) * 0.1::DOUBLE * (1 - {jaro}))"


def jaccard(a: str, b: str) -> str:
    left, right = f"list_distinct(string_split({a}, ','))", f"list_distinct(string_split({b}, ','))"
    return (
        f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.0::DOUBLE"
        f" WHEN {a} IS NULL OR {b} IS NULL THEN 1.0::DOUBLE"
        f" ELSE 1 - len(list_intersect({left}, {right}))::DOUBLE"
        f" / len(list_distinct(list_concat({left}, {right}))) END"
    )


RECORDS = """
records AS MATERIALIZED (
  SELECT p_partkey // 10 AS task_id, p_partkey AS id,
    CASE WHEN p_partkey % 3 = 0 THEN reverse(split_part(p_name, ' ', 1))
         ELSE split_part(p_name, ' ', 1) END AS firstname,
    split_part(p_name, ' ', 2) AS lastname, p_brand AS address,
    CASE WHEN p_partkey % 7 <> 0 THEN '2012070' || CAST(p_size % 3 AS VARCHAR) END AS dob,
    CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'F' END END AS gender,
    'India' AS country
  FROM part)"""

VECTORS = f"""{RECORDS},
vectors AS MATERIALIZED (
  SELECT *, {letters('firstname')} AS fv, {letters('lastname')} AS lv, {letters('address')} AS av
  FROM records),
normed AS MATERIALIZED (
  SELECT *, {norm('fv')} AS fnorm, {norm('lv')} AS lnorm, {norm('av')} AS anorm FROM vectors)"""


def _text(side: str) -> str:
    return " || ' ' || ".join(
        f"{side}.{c}" for c in ("firstname", "lastname", "dob", "gender", "country")
    )


def scored(block: str = "a.task_id = b.task_id AND") -> str:
    return f"""{VECTORS},
scored AS (
  SELECT a.task_id, a.id AS id_a, b.id AS id_b, a.dob AS dob_a, b.dob AS dob_b,
    a.gender AS gender_a, b.gender AS gender_b, a.firstname AS firstname_a,
    b.firstname AS firstname_b, a.lastname AS lastname_a, b.lastname AS lastname_b,
    {_text('a')} AS first_record, {_text('b')} AS second_record,
    list_dot_product(a.fv, b.fv) / nullif(a.fnorm * b.fnorm, 0) AS fn_similarity_score,
    list_dot_product(a.lv, b.lv) / nullif(a.lnorm * b.lnorm, 0) AS ln_similarity_score,
    list_dot_product(a.av, b.av) / nullif(a.anorm * b.anorm, 0) AS adrs_similarity_score
  FROM normed a JOIN normed b ON {block} a.id < b.id)"""


SAME_DOB = "coalesce(dob_a, '11110101') = coalesce(dob_b, '11110101')"
SAME_GENDER = "coalesce(gender_a, 'UNK') = coalesce(gender_b, 'UNK')"
TESTS = {
    "exact": f"firstname_a = firstname_b AND lastname_a = lastname_b AND {SAME_DOB} AND {SAME_GENDER}",
    "high": f"fn_similarity_score > 0.95 AND ln_similarity_score > 0.95 AND {SAME_DOB} AND {SAME_GENDER}",
    "address": "adrs_similarity_score > 0.9 AND fn_similarity_score > 0.9"
    f" AND ln_similarity_score > 0.9 AND {SAME_DOB}",
    "fuzzy": "levenshtein(lastname_a, lastname_b) < 3",
}


def pairs(block: str = "a.task_id = b.task_id AND") -> str:
    """CTEs up to ``pairs``, the labelled pair relation."""
    return f"""{scored(block)},
pairs AS MATERIALIZED (
  SELECT *, fn_similarity_score + ln_similarity_score + adrs_similarity_score AS total_score,
    CASE WHEN {TESTS['exact']} THEN 'Exact firstname+lastname+dob+gender'
         WHEN {TESTS['high']} THEN 'hc-firstname+hc-lastname | Exact DOB+gender'
         WHEN {TESTS['address']} THEN 'lc firstname+lastname + hc-address  | Exact DOB+gender'
         WHEN {TESTS['fuzzy']} THEN 'Fuzzy Match on Lastname'
         ELSE 'No Match' END AS match_type
  FROM scored)"""


PAIRS = pairs()

#: One row per (label, task, record), and the best-first walk of each task's pairs.
WALK = f"""{PAIRS},
sides AS MATERIALIZED (
  SELECT task_id, match_type, id_a AS id, id_b AS partner FROM pairs
  UNION ALL SELECT task_id, match_type, id_b, id_a FROM pairs),
typed AS MATERIALIZED (SELECT DISTINCT task_id, match_type, id FROM sides),
group_ids AS MATERIALIZED (
  SELECT task_id, match_type, list(id) AS ids FROM typed GROUP BY ALL),
numbers AS MATERIALIZED (
  SELECT task_id, match_type, row_number() OVER (ORDER BY task_id, first) AS group_id
  FROM (SELECT task_id, match_type, min((id_a, id_b)) AS first FROM pairs GROUP BY ALL)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY task_id
    ORDER BY total_score DESC NULLS LAST, id_a, id_b) AS rn FROM pairs)"""

GROUPS = f"""{WALK},
walk AS (
  SELECT DISTINCT task_id, 0::BIGINT AS rn, []::BIGINT[] AS used,
    NULL::VARCHAR AS chosen, NULL::DOUBLE AS score FROM pairs
  UNION ALL
  SELECT w.task_id, r.rn,
    CASE WHEN list_has_any(w.used, [r.id_a, r.id_b]) THEN w.used ELSE list_concat(w.used, g.ids) END,
    CASE WHEN list_has_any(w.used, [r.id_a, r.id_b]) THEN NULL ELSE r.match_type END,
    CASE WHEN list_has_any(w.used, [r.id_a, r.id_b]) THEN NULL ELSE r.total_score END
  FROM walk w JOIN ranked r ON r.task_id = w.task_id AND r.rn = w.rn + 1
  JOIN group_ids g ON g.task_id = r.task_id AND g.match_type = r.match_type),
chosen AS MATERIALIZED (
  SELECT w.task_id, w.chosen AS match_type, w.score AS total_score, n.group_id
  FROM walk w JOIN numbers n ON n.task_id = w.task_id AND n.match_type = w.chosen),
members AS MATERIALIZED (
  SELECT t.task_id, t.id, t.match_type, c.total_score, c.group_id
  FROM typed t JOIN chosen c ON c.task_id = t.task_id AND c.match_type = t.match_type),
grouped AS MATERIALIZED (
  SELECT * FROM members UNION ALL
  SELECT DISTINCT s.task_id, s.id, 'Singleton', 0.0::DOUBLE, -1::BIGINT FROM sides s
  WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.task_id = s.task_id AND m.id = s.id))"""

COUPLES = f"""{WALK},
walk AS (
  SELECT DISTINCT task_id, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS id_a,
    NULL::BIGINT AS id_b, NULL::VARCHAR AS match_type, NULL::DOUBLE AS total_score FROM pairs
  UNION ALL
  SELECT w.task_id, r.rn,
    CASE WHEN list_has_any(w.used, [r.id_a, r.id_b]) THEN w.used
         ELSE list_concat(w.used, [r.id_a, r.id_b]) END,
    CASE WHEN list_has_any(w.used, [r.id_a, r.id_b]) THEN NULL ELSE r.id_a END,
    r.id_b, r.match_type, r.total_score
  FROM walk w JOIN ranked r ON r.task_id = w.task_id AND r.rn = w.rn + 1)"""

MEMBERS = """
members AS MATERIALIZED (
  SELECT CAST(p_partkey // 10 AS VARCHAR) AS task_id, CAST(p_partkey AS VARCHAR) AS mcid,
    CASE WHEN p_partkey % 3 = 0 THEN reverse(split_part(p_name, ' ', 1))
         ELSE split_part(p_name, ' ', 1) END AS first_name,
    split_part(p_name, ' ', 2) AS last_name, chr(p_size % 26 + 65) AS middle_initial,
    CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'F' END END AS gender,
    CASE WHEN p_partkey % 7 <> 0 THEN DATE '1950-01-01' + CAST(p_size * 20 AS INTEGER) END AS dob,
    CASE WHEN p_partkey % 100 = 5 THEN 1 - (p_partkey // 10) % 2
         ELSE (p_partkey // 10) % 2 END AS response_final
  FROM part)"""

MEMBER_KEYS = f"""{MEMBERS},
keys AS MATERIALIZED (
  SELECT DISTINCT task_id, mcid, first_name || last_name || middle_initial AS fn_ln_mi,
    translate(first_name || last_name || middle_initial, 'aeiouAEIOU', '') AS fn_ln_mi_sprsd_vwl,
    gender, dob, response_final
  FROM members),
embedded AS MATERIALIZED (SELECT *, {letters('fn_ln_mi')} AS v FROM keys)"""


def _agree(part: str) -> str:
    return f"CASE WHEN {part}(a.dob) = {part}(b.dob) THEN 1 ELSE 0 END"


FEATURES = f"""{MEMBER_KEYS},
features AS MATERIALIZED (
  SELECT a.task_id, a.mcid AS mcid_a, b.mcid AS mcid_b,
    a.fn_ln_mi AS fn_ln_mi_a, b.fn_ln_mi AS fn_ln_mi_b,
    {cosine('a.v', 'b.v')} AS fn_ln_mi_smlrty_score,
    {jaro_winkler('a.fn_ln_mi', 'b.fn_ln_mi')} AS fn_ln_mi_jw,
    {jaccard('a.fn_ln_mi', 'b.fn_ln_mi')} AS fn_ln_mi_jd,
    levenshtein(a.fn_ln_mi, b.fn_ln_mi) AS fn_ln_mi_ed,
    levenshtein(a.fn_ln_mi_sprsd_vwl, b.fn_ln_mi_sprsd_vwl) AS fn_ln_mi_sprs_vwl_ed,
    {jaro_winkler('a.fn_ln_mi_sprsd_vwl', 'b.fn_ln_mi_sprsd_vwl')} AS fn_ln_mi_sprs_vwl_jw,
    a.dob AS dob_a, b.dob AS dob_b,
    {_agree('month')} AS month_match, {_agree('year')} AS year_match, {_agree('day')} AS day_match,
    {_agree('month')} + {_agree('year')} + {_agree('day')} AS total_match_score
  FROM embedded a JOIN embedded b ON a.task_id = b.task_id AND a.mcid < b.mcid)"""

SCORED_DOCUMENTS = """
scored AS MATERIALIZED (
  SELECT d.doc_id, l.quality AS label, round(d.n_chars / (d.n_chars + 200.0::DOUBLE), 4) AS probability,
    CAST(round(d.n_chars / (d.n_chars + 200.0::DOUBLE), 4) > 0.5 AS INTEGER) AS predicted
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TRAINING_ROWS = """
training AS MATERIALIZED (
  SELECT event_id, user_id, nullif(event_type, 'error') AS event_type,
    nullif(CAST(floor(value / 10) AS BIGINT), 0) AS tens
  FROM events)"""
