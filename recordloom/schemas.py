"""Table schemas and column names."""

from __future__ import annotations

from pyspark.sql import types as T

_VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INPUT_RECORDS = _struct(
    id=T.LongType(),
    firstname=T.StringType(),
    lastname=T.StringType(),
    address=T.StringType(),
    dob=T.StringType(),
    gender=T.StringType(),
    country=T.StringType(),
    firstname_vector=_VECTOR,
    lastname_vector=_VECTOR,
    address_vector=_VECTOR,
    task_id=T.LongType(),
)

#: The record columns a file brings; vectors are added later.
RECORD_FILE = T.StructType([f for f in INPUT_RECORDS if f.dataType != _VECTOR])

#: Text column -> its vector column.
RECORD_VECTORS = {
    "firstname": "firstname_vector",
    "lastname": "lastname_vector",
    "address": "address_vector",
}

MEMBERS = _struct(
    task_id=T.StringType(),
    mcid=T.StringType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    middle_initial=T.StringType(),
    gender=T.StringType(),
    dob=T.DateType(),
    subscriber_id=T.StringType(),
    zip_code=T.StringType(),
    country=T.StringType(),
    response_final=T.LongType(),
)

MEMBER_KEYS = _struct(
    task_id=T.StringType(),
    mcid=T.StringType(),
    fn_ln_mi=T.StringType(),
    fn_ln_mi_vector=_VECTOR,
    fn_ln_mi_sprsd_vwl=T.StringType(),
    gender=T.StringType(),
    dob=T.DateType(),
    response_final=T.LongType(),
)

SCORED_TASKS = _struct(
    fni_file_id=T.LongType(),
    task_id=T.LongType(),
    response_final=T.IntegerType(),
    probability=T.DoubleType(),
    confidence_score=T.StringType(),
)

#: A saved pair relation, with the display names of its columns.
MATCHING_PAIRS = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("id_a", T.LongType()),
        T.StructField("id_b", T.LongType()),
    ]
    + [
        T.StructField(f"{c}_{side}", T.StringType())
        for c in ("dob", "gender", "firstname", "lastname")
        for side in "ab"
    ]
    + [
        T.StructField(c, T.StringType())
        for c in ("First Record", "Second Record", "Match Type")
    ]
    + [
        T.StructField(f"{c}_similarity_score", T.DoubleType())
        for c in ("fn", "ln", "adrs")
    ]
)

#: Internal pair columns -> display names.
DISPLAY_NAMES = {
    "first_record": "First Record",
    "second_record": "Second Record",
    "match_type": "Match Type",
}

# Other names under which uploaded files carry the record columns.
COLUMN_SYNONYMS = {
    "id": ["ORDER_ID"],
    "firstname": ["fname", "First Name"],
    "lastname": ["lname", "surname"],
    "address": ["addr", "Place", "Location", "city"],
    "dob": ["Birthdate", "Date of birth"],
    "gender": ["sex"],
    "country": ["member country"],
}
