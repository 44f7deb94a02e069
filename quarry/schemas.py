"""Declared schemas: web log, warehouse dimensions and facts."""

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Web log: every field is text, as declared by the log jobs.
WEBLOG = _struct(("user_id", _S, True), ("search_query", _S, True), ("browser", _S, True),
                 ("os", _S, True), ("referrer", _S, True))
WEBLOG_TM = _struct(("timestamp", _S, True), *[(f.name, f.dataType, True) for f in WEBLOG])

# Warehouse targets. Keys are LongType (the source keys are bigint).
DIM_TIME = _struct(("date_id", _I, False), ("start_dt", _D, False), ("end_dt", _D, False),
                   ("days_in_month", _I, False), ("month", _S, False), ("year", _I, False),
                   ("quarter", _I, False))
DIM_PATIENT = _struct(("patient_id", _L, False), ("first_name", _S, True), ("last_name", _S, True),
                      ("gender", _S, True), ("dob", _D, True), ("birth_month", _S, True),
                      ("birth_year", _I, True))
DIM_PROVIDER = _struct(("provider_id", _L, False), ("first_name", _S, True),
                       ("last_name", _S, True), ("specialty", _S, True))
DIM_LAB = _struct(("lab_id", _L, False), ("cpt_code", _S, False), ("lab_name", _S, False))
DIM_PROCEDURE = _struct(("procedure_id", _L, False), ("icd10_code", _S, False),
                        ("proc_name", _S, False), ("description", _S, False))
DIM_DIAGNOSIS = _struct(("diagnosis_id", _L, False), ("name", _S, False), ("icd10_code", _S, False))
FACT_PATIENT = _struct(("provider_id", _L, False), ("patient_id", _L, False), ("date_id", _I, False),
                       ("visit_count", _L, False), ("lab_count", _L, False),
                       ("procedure_count", _L, False), ("diagnosis_count", _L, False))
FACT_LAB = _struct(("provider_id", _L, False), ("lab_id", _L, False), ("date_id", _I, False),
                   ("patient_count", _L, False), ("visit_count", _L, False), ("lab_count", _L, False))
FACT_PROCEDURE = _struct(("provider_id", _L, False), ("procedure_id", _L, False),
                         ("date_id", _I, False), ("patient_count", _L, False),
                         ("visit_count", _L, False), ("procedure_count", _L, False))
FACT_DIAGNOSIS = _struct(("provider_id", _L, False), ("diagnosis_id", _L, False),
                         ("date_id", _I, False), ("patient_count", _L, False),
                         ("visit_count", _L, False), ("diagnosis_frequency", _L, False))

WAREHOUSE = {
    "dim_time": DIM_TIME, "dim_patient": DIM_PATIENT, "dim_provider": DIM_PROVIDER,
    "dim_lab": DIM_LAB, "dim_procedure": DIM_PROCEDURE, "dim_diagnosis": DIM_DIAGNOSIS,
    "fact_patient": FACT_PATIENT, "fact_lab": FACT_LAB, "fact_procedure": FACT_PROCEDURE,
    "fact_diagnosis": FACT_DIAGNOSIS,
}

# Primary keys and foreign keys of the warehouse (checked by quarry.operators.quality).
PRIMARY_KEYS = {
    "dim_time": ["date_id"], "dim_patient": ["patient_id"], "dim_provider": ["provider_id"],
    "dim_lab": ["lab_id"], "dim_procedure": ["procedure_id"], "dim_diagnosis": ["diagnosis_id"],
    "fact_patient": ["provider_id", "patient_id", "date_id"],
    "fact_lab": ["provider_id", "lab_id", "date_id"],
    "fact_procedure": ["provider_id", "procedure_id", "date_id"],
    "fact_diagnosis": ["provider_id", "diagnosis_id", "date_id"],
}
FOREIGN_KEYS = [  # (fact, column, dimension)
    ("fact_patient", "provider_id", "dim_provider"), ("fact_patient", "patient_id", "dim_patient"),
    ("fact_patient", "date_id", "dim_time"),
    ("fact_lab", "provider_id", "dim_provider"), ("fact_lab", "lab_id", "dim_lab"),
    ("fact_lab", "date_id", "dim_time"),
    ("fact_procedure", "provider_id", "dim_provider"),
    ("fact_procedure", "procedure_id", "dim_procedure"), ("fact_procedure", "date_id", "dim_time"),
    ("fact_diagnosis", "provider_id", "dim_provider"),
    ("fact_diagnosis", "diagnosis_id", "dim_diagnosis"), ("fact_diagnosis", "date_id", "dim_time"),
]


def not_null_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
