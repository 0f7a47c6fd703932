"""Identifiers by label, shape and key, nested values, the filter before redaction; shared folders and appends."""

import pytest
from pyspark.sql import functions as F

from billspark import session
from billspark.operators import privacy
from billspark.sources import files


@pytest.fixture(scope="module")
def redacted(spark):
    def run(*texts, **how):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r["x"] for r in df.select("i", privacy.redact(F.col("t"), **how).alias("x")).orderBy("i").collect()]

    return run


CASES = [
    ("Her MRN is AB-12345 now", "Her [REDACTED:MRN] now"), ("Medical record number: 00912345", "[REDACTED:MRN]"), ("MRN 1234", "MRN 1234"), ("date of birth - 1980-02-03", "[REDACTED:DOB]"), ("DOB=3/4/85", "[REDACTED:DOB]"), ("DOB unknown", "DOB unknown"),
    ("patient mobile # 541-555-0146", "[REDACTED:PATIENT_PHONE]"), ("guarantor telephone: (541)555.0146", "[REDACTED:PATIENT_PHONE]"), ("call 541-555-0146", "call 541-555-0146"), ("Patient Account Number PA-00001", "[REDACTED:PATIENT_ACCOUNT]"), ("account # 12345", "[REDACTED:PATIENT_ACCOUNT]"), ("accountants", "accountants"),
    ("guarantor number: GU-77777", "[REDACTED:GUARANTOR_ACCOUNT]"), ('{"Patient_Name" : "Ann", "x": 1}', '{"Patient_Name" : "[REDACTED:JSON_PATIENT_NAME]", "x": 1}'), ('"guarantor_account_number":"G9"', '"guarantor_account_number":"[REDACTED:JSON_ACCOUNT_NUMBER]"'), ('"facility_name": "A"', '"facility_name": "A"'), (None, None), ("", ""),
]


def test_kinds(redacted):
    assert redacted(*[c[0] for c in CASES]) == [c[1] for c in CASES]
    # nothing changes the second time
    assert redacted(*[c[1] for c in CASES]) == [c[1] for c in CASES]


def test_names_and_addresses_that_are_kept(redacted):
    t = '{"patient_name": "Ann", "account_number": "A1", "mail": "office@care.example and ann@care.example"}'
    got = redacted(t, keep_names=True, public=["office@care.example"])[0]
    assert '"Ann"' in got and "A1" not in got and "office@care.example" in got and "ann@" not in got


def test_nested(spark):
    schema = "id int, r struct<patient_name:string, notes:array<struct<text:string, n:int>>, tags:map<string,string>, ssn:string>"
    df = spark.createDataFrame([(1, ("Ann", [("MRN 12345", 7), None], {"dob": "x", "path": "a@b.co", "k": "a@b.co"}, None)), (2, None)], schema)
    got = [r["r"] for r in df.select("id", privacy.redact_nested(F.col("r"), df.schema["r"].dataType).alias("r")).orderBy("id").collect()]
    assert got[1] is None and got[0]["patient_name"] == "[REDACTED:PATIENT_NAME]" and got[0]["ssn"] is None
    assert got[0]["notes"][0].asDict() == {"text": "[REDACTED:MRN]", "n": 7} and got[0]["notes"][1] is None
    assert got[0]["tags"] == {"dob": "[REDACTED:DOB]", "path": "a@b.co", "k": "[REDACTED:EMAIL]"}
    kept = df.select(privacy.redact_nested(F.col("r"), df.schema["r"].dataType, keep_names=True).alias("r")).head()["r"]
    assert kept["patient_name"] == "Ann"


def test_filter_goes_first(spark):
    df = spark.createDataFrame([(1, "May I SUE them? SSN 123-45-6789"), (2, "SSN 123-45-6789"), (3, None)], "id int, t string")
    assert {r["id"]: (r["allowed"], r["t"]) for r in privacy.filter_then_redact(df, "id", "t").collect()} == {1: (False, None), 2: (True, "SSN [REDACTED:SSN]"), 3: (True, None)}


class _Cluster:
    """What the session tells of itself on a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://head:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster())


def test_an_unreadable_table_is_no_empty_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    p = f"{tmp_path}/t"
    assert files.append_new(df, p, "k") == 2 and files.append_new(df, p, "k") == 0 and spark.read.parquet(p).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):  # noqa: B017
        files.append_new(df, f"{tmp_path}/bad", "k")
