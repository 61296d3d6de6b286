"""CSV edge cases: NA tokens, Latin-1 bytes, quoted multi-line text, folder routing."""

import os
import tempfile

from pyspark.sql import types as T

from sparkprep.sources.files import MAIN_NA_TOKENS, read_csv, scan_folder

SCHEMA = T.StructType([T.StructField("VAERS_ID", T.LongType()), T.StructField("AGE_YRS", T.DoubleType()),
                       T.StructField("SEX", T.StringType()), T.StructField("SYMPTOM_TEXT", T.StringType())])


def _write(path, text, enc):
    with open(path, "wb") as f:
        f.write(text.encode(enc))


def test_na_tokens_latin1_multiline(spark):
    d = tempfile.mkdtemp(prefix="sparkprep-csv-")
    text = ('VAERS_ID,AGE_YRS,SEX,SYMPTOM_TEXT\n'
            '1,34,F,"fièvre, maux\nde tête"\n'
            '2,n/a,None,-\n'
            '3,,M,"said ""ok"""\n')
    _write(os.path.join(d, "2021VAERSDATA.csv"), text, "ISO-8859-1")
    df = read_csv(spark, os.path.join(d, "2021VAERSDATA.csv"), schema=SCHEMA, na_tokens=MAIN_NA_TOKENS,
                  encoding="ISO-8859-1")
    rows = {r.VAERS_ID: r for r in df.collect()}
    assert rows[1].SYMPTOM_TEXT == "fièvre, maux\nde tête" and rows[1].AGE_YRS == 34.0
    assert rows[2].AGE_YRS is None and rows[2].SEX is None and rows[2].SYMPTOM_TEXT is None
    assert rows[3].AGE_YRS is None and rows[3].SYMPTOM_TEXT == 'said "ok"'


def test_scan_folder_routes_by_token(spark):
    d = tempfile.mkdtemp(prefix="sparkprep-folder-")
    _write(os.path.join(d, "2021VAERSDATA.csv"), "VAERS_ID,AGE_YRS,SEX,SYMPTOM_TEXT\n1,5,F,x\n", "utf-8")
    _write(os.path.join(d, "2021VAERSSYMPTOMS.csv"), "VAERS_ID,SYMPTOM1\n1,Headache\n1,Fever\n", "utf-8")
    _write(os.path.join(d, "README.csv"), "a,b\n1,2\n", "utf-8")
    t = scan_folder(spark, d, {"main": "DATA", "symptoms": "SYMPTOMS"}, schemas={"main": SCHEMA})
    assert t["main"].count() == 1
    assert sorted(r.SYMPTOM1 for r in t["symptoms"].collect()) == ["Fever", "Headache"]


def test_ingest_folder_default_config(spark):
    """J3 with the default configuration on reference-shaped files."""
    from sparkprep.plans.ingest import IngestConfig, ingest_folder
    d = tempfile.mkdtemp(prefix="sparkprep-ingest-")
    _write(os.path.join(d, "2021VAERSDATA.csv"),
           "VAERS_ID,RECVDATE,AGE_YRS,SYMPTOM_TEXT\n"
           "1,01/15/2021,34,fever\n2,02/01/2021,n/a,rash\n3,05/01/2021,50,late report\n", "ISO-8859-1")
    _write(os.path.join(d, "2021VAERSSYMPTOMS.csv"),
           "VAERS_ID,SYMPTOM1,SYMPTOM2,SYMPTOM3,SYMPTOM4,SYMPTOM5\n"
           "1,Pyrexia,Headache,,,\n2,Rash,,,,\n1,Chills,,,,\n3,Pain,,,,\n", "utf-8")
    _write(os.path.join(d, "2021VAERSVAX.csv"),
           "VAERS_ID,VAX_MANU,VAX_TYPE\n1,PFIZER\\BIONTECH,COVID19\n1,MODERNA,COVID19\n2,JANSSEN,COVID19\n"
           "3,MODERNA,COVID19\n", "ISO-8859-1")
    rows = {r.VAERS_ID: r for r in ingest_folder(spark, d, IngestConfig()).collect()}
    # key 2 has no Pfizer / Moderna row; key 3 is past the date bound
    assert set(rows) == {"1"}
    r = rows["1"]
    assert r.VAX_MANU == "PFIZER\\BIONTECH"          # first matching row in file order
    assert r.SYMP == "Pyrexia,Headache,Chills" and r.COUNT_SYMPT == 3
    assert str(r.RECVDATE) == "2021-01-15"
