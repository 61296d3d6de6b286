"""J4 end to end on a small table shaped like the reference's merged table."""

import datetime as dt

from sparkprep.plans.preprocess import PreprocessConfig, audit_preprocess, preprocess

D = dt.date
ROWS = [
    # id, age, vax, onset, symp, history, admin, died, hosp, sex, count
    (1, 40.0, D(2021, 1, 10), D(2021, 1, 12), "Headache,Chest pain", "Hypertension", "SEN", "Y", None, "F", 2),
    (2, 8.0, D(2021, 1, 10), D(2021, 1, 11), "Rash", None, "PVT", None, None, "M", 1),
    (3, None, D(2021, 1, 10), D(2021, 1, 11), "Rash", None, "PVT", None, None, "M", 1),
    (4, 30.0, D(2021, 1, 10), D(2021, 1, 1), "Fatigue", "none", None, None, "Y", "M", 25),
    (5, 50.0, D(2021, 1, 10), D(2021, 1, 30), "Wrong product administered", "asthma", "PVT", None, None, "U", 1),
    (6, 60.0, D(2021, 1, 10), D(2021, 1, 11), "Dizziness", "no", "PVT", None, None, "F", 1),
]
SCHEMA = ("VAERS_ID long, AGE_YRS double, VAX_DATE date, ONSET_DATE date, SYMP string, HISTORY string, "
          "V_ADMINBY string, DIED string, HOSPITAL string, SEX string, COUNT_SYMPT int")

CFG = PreprocessConfig(
    lowercase=("SYMP", "HISTORY"),
    error_rules={"AGE_YRS": ["<", 12]},
    symptom_col="SYMP",
    symptom_errors=("Wrong product administered",),
    drop_na=("AGE_YRS",),
    impute={"DIED": "N", "HOSPITAL": "N"},
    interval={"NUMDAYS_CAL": ["ONSET_DATE", "VAX_DATE"]},
    none_synonyms={"HISTORY": ["none", "no"]},
    history_col="HISTORY",
    history_flags={"HYPERTENSION": ["hypertension", "htn"]},
    symptom_flags={"SYMP_CARDIAC": ["chest pain", "cardiac"]},
    indicator=("V_ADMINBY", "SEN", "NUR_HOME"),
    composite=("DIED", "HOSPITAL", "SYMP_CARDIAC"),
    target="TARGET",
    replace={"SEX": {"U": 0, "F": 0, "M": 1}},
    clip={"NUMDAYS_CAL": 10, "COUNT_SYMPT": 20},
    drop_cols=("SYMP", "HISTORY", "V_ADMINBY", "DIED", "HOSPITAL", "VAX_DATE", "ONSET_DATE", "composite"),
)


def test_preprocess_end_to_end(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    vis, mod = preprocess(df, CFG)
    v = {r.VAERS_ID: r for r in vis.collect()}
    # 2: age < 12 dropped; 3: NULL age survives the rule but is dropped as missing;
    # 5: error symptom dropped
    assert set(v) == {1, 4, 6}
    assert v[1].NUMDAYS_CAL == 2 and v[4].NUMDAYS_CAL == 0          # onset before vaccination repaired
    assert (v[1].HISTORY_DUM, v[4].HISTORY_DUM, v[6].HISTORY_DUM) == (1, 0, 0)
    assert (v[1].HYPERTENSION, v[4].HYPERTENSION) == (1, 0)
    assert (v[1].SYMP_CARDIAC, v[6].SYMP_CARDIAC) == (1, 0)
    assert (v[1].NUR_HOME, v[4].NUR_HOME, v[6].NUR_HOME) == (1, None, 0)
    assert (v[1].TARGET, v[4].TARGET, v[6].TARGET) == ("Yes", "Yes", "No")
    m = {r.VAERS_ID: r for r in mod.collect()}
    assert m[4].COUNT_SYMPT == 20 and m[1].SEX == 0 and m[4].SEX == 1
    assert "SYMP" not in mod.columns and "composite" not in mod.columns
    steps = {r.step: r.rows for r in audit_preprocess(df, CFG).collect()}
    assert steps["drop AGE_YRS < 12"] == 1 and steps["null AGE_YRS"] == 1
    assert steps["drop SYMP matching"] == 1            # matched after lowercasing, as in clean()
    assert steps["replace ONSET_DATE < VAX_DATE"] == 1
