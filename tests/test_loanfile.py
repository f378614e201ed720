import csv
import random

import pytest

from riskframe.operators.design import design_terms
from riskframe.plans import loanfile as LF
from riskframe.sources import loans as L

STATES = [s for states in L.LOAN_STATE_REGIONS.values() for s in states]


@pytest.fixture(scope="module")
def loan_csv(tmp_path_factory):
    """Sixty rows that meet every rule of the import."""
    rng = random.Random(1)
    extra = L.LOAN_DROP_COLUMNS
    header = ["id", *[c for c in extra if c != "id"], *L.LOAN_TEXT_COLUMNS, *LF.NUMBERS]
    header = list(dict.fromkeys(header))
    statuses = list(L.LOAN_STATUS_CLASSES)
    purposes = ["car", "house", "wedding", "renewable_energy", "moving", "vacation", "medical", "credit_card",
                "major_purchase", "small_business", "debt_consolidation", "other", "home_improvement"]
    rows = []
    for i in range(60):
        r = {c: f"{rng.uniform(1, 900):.2f}" for c in LF.NUMBERS}
        r |= {c: "x" for c in extra} | {"id": 1000 + i}
        r |= {"loan_status": statuses[i % 7], "term": [" 36 months", " 60 months"][i % 2], "purpose": purposes[i % 13],
              "emp_length": list(L.LOAN_EMP_LENGTH_YEARS)[i % 11], "addr_state": STATES[i % len(STATES)],
              "verification_status": ["Verified", "Source Verified", "Not Verified"][i % 3],
              "initial_list_status": "wf"[i % 2], "hardship_flag": "YN"[i // 2 % 2],
              "disbursement_method": ["Cash", "DirectPay"][i // 3 % 2], "grade": "ABC"[i % 3],
              "sub_grade": f"{'ABC'[i % 3]}{1 + i % 5}"}
        rows.append(r)
    rows[0]["loan_status"] = "Issued"
    for c in header[:61]:
        rows[1][c] = ""
    rows[2]["dti"] = "-1"
    rows[3]["total_rev_hi_lim"] = "9999999"
    rows[4]["total_rec_late_fee"], rows[5]["total_rec_late_fee"] = "-3.5", "0"
    rows[6]["purpose"] = "educational"
    rows[7]["dti"] = "not a number"
    rows[8]["emp_length"] = ""
    path = tmp_path_factory.mktemp("loans") / "accepted.csv"
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, header)
        w.writeheader()
        w.writerows(rows)
    return str(path)


def test_import_and_cleaning(spark, loan_csv):
    loans = LF.import_loans(spark, loan_csv)
    assert loans.count() == 59 and [f.name for f in loans.schema][1:] == [f.name for f in LF.RAW_SCHEMA]
    got = {r["loan_id"]: r for r in LF.cleaned_loan_file(loans).collect()}
    assert len(got) == 57 and not {1000, 1001, 1006} & set(got)
    assert got[1002]["dti"] == 0.0 and got[1003]["total_rev_hi_lim"] == 3_000_000.0
    assert got[1004]["total_rec_late_fee"] == 0.0 and got[1007]["dti"] is None and got[1008]["emp_length"] is None
    assert got[1011]["emp_length"] == 0 and got[1010]["emp_length"] == 10        # '< 1 year', '10+ years'
    assert {r["addr_state"] for r in got.values()} == set(L.LOAN_STATE_REGIONS)
    assert {r["term"] for r in got.values()} == {36, 60} and {r["y"] for r in got.values()} == {1, 2, 3}
    assert {r["verification_status"] for r in got.values()} == {"Verified", "Not Verified"}
    assert not {"wedding", "moving", "medical", "credit_card"} & {r["purpose"] for r in got.values()}


def test_prepared_inputs(spark, loan_csv):
    p = LF.prepared_loan_file(LF.import_loans(spark, loan_csv), remove_class1=5)
    assert p.features == L.LOAN_FEATURES and len(p.features) == 35
    rows = p.data.collect()
    assert len(rows) == 52 and all(v is not None for r in rows for v in r)
    train = [r for r in rows if r["split"] == "train"]
    for c in set(p.features) - set(L.LOAN_FIXED_SCALES):
        assert min(r[c] for r in train) == 0 and max(r[c] for r in train) <= 1
    with pytest.raises(Exception, match="smaller"):
        LF.prepared_loan_file(LF.import_loans(spark, loan_csv)).data.collect()


def test_column_roles():
    sizes = {k: (len(v.wide), len(v.deep), v.n_beta(), len(design_terms(v.wide))) for k, v in LF.PRESETS.items()}
    assert sizes == {"MNL": (35, 0, 72, 72), "H1": (28, 7, 58, 58), "H2": (9, 26, 20, 20), "H3": (4, 31, 10, 10)}
    assert all(sorted(v.wide + v.deep) == sorted(L.LOAN_FEATURES) for v in LF.PRESETS.values())
    assert len(L.LOAN_DROP_CORRELATED) == 44
