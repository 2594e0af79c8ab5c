import pytest
from pyspark.sql import functions as F

from staywise.operators import contract
from staywise.telco import TELCO_CONTRACT, TOTAL_CHARGES_MEDIAN
from tests.fixtures import BASE, COLUMNS, ROWS, mutated, text_frame

ACCEPTED_FLAGS = ["0", "1", "0.0", "1.0", "yes", "Yes", "no", "No", "true", "FALSE", "y", "n", "t", " F "]
REJECTED_FLAGS = ["3", "0.25", "-2", "10", "perhaps", "", None, "yes!", "-inf"]


def accepted_ids(spark, rows):
    frame = text_frame(spark, rows)
    return {r["customerID"] for r in contract.accepted(frame, TELCO_CONTRACT, ["customerID"]).collect()}


def test_sample_batch_is_accepted(spark):
    clean = contract.accepted(text_frame(spark, ROWS), TELCO_CONTRACT, ["customerID"])
    assert clean.count() == len(ROWS)
    assert clean.columns == ["customerID", *TELCO_CONTRACT.required]
    assert dict(clean.dtypes)["TotalCharges"] == "double"


@pytest.mark.parametrize("values,kept", [(ACCEPTED_FLAGS, True), (REJECTED_FLAGS, False)])
def test_flag_spellings(spark, values, kept):
    rows = mutated([("SeniorCitizen", v) for v in values])
    assert accepted_ids(spark, rows) == ({r["customerID"] for r in rows} if kept else set())


def test_categories_outside_the_domain_are_rejected(spark):
    rows = mutated(
        [("Contract", "Five year"), ("Contract", "TWO YEAR"), ("InternetService", "Cable"), ("gender", "X"), ("Contract", None)]
    )
    assert accepted_ids(spark, rows) == set()
    report = {(r["feature"], r["value"]) for r in contract.bad_value_report(text_frame(spark, rows), TELCO_CONTRACT).collect()}
    assert report == {("Contract", "Five year"), ("Contract", "TWO YEAR"), ("InternetService", "Cable"), ("gender", "X")}


def test_infinity_is_rejected_everywhere(spark):
    rows = mutated([(c, v) for c in ("tenure", "MonthlyCharges", "TotalCharges") for v in ("inf", "-inf", "Infinity")])
    assert accepted_ids(spark, rows) == set()
    counts = {r["feature"]: r["infinite"] for r in contract.infinity_report(text_frame(spark, rows), TELCO_CONTRACT).collect()}
    assert counts == {"tenure": 3, "MonthlyCharges": 3, "TotalCharges": 3}


def test_only_the_imputable_number_may_be_missing(spark):
    rows = mutated([("TotalCharges", None), ("TotalCharges", "  "), ("TotalCharges", "abc"), ("tenure", None), ("MonthlyCharges", "")])
    assert accepted_ids(spark, rows) == {"case-0", "case-1", "case-2"}
    clean = contract.accepted(text_frame(spark, rows), TELCO_CONTRACT, ["customerID"])
    assert {r["TotalCharges"] for r in clean.collect()} == {TOTAL_CHARGES_MEDIAN}


@pytest.mark.parametrize(
    "value,number",
    [("500.0", 500.0), (" 70.5 ", 70.5), ("1e3", 1000.0), (".5", 0.5), ("7.", 7.0), ("+3", 3.0), ("1.0d", None), ("2f", None), ("0x1p3", None), ("1_000", None), ("12,5", None)],
)
def test_text_numbers(spark, value, number):
    clean = contract.accepted(text_frame(spark, mutated([("TotalCharges", value)])), TELCO_CONTRACT, ["customerID"])
    assert clean.first()["TotalCharges"] == (TOTAL_CHARGES_MEDIAN if number is None else number)


def test_nan_is_missing_and_typed_columns_work(spark):
    frame = text_frame(spark, [BASE]).withColumns(
        {"MonthlyCharges": F.lit(float("nan")), "tenure": F.lit(3), "SeniorCitizen": F.lit(1)}
    )
    assert contract.accepted(frame, TELCO_CONTRACT, ["customerID"]).count() == 0
    found = contract.findings(frame, TELCO_CONTRACT).collect()
    assert [(r["feature"], r["rule"]) for r in found] == [("MonthlyCharges", "missing")]


def test_missing_column_and_extra_columns(spark):
    with pytest.raises(contract.ContractViolation, match="tenure"):
        contract.accepted(text_frame(spark, ROWS).drop("tenure"), TELCO_CONTRACT)
    shuffled = text_frame(spark, ROWS, list(reversed(COLUMNS))).withColumn("extra", F.lit("x"))
    assert contract.accepted(shuffled, TELCO_CONTRACT).columns == list(TELCO_CONTRACT.required)


def test_strict_fails_the_whole_batch(spark):
    assert contract.strict(text_frame(spark, ROWS), TELCO_CONTRACT, ["customerID"]).count() == len(ROWS)
    rows = ROWS + mutated([("Contract", "Five year"), ("tenure", None)])
    with pytest.raises(contract.ContractViolation, match="Contract: unknown_value in 1") as caught:
        contract.strict(text_frame(spark, rows), TELCO_CONTRACT, ["customerID"])
    assert caught.value.report.count() == 2


def test_accepted_and_rejected_split_the_batch(spark):
    rows = ROWS + mutated([("SeniorCitizen", "perhaps"), ("MonthlyCharges", "inf"), ("Contract", None)])
    frame = text_frame(spark, rows)
    kept = contract.accepted(frame, TELCO_CONTRACT, ["customerID"]).select("customerID")
    refused = contract.rejected(frame, TELCO_CONTRACT, ["customerID"])
    assert kept.unionByName(refused.select("customerID")).distinct().count() == len(rows)
    assert kept.join(refused, "customerID").count() == 0
    assert refused.count() == 3
    assert refused.where(F.size("violations") == 0).count() == 0


def test_guard_reads_the_batch_once(spark, tmp_path):
    rows = ROWS + mutated([("Contract", "Five year"), ("tenure", None), ("SeniorCitizen", "perhaps")])
    frame = text_frame(spark, rows)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    guarded = contract.guard(frame.mapInArrow(counted, frame.schema), TELCO_CONTRACT, ["customerID"], str(tmp_path / "written"))
    assert guarded.records == {"accepted": len(ROWS), "refused": 3}
    assert guarded.broken == {("Contract", "unknown_value"): 1, ("tenure", "missing"): 1, ("SeniorCitizen", "unknown_value"): 1}
    assert guarded.accepted.count() == len(ROWS) and guarded.refused.where("size(violations) = 1").count() == 3
    assert seen.value == len(rows)
    plain = contract.accepted(frame, TELCO_CONTRACT, ["customerID"])
    assert guarded.accepted.columns == plain.columns and guarded.accepted.exceptAll(plain).count() == 0


def test_guard_of_an_empty_batch(spark):
    empty = text_frame(spark, ROWS).limit(0)
    guarded = contract.guard(empty, TELCO_CONTRACT)
    assert guarded.records == {"accepted": 0, "refused": 0} and guarded.refusal == contract.NO_RECORDS
    assert guarded.accepted.count() == guarded.refused.count() == 0
    with pytest.raises(contract.ContractViolation, match=contract.NO_RECORDS):
        contract.strict(empty, TELCO_CONTRACT)


def test_guard_counts_records_with_several_faults_once(spark):
    [row] = mutated([("Contract", "Five year")])
    guarded = contract.guard(text_frame(spark, ROWS + [row | {"tenure": None, "gender": "X"}]), TELCO_CONTRACT, ["customerID"])
    assert guarded.records["refused"] == 1 and len(guarded.broken) == 3
