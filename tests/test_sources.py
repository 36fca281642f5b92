import json
import os

import pytest
from pyspark.sql import functions as F

from finsieve.functions import cleaning as C
from finsieve.functions import encoding as E
from finsieve.operators import features as FT
from finsieve.operators import labels as L
from finsieve.operators.audit import daily_volume
from finsieve.operators.datasets import build_dataset
from finsieve.operators.splitting import split_chronological, split_manifest
from finsieve.schema import FEATURES, RAW_COLUMNS
from finsieve.sources import patterns as P
from finsieve.sources import run_records as RR
from finsieve.sources import stored
from finsieve.sources import transactions as X
from finsieve.streaming.ingest import load_incrementally

HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
LINES = [
    "2022/09/01 00:20,011, 8000EBD30 ,003,8000EBD31,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0",
    "2022/09/01 00:26,11,8000F4580,001,8000F5340,n/a,US Dollar,0.01,US Dollar,Cheque,1",
    "bad,11,8000F4580,001,8000F5340,1,US Dollar,0.01,US Dollar,Cheque,1",
    "2022/09/04 10:00,,A,001,B,5,Euro,0,Euro,ACH,maybe",
]


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "trans.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def test_transactions_with_a_repeated_header(spark, csv):
    rows = X.load_transactions(spark, csv).orderBy("timestamp").collect()
    assert X.load_transactions(spark, csv).columns == RAW_COLUMNS
    assert [r["from_bank"] for r in rows] == ["011", "11", None]
    assert rows[0]["from_account"] == "8000EBD30" and rows[0]["to_account"] == "8000EBD31"
    assert rows[1]["amount_received"] is None and rows[1]["is_laundering_csv"] == 1
    assert rows[2]["is_laundering_csv"] == 0
    q = C.timestamp_quality(X.scan_raw(spark, csv)).first()
    assert (q["n_rows"], q["n_kept"], q["n_dropped"]) == (4, 3, 1)


def test_incremental_load_equals_batch(spark, csv, tmp_path):
    folder, table, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text("\n".join([HEADER, LINES[i]]) + "\n")
    run = lambda: load_incrementally(spark, str(folder), str(table), str(state), 1).awaitTermination(120)
    run()
    (folder / "3.csv").write_text("\n".join([HEADER, LINES[3]]) + "\n")
    run()
    batch = C.ground_truth_labels(X.load_transactions(spark, csv))
    loaded = spark.read.parquet(str(table)).select(*batch.columns)
    assert loaded.count() == 3
    assert loaded.exceptAll(batch).count() == 0 == batch.exceptAll(loaded).count()


def test_accounts_drop_empty_rows_and_last_duplicate_wins(spark, tmp_path):
    path = tmp_path / "accounts.csv"
    path.write_text(
        "Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n"
        "B,1,A1,E1,Corporation #1\nB,1,A2,E2,Partnership #2\n,,,,\nB,2, A1 ,E3,Sole Proprietorship #3\nB,2,A4,E4,\n"
    )
    accounts = X.load_accounts(spark, str(path))
    assert accounts.count() == 4
    types = {r["account"]: r["entity_type"] for r in FT.entity_types(accounts).collect()}
    assert types == {"A1": 2, "A2": 1, "A4": 2}


def test_pattern_file(spark, tmp_path):
    row = LINES[0].replace(" 8000EBD30 ", "8000EBD30")
    path = tmp_path / "patterns.txt"
    path.write_text(
        "\n".join(
            [
                LINES[3],
                "BEGIN LAUNDERING ATTEMPT - FAN-IN:  Max 3-degree Fan-In", row, row + ",extra", "",
                "END LAUNDERING ATTEMPT - FAN-IN", "",
                "BEGIN LAUNDERING ATTEMPT", LINES[1], LINES[2], "END LAUNDERING ATTEMPT",
                "BEGIN LAUNDERING ATTEMPT - STACK", LINES[1].replace(",0.01,", ","),
            ]
        )
    )
    got = P.parse_patterns(spark, str(path)).orderBy("pattern_block_id").collect()
    # a line with too few fields keeps its place, its last fields are missing
    assert [(r["pattern_type"], r["pattern_block_id"]) for r in got] == [("UNKNOWN", 0), ("FAN-IN", 1), ("UNKNOWN", 2), ("STACK", 3)]
    assert all(r["is_laundering_csv"] == 1 for r in got)
    assert got[1]["amount_paid"] == 3697.34
    assert [(r["surplus_fields"], r["bad_timestamp"]) for r in P.dropped_lines(spark, str(path)).collect()] == [(1, 1)]


def test_pattern_file_read_in_pieces(spark, tmp_path):
    path = tmp_path / "long.txt"
    lines, want = [], []
    for b in range(40):
        lines.append(f"BEGIN LAUNDERING ATTEMPT - T{b}: x")
        for i in range(b % 7 + 1):
            lines.append(LINES[0])
            want.append((f"T{b}", b + 1))
        lines.append(f"END LAUNDERING ATTEMPT - T{b}")
    path.write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        got = P.parse_patterns(spark, str(path)).select("pattern_type", "pattern_block_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(tuple, got)) == sorted(want)


def test_match_keys(spark):
    df = spark.createDataFrame(
        [("2022-09-01 00:20:59", " 011", "AB", "3 ", "cd", 5326.7, "US Dollar", None), (None, "1", "a", "2", "b", 1.0, "x", "y"), ("2022-09-01 00:20:00", "1", "a", "2", "b", None, "x", "y")],
        "t string, from_bank string, from_account string, to_bank string, to_account string, amount_paid double, payment_currency string, payment_format string",
    ).withColumn("timestamp", F.col("t").cast("timestamp"))
    keys = [r["k"] for r in df.select(C.match_key().alias("k")).collect()]
    assert keys == ["2022-09-01 00:20|011|ab|3|cd|5326.70|us dollar|nan", None, None]


def test_labels_without_patterns(spark, csv):
    rows = L.create_labels(X.load_transactions(spark, csv)).collect()
    assert {(r["label_from_patterns"], r["mismatch_flag"], r["pattern_type"], r["pattern_block_id"]) for r in rows} == {(0, 0, "NONE", -1)}
    assert all(r["label"] == r["label_existing_csv"] == r["is_laundering_csv"] for r in rows)


def test_empty_days_are_listed(spark):
    df = spark.createDataFrame([("2022-09-01 10:00", 1), ("2022-09-01 11:00", 0), ("2022-09-04 01:00", 0)], "t string, label int")
    got = daily_volume(df.withColumn("timestamp", F.col("t").cast("timestamp"))).orderBy("day").collect()
    assert [(r["total"], r["illicit"], r["illicit_ratio"]) for r in got] == [(2, 1, 0.5), (0, 0, None), (0, 0, None), (1, 0, 0.0)]


def test_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    codes = E.fit_codes(train, "c")
    assert {r["category"]: r["code"] for r in codes.collect()} == {"a": 0.0, "b": 1.0, "nan": 2.0}
    other = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    assert {r["c"]: r["k"] for r in E.apply_codes(other, codes, "c", "k").collect()} == {"a": 0.0, "zz": None, None: 2.0}
    both = E.encode(other.withColumn("d", F.lit("b")), E.fit_encoder(train.withColumn("d", F.col("c")), ["c", "d"]), ["c", "d"])
    assert {(r["c_code"], r["d_code"]) for r in both.collect()} == {(0.0, 1.0), (None, 1.0), (2.0, 1.0)}


def test_feature_table_and_its_store(spark, csv, tmp_path):
    base = L.create_labels(X.load_transactions(spark, csv)).withColumn("row_idx", F.unix_micros("timestamp") % 7)
    base = base.withColumn("split", F.when(F.col("is_laundering_csv") == 1, "val").otherwise("train"))
    accounts = spark.createDataFrame([("A", "Corporation", 1)], "account_number string, entity_name string, file_pos int")
    table = FT.feature_table(base, accounts)
    assert table.columns == ["row_idx", "split", "label", *FEATURES]
    path = str(tmp_path / "features")
    assert not stored.has_features(spark, path, "val")
    stored.save_features(table, path)
    assert stored.has_features(spark, path, "val") and not stored.has_features(spark, path, "test")
    assert stored.load_features(spark, path, "val").count() == 1
    row = table.filter("from_account IS NOT NULL" if "from_account" in table.columns else "amount_ratio = 1.0").first()
    assert row["amount_ratio"] == 1.0
    with pytest.raises(ValueError):
        FT.feature_table(base.drop("amount_paid"), accounts)


def test_split_manifest(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("row_idx"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.timestamp_seconds("id").alias("timestamp"))
    split = split_chronological(df)
    stored.save_json(split_manifest(split), str(tmp_path / "m"))
    got = spark.read.json(str(tmp_path / "m")).first()
    assert {s["split"]: (s["n_rows"], s["n_positive"]) for s in got["splits"]} == {"train": (70, 7), "val": (15, 2), "test": (15, 1)}
    assert got["test_ratio"] == 0.15


def test_score_table_checks(spark, tmp_path):
    good = spark.range(50).select(F.col("id").alias("row_idx"), (F.col("id") / 50).alias("score"))
    for name, df, ok in (
        ("good", good, True),
        ("gap", good.filter("row_idx <> 7"), False),
        ("twice", good.withColumn("row_idx", F.when(F.col("row_idx") == 7, 8).otherwise(F.col("row_idx"))), False),
    ):
        path = str(tmp_path / name)
        stored.save_scores(df, path)
        if ok:
            assert dict(stored.load_scores(spark, path).dtypes) == {"row_idx": "bigint", "score": "float"}
        else:
            with pytest.raises(ValueError):
                stored.load_scores(spark, path)
    a, b = (stored.score_checksum(good.repartition(n)).first() for n in (1, 7))
    assert a == b != stored.score_checksum(good.withColumn("score", F.col("score") + 0.01)).first()


def test_run_folders(spark, tmp_path):
    root = str(tmp_path / "runs")
    config = {"run_id": "xgboost__baseline__p001__1", "model": "xgboost", "strategy": "baseline", "target_prevalence": 0.001, "feature_names": ["a"], "class_weight_used": None}
    metrics = {"pr_auc": 0.1, "roc_auc": 0.9, "precision": 0.2, "recall": 0.3, "f1": 0.24, "weighted_accuracy": 0.6, "tp": 3.0, "fp": 12.0, "tn": 80.0, "fn": 7.0, "threshold": 0.5}
    RR.save_run(spark, root, config, {"val": metrics, "test": metrics, "test_thresh": {**metrics, "recall": 0.5}}, {"criterion": "f1", "optimal_threshold": 0.25})
    RR.save_run(spark, root, {**config, "run_id": "xgboost__smote__p010__2", "strategy": "smote", "class_weight_used": {"0": 1.0, "1": 9.0}}, {"val": metrics}, None)
    RR.save_run(spark, root, {"run_id": "other"}, {}, None)
    board = {r["run_id"]: r for r in RR.scan_run_records(spark, root).collect()}
    assert set(board) == {"xgboost__baseline__p001__1", "xgboost__smote__p010__2"}
    a, b = board["xgboost__baseline__p001__1"], board["xgboost__smote__p010__2"]
    assert (a["recall_test"], a["recall_test_thresh"], a["f2_test"], a["optimal_threshold"]) == (0.3, 0.5, None, 0.25)
    assert b["pr_auc_val"] == 0.1 and b["pr_auc_test"] is None and b["optimal_threshold"] is None
    assert [r["run_id"] for r in RR.completed_runs(spark, root).collect()] == ["xgboost__baseline__p001__1"]
    folder = os.path.join(root, "xgboost__baseline__p001__1")
    assert json.load(open(os.path.join(folder, "metrics_test.json")))["tp"] == 3.0
    assert open(os.path.join(folder, "metrics_test.csv")).read().startswith("pr_auc,roc_auc")


def test_small_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", 0.5, 2)], "feature string, importance double, n_runs int")
    stored.save_importances(df, df, df, df, str(tmp_path / "imp"))
    assert len(os.listdir(tmp_path / "imp")) == 4
    back = spark.read.csv(str(tmp_path / "imp" / "feature_importance_rf_mean"), header=True)
    assert back.columns == ["feature", "importance", "n_runs"]
    sub = spark.createDataFrame([(0, 5)], "row_idx bigint, orig_row_idx bigint")
    stored.save_row_mapping(sub, str(tmp_path / "map"))
    assert stored.load_parquet(spark, str(tmp_path / "map"), ["orig_row_idx"]).first()[0] == 5


def test_dataset_in_one_call(spark, tmp_path):
    lines = [f"2022/09/{1 + i // 4:02d} 00:{i % 4:02d},011,A{i},003,B{i},5.00,Euro,5.00,Euro,ACH,{int(i % 10 == 3)}" for i in range(40)]
    # one part holds the late rows, and a line without a readable time
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([HEADER, *lines[20:], LINES[2]]) + "\n")
    (tmp_path / "in" / "b.csv").write_text("\n".join([HEADER, *lines[:20]]) + "\n")
    (tmp_path / "patterns.txt").write_text(f"{C.BEGIN_MARKER} - FAN-IN\n{lines[3]}\n{C.END_MARKER}\n")
    (tmp_path / "accounts.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nx,1,A1,E1,Corporation 1\n,,,,\n")
    made = build_dataset(spark, str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "accounts.csv"), str(tmp_path / "patterns.txt"))
    total = made.summary.first()
    assert (total["n_rows"], total["n_illicit_csv"], total["n_illicit_patterns"], total["n_mismatch"], total["n_accounts"]) == (40, 4, 1, 3, 1)
    assert [made.split(s).count() for s in ("train", "val", "test")] == [28, 6, 6]
    assert [r["from_account"] for r in made.rows.orderBy("row_idx").collect()] == [f"A{i}" for i in range(40)]
    assert made.rows.filter("label_from_patterns = 1").first()["pattern_type"] == "FAN-IN"
    manifest = spark.read.json(str(tmp_path / "out" / "split_manifest")).first()
    assert manifest["test_ratio"] == 0.15 and sorted(s["n_rows"] for s in manifest["splits"]) == [6, 6, 28]
    # without pattern and account files
    plain = build_dataset(spark, str(tmp_path / "plain"), str(tmp_path / "in")).summary.first()
    assert (plain["n_rows"], plain["n_illicit_patterns"], plain["n_accounts"]) == (40, 0, None)
    with pytest.raises(FileNotFoundError, match="nowhere"):
        build_dataset(spark, str(tmp_path / "none"), str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        build_dataset(spark, str(tmp_path / "none"), str(tmp_path / "in"), train_ratio=0.9, val_ratio=0.1)
    assert not (tmp_path / "none").exists()
