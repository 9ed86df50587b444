import pytest
from pyspark.sql import functions as F

from tillflow.functions.expressions import parse_number, spark_pattern
from tillflow.operators import cleaning, cohort as C, splits as S, windows as W
from tillflow.sources import tables
from tillflow.sources.raw import ExportSection, read_raw

TX = "customer_id long, date string, amount double, mcc int, seq long"


def ids(df):
    return sorted(r["customer_id"] for r in df.collect())


def test_merchant_codes(spark):
    codes = [5411, 5462, 5812, 5814, 5541, 5542, 5983, 5651, 5137, 5941, 4812]
    got = tables.map_categories(spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, mcc int")).orderBy("i")
    assert [r["code"] for r in got.collect()] == [2, 2, 3, 3, 1, 1, 1, 0, 0, 0, 3]


def test_override_map_replaces_the_default(spark):
    got = tables.map_categories(spark.createDataFrame([(5411,), (5651,)], "mcc int"), tables.code_table(spark, {"Gas stations": [5411]}))
    assert {r["mcc"]: r["category"] for r in got.collect()} == {5411: "Gas stations", 5651: "Other"}


def test_cohort_rules(ladder):
    assert ids(C.eligible_customers(ladder)) == [20]
    assert ids(C.eligible_customers(ladder, min_distinct=3)) == [20] and ids(C.eligible_customers(ladder, min_distinct=4)) == []
    assert ids(C.eligible_customers(ladder, min_distinct=1)) == [20, 31]


def test_filter_does_not_look_at_the_target_or_behind_the_window(spark):
    codes = [5411, 5651, *[5541] * 9, 5651]                                # rn 12 and 11 lie behind the window, rn 1 is the target
    tx = tables.load_transactions(spark.createDataFrame([(57, f"2020-0{1 + i // 4}-{10 + i % 4}", 1.0, c, i) for i, c in enumerate(codes)], TX))
    assert ids(C.eligible_customers(tx)) == [] and ids(C.eligible_customers(tx, min_distinct=1)) == [57]
    assert ids(C.eligible_customers(tx, on_inputs=False)) == [57] and ids(C.eligible_customers(tx, on_inputs=False, min_distinct=3)) == []


def test_windows_hold_length_plus_one(ladder):
    w = {r["customer_id"]: r for r in W.last_windows(ladder, 9).collect()}
    assert sorted(w) == [20, 31] and w[31]["codes"] == [1] * 9
    assert w[20]["codes"] == [3, 0, 0, 3, 2, 2, 0, 3, 3] and w[20]["target"] == 2
    assert [W.last_windows(ladder, x).count() for x in (8, 10, 12, 13)] == [3, 1, 1, 0]


def test_many_lengths_equal_single_lengths(ladder):
    many = {(r["customer_id"], r["length"]): r["codes"] for r in W.windows_at(ladder, (4, 9)).collect()}
    for x in (4, 9):
        for r in W.last_windows(ladder, x).collect():
            assert many.pop((r["customer_id"], x)) == r["codes"]
    assert not many


def test_untimed_purchase_comes_first_on_its_day(spark):
    rows = [(7, "2014-01-02", "09:00:00", 3.0, 5411, 1), (7, "2014-01-02", None, 4.0, 5411, 2),
            (7, "2014-01-01", "23:00:00", 1.0, 5411, 3), (7, "2014-01-02", "21:00:00", 2.0, 5411, 4)]
    tx = tables.load_transactions(spark.createDataFrame(rows, "customer_id long, date string, time string, amount double, mcc int, seq long"))
    got = tables.rank_in_customer(tx, 10).orderBy(F.desc("rn")).collect()
    assert [r["amount"] for r in got] == [1.0, 4.0, 3.0, 2.0]


def test_ties_on_the_last_day(spark):
    rows = [(1, "2014-07-01", 1.0, 5411, 1), (1, "2014-07-02", 1.0, 5411, 2), (1, "2014-07-02", 1.0, 5541, 3),
            (2, "2014-07-01", 1.0, 5411, 4), (2, "2014-07-03", 1.0, 5411, 5), (3, "2014-07-05", 1.0, 5411, 6), (3, "2014-07-05", 1.0, 5411, 7)]
    tx = tables.load_transactions(spark.createDataFrame(rows, TX))
    assert C.tie_report(tx).collect()[0].asDict() == {"customers": 3, "tied_last_date": 2, "tied_share": 2 / 3, "tied_with_different_classes": 1}
    assert ids(C.tied_customers(tx)) == [1, 3]


def test_hot_customer_gives_the_same_window(spark, ladder):
    """One customer with two thirds of all rows: every task keeps ten of its rows before the shuffle."""
    hot = spark.range(5000).select(F.expr("IF(id % 3 = 0, id, 9999)").alias("customer_id"), F.expr("date_add(date'2013-01-01', cast(id % 500 as int))").alias("date"),
                                   F.lit(1.0).alias("amount"), (F.lit(5411) + F.col("id") % 2 * 130).cast("int").alias("mcc"), (F.col("id") + 1000).alias("seq"))
    tx = tables.load_transactions(hot.repartition(8))
    w = W.last_windows(tx, 9).collect()
    assert len(w) == 1 and len(w[0]["codes"]) == 9
    plan = W.last_windows(tx, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_draws_are_exact_and_reproducible(spark):
    base = spark.range(1000).withColumnRenamed("id", "customer_id")
    a = ids(S.draw(base, 137))
    assert len(a) == 137 and a == ids(S.draw(base.repartition(13), 137)) and a != ids(S.draw(base, 137, seed=1))
    assert ids(S.draw(base, 5000)) == list(range(1000)) and ids(S.draw(base, 0)) == []
    parts = S.train_val_split(base, 0.2501).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"val": 251, "train": 749}
    rest = ids(S.draw_excluding(base, 400, base.where("customer_id < 700")))
    assert rest == list(range(700, 1000))


def test_split_recipe_is_disjoint_and_guarded(spark):
    rows = [(c, f"2014-07-{d:02d}", 1.0, 5411 if (c + d) % 3 else 5541, c * 100 + d) for c in range(60) for d in range(1, 13)]
    tx = tables.load_transactions(spark.createDataFrame(rows, TX))
    dev = spark.range(10).withColumnRenamed("id", "customer_id")
    a = S.prepare_splits(tx, None, tx, None, dev, dev, pool_size=30, in_bank_test=20)
    n = {r["split"]: r["customers"] for r in S.split_summary(a).collect()}
    assert n == {"train": 24, "val": 6, "bank_a_test": 20, "bank_b_dev": 10, "bank_b_confirm": 50, "bank_b_unfiltered": 50}
    S.require_no_leakage(a, dev)
    leak = a.unionByName(a.where("split = 'train'").withColumn("split", F.lit("val")))
    with pytest.raises(ValueError, match="train and val"):
        S.require_no_leakage(leak, dev)


def test_price_index_month_must_exist(spark, ladder):
    table = spark.createDataFrame([(f"2019-{m:02d}", 100.0 + 10 * m) for m in range(1, 13)], "month string, index double")
    got = {str(r["date"]): r["amount"] for r in tables.deflate(ladder, table, "2019-05").where("customer_id = 44").collect()}
    assert abs(got["2019-03-01"] - 5.0 * 150 / 130) < 1e-12 and abs(got["2019-05-20"] - 10.0) < 1e-12
    for month in ("2019-05", "2019-09"):
        with pytest.raises(Exception, match="price index missing"):
            tables.deflate(ladder, table.where(f"month <> '{month}'"), "2019-05").collect()


def test_numbers_and_patterns(spark):
    texts = [" 21,55", "7d", "NaN", "1e3", "-,5", "1.000,5", "", None, "12."]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_number(F.col("t"), ",").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [21.55, None, None, 1000.0, -0.5, None, None, None, 12.0]
    assert spark_pattern("%m/%d/%Y") == "M/d/yyyy" and spark_pattern("%Y-%m-%dT%H:%M") == "yyyy-M-d'T'H:m"
    with pytest.raises(ValueError):
        spark_pattern("%Q")


# two files of one pattern with their columns in different places, a long line, a short line, blank and quoted fields
MAY = ("when;at;who;paid;kind;note;shop\n03.05.2021;08:15;71;12,4;5411;bread;'A; B'\n03.05.2021;;71;7;5541;fuel;C\n04.05.2021;23:59;72;1,25;5651;coat;D;surplus;fields\n"
       "torn line;x\n05.05.2021;12:00;72;3;4812;;E\n")
JUNE = "paid;who;shop;kind;when;at;note\n99,99;71;F;5651;01.06.2021;10:00;shoes\n5;73;G;5999;31.06.2021;10:00;no such day\n"
PEOPLE = "who|years|sex|bond|school|work|pay\n71|35|f|wed|uni|clerk|2100,5\n72|61|m|alone|uni|baker|\n torn\n73|28|m|wed|uni|judge|900\n"


def sections(folder, **options):
    tx = ExportSection.from_dict({"files": [str(folder / "p_*.dat")], "read_csv": {"sep": ";", "quotechar": "'", "encoding": "latin-1", **options},
                                  "columns": {"customer_id": "who", "date": "when", "time": "at", "amount": "paid", "mcc": "kind"},
                                  "date_format": "%d.%m.%Y", "time_format": "%H:%M", "decimal": ",", "require": ["note"]})
    who = ExportSection.from_dict({"files": [str(folder / "people.dat")], "read_csv": {"sep": "|"}, "decimal": ",",
                                   "columns": {"customer_id": "who", "age": "years", "gender": "sex", "marital_status": "bond", "education": "school",
                                               "occupation": "work", "income": "pay"},
                                   "labels": {"gender": {"f": "female", "m": "male"}, "marital_status": {"wed": "married", "alone": "single"},
                                              "education": {"uni": "university"}, "occupation": {"clerk": "private sector employee", "*": "other occupation"}}})
    return tx, who


def raw_files(folder, people=PEOPLE):
    (folder / "p_1.dat").write_text(MAY, encoding="latin-1")
    (folder / "p_2.dat").write_text(JUNE, encoding="latin-1")
    (folder / "people.dat").write_text(people)


@pytest.mark.parametrize("options", [{}, {"on_bad_lines": "skip"}])
def test_raw_export_end_to_end(spark, tmp_path, options):
    raw_files(tmp_path)
    tx, who = sections(tmp_path, **options)
    raw = read_raw(spark, tx)
    out = cleaning.export_transactions(raw, tx).orderBy("seq").collect()
    assert [(r["customer_id"], r["date"], r["time"], r["amount"], r["mcc"]) for r in out] == [
        (71, "2021-05-03", "08:15:00", 12.4, 5411), (71, "2021-05-03", None, 7.0, 5541), (72, "2021-05-04", "23:59:00", 1.25, 5651), (71, "2021-06-01", "10:00:00", 99.99, 5651)]
    report = {r["item"]: r["value"] for r in cleaning.export_report(raw, tx).collect()}
    assert report == {"rows read": "7", "dropped: broken line": "1", "dropped: empty note": "1", "without a recorded time (kept)": "1",
                      "dropped: missing date, amount or code": "1", "rows written": "4", "customers": "2", "first date": "2021-05-03", "last date": "2021-06-01"}
    people = cleaning.export_demographics(read_raw(spark, who), who).orderBy("customer_id").collect()
    assert [(r["customer_id"], r["gender"], r["occupation"], r["income"]) for r in people] == [
        (71, "female", "private sector employee", 2100.5), (72, "male", "other occupation", None), (73, "male", "other occupation", 900.0)]
    assert ids(tables.complete_profiles(cleaning.export_demographics(read_raw(spark, who), who))) == [71, 73]


def test_raw_rows_do_not_hang_on_the_columns_read(spark, tmp_path):
    raw_files(tmp_path)
    tx, _ = sections(tmp_path)
    every = ExportSection(**{**tx.__dict__, "require": ("note", "shop")})
    key = lambda df: sorted((str(r["who"]), str(r["paid"])) for r in df.select("who", "paid").collect())
    assert key(read_raw(spark, every)) == key(read_raw(spark, tx)) and ("72", "1,25") in key(read_raw(spark, tx))
    assert sorted(str(r["shop"]) for r in read_raw(spark, every).select("shop").collect()) == ["A; B", "C", "D", "E", "F", "G", "None"]


def test_unlisted_labels_columns_and_options_stop_the_export(spark, tmp_path):
    raw_files(tmp_path, PEOPLE.replace("|f|", "|x|").replace("|alone|", "|apart|"))
    tx, who = sections(tmp_path)
    with pytest.raises(ValueError, match="gender 'x', marital_status 'apart'"):
        cleaning.export_demographics(read_raw(spark, who), who)
    with pytest.raises(ValueError, match="NOPE"):
        read_raw(spark, ExportSection(**{**tx.__dict__, "require": ("NOPE",)}))
    with pytest.raises(ValueError, match="nrows"):
        read_raw(spark, sections(tmp_path, nrows=1)[0])


def test_a_code_listed_twice_belongs_to_the_last_class(spark):
    codes = tables.code_table(spark, {"Clothing": [1, 2], "Gas stations": [2, 3]})
    got = tables.map_categories(spark.createDataFrame([(1,), (2,), (3,), (4,)], "mcc int"), codes).collect()
    assert sorted((r["mcc"], r["category"]) for r in got) == [(1, "Clothing"), (2, "Gas stations"), (3, "Gas stations"), (4, "Other")]


def test_time_of_day_decides_order_and_ties(spark):
    rows = [(1, "2020-02-02 18:30:00", 5.0, 5411, 1), (1, "2020-02-02 09:00:00", 6.0, 5541, 2), (1, "2020-02-01 20:00:00", 7.0, 5541, 3)]
    raw = spark.createDataFrame(rows, TX).withColumn("date", F.col("date").cast("timestamp_ntz"))
    tx = tables.load_transactions(raw)
    assert [r["amount"] for r in tables.rank_in_customer(tx).orderBy("rn").collect()] == [5.0, 6.0, 7.0]
    assert C.tie_report(tx).first()["tied_last_date"] == 0
    assert [r["amount"] for r in tables.rank_in_customer(tables.load_transactions(spark.createDataFrame(rows, TX))).orderBy("rn").collect()] == [6.0, 5.0, 7.0]


def test_filters_reach_the_scan_of_a_table(spark, tmp_path, ladder):
    ladder.select("customer_id", "date", "amount", "mcc").write.parquet(str(tmp_path / "t.parquet"))
    tx = tables.load_transactions(tables.read_table(spark, str(tmp_path / "t.parquet")))
    plan = tx._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan and tx.count() == 32


def test_file_digests_read_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    from tillflow.sources import manifest

    monkeypatch.setattr(manifest, "BLOCK", 7)
    (tmp_path / "sub dir").mkdir()
    for name, text in (("a.bin", b"x" * 100), ("sub dir/b.bin", b"")):
        (tmp_path / name).write_bytes(text)
    got = {r["path"]: r["sha256"] for r in manifest.file_digests(spark, str(tmp_path)).collect()}
    assert got == {str(tmp_path / n): hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.bin", "sub dir/b.bin")}


def test_read_table_and_terciles(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "b.csv").write_text("customer_id,date,amount,mcc\n1,2014-01-02,5,5411\n1,2014-01-02,6,5411\n")
    (folder / "a.csv").write_text("customer_id,date,amount,mcc\n1,2014-01-02,4,5411\n,2014-01-02,4,5411\n")
    tx = tables.load_transactions(tables.read_table(spark, str(folder)))
    assert [r["amount"] for r in tables.rank_in_customer(tx, 5).orderBy(F.desc("rn")).collect()] == [4.0, 5.0, 6.0]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="missing columns"):
        tables.load_transactions(spark.range(1))
    flat = spark.range(6).select(F.lit(1.0).alias("income"))
    with pytest.raises(Exception, match="not distinct"):
        tables.income_terciles(flat).collect()


def test_saved_splits_read_back(spark, tmp_path, ladder):
    assignment = spark.createDataFrame([(20, "train"), (31, "val"), (31, "train")], "customer_id long, split string")
    tables.save_splits(ladder, None, assignment, str(tmp_path))
    tx, people = tables.load_split(spark, str(tmp_path), "val")
    assert people is None and ids(tx.select("customer_id").distinct()) == [31] and tx.count() == 10
    assert ids(tables.load_split(spark, str(tmp_path), "train")[0].select("customer_id").distinct()) == [20, 31]


def test_filter_counts_and_overlap(spark, ladder):
    assignment = spark.createDataFrame([(20, "x"), (31, "x"), (44, "y")], "customer_id long, split string")
    got = {r["split"]: r for r in C.filter_counts(ladder, assignment).collect()}
    assert (got["x"]["single_at_4"], got["x"]["single_at_9"], got["x"]["customers"], got["x"]["tied"]) == (1, 1, 2, 0)
    assert got["y"]["single_at_9_pct"] is None
    row = S.overlap_of(spark.range(10).withColumnRenamed("id", "customer_id"), spark.range(5, 20).withColumnRenamed("id", "customer_id"), 100).collect()[0]
    assert (row["list_a"], row["list_b"], row["in_both"], row["expected"]) == (10, 15, 5, 1.5)


def test_cluster_must_name_its_checkpoint_folder(spark):
    from types import SimpleNamespace as N

    from tillflow.sources.session import durable, scratch_folder

    session = lambda folder: N(sparkContext=N(master="spark://head:7077", getConf=lambda: N(get=lambda key: folder)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(session(None))
    assert scratch_folder(session("hdfs://shared")) == "hdfs://shared"
    kept = durable(spark.range(5).withColumn("x", F.array("id")))
    assert sorted(r["x"][0] for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.inputFiles()
