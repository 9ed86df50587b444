"""Reading files: records cut by many tasks, columns by name, listings and digests."""
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tillflow.sources import manifest, predictions, raw as R, records as K, stores, tables

CSV = ('key,note,n\n1,plain,10\n2,"two\nlines, with ""quotes""\n",20\n\n3,"",30\r\n4,"' + "long " * 60 + '\nend",40\n5,"a\n\n\nb",50\n6,last without end,60')


def files(spark, *paths):
    return R.files_of(spark, list(map(str, paths)) if len(paths) > 1 else str(paths[0]))


def cut(text, quote):
    """Records of a text, one character after the other."""
    out, now, inside = [], "", False
    for c in text:
        now += c
        inside ^= c == quote
        if c == "\n" and not inside:
            out.append(now)
            now = ""
    return [r.removesuffix("\n").removesuffix("\r") for r in out + [now] * bool(now)]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("quote", [None, '"'])
def test_records_do_not_hang_on_the_blocks(spark, tmp_path, block, quote):
    (tmp_path / "a.txt").write_bytes(CSV.encode())
    (tmp_path / "b.txt").write_bytes(b"\n\nx\n")
    rows, strays = K.records(files(spark, tmp_path / "*.txt"), quote, block=block)
    got = sorted((r["path"][-5:], r["row"], r["record"]) for r in rows.collect())
    assert got == [("a.txt", i, t) for i, t in enumerate(cut(CSV, quote))] + [("b.txt", i, t) for i, t in enumerate(["", "", "x"])]
    assert strays is None or strays.count() == 0


def test_one_file_goes_to_many_tasks_and_equals_the_reading_in_one(spark, tmp_path, monkeypatch):
    body = "".join(f'{i},"text {i}\n{"x" * (i % 50)}",{i * 3}\n' for i in range(3000))
    (tmp_path / "big.csv").write_text("key,note,n\n" + body)
    monkeypatch.setattr(K, "BLOCK", 4096)
    section = R.ExportSection(files=(str(tmp_path / "big.csv"),), columns={"a": "key", "b": "note", "c": "n"}, read_csv={"multi_line": True})
    rows = R.read_raw(spark, section)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "big.csv"))
    key = lambda df: sorted(map(tuple, df.select("key", "note", "n").collect()))
    assert key(rows) == key(whole) and rows.rdd.getNumPartitions() > 8
    ordered = rows.orderBy("seq").select("key").collect()
    assert [int(r["key"]) for r in ordered] == list(range(3000))


def test_a_stray_quote_sends_the_file_to_the_reader_of_whole_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,note\n1,5" pipe\n2,"two\nlines"\n')
    (tmp_path / "b.csv").write_text('key,note\n3,"fine\nhere"\n')
    section = R.ExportSection(files=(str(tmp_path / "*.csv"),), columns={"a": "key", "b": "note"}, read_csv={"multi_line": True})
    assert sorted((r["key"], r["note"]) for r in R.read_raw(spark, section).collect()) == [("1", '5" pipe'), ("2", "two\nlines"), ("3", "fine\nhere")]


def test_packed_files_and_wide_encodings(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"key,note\n1,x\n"))
    (tmp_path / "b.csv").write_text("note,key\ny,2\n", encoding="utf-8")
    section = R.ExportSection(files=(str(tmp_path / "a*"), str(tmp_path / "b*")), columns={"a": "key", "b": "note"})
    assert sorted((r["key"], r["note"], r["seq"]["list"]) for r in R.read_raw(spark, section).collect()) == [("1", "x", 0), ("2", "y", 1)]
    (tmp_path / "c.dat").write_text("key,note\n3,ž\n", encoding="utf-16")
    wide = R.ExportSection(files=(str(tmp_path / "c.dat"),), columns={"a": "key", "b": "note"}, read_csv={"encoding": "utf-16"})
    assert [(r["key"], r["note"]) for r in R.read_raw(spark, wide).collect()] == [("3", "ž")]


def test_skipped_rows_comments_and_missing_headers(spark, tmp_path):
    (tmp_path / "a.dat").write_text("made by x\nmade on y\nkey,note\n1,x\n2,y\n")
    (tmp_path / "b.dat").write_text("3,z\n4,w\n")
    (tmp_path / "c.dat").write_text("# one\nkey,note\n# two\n5,v\n")
    read = lambda name, **o: sorted((r["key"], r["note"]) for r in R.read_raw(spark, R.ExportSection(files=(str(tmp_path / name),), columns={"a": "key", "b": "note"}, read_csv=o)).collect())
    assert read("a.dat", skiprows=2) == [("1", "x"), ("2", "y")]
    assert read("b.dat", header=None, names=["key", "note"]) == [("3", "z"), ("4", "w")]
    assert read("c.dat", comment="#") == [("5", "v")]
    with pytest.raises(ValueError, match="names"):
        read("b.dat", header=None)


def test_columns_of_a_folder_go_by_name_and_dates_by_row(spark, tmp_path):
    (tmp_path / "1.csv").write_text("customer_id,date,amount,mcc\n7,2020-03-01,1.5,5411\n7,,2,5411\nx,2020-03-02,1,5411\n")
    (tmp_path / "2.csv").write_text("customer_id,mcc,amount,date\n7,5651,2.5,2020-03-01 09:15:00\n8,5541,nothing,2020-03-04\n")
    table = tables.read_table(spark, str(tmp_path))
    got = sorted((r["mcc"], str(r["date"]), r["amount"]) for r in tables.load_transactions(table).collect())
    assert got == [(5411, "2020-03-01 00:00:00", 1.5), (5651, "2020-03-01 09:15:00", 2.5)]
    plan = table.where("amount > 2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(amount), GreaterThan(amount,2.0)]" in plan
    assert [r["seq"]["row"] for r in table.where("seq.file like '%1.csv'").orderBy("seq").collect()] == [1, 2, 3]
    (tmp_path / "days").mkdir()
    (tmp_path / "days" / "a.csv").write_text("customer_id,date\n1,2020-01-01\n")
    assert dict(tables.read_table(spark, str(tmp_path / "days")).dtypes)["date"] == "date"


def test_digests_are_of_the_stored_bytes_and_folders_are_listed_by_level(spark, tmp_path):
    deep = tmp_path / "x y" / "deeper"
    deep.mkdir(parents=True)
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"key\n1\n"))
    (deep / "b.bin").write_bytes(b"123")
    (tmp_path / "empty").mkdir()
    got = {r["path"]: r["sha256"] for r in manifest.file_digests(spark, str(tmp_path), str(deep / "b.bin")).collect()}
    assert got == {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "a.csv.gz", deep / "b.bin")}
    with pytest.raises(Exception, match="nowhere"):
        stores.listed(spark, str(tmp_path / "nowhere"))


def test_many_prediction_files_are_one_scan_per_header(spark, tmp_path):
    probs = ",".join(f"p_{c}" for c in ("Clothing", "Gas stations", "Food and grocery", "Other"))
    for i in range(40):
        (tmp_path / f"m{i}_last9.csv").write_text(f"customer_id,ground_truth,prediction,{probs}\n{i},Other,NA,0.1,0.2,0.3,0.4\n")
        (tmp_path / f"f{i}-seed2.csv").write_text(f"customer_id,ground_truth,prediction\n{i},Other,\n")
    rows = predictions.read_prediction_files(spark, str(tmp_path), "s")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    got = {(r["model"], r["length"]): (r["customer_id"], r["prediction"], r["p"]) for r in rows.collect()}
    assert len(got) == 80 and got["m3", 9] == (3, "NA", [0.1, 0.2, 0.3, 0.4]) and got["f5-seed2", None] == (5, "", None)
