from __future__ import annotations

import csv
import random

import pytest

from marketspark.sources import contract, raw, store
from tests import fixture
from tests.conftest import rows, write_files


def test_every_file_is_found_and_complete(spark, tmp_path):
    folder = str(write_files(tmp_path / "raw", fixture.tables()))
    assert set(contract.find_files(spark, folder)) == set(contract.CONTRACT)
    assert rows(contract.schema_problems(spark, folder)) == []


def test_all_problems_are_listed_at_once(spark, tmp_path):
    tables = fixture.tables()
    del tables["payments"]
    tables["sellers"][1][3] = "seller_region"
    folder = str(write_files(tmp_path / "raw", tables))
    assert [tuple(r) for r in contract.schema_problems(spark, folder).collect()] == [
        ("order_payments_dataset.csv", "missing file"),
        ("sellers_dataset.csv", "missing columns: seller_state"),
    ]


def test_a_missing_folder_misses_every_file(spark, tmp_path):
    assert len(rows(contract.schema_problems(spark, str(tmp_path / "none")))) == 9


def test_one_folder_below_and_parts(spark, tmp_path):
    tables = fixture.tables()
    below = write_files(tmp_path / "raw" / "archive", tables)
    files = contract.find_files(spark, str(tmp_path / "raw"))
    assert files["orders"].endswith("archive/shop_orders_dataset.csv")
    deeper = write_files(tmp_path / "other" / "a" / "b", tables)
    assert contract.find_files(spark, str(tmp_path / "other")) == {}
    parts = tmp_path / "parts"
    spark.read.csv(str(below / "shop_orders_dataset.csv"), header=True).repartition(3).write.csv(
        str(parts / "shop_orders_dataset.csv"), header=True
    )
    found = contract.find_files(spark, str(parts))
    assert set(found) == {"orders"}
    assert raw.read_raw(spark, found["orders"], "orders").count() == 13
    assert deeper.exists()


def test_headers_are_normalised(spark, tmp_path):
    folder = write_files(tmp_path / "raw", fixture.tables())
    files = contract.find_files(spark, str(folder))
    (products,), (translation,) = contract.headers_of(spark, files)["products"], contract.headers_of(spark, files)["category_translation"]
    assert "product_name_length" in products.columns
    assert translation.columns[0] == "product_category_name"
    assert contract.normal_name('﻿ "Product_Name_Lenght" ') == "product_name_length"


def test_text_only_with_line_breaks_quotes_and_blanks(spark, tmp_path):
    files = contract.find_files(spark, str(write_files(tmp_path / "raw", fixture.tables())))
    reviews = raw.read_raw(spark, files["reviews"], "reviews")
    assert {t for _, t in reviews.dtypes} == {"string"}
    assert reviews.count() == 9
    (text,) = reviews.filter("review_id = 'r2'").select("review_comment_message").first()
    assert text == 'came in the\nevening, "fine"'
    (title,) = reviews.filter("review_id = 'r2'").select("review_comment_title").first()
    assert title is None
    sellers = raw.read_raw(spark, files["sellers"], "sellers", multi_line=False)
    assert sorted(r[0] for r in sellers.select("seller_zip_code_prefix").collect()) == ["04000", "4001"]


def test_extra_columns_are_left_out(spark, tmp_path):
    tables = fixture.tables()
    file, header, lines = tables["sellers"]
    tables["sellers"] = (file, [*header, "note"], [[*line, "n"] for line in lines])
    files = contract.find_files(spark, str(write_files(tmp_path / "raw", tables)))
    assert raw.read_raw(spark, files["sellers"], "sellers").columns == header


def parts_with(spark, folder, table, frames):
    """A folder of parts of one table, written one after the other."""
    path = f"{folder}/shop_{contract.CONTRACT[table][0]}"
    for df in frames:
        df.coalesce(1).write.mode("append").csv(path, header=True)
    return path


def sellers_of(spark, *rows_):
    return spark.createDataFrame(rows_, "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string")


def test_two_files_for_one_table_are_reported(spark, tmp_path):
    folder = write_files(tmp_path / "raw", fixture.tables())
    for year in ("y2017", "y2018"):
        (folder / f"{year}_sellers_dataset.csv").write_text("seller_id\n")
    (folder / "shop_sellers_dataset.csv").unlink()
    assert "sellers" not in contract.find_files(spark, str(folder))
    assert [tuple(r) for r in contract.schema_problems(spark, str(folder)).collect()] == [
        ("sellers_dataset.csv", "more than one file: y2017_sellers_dataset.csv, y2018_sellers_dataset.csv")
    ]


def test_parts_in_another_column_order_are_read_right(spark, tmp_path):
    one = sellers_of(spark, ("s1", "01", "rio", "RJ"))
    two = sellers_of(spark, ("s2", "02", "sao", "SP")).select("seller_state", "seller_id", "seller_city", "seller_zip_code_prefix")
    more = sellers_of(spark, ("s3", "03", "bel", "PA")).selectExpr("'x' AS note", "*")
    path = parts_with(spark, tmp_path, "sellers", [one, two, more])
    found = raw.read_raw(spark, path, "sellers")
    assert sorted(tuple(r) for r in found.collect()) == [
        ("s1", "01", "rio", "RJ"),
        ("s2", "02", "sao", "SP"),
        ("s3", "03", "bel", "PA"),
    ]


def test_every_part_is_checked(spark, tmp_path):
    one = sellers_of(spark, ("s1", "01", "rio", "RJ"), ("s4", "01", "rio", "RJ"))
    two = sellers_of(spark, ("s2", "02", "sao", "SP")).drop("seller_state")
    path = parts_with(spark, tmp_path, "sellers", [one, two])
    problems = [tuple(r) for r in contract.schema_problems(spark, str(tmp_path)).collect()]
    assert ("sellers_dataset.csv", "missing columns: seller_state") in problems
    with pytest.raises(ValueError, match="seller_state"):
        raw.read_raw(spark, path, "sellers")
    report = raw.part_report(spark, {"sellers": path})
    assert sorted((r["missing"], r["rows"]) for r in report.collect()) == [("", 2), ("seller_state", 1)]


def test_empty_files_are_no_parts(spark, tmp_path):
    path = parts_with(spark, tmp_path, "sellers", [sellers_of(spark, ("s1", "01", "rio", "RJ"))])
    (tmp_path / "shop_sellers_dataset.csv" / "part-99999.csv").write_text("")
    assert raw.read_raw(spark, path, "sellers").count() == 1


@pytest.fixture
def small_ranges(spark):
    """Files are split every so many bytes."""
    keys = [f"spark.sql.files.{k}" for k in ("maxPartitionBytes", "openCostInBytes")]
    before = {k: spark.conf.get(k) for k in keys}

    def split(size: str) -> None:
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")

    yield split
    for k, v in before.items():
        spark.conf.set(k, v)


def test_long_files_are_split(spark, tmp_path, small_ranges):
    """A long orders file makes several tasks, and so does a long reviews file; a short one is read whole."""
    big = spark.range(20_000).selectExpr(*[f"cast(id AS string) AS {c}" for c in contract.CONTRACT["orders"][1]])
    path = parts_with(spark, tmp_path, "orders", [big])
    text = spark.range(20_000).selectExpr(*[f"cast(id AS string) AS {c}" for c in contract.CONTRACT["reviews"][1]])
    other = parts_with(spark, tmp_path, "reviews", [text])
    small_ranges("100k")
    tables = {"orders": raw.read_raw(spark, path, "orders"), "reviews": raw.read_raw(spark, other, "reviews", cut_above=100_000)}
    assert all(df.rdd.getNumPartitions() > 4 for df in tables.values())
    assert raw.read_raw(spark, other, "reviews").rdd.getNumPartitions() == 1
    assert raw.read_all(spark, {"reviews": other}, ())["reviews"].rdd.getNumPartitions() > 4
    assert tables["orders"].count() == tables["reviews"].count() == 20_000


def text_file(path, seed, rows=50):
    """A CSV file of fields with line breaks, quotes and commas; the line ends of the file follow the seed."""
    dice = random.Random(seed)
    marks = ["x", '"', "\n", "\r\n", ",", "ä", '""', "line ", " ", ""]
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write("\ufeff" * (seed % 2))
        quoting = csv.QUOTE_ALL if seed % 3 == 1 else csv.QUOTE_MINIMAL
        writer = csv.writer(out, lineterminator="\r\n" if seed % 4 > 1 else "\n", quoting=quoting)
        writer.writerow(["id", "text", "more"])
        for i in range(rows):
            text = "".join(dice.choice(marks) for _ in range(dice.choice([0, 3, 30, 300])))
            writer.writerow([f"{path.name}-{i}", text, dice.choice(["", "z", '"q"', "a,b", "\n"])])


@pytest.mark.parametrize("size", ["150", "5k"])
@pytest.mark.parametrize("seed", [0, 3, 7])
def test_cut_records_equal_the_multi_line_reader(spark, tmp_path, small_ranges, seed, size):
    for k in range(2):
        text_file(tmp_path / f"part {k}+.csv", seed + k)
    path = str(tmp_path)
    whole = sorted(map(tuple, raw.read_raw(spark, path, cut_above=10**9).collect()), key=repr)
    small_ranges(size)
    cut = raw.read_raw(spark, path, cut_above=0)
    assert cut.columns == ["id", "text", "more"] and cut.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, cut.collect()), key=repr) == whole and len(whole) == 100


def test_stray_quotes_stay_in_their_record(spark, tmp_path, small_ranges):
    """A quote inside a field that is not quoted is a character, and no later record suffers."""
    lines = [f'{i},{chr(34) if i % 7 == 0 else ""}line {i}\nnext{chr(34) if i % 7 == 0 else ""},5" screen' for i in range(200)]
    lines = [line if i % 7 == 0 else line.replace("\n", " ") for i, line in enumerate(lines)]
    (tmp_path / "a.csv").write_text("id,text,more\n" + "\n".join(lines))
    whole = sorted(map(tuple, raw.read_raw(spark, str(tmp_path), cut_above=10**9).collect()))
    small_ranges("97")
    assert sorted(map(tuple, raw.read_raw(spark, str(tmp_path), cut_above=0).collect())) == whole and len(whole) == 200


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(500))
    (tmp_path / "a.csv").write_text(f'id,text\n1,"{long}"\n2,b\n3,"open')
    small_ranges("100")
    got = {r["id"]: r["text"] for r in raw.read_raw(spark, str(tmp_path), cut_above=0).collect()}
    assert got["1"] == long and got["2"] == "b" and set(got) == {"1", "2", "3"}


def test_ranges_that_change_are_an_error(spark, tmp_path, small_ranges):
    text_file(tmp_path / "a.csv", 0)
    small_ranges("300")
    cut = raw.read_raw(spark, str(tmp_path), cut_above=0)
    small_ranges("200")
    with pytest.raises(Exception, match="split anew"):
        raw.read_raw(spark, str(tmp_path), cut_above=10**9).join(cut, "id").count()


def jobs_of(spark, work):
    """Number of Spark jobs that some work starts."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        found = work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_headers_of_many_parts_take_one_job(spark, tmp_path):
    path = tmp_path / "shop_sellers_dataset.csv"
    path.mkdir()
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state"
    for i in range(90):
        named = header.upper() if i % 3 else ",".join(reversed(header.split(",")))
        (path / f"part-{i:05d}.csv").write_text(f"{named}\n" + "a,b,c,d\n" * 5)
    (path / "part-empty.csv").write_text("")
    found, jobs = jobs_of(spark, lambda: contract.headers_of(spark, {"sellers": str(path)})["sellers"])
    assert [(h.parts, h.columns[0]) for h in found] == [(60, "seller_id"), (30, "seller_state")]
    assert jobs <= 2  # the shuffle of the fold is a job of its own under adaptive execution
    rows = raw.read_raw(spark, str(path), "sellers")
    assert rows.count() == 450 and rows.where("seller_id = 'd'").count() == 150


@pytest.mark.parametrize(
    "name",
    ["Seller_ID", '"seller_id"', "\ufeffseller_id", '\ufeff"seller_id"', '" seller_id "', ' "\ufeff seller_id" ', "'seller_id'"],
)
def test_wrapped_names(name):
    assert contract.normal_name(name) == "seller_id"


def test_misspelt_names():
    assert contract.normal_name('"PRODUCT_DESCRIPTION_LENGHT "') == "product_description_length"
    assert contract.normal_name("a b", {"a b": "c"}) == "c" and contract.normal_name("lenght") == "lenght"


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    class Bare:
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)

        def getConf(self):
            return self

        def getCheckpointDir(self):
            return None

        def get(self, key, default=None):
            return default

    with pytest.raises(store.NoSharedFolder, match="spark.checkpoint.dir"):
        store.store_root(Bare())


def test_a_finished_run_can_be_dropped(spark):
    lake = store.Lake(spark, {"numbers": lambda t: t.spark.range(3).toDF("n")})
    assert lake["numbers"].count() == 3
    folder = lake.folder
    assert lake.drop() and not store.drop_folder(spark, folder)
    for outside in ("/tmp/other", f"{store.store_root(spark)}/../x"):
        with pytest.raises(ValueError, match="is not below"):
            store.drop_folder(spark, outside)


def test_tables_go_to_the_shared_folder_the_session_names(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = store.store_root(spark)
    assert store.new_folder(spark, "x").startswith(f"{root}/marketspark/x-")
    if shared:
        assert root == shared.rstrip("/")


def test_each_table_is_built_once_and_facts_are_split_by_month(spark, tmp_path):
    calls = []

    def numbers(lake):
        calls.append("numbers")
        return spark.range(10).selectExpr("id", "cast(null as date) purchase_month")

    lake = store.Lake(
        spark,
        {"numbers": numbers, "fact_orders": lambda t: t["numbers"], "dim_x": lambda t: t["numbers"]},
        folder=str(tmp_path / "lake"),
    )
    one, two = lake.together("fact_orders", "dim_x")
    assert calls == ["numbers"]
    assert one.columns == ["id", "purchase_month"] and one.count() == two.count() == 10
    assert [p.name.split("=")[0] for p in (tmp_path / "lake" / "fact_orders").glob("purchase*")] == [
        "purchase_month"
    ]


def test_headers_where_files_are_split_and_share_tasks(spark, tmp_path):
    """As if the size of splits could not be set: only the first range of each file has its header."""
    import pyarrow as pa

    first = contract._first_lines(alone=False)
    row = lambda path, start, line: {"path": path, "size": 99, "line": line, "start": start}
    rows_ = [row("a", 0, "h,a"), row("a", 0, "1,2"), row("a", 50, "3,4"), row("b", 7, "5,6"), row("c", 0, " "), row("c", 0, "h,c"), row("d", 0, "h,d"), row("d", 0, "7,8")]
    for size in (1, 3, 8):
        batches = [pa.RecordBatch.from_pylist(rows_[i : i + size]) for i in range(0, 8, size)]
        assert [(r["path"], r["line"]) for b in first(iter(batches)) for r in b.to_pylist()] == [("a", "h,a"), ("c", "h,c"), ("d", "h,d")]
    long = [pa.RecordBatch.from_pylist([{**r, "size": 1 << 40}]) for r in rows_[:2]]
    left = iter(long)
    assert len(list(contract._first_lines(alone=True)(left))) == 1 and len(list(left)) == 1
