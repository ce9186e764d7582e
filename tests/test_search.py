import pytest

from pulsecart.operators import search as S
from pulsecart.sources.index import hits


@pytest.fixture(scope="module")
def students(spark):
    data = [
        ("1", "男", "篮球,足球", "c1", 20), ("2", "男", "乒乓球", "c2", 22), ("3", "女", "羽毛球", "c1", 25),
        ("4", "男", "唱歌", "c1", 30), ("5", "男", "网球", "c2", 21), ("6", "男", "足球", "c3", 19),
        ("7", "男", "棒球", "c1", 18),
    ]
    return spark.createDataFrame(data, "_id string, sex string, favo string, class_id string, age int")


@pytest.fixture(scope="module")
def found(students):
    return S.matching(students, terms={"sex": "男"}, match={"favo": "球"})


def test_filter_and_match(found):
    assert sorted(r["_id"] for r in found.collect()) == ["1", "2", "5", "6", "7"]


def test_total_is_independent_of_the_page(found):
    assert S.total_hits(found).first()["total"] == 5
    assert [r["_id"] for r in S.slice_hits(found, ["_id"], 0, 2).collect()] == ["1", "2"]


def test_second_page_of_five_hits(found):
    assert [r["_id"] for r in S.slice_hits(found, ["_id"], 2, 2).collect()] == ["5", "6"]


def test_buckets_cover_all_hits(found):
    assert [tuple(r) for r in S.top_terms(found, "class_id", "age").collect()] == [
        ("c1", 2, 20), ("c2", 2, 22), ("c3", 1, 19),
    ]


def test_top_terms_stop_at_size(spark):
    df = spark.createDataFrame([(str(i % 12),) for i in range(50)] + [(None,)], "k string")
    rows = S.top_terms(df, "k").collect()
    assert len(rows) == 10 and [r["doc_count"] for r in rows] == [5, 5] + [4] * 8


def test_pages(students):
    assert [r["_id"] for r in S.page(students, ["_id"], 2, 5).collect()] == ["6", "7"]
    for number, size in ((0, 5), (1, 7)):
        with pytest.raises(ValueError):
            S.page(students, ["_id"], number, size)


def test_no_condition_keeps_all(students):
    assert S.matching(students).count() == 7


def test_hits(students):
    row = hits("student", students).filter("_id = '4'").first()
    assert (row["_index"], row["_type"], row["_source"]["favo"]) == ("student", "_doc", "唱歌")


def test_sales_of(spark):
    df = spark.createDataFrame(
        [("2019-03-04", "red ring"), ("2019-03-04", "bolt"), ("2024-01-15", "ring")], "dt string, sku_name string"
    )
    assert S.sales_of(df).count() == 2
    assert S.sales_of(df, keyword="").count() == 2
    assert S.sales_of(df, keyword="ring").count() == 1
    assert S.sales_of(df, "2024-01-15", "bolt").count() == 0
