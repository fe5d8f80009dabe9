import json

import pytest
from pyspark.errors import PySparkException

from gneiss.session import read_table
from gneiss.sources import paged, readers

SF = "/root/testdata/sf0.001"


def put(folder, pages):
    folder.mkdir(exist_ok=True)
    for k, page in enumerate(pages):
        body = page if isinstance(page, str) else json.dumps(page)
        (folder / f"page-{k:03d}.json").write_text(body)
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sheet_has_one_header_and_coerces_whole_columns(spark, tmp_path):
    path = put(tmp_path / "s", [{"values": [["id", "", "id", "price", "note"], ["1", "a", "2", "1.5"]]}, {"values": []}, {"values": [["2", None, "x", "2", "id", "more"], []]}])
    df = paged.read_sheet(spark, path)
    assert df.dtypes == [("id", "bigint"), ("column_1", "string"), ("id_2", "string"), ("price", "double"), ("note", "string")]
    got = sorted(df.collect(), key=lambda r: repr(r.id))
    assert [tuple(r) for r in got] == [(1, "a", "2", 1.5, None), (2, None, "x", 2.0, "id"), (None, None, None, None, None)]


def test_sheet_rows_keep_their_place(spark, tmp_path):
    path = put(tmp_path / "s", [{"values": [["v"], ["5"], ["4"]]}, {"values": [["3"]]}])
    df = paged.read_sheet(spark, path, positions="true")
    assert [r.v for r in df.orderBy("_page", "_row").collect()] == [5, 4, 3]
    assert rows(df.select("_page", "_row")) == [("page-000.json", 0), ("page-000.json", 1), ("page-001.json", 0)]


def test_warehouse_types(spark, tmp_path):
    fields = [{"name": n, "type": t} for n, t in (("i", "INTEGER"), ("f", "FLOAT64"), ("d", "NUMERIC"), ("b", "BOOLEAN"), ("t", "TIMESTAMP"))]
    page = {"schema": {"fields": fields}, "rows": [{"f": [{"v": v} for v in ("7", "0.5", "2.25", "true", "1.7E9")]}, {"f": [{"v": None}] * 5}]}
    df = paged.read_warehouse(spark, put(tmp_path / "w", [page, page]))
    assert df.dtypes == [("i", "bigint"), ("f", "double"), ("d", "double"), ("b", "boolean"), ("t", "string")]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, [(7, 0.5, 2.25, True, "1.7E9"), (None,) * 5] * 2))


def test_rest_equals_one_reading_of_all_pages(spark, tmp_path):
    pages = [{"data": {"rows": [{"a": 1, "b": {"c": [1.5, 2]}, "d": "x"}, {"a": 2}]}}, {"data": {"rows": [{"a": 3, "e": "ü\n", "b": None}]}}, {"data": {"rows": {"a": 4, "d": None}}}, {"data": {}}]
    path = put(tmp_path / "r", pages)
    flat = tmp_path / "all.json"
    flat.write_text(json.dumps([r for p in pages for x in [p["data"].get("rows", [])] for r in (x if isinstance(x, list) else [x])]))
    want = readers.read_json(spark, str(flat))
    got = paged.read_rest(spark, path, "data.rows")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.selectExpr("a", "to_json(b) AS b", "d", "e").na.fill("-")) == rows(want.selectExpr("a", "to_json(b) AS b", "d", "e").na.fill("-"))
    assert got.rdd.getNumPartitions() == 4


def test_fields_that_fit_no_type_stay_variants(spark, tmp_path):
    path = put(tmp_path / "r", [[{"a": 1}], [{"a": "one"}]])
    df = paged.read_rest(spark, path)
    assert df.dtypes == [("a", "variant")]
    assert sorted(r.t for r in df.selectExpr("CAST(a AS STRING) AS t").collect()) == ["1", "one"]


def test_given_schema_and_broken_pages(spark, tmp_path):
    path = put(tmp_path / "r", [[{"a": 1}]])
    assert rows(paged.read_rest(spark, path, schema="a double, z string")) == [(1.0, None)]
    broken = put(tmp_path / "b", [[{"a": 1}], "{not json"])
    with pytest.raises(PySparkException, match="page-001.json is not JSON"):
        paged.read_pages(spark, broken, schema="row string").count()
    odd = put(tmp_path / "o", [{"schema": {"fields": [{"name": "i", "type": "INTEGER"}]}, "rows": [{"f": [{"v": "seven"}]}]}])
    with pytest.raises(PySparkException, match="does not fit the layout fields"):
        paged.read_warehouse(spark, odd).collect()
    with pytest.raises(PySparkException, match="no page tells the columns"):
        paged.read_sheet(spark, put(tmp_path / "e", []))


@pytest.mark.parametrize("layout", ["values", "fields", "records"])
def test_written_tables_come_back(spark, tmp_path, layout):
    path = str(tmp_path / layout)
    df = read_table(spark, SF, "supplier").selectExpr("s_suppkey", "s_name", "s_acctbal", "CAST(s_nationkey AS BIGINT) AS s_nationkey").repartition(3)
    read = {"values": paged.read_sheet, "fields": paged.read_warehouse, "records": lambda s, p: paged.read_rest(s, p, "x.y")}[layout]
    options = {"rows": "x.y"} if layout == "records" else {}
    paged.write_pages(df, path, layout, rowsPerPage="2", **options)
    assert rows(read(spark, path).select(*df.columns)) == rows(df)
    assert paged.missing_pages(spark, path).collect() == []
    names = paged.page_names(path)
    assert len(names) >= 6 and not list((tmp_path / layout / "_attempts").iterdir())
    paged.write_pages(df.limit(3), path, layout, rowsPerPage="2", **options)
    assert read(spark, path).count() == 3
    if layout == "values":
        with pytest.raises(PySparkException, match="one header"):
            paged.write_pages(df, path, layout, "append")
    else:
        paged.write_pages(df, path, layout, "append", rowsPerPage="2", **options)
        assert read(spark, path).count() == 3 + df.count()
        assert paged.missing_pages(spark, path).collect() == []
    (tmp_path / layout / paged.page_names(path)[1]).unlink()
    assert [r.next for r in paged.missing_pages(spark, path).collect()] == [r for r in [paged.page_names(path)[0].replace("000000.json", "000001.json")]] or paged.missing_pages(spark, path).count() == 1


def test_a_task_that_fails_leaves_no_page(spark, tmp_path):
    path = str(tmp_path / "f")
    bad = spark.range(0, 100, 1, 4).selectExpr("id", "CASE WHEN id = 99 THEN raise_error('stop') ELSE 'x' END AS v")
    with pytest.raises(PySparkException):
        paged.write_pages(bad, path, "fields", rowsPerPage="10")
    assert paged.page_names(path) == []


def test_stream_takes_each_page_once(spark, tmp_path):
    folder = tmp_path / "p"
    put(folder, [[{"k": n}] for n in range(5)])
    seen = []

    def take():
        stream = paged.stream_pages(spark, str(folder), pagesPerTrigger="2", positions="true")
        query = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r._page for r in b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()

    take()
    assert [p for p in seen if p] == [["page-000.json", "page-001.json"], ["page-002.json", "page-003.json"], ["page-004.json"]]
    seen.clear()
    (folder / "page-005.json").write_text('[{"k": 5}]')
    take()
    assert [p for p in seen if p] == [["page-005.json"]]


def test_router_knows_the_layouts(spark, tmp_path):
    paged.register(spark)
    path = put(tmp_path / "r", [[{"a": 1}]])
    assert rows(readers.read(spark, path, "rest")) == [(1,)]


def test_a_backlog_takes_a_bounded_number_of_batches(spark, tmp_path):
    path, sizes = put(tmp_path / "p", [[{"k": n}] for n in range(40)]), []
    stream = paged.stream_pages(spark, path, pagesPerTrigger="2", mostTriggers="4")
    query = stream.writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [n for n in sizes if n] == [10] * 4


def test_many_pages_share_a_partition(spark, tmp_path):
    path = put(tmp_path / "p", [[{"k": n}] for n in range(600)])
    df = paged.read_rest(spark, path)
    assert df.rdd.getNumPartitions() == 200 and sorted(r.k for r in df.collect()) == list(range(600))
