"""Sets of files: written by the tasks that hold the rows, each file of a bounded number of rows."""

import pytest
from pyspark.sql import functions as F

from bitloom.plans import exchange
from bitloom.sinks import files as out
from bitloom.sources import files as src


def _units(spark, n):
    odd = F.when(F.col("id") % 10 == 3, F.lit(" 　")).otherwise(F.concat(F.lit("t&"), F.col("id").cast("string")))
    return spark.range(0, n, 1, 5).select(F.col("id").alias("ord"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("src_text"), odd.alias("tgt_text"), F.lit("20240105T080910Z").alias("modified_at"))


@pytest.mark.parametrize("kind", ["tmx", "sdltm"])
def test_units_count_on_from_file_to_file(spark, tmp_path, kind):
    units = _units(spark, 230)
    if kind == "sdltm":
        units = units.filter("ord % 10 <> 3")
    written = out.write_set(units, str(tmp_path), ["ord"], kind, 20, src_lang="en", tgt_lang="de")
    names = sorted(p.name for p in tmp_path.iterdir())
    assert [n for n, _ in written] == names and len(names) >= 10  # bounded, and nothing else is left there
    read = src.read_units(spark, str(tmp_path))
    assert read.groupBy("source_file").count().agg(F.max("count")).first()[0] <= 20
    got = exchange._counted_on(read, written, "unit_ord").orderBy("unit_ord").collect()
    assert [(r.unit_ord, r.src_text, r.tgt_text) for r in got] == [(n, f"s{i}", f"t&{i}") for n, i in enumerate(i for i in range(230) if i % 10 != 3)]


@pytest.mark.parametrize("kind", ["xlsx", "csv", "tbx"])
def test_no_rows_are_one_file(spark, tmp_path, kind):
    d = spark.createDataFrame([], "k int, a string, b string")
    assert out.write_set(d, str(tmp_path), ["k"], kind, **({} if kind == "tbx" else {"columns": d.columns})) == [(f"part-000000-000000.{kind}", 0)]
    assert len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("name", ["tmx_round_trip", "xlsx_round_trip", "tbx_round_trip", "glossary_csv_round_trip", "glossary_xlsx_round_trip", "sdltm_round_trip"])
def test_round_trips_write_bounded_files(spark, tmp_path, monkeypatch, name):
    """No row goes through the driver, and no file has more rows than a file of a set."""
    from bitloom.plans import catalogue

    rows = 70
    spark.range(1, rows + 1).selectExpr("id as p_partkey", "concat('n ', id) as p_name", "concat('t ', id) as p_type", "'Brand#1' as p_brand", "cast(id % 30 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, rows + 1).selectExpr("id as o_orderkey", "id as o_custkey", "'1-URGENT' as o_orderpriority", "'O' as o_orderstatus", "date '1996-01-02' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(out, "_rows", lambda *a: pytest.fail("rows are gathered on the driver"))
    monkeypatch.setattr(out.write_set, "__defaults__", (9,))
    got = catalogue.queries()[name](spark, str(tmp_path))
    key = next(c for c in ("unit_ord", "entry_ord", "key") if c in got.columns)
    first, n = (2, rows) if key == "key" else (0, rows - 10 if name == "tmx_round_trip" else rows)
    assert sorted(int(r[key]) for r in got.collect()) == list(range(first, first + n))


def test_elements_leave_the_tree():
    import io

    xml = "<a><b>" + "".join(f"<c><d>{i}</d></c>" for i in range(50)) + "</b><c/></a>"
    got = [[x.text for x in e] for e in src._each(io.BytesIO(xml.encode()), "c")]
    assert got == [[str(i)] for i in range(50)] + [[]]


@pytest.mark.parametrize("name", ["docx_tables", "alternating_pairs", "csv_utf_8_sig_pairs", "reader_warnings"])
def test_a_brands_documents_are_bounded(spark, tmp_path, monkeypatch, name):
    """A brand of many parts has several documents of a bounded number of rows; keys count on."""
    from bitloom.plans import catalogue

    at = f"{tmp_path}/part.parquet"
    spark.range(1, 91).selectExpr("id as p_partkey", "concat('n ', id) as p_name", "concat('t ', id) as p_type", "concat('Brand#', if(id % 3 = 0, 1, 2)) as p_brand", "1 as p_size").coalesce(1).write.parquet(at)
    monkeypatch.setattr(out, "SET_ROWS", 20)
    sizes = [len(c) for _, c in exchange._in_parts(spark, str(tmp_path), lambda p: p.iloc[:1].assign(path="x", content=[b"x" * len(p)])[["path", "content"]]).collect()]
    assert sorted(sizes) == [15, 15, 20, 20, 20]
    import duckdb

    got = catalogue.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{at}/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_plain_segments_are_what_a_parser_finds():
    from xml.etree import ElementTree as ET

    head = '<Segment xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><Elements><Text><Value>'
    tail = "</Value></Text></Elements><CultureName>en-US</CultureName></Segment>"
    for text in ("", "a b", " 甲\n\t'\" ;%", "😀"):
        root = ET.fromstring(head + text + tail)
        assert src._PLAIN.fullmatch(head + text + tail).groups() == (root.find(".//Value").text or "", "en-US")
    for text in ("a &amp; b", "<Tag/>", "\r\n", "\x00", "￾", "]]>&", "</Value><Value>"):
        assert not src._PLAIN.fullmatch(head + text + tail)
