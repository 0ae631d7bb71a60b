import gzip

from tideweave.sources import readers, sinks


def test_csv_gzip_utf16_and_reports(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("region,city,n\nTX,Austin,3\nCA,LA,4\nTX,Waco,5\n")
    got = readers.csv(spark, str(tmp_path / "a.csv.gz"), "region string, city string, n int", columns=["city", "n"])
    assert {tuple(r) for r in got.collect()} == {("Austin", 3), ("LA", 4), ("Waco", 5)}
    (tmp_path / "b.txt").write_bytes("date\tpct\n1/2/23\t45%\n".encode("utf-16"))
    assert [tuple(r) for r in readers.delimited_utf16(spark, str(tmp_path / "b.txt"), ["date", "pct"]).collect()] == [("1/2/23", "45%")]
    sinks.csv(got, str(tmp_path / "out"), by=["city"])
    assert readers.csv(spark, str(tmp_path / "out"), "n int, city string").count() == 3
    assert sinks.report(spark.createDataFrame([(1234.567, "x")], "v double, k string"), 1, v="value").first().value == "1,234.6"


def test_networks_in_text(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("a  b\n b c \n\n")
    edges = readers.edge_list(spark, str(tmp_path / "edges.txt"))
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "c")}
    assert {tuple(r) for r in readers.numbered_nodes(edges).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    (tmp_path / "adj.txt").write_text("0 1 0\n0 0 1\n1 0 0\n")
    assert {tuple(r) for r in readers.adjacency(spark, str(tmp_path / "adj.txt")).collect()} == {(1, 2), (2, 3), (3, 1)}


def test_circles(spark):
    lines = spark.createDataFrame([("c1\t1\t2\t3\t4\t5",), ("c2\t1\t2",), ("c3",)], "value string")
    long = readers.circles(lines)
    assert {tuple(r) for r in long.collect()} == {("c1", str(i)) for i in range(1, 6)}
    assert readers.one_hot(long, "node", "circle", ["c1", "c2"]).filter("c1 = 1 AND c2 = 0").count() == 5


def test_runs_by_file_name(spark, tmp_path):
    for i in (3, 12):
        spark.range(i).write.parquet(str(tmp_path / f"sim{i}.parquet"))
    got = readers.runs_in(spark, str(tmp_path / "sim*.parquet"), "id long")
    assert got.count() == 15


def test_gml(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [ directed 0\n node [ id 1 label "a" ]\n node [ id 2 label "b" ]\n edge [ source 1 target 2 weight 2.5 ]\n edge [ source 2 target 1 ] ]')
    nodes, edges = readers.gml(spark, str(tmp_path / "g.gml"))
    assert [tuple(r) for r in nodes.collect()] == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in edges.collect()] == [(1, 2, 2.5), (2, 1, None)]
