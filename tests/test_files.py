import json

import pytest

from graphweft import functions as gf
from graphweft.model import Embedding
from graphweft.sources import edge_files, store
from graphweft import cli


def write(path, text):
    path.write_text(text)
    return str(path)


def test_edge_files(spark, tmp_path):
    p = write(tmp_path / "a.txt", "# one\n% two\n1 2 0.5\n2 3 1.5\r\n1 2 1\n4 4 1\n\n")
    assert edge_files.header_lines(spark, p) == 2 and edge_files.probe_delimiter(spark, p) == " "
    g = edge_files.load_graph(spark, p, True)
    assert {(r.src, r.dst): r.w for r in g.edges.collect()} == {(1, 2): 1.5, (2, 3): 1.5} and {r.node for r in g.nodes.collect()} == {1, 2, 3, 4}
    q = write(tmp_path / "b.csv", "1,2,9,x\n2,1,9,x\n")
    assert {(r.src, r.dst, r.w) for r in edge_files.read_edges(spark, q).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    assert edge_files.read_labelled_network(spark, q, directed=False).count() == 1
    bad = write(tmp_path / "c.csv", "1,2\n1,2,3\n")
    with pytest.raises(Exception, match="another number of fields"):
        edge_files.read_edges(spark, bad).collect()
    with pytest.raises(ValueError):
        edge_files.probe_delimiter(spark, write(tmp_path / "d.csv", "abc\n"))


def test_labelled_graph(spark, tmp_path):
    e, l = write(tmp_path / "e.txt", "1 2\n2 3\n2 1\n"), write(tmp_path / "l.txt", "1 0\n2 4\n9 1\n")
    edges, nodes, labels = edge_files.load_labelled_graph(spark, e, l, False)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert {r.node for r in nodes.collect()} == {1, 2, 3} and {(r.node, r.label) for r in labels.collect()} == {(1, "5"), (2, "4")}


def test_communities(spark, tmp_path):
    p = write(tmp_path / "c.txt", "1\t2\t3\n4\n")
    assert sorted((r.community, r.node) for r in edge_files.read_communities(spark, p).collect()) == [(0, 1), (0, 2), (0, 3), (1, 4)]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_stores(spark, tmp_path, fmt):
    e = Embedding(spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "node long, vec array<long>"), gf.positional_distance, True)
    out = store.Output(str(tmp_path / "e"), fmt)
    store.dump_embedding(e, out)
    back = store.load_embedding(spark, out.name, "array<bigint>")
    assert back.symmetric and store.differences(e.vectors, back.vectors).count() == 0 and store.read_header(spark, out.name)["dimension"] == 2
    assert store.differences(e.vectors, back.vectors.filter("node = 1")).count() == 1
    with pytest.raises(ValueError):
        store.load_embedding(spark, out.name, "array<double>")
    with pytest.raises(ValueError):
        store.Output("x", "bson")


def test_command_line(spark, tmp_path, capsys):
    lines = "\n".join(f"{i} {j}" for i in range(14) for j in range(i + 1, 14) if (i + j) % 3)
    p = write(tmp_path / "g.txt", lines)
    assert cli.main(["--csv", p, "embedding", "-o", str(tmp_path / "out"), "sketching", "--dim", "8", "--decay", "0.2", "--nbiter", "1"]) == 0
    assert store.load_embedding(spark, str(tmp_path / "out")).vectors.count() == 14
    assert cli.main(["--csv", p, "validation", "--nbpass", "1", "--skip", "0.2", "--centric", "sketching", "--dim", "8", "--decay", "0.2", "--nbiter", "1"]) == 0
    assert "centric_auc" in capsys.readouterr().out
    assert cli.main(["--csv", p, "--symetric", "false", "validation", "--nbpass", "2", "--skip", "0.2", "--centric", "hope", "rank", "--targetrank", "4", "--nbiter", "1"]) == 0
    figures = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert all(figures[k]["passes"] == 2 for k in ("auc", "centric_auc", "vcmpr"))


def test_string_ids_come_back(spark, tmp_path):
    e = Embedding(spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "node string, vec array<double>"), gf.dot_distance, True, "hope")
    store.dump_embedding(e, store.Output(str(tmp_path / "s")))
    back = store.load_embedding(spark, str(tmp_path / "s"))
    assert back.vectors.schema == e.vectors.schema and store.differences(e.vectors, back.vectors).count() == 0
