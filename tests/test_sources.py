"""Files: what is read, what is refused, and round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from tidegraph.errors import FileFormat
from tidegraph.fixpoint import INFINITE
from tidegraph.graph import EdgeBatch, Graph, Properties
from tidegraph.hypergraph import HyperBatch
from tidegraph.sources import batches as B
from tidegraph.sources import binary, graphs, hypergraphs, results
from tidegraph.sources.lines import lines


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def edges(g, *w):
    return sorted(tuple(r) for r in g.edges.select("src", "dst", *w).collect())


def test_lines_are_numbered_over_files(spark, tmp_path):
    path = put(tmp_path, "a.txt", "".join(f"line {i}\r\n" for i in range(1000)))
    assert [r.value for r in lines(spark, path).orderBy("line").collect()] == [f"line {i}" for i in range(1000)]


def test_edge_lists(spark, tmp_path):
    path = put(tmp_path, "e.txt", "# c\n% c\n10, 20 5\n20\t30 7\n30 30 1\n10 20 9\n\n+10 40 2\n")
    g, ids = graphs.read_edge_list(spark, path, num_weights=1)
    assert edges(g, "w0") == [(0, 1, 9), (0, 3, 2), (1, 2, 7)]
    assert {r.id: r.external for r in ids.collect()} == {0: 10, 1: 20, 2: 30, 3: 40}
    g, _ = graphs.read_edge_list(spark, path, ids="as_is", index_base=10, symmetrize=True, drop_self_loops=False)
    assert edges(g) == sorted([(0, 10), (10, 0), (10, 20), (20, 10), (20, 20), (0, 30), (30, 0)])
    kept, _ = graphs.read_edge_list(spark, path, num_weights=1, duplicates="keep")
    assert kept.edges.count() == 4
    with pytest.raises(FileFormat, match=":2:"):
        graphs.read_edge_list(spark, put(tmp_path, "bad.txt", "1 2\nx 3\n"))
    out = str(tmp_path / "out.txt")
    graphs.write_edge_list(kept, out)
    assert open(out).read() == "0 1 5\n0 1 9\n0 3 2\n1 2 7\n" or sorted(open(out).read().split("\n")) == sorted("0 1 5\n0 1 9\n0 3 2\n1 2 7\n".split("\n"))


def test_matrix_market(spark, tmp_path):
    path = put(tmp_path, "m.mtx", "%%MatrixMarket matrix coordinate integer symmetric\n% c\n3 3 4\n2 1 5\n3 1 6\n3 3 1\n2 1 8\n")
    g = graphs.read_matrix_market(spark, path)
    assert edges(g, "w0") == [(0, 1, 8), (0, 2, 6), (1, 0, 8), (2, 0, 6)]
    assert all(1 <= r.w1 <= 10 for r in graphs.read_matrix_market(spark, path, "random", (2, 1, 10, 3)).edges.collect())
    out = str(tmp_path / "out.mtx")
    graphs.write_matrix_market(g, out, 0)
    assert edges(graphs.read_matrix_market(spark, out), "w0") == edges(g, "w0")
    for text in ("%%MatrixMarket matrix array real general\n", "%%MatrixMarket matrix coordinate real general\n2 3 0\n", "%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 1\n", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 3\n"):
        with pytest.raises(FileFormat):
            graphs.read_matrix_market(spark, put(tmp_path, "bad.mtx", text))


def test_csr_triplets(spark, tmp_path):
    prefix = str(tmp_path) + "/g"
    for name, text in (("RowPtr", "0\n2\n2\n3\n"), ("ColInd", "1\n2\n0\n"), ("Values", "4 1\n5 2\n6 3\n")):
        put(tmp_path, f"g{name}.txt", text)
    g = graphs.read_csr_triplet(spark, prefix)
    assert edges(g, "w0", "w1") == [(0, 1, 4, 1), (0, 2, 5, 2), (2, 0, 6, 3)] and g.num_vertices == 3
    graphs.write_csr_triplet(g, str(tmp_path) + "/h")
    for name in ("RowPtr", "ColInd", "Values"):
        assert (tmp_path / f"h{name}.txt").read_text() == (tmp_path / f"g{name}.txt").read_text()
    assert graphs.widen(g, 4).num_weights == 4
    same = Graph.from_csr(spark, [0, 2, 2, 3], [1, 2, 0], [[4, 5, 6], [1, 2, 3]])
    assert edges(same, "w0", "w1") == edges(g, "w0", "w1")
    put(tmp_path, "gRowPtr.txt", "0\n2\n1\n3\n")
    with pytest.raises(FileFormat):
        graphs.read_csr_triplet(spark, prefix)


def listed(b):
    return {k: sorted(tuple(r)[1:] for r in getattr(b, k).collect()) for k in ("inserts", "deletes", "arrivals")} | {"departures": sorted(r.id for r in b.departures.collect())}


def test_text_batches(spark, tmp_path):
    path = put(tmp_path, "b.dgt", "%dgt 1 graph\n# c\n%batch 0\n-e 0 1\n+e 0 3 7\n%batch 4\n+e 2 0 1\n+v 5 1\n+v 6\n-v 2\n")
    got = B.read_batches(spark, path)
    assert [i for i, _ in got] == [0, 4]
    assert listed(got[0][1]) == {"inserts": [(0, 3, 7)], "deletes": [(0, 1)], "arrivals": [], "departures": []}
    assert listed(got[1][1]) == {"inserts": [(2, 0, 1)], "deletes": [], "arrivals": [(5, 1), (6, -1)], "departures": [2]}
    out = str(tmp_path / "o.dgt")
    B.write_batches(spark, out, [b for _, b in got])
    assert open(out).read() == "%dgt 1\n%batch 0\n-e 0 1\n+e 0 3 7\n%batch 1\n+v 5 1\n+v 6\n-v 2\n+e 2 0 1\n"
    for bad in ("%dgt 2\n", "%dgt 1 hypergraph\n", "%batch 1\n%batch 1\n", "+e 1\n", "+h 1 2\n", "+e 0 1 2\n+e 0 1\n", "-e 0 1\n%batch 3\n"):
        with pytest.raises(FileFormat):
            B.read_batches(spark, put(tmp_path, "bad.dgt", bad))
    path = put(tmp_path, "h.dgt", "%dgt 1 hypergraph\n%batch 0\n-h 4\n-i 2 7\n+i 2 1\n+h 0 2 7 ; 3\n%batch 1\n+h 1 5;9\n")
    (_, a), (_, b) = B.read_hyperedge_batches(spark, path, weighted=True)
    assert [tuple(r)[1:] for r in a.deletes.collect()] == [(4,)] and [tuple(r)[1:] for r in a.removals.collect()] == [(2, 7)]
    assert [(list(r.members), r.w) for r in b.inserts.collect()] == [([1, 5], 9)]
    out = str(tmp_path / "o2.dgt")
    B.write_hyperedge_batches(spark, out, [a, b])
    assert open(out).read() == "%dgt 1 hypergraph\n%batch 0\n-h 4\n-i 2 7\n+i 2 1\n+h 0 2 7 ; 3\n%batch 1\n+h 1 5 ; 9\n"
    with pytest.raises(FileFormat):
        B.read_hyperedge_batches(spark, path, weighted=False)


def test_pair_files_and_signed_lines(spark, tmp_path):
    b = B.read_pair_files(spark, put(tmp_path, "insert.txt", "0 1 5\n2 3 6\n"), put(tmp_path, "delete.txt", "4 5\n"))
    assert sorted(tuple(r)[1:] for r in b.inserts.collect()) == [(0, 1, 5), (2, 3, 6)]
    B.write_pair_files(b, str(tmp_path / "i.txt"), str(tmp_path / "d.txt"))
    assert (tmp_path / "i.txt").read_text() == "0 1 5\n2 3 6\n" and (tmp_path / "d.txt").read_text() == "4 5\n"
    s = B.read_signed_lines(spark, put(tmp_path, "s.txt", "- 0 1\n+ 2 3 9\n"))
    assert [tuple(r)[1:] for r in s.inserts.collect()] == [(2, 3, 9)] and [tuple(r)[1:] for r in s.deletes.collect()] == [(0, 1)]


pairs = st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 2**31 - 1)), max_size=5)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(pairs, pairs, st.lists(st.integers(0, 99), max_size=3, unique=True)), max_size=3), st.integers(0, 3), st.sampled_from([32, 64]), st.booleans())
def test_binary_graph_batches_round_trip(rows, k, bits, floats):
    records = []
    for ins, dels, vertices in rows:
        w = (np.arange(len(ins) * k).reshape(len(ins), k) + 1).astype(np.float32 if floats else np.int64)
        records.append(binary.GraphRecord(0, np.array(dels, np.int64).reshape(-1, 2), np.array(ins, np.int64).reshape(-1, 2), w, np.array(vertices, np.int64), np.full(len(vertices), 1, np.int8), np.array(vertices[:1], np.int64)))
    raw = binary.encode(records, bits, floats)
    back = list(binary.Reader(raw))
    assert binary.encode(back, bits, floats) == raw and len(back) == len(records)
    for a, b in zip(records, back):
        assert (a.insert == b.insert).all() and (a.delete == b.delete).all() and (a.vertices == b.vertices).all()
    for cut in range(0, len(raw), 37):
        with pytest.raises(FileFormat):
            list(binary.Reader(raw[:cut]))
    for at in range(0, len(raw), 31):
        damaged = bytearray(raw)
        damaged[at] ^= 0x41
        if at >= 4:
            with pytest.raises(FileFormat):
                list(binary.Reader(bytes(damaged)))


def test_binary_files(spark, tmp_path):
    records = [binary.HyperRecord(0, [4], [[0, 2], [7]], [3, 1], [(2, 7)], [(2, 1)], [[1, 2]], [5, 6]), binary.HyperRecord(1, [], [], [], [], [], [], [])]
    path = str(tmp_path / "h.dgb")
    binary.write_binary(spark, path, records)
    assert binary.read_binary(spark, path) == records
    g = str(tmp_path / "g.dgb")
    b = EdgeBatch.of(spark, [(0, 1, 5)], [(2, 3)], [(7, 1)], [8])
    binary.write_binary(spark, g, [binary.record_of(b, 1)])
    assert listed(binary.read_binary(spark, g)[0].batch(spark)) == listed(b)
    ops = sorted((r.batch, r.op, r.src, r.dst) for r in binary.read_binary_operations(spark, g).collect())
    assert ops == [(0, "+e", 0, 1), (0, "+v", 7, 1), (0, "-e", 2, 3), (0, "-v", 8, None)]
    assert isinstance(records[0].batch(spark), HyperBatch)
    ops = [(r.batch, r.op, r.src, r.dst, r.members, r.w) for r in binary.read_binary_operations(spark, path).orderBy("batch", "op", "seq").collect()]
    assert ops == [(0, "+h", None, None, [0, 2], [3.0]), (0, "+h", None, None, [7], [1.0]), (0, "+i", 2, 1, None, None), (0, "-h", 4, None, None, None), (0, "-i", 2, 7, None, None)]


def test_binary_files_are_read_record_by_record(spark, tmp_path, monkeypatch):
    several = tmp_path / "several"
    several.mkdir()
    for i in range(2):
        part = [binary.GraphRecord(0, np.zeros((0, 2), np.int64), np.array([[i, j]] * 4000, np.int64)) for j in range(3)]
        binary.write_binary(spark, str(several / f"{i}.dgb"), part)
    read = []
    plain = binary.Opened.read
    monkeypatch.setattr(binary.Opened, "read", lambda self, n: read.append(n) or plain(self, n))
    found = binary.records(spark, str(several))
    assert next(found).insert[0].tolist() == [0, 0] and sum(read) < 4000 * 16 + 200
    assert [r.insert[0].tolist() for r in found] == [[0, 1], [0, 2], [1, 0], [1, 1], [1, 2]]


def test_hypergraph_files(spark, tmp_path):
    path = put(tmp_path, "a.hg", "% c\n1 2 3\n2,4\n6 5 2\n3 2 1\n\n")
    f = hypergraphs.read_hypergraph(spark, path, dedupe_hyperedges=True)
    assert {r.h: list(r.members) for r in f.hypergraph.members().collect()} == {0: [0, 1, 2], 1: [1, 3], 2: [1, 4, 5]} and f.dropped_duplicates == 1
    f = hypergraphs.read_hypergraph(spark, path, max_cardinality=2, relabel="first_appearance", random_weights=(1, 9, 4))
    assert f.dropped_large == 3 and f.hypergraph.members().first().members == [0, 1]
    f = hypergraphs.read_hypergraph(spark, path, relabel="dense_sorted")
    assert f.hypergraph.num_vertices == 6
    path = put(tmp_path, "w.hg", "1 2 ; 4\n3 ;5\n")
    f = hypergraphs.read_hypergraph(spark, path, weighted=True)
    out = str(tmp_path / "o.hg")
    hypergraphs.write_hypergraph(f.hypergraph, out)
    assert open(out).read() == "1 2 ; 4\n3 ; 5\n"
    for bad in ("%dgt 1\n", "1 x\n", "%%MatrixMarket matrix\n1 2\n"):
        with pytest.raises(FileFormat):
            hypergraphs.read_hypergraph(spark, put(tmp_path, "bad.hg", bad))
    with pytest.raises(FileFormat):
        hypergraphs.read_hypergraph(spark, path)
    sets = hypergraphs.from_simplices(spark.createDataFrame([(0, 2), (1, 1), (2, 2)], "at long, n long"), spark.createDataFrame([(0, 5), (1, 6), (2, 9), (3, 6), (4, 5)], "at long, v long"))
    assert sorted(tuple(r) for r in sets.collect()) == [(0, 5), (0, 6), (1, 9)]


def test_result_files(spark, tmp_path):
    tree = spark.createDataFrame([(1, 5, 0), (0, 0, -1), (2, INFINITE, -1)], "v long, distance long, parent long")
    d, p = str(tmp_path / "d.txt"), str(tmp_path / "p.txt")
    results.write_distances(tree, d)
    results.write_parents(tree, p)
    assert open(d).read() == "0 0\n1 5\n2 INF\n" and open(p).read() == "0 -1\n1 0\n2 -1\n"
    assert sorted(tuple(r) for r in results.read_distances(spark, d, 3).collect()) == [(0, 0), (1, 5), (2, INFINITE)]
    assert sorted(tuple(r) for r in results.read_parents(spark, p, 3).collect()) == [(0, -1), (1, 0), (2, -1)]
    with pytest.raises(FileFormat):
        results.read_parents(spark, p, 4)
    labels = spark.createDataFrame([(0, 0.0078125), (1, 0.0234375), (2, 1.0), (3, 1 / 3)], "v long, label float")
    path = str(tmp_path / "l.txt")
    results.write_labels(labels, path)
    assert open(path).read() == "".join(f"{r.v} {r.label:.6f}\n" for r in labels.collect())
    assert results.read_labels(spark, path, 4).count() == 4
    assert results.read_classes(spark, put(tmp_path, "c.txt", "3 1\n")).first()["class"] == 1
    assert [r.capacity for r in results.read_capacities(spark, put(tmp_path, "k.txt", "4\n7\n")).orderBy("v").collect()] == [4, 7]
    costs = spark.createDataFrame([(0, 1, 2), (1, None, None)], "v long, c0 long, c1 long")
    results.write_path_costs(costs, path)
    assert open(path).read() == "0 1 2\n1 INF INF\n"


def test_histograms_and_bins():
    assert results.histogram_csv({3: 2, 2: 1, 4: 0}) == "# cycle_size, num_of_cycles\n2, 1\n3, 2\nTotal, 3\n"
    text = results.bins_json([7], "type1", 3, [[-1], [2]])
    assert results.read_bins_json(text) == {"kind": "type1", "counts": [7], "deltas": [[-1], [2]], "graph_version": 3}
    assert results.read_bins_json(results.bins_json(list(range(30)), "h_motif"))["counts"] == list(range(30))
    for bad in (text.replace("7", "7.0"), text.replace('"version": 1', '"version": 2'), text + "x", text.replace("[7]", "[-7]"), text.replace('"version": 1,', '"version": 1,\n"version": 1,')):
        with pytest.raises(FileFormat):
            results.read_bins_json(bad)


def test_undirected_graphs_hold_both_directions(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "src long, dst long, w0 int"), 3, Properties(directed=False))
    g.apply(EdgeBatch.of(spark, [(2, 0, 4)], [(1, 0)]))
    assert edges(g, "w0") == [(0, 2, 4), (1, 2, 3), (2, 0, 4), (2, 1, 3)]
    g.check()
    rows = {r.id: [(e.dst, e.w0) for e in r.edges] for r in g.rows().collect()}
    assert rows == {0: [(2, 4)], 1: [(2, 3)], 2: [(0, 4), (1, 3)]}
    ptr, cells = g.csr()
    assert [r.row_ptr for r in ptr.orderBy("id").collect()] == [0, 1, 2, 4]
    assert [r.dst for r in cells.orderBy("e").collect()] == [2, 2, 0, 1]
