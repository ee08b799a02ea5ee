"""Small inputs and outputs, types of all queries, views of clusters, external scans."""

import json
import stat

import pytest

from clademill.operators import clusters as C
from clademill.operators import kernels as K
from clademill.operators import recombination as R
from clademill.plans import stages as G
from clademill.sources import fasta as I
from clademill.sources import sinks as O


def test_json_and_summary(spark, tmp_path):
    assert I.read_json(spark, str(tmp_path / "none")) == {} == I.read_summary(spark, str(tmp_path / "none"))
    O.write_text(spark, str(tmp_path / "a/b.json"), json.dumps({"x": [1, "é"]}))
    assert I.read_json(spark, str(tmp_path / "a/b.json")) == {"x": [1, "é"]}
    O.write_summary(spark, str(tmp_path / "s.txt"), {"a": 1, "b": None, "c": "x\ty"})
    (tmp_path / "t.txt").write_text((tmp_path / "s.txt").read_text() + "no tab\n\na\t2\n")
    assert I.read_summary(spark, str(tmp_path / "t.txt")) == {"a": "2", "b": "", "c": "x\ty"}
    (tmp_path / "empty").write_text("")
    assert I.read_summary(spark, str(tmp_path / "empty")) == {}


def test_types_of_all_queries(spark):
    hits = spark.createDataFrame([(0, "q1", "s1", 95.0, 80.0, 10.0), (1, "q1", "s2", 99.0, 80.0, 30.0), (2, "q2", "s1", 40.0, 80.0, 50.0), (3, "q3", "s9", 91.0, 80.0, 5.0)], "ord int, qseqid string, sseqid string, pident double, qcovs double, bitscore double")
    types = spark.createDataFrame([("s1", "GI"), ("s2", "GII")], "sseqid string, type string")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "id string")
    got = {r.id: (r.type, r.pident) for r in C.typed(queries, hits, types, least_pident=50.0).collect()}
    assert got == {"q1": ("GII", 99.0), "q2": ("untyped", None), "q3": ("s9", 91.0), "q4": ("untyped", None)}


def test_first_coding_part(spark):
    features = spark.createDataFrame([("a", 0, "gene", "capsid", "", "", "A" * 9), ("a", 1, "CDS", "RdRp", "", "", "C" * 9), ("a", 2, "CDS", "Major capsid", None, "", "G" * 9), ("a", 3, "CDS", "capsid", "", "", "T" * 9), ("b", 0, "CDS", "", "VP1", "", "A" * 50), ("c", 0, "CDS", None, "", "like VP1", "A" * 8)], "id string, ord int, kind string, product string, gene string, note string, seq string")
    records = spark.createDataFrame([("a", "N" * 99), ("b", "N" * 10), ("c", "N" * 99), ("d", "N" * 99)], "id string, seq string")
    got = {r.id: (r.seq, r.description) for r in I.first_coding(features, records, ["capsid", "VP1"], 8, 12).collect()}
    assert got == {"a": ("G" * 9, "major capsid"), "b": ("N" * 10, "whole record"), "c": ("A" * 8, "capsid")}


def test_view_follows_a_length_window(spark):
    rows = [(i, float(i % 3), float(i // 3), f"C{10 - i % 2}", 100 * i, "genome") for i in range(12)] + [(99, 50.0, 50.0, "C10", 500, "reference")]
    points = spark.createDataFrame(rows, "id int, x double, y double, cluster string, len int, item_class string")
    view = {r.cluster: r for r in C.cluster_view(points).collect()}
    assert [view[c].place for c in ("C9", "C10")] == [1, 2] and view["C10"].genomes == 6 and view["C10"].pct_genomes == 50.0
    hull = K.hull([[x, y] for _, x, y, c, _, k in rows if c == "C10" and k == "genome"])
    assert [(p.x, p.y) for p in view["C10"].hull] == [tuple(p) for p in hull]
    some = {r.cluster: r for r in C.cluster_view(points, 300, 700).collect()}
    assert (some["C10"].genomes, some["C9"].genomes) == (2, 3) and not some["C10"].hull


def test_best_cell(spark):
    rows = spark.createDataFrame([("b", 1, 0.5), ("a", 2, 0.9), ("a", 1, 0.9), ("c", 1, None), ("d", 1, float("nan"))], "target string, k int, nmi double")
    assert tuple(C.best_cell(rows, "nmi", ["target", "k"]).first()) == ("a", 1, 0.9) and C.best_cell(rows.limit(0), "nmi", ["target"]).first() is None


def test_recoded_counts(spark):
    rows = spark.createDataFrame([("a", "ACRYRN-"), ("b", "KACGT"), ("c", "")], "id string, seq string")
    assert {r.code: r.n for r in R.recoded_counts(rows).collect()} == {"R": 2, "Y": 1, "K": 1}
    assert {r.id: (r.seq, r.recoded) for r in R.sanitise(rows).collect()} == {"a": ("ACNNNN-", 3), "b": ("NACGT", 1), "c": ("", 0)}


def test_records_of_one_id_are_items_of_the_explorer(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nACGTACGTAC\n>b\nGGGGGTTTTT\n>a\nTTTTTGGGGG\n>c\nACACACACAC\n")
    (tmp_path / "r.fa").write_text(">b\nACGTACGTAA\n")
    states = G.explore(spark, str(tmp_path / "g.fa"), str(tmp_path / "r.fa"), str(tmp_path / "x"), [2], [2], [0.1], [1.0], graph_k=2)
    assert sorted((r.id, r.item_class) for r in states.collect()) == [("a", "genome"), ("a", "genome"), ("b", "genome"), ("b", "reference"), ("c", "genome")]


def test_scan_by_method(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\n" + "A" * 40 + "\n>y\n" + "C" * 40 + "\n>z\n" + "A" * 20 + "C" * 10 + "A" * 9 + "R\n")
    program = tmp_path / "scan.sh"
    program.write_text('#!/bin/sh\ncase "$5" in bad) echo no >&2; exit 3;; esac\ngrep -q N "$1" || exit 4\nprintf "Method,Start,End,Recombinant,Parent1,Parent2,Pvalue\\n$5,20,30,z,x,y,0.001\\n" > "$3"\n')
    program.chmod(program.stat().st_mode | stat.S_IXUSR)
    out = tmp_path / "out"
    rows = G.recombination(spark, str(tmp_path / "a.fa"), str(out), [], 2, scan_command=[str(program)], methods=["rdp", "bad", "maxchi"]).collect()
    assert [(r.methods, r.recombinant_resolved, r.donor_parent, r.role_support) for r in rows] == [(["maxchi", "rdp"], "z", "y", 39)]
    status = json.loads((out / "scan_status.json").read_text())
    assert status["rdp"] == status["maxchi"] == "ok" and status["bad"].startswith("failed (exit 3): no")
    assert json.loads((out / "recoded.json").read_text())["codes"] == {"R": 1} and (out / "raw_rdp.csv").is_file() and (out / "raw_events").is_dir()
    with pytest.raises(RuntimeError):
        G.recombination(spark, str(tmp_path / "a.fa"), str(tmp_path / "o2"), [], 2, scan_command=[str(program)], methods=["bad"])
    with pytest.raises(OSError):
        G.recombination(spark, str(tmp_path / "a.fa"), str(tmp_path / "o3"), [], 2, scan_command=[str(tmp_path / "absent")], methods=["rdp"])


def test_export_headers_of_a_manifest(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">b\nACGT\n>a\nTTTT\n>c\nGG\n")
    (tmp_path / "t.tsv").write_text("id\tcluster\na\tX 1\nb\tX 1\nc\tY\n")
    (tmp_path / "m.tsv").write_text("id\tlabel\titem_class\tsource_cluster\na\tAlpha\treference\tC1\nb\tBeta\t\t\n")
    got = G.export_clusters(spark, str(tmp_path / "s.fa"), str(tmp_path / "t.tsv"), str(tmp_path / "o"), manifest=str(tmp_path / "m.tsv"), prefix="p")
    assert {r.cluster: (r.members, r.genomes, r.references) for r in got.collect()} == {"X 1": (2, 1, 1), "Y": (1, 1, 0)}
    text = "".join(p.read_text() for p in (tmp_path / "o/clusters/slug=p_X_1").glob("part-*"))
    assert text == ">Alpha id=a cluster=X 1 item_class=reference source_cluster=C1\nTTTT\n>Beta id=b cluster=X 1\nACGT\n"
    assert I.read_summary(spark, str(tmp_path / "o/summary.txt"))["exports"] == "2"


def test_picture_is_optional(spark, tmp_path):
    cells = spark.createDataFrame([("a", "b", 90.0)], "row string, col string, v double")
    assert O.png_heatmap(cells, "t", str(tmp_path / "x.png")) == (tmp_path / "x.png").exists()


def test_states_of_delimited_tables(spark, tmp_path):
    for state, rows in (("k3_n5_d0p1_r1e-02", "a\tA\tgenome\tC01\nb\tB\treference\tC02\n"), ("other", "a\tA\tgenome\tC09\n")):
        for name, head, body in (("assignments", "id\tlabel\titem_class\tcluster\n", rows), ("coords", "ID,AF_UMAP1,AF_UMAP2\n", "a,1.5,2\nb,3,4\n")):
            (tmp_path / "x/tables" / state / name).mkdir(parents=True)
            (tmp_path / "x/tables" / state / name / "part-0.csv").write_text(head + body)
    got = {(r.state_id, r.id): (r.k, r.min_dist, r.resolution, r.cluster, r.x) for r in I.read_states(spark, str(tmp_path / "x/tables")).collect()}
    assert got == {("k3_n5_d0p1_r1e-02", "a"): (3, 0.1, 0.01, "C01", 1.5), ("k3_n5_d0p1_r1e-02", "b"): (3, 0.1, 0.01, "C02", 3.0), ("other", "a"): (None, None, None, "C09", 1.5)}
    assert G._state(spark, str(tmp_path / "x"), 3, 5, 0.1, 0.01).count() == 2


def test_matrix_file(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("ID\ta\tb\na\t0\t0.25\nb\t0.25\t0\n")
    assert {(r.i, r.j): r.v for r in I.read_matrix(spark, str(tmp_path / "m.tsv")).collect()} == {("a", "a"): 0.0, ("a", "b"): 0.25, ("b", "a"): 0.25, ("b", "b"): 0.0}
    (tmp_path / "w.tsv").write_text("ID\ta\tb\nb\t0\t0.25\na\t0.25\t0\n")
    with pytest.raises(ValueError):
        I.read_matrix(spark, str(tmp_path / "w.tsv"))


def test_assign_types(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">q1\nAC\n>q2\nGT\n")
    (tmp_path / "h.tsv").write_text("q1\ts1\t90\t80\t10\nq1\ts2\t95\t80\t10\n")
    (tmp_path / "t.tsv").write_text("id\ttype\ns1\tGI\ns2\tGII\n")
    got = G.assign_types(spark, str(tmp_path / "s.fa"), str(tmp_path / "h.tsv"), str(tmp_path / "t.tsv"), str(tmp_path / "o"))
    assert {r.id: (r.type, r.pident) for r in got.collect()} == {"q1": ("GI", 90.0), "q2": ("untyped", None)}  # the first hit on ties


def test_distinct_records_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{{"id": "{}", "seq": "{}", "at": "2026-01-0{}T00:00:00"}}\n'
    (tmp_path / "in/1.json").write_text(line.format("a", "AC-GT", 1) + line.format("b", "acgt", 1) + line.format("c", "GG", 1))
    run = lambda: G.distinct_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "9 days").awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text(line.format("d", "ACGT", 2) + line.format("e", "TT", 2))
    run()
    rows = [r.seq.replace("-", "").upper() for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == ["ACGT", "GG", "TT"]
