"""Panels and matrices as files, and the options of the command line."""

import csv

import numpy as np
import pytest

from clademill import cli
from clademill.operators import kernels as K
from clademill.plans import stages as G

RNG = np.random.default_rng(5)
BASE = "".join(RNG.choice(list("ACGT"), 300))


def _changed(n):
    s = list(BASE)
    for i in RNG.choice(300, n, replace=False):
        s[i] = "ACGT"[("ACGT".index(s[i]) + 1) % 4]
    return "".join(s)


RECORDS = {"r2": _changed(30), "g1": BASE, "g3": _changed(12), "r1": _changed(3), "g2": _changed(5), "unnamed": BASE}
MANIFEST = [("g2", "two", "genome", "A"), ("r1", "Ref one", "reference", ""), ("g1", "one", "genome", "A"), ("r2", "Ref two", "reference", ""), ("g3", "three", "genome", "B")]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "p.fa").write_text("".join(f">{i}\n{s[:100]}\n{s[100:]}\n" for i, s in RECORDS.items()))
    (tmp_path / "m.tsv").write_text("id\tlabel\titem_class\tsource_cluster\n" + "".join("\t".join(r) + "\n" for r in MANIFEST))
    return tmp_path


def _table(folder, sep="\t"):
    path = next(folder.glob("part-*.csv"))
    return list(csv.DictReader(path.open(newline=""), delimiter=sep))


def test_files_in_and_tables_out(spark, files):
    at = lambda n: str(files / n)
    cli_args = cli.parser().parse_args(["align-panel", "--panel-fasta", at("p.fa"), "--manifest-tsv", at("m.tsv"), "--outdir", at("a")])
    assert cli_args.panel_dir == "" and cli_args.panel_fasta == at("p.fa")
    G.align_panel(spark, None, at("a"), fasta=at("p.fa"), manifest=at("m.tsv"))
    ids = [r[0] for r in MANIFEST]
    matrix = _table(files / "a" / "matrix_distance")
    assert [r["ID"] for r in matrix] == ids and list(matrix[0]) == ["ID", *ids]
    # the matrices' files are enough, without the folder
    got = G.review(spark, None, None, at("v"), [0.03, 0.06], fasta=at("p.fa"), manifest_file=at("m.tsv"), distance_file=at("a/matrix_distance"), identity_file=at("a/matrix_identity"), umap_neighbors=3)
    assert got["items"] == 5
    best = {r["id"]: r for r in _table(files / "v" / "best_reference_summary")}
    assert best["g1"]["best_ref_label"] == "Ref one" and best["g1"]["second_ref_label"] == "Ref two" and list(best) == ids
    d = np.array([[float(r[i]) for i in ids] for r in matrix])
    nodes = K.tree_nodes(K.neighbor_joining(d), 5)
    lines = _table(files / "v" / "tree_edges")
    assert sum(r["kind"] == "branch" for r in lines) == len(nodes) - 1
    assert sum(r["kind"] == "connector" for r in lines) == len(nodes) - 5 + (1 if any(nodes[k]["parent"] is None for k in range(5)) else 0)
    leaves = {r["child_id"]: r for r in _table(files / "v" / "tree_leaves")}
    assert set(leaves) >= set(ids) - {i for k, i in enumerate(ids) if nodes[k]["parent"] is None}
    assert {r["length_bp"] for r in leaves.values()} == {"300"}
    for kind, prefix in (("agglomerative", "A"), ("tree", "T")):
        rows = _table(files / "v" / f"{kind}_threshold_assignments")
        assert [(r["threshold"], r["id"]) for r in rows] == [(t, i) for t in ("0.030000", "0.060000") for i in sorted(ids)]
        assert all(r[f"{kind}_cluster"].startswith(prefix) for r in rows)
        summary = _table(files / "v" / f"{kind}_threshold_summary")
        for s in summary:
            assert int(s["cluster_count"]) == len({r[f"{kind}_cluster"] for r in rows if r["threshold"] == s["threshold"]})
        assert [r["threshold"] for r in _table(files / "v" / f"{kind}_validation")] == ["0.030000", "0.060000"]


def test_what_is_missing_is_an_error(spark, files):
    at = lambda n: str(files / n)
    rows = G.read_panel(spark, at("p.fa"), at("m.tsv")).orderBy("ord").collect()
    assert [r.id for r in rows] == [r[0] for r in MANIFEST] and [r.ord for r in rows] == [1, 2, 3, 4, 5]
    (files / "more.tsv").write_text("id\tlabel\ng1\tone\nnobody\tx\n")
    (files / "twice.tsv").write_text("id\tlabel\ng1\tone\ng1\tx\n")
    for name in ("more.tsv", "twice.tsv"):
        with pytest.raises(ValueError):
            G.read_panel(spark, at("p.fa"), at(name))
    with pytest.raises(ValueError):
        G.align_panel(spark, None, at("x"), fasta=at("p.fa"))
    (files / "i.tsv").write_text("ID\ta\tb\na\t100\t90\nb\t90\t100\n")
    (files / "d.tsv").write_text("ID\ta\tb\na\t0\t0.1\nb\t0.1\t0\n")
    (files / "o.tsv").write_text("ID\ta\tb\na\t0\t0.2\nb\t0.2\t0\n")
    assert {(r.i, r.j): round(r.v, 9) for r in G._distances(spark, None, None, at("i.tsv")).collect()} == {("a", "a"): 0, ("a", "b"): 0.1, ("b", "a"): 0.1, ("b", "b"): 0}
    assert G._distances(spark, None, at("d.tsv"), at("i.tsv")).count() == 4
    with pytest.raises(ValueError):
        G._distances(spark, None, at("o.tsv"), at("i.tsv"))
    with pytest.raises(ValueError):
        G._distances(spark, None, None, None)


def test_other_names_of_options():
    parse = cli.parser().parse_args
    a = parse("sample-panel --input-fasta a --umap-explorer-dir b --chosen-kmer 5 --chosen-neighbors 50 --chosen-min-dist 0.1 --chosen-leiden-resolution 0.2 --sample-size 9 --outdir o".split())
    assert (a.explorer_dir, a.kmer, a.neighbors, a.min_dist, a.resolution) == ("b", "5", "50", "0.1", 0.2)
    a = parse("umap-explorer --input-fasta a --kmer-values 4,5 --neighbors-values 9 --leiden-neighbor-k 30 --cg-map-tsv m --leiden-resolution-values 1e-3 --validation-subsample-size 5 --outdir o".split())
    assert (a.kmers, a.neighbors, a.graph_neighbors, a.cg_map, a.resolution, a.validation_subsample) == ("4,5", "9", 30, "m", "1e-3", 5)
    a = parse("distance-explorer --panel-fasta f --manifest-tsv m --identity-matrix i --distance-matrix d --novel-threshold 90 --umap-seed 1 --pictures --outdir o".split())
    assert (a.panel_fasta, a.identity_matrix, a.novelty, a.seed, a.pictures) == ("f", "i", 90.0, 1, True)
    a = parse("export-clusters --sequence-fasta f --cluster-tsv c --cluster-list A,B --manifest-tsv m --outdir o".split())
    assert (a.clusters, a.manifest) == ("A,B", "m")
