"""Sources, and all stages end to end on a small collection."""

import pytest

from clademill.plans import stages as G
from clademill.sources import fasta as I

GENOMES = {"g1": "AAAAACCCCCAAAAACCCCCAAAA", "g2": "AAAAACCCCCAAAATCCCCCAAAA", "g3": "GGGGGTTTTTGGGGGTTTTTGGGG", "g4": "GGGGGTTTTTGGGGATTTTTGGGG"}
REFS = {"r1": GENOMES["g1"], "r2": GENOMES["g3"]}


def _fasta(path, records):
    path.write_text("".join(f">{i} some words\n{s[:10]}\n{s[10:]}\n" for i, s in records.items()))
    return str(path)


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">x first one\nac--\ngt\n\n>y\nAC-RT\n>x again\nTTTT\n")
    rows = lambda **k: [(r.id, r.seq) for r in I.read_fasta(spark, str(p), **k).orderBy("ord").collect()]
    assert rows(duplicates="all", keep_gaps=True) == [("x", "AC--GT"), ("y", "AC-RT"), ("x", "TTTT")]
    assert rows(duplicates="first") == [("x", "ACGT"), ("y", "ACRT")]
    assert rows(duplicates="last") == [("x", "TTTT"), ("y", "ACRT")]
    with pytest.raises(ValueError):
        I.read_fasta(spark, str(p), duplicates="some")


def test_state_slugs_are_distinct():
    assert G.state_slug(3, 3, 0.3, 0.01) == "k3_n3_d0p3_r1e-02"
    assert len({G.state_slug(3, 3, 0.3, r) for r in (0.15, 0.11, 0.1)}) == 3
    assert "e" not in G.state_slug(3, 3, 1e-5, 1.0).split("_d")[1].split("_r")[0]


def test_stages(spark, tmp_path):
    genomes, refs = _fasta(tmp_path / "g.fa", GENOMES), _fasta(tmp_path / "r.fa", REFS)
    out = lambda n: str(tmp_path / n)
    states = G.explore(spark, genomes, refs, out("x"), [3], [3], [0.3], [0.01], graph_k=3, validation_k=[1], validation_size=4)
    assert states.count() == 6
    panel = G.sample_panel(spark, genomes, refs, out("x"), 3, 3, 0.3, 5, out("p"), 0.01)
    assert panel.where("item_class = 'genome'").count() <= 3 and panel.where("item_class = 'reference'").count() == 2
    with pytest.raises(ValueError):
        G.sample_panel(spark, genomes, refs, out("x"), 3, 3, 0.3, 2, out("p2"), 0.01)
    (tmp_path / "focal").write_text("# chosen\ng2\n\n")
    kept = G.collapse_panel(spark, genomes, out("x"), 3, 3, 0.3, out("c"), refs, 0.01, 70.0, 5, out("focal"))
    assert "g2" in {r.id for r in kept.where("selection_mode = 'focal'").collect()}
    (tmp_path / "focal").write_text("nobody\n")
    with pytest.raises(ValueError):
        G.collapse_panel(spark, genomes, out("x"), 3, 3, 0.3, out("c2"), refs, 0.01, 98.1, 5, out("focal"))
    d = {(r.i, r.j): r.v for r in G.align_panel(spark, out("p"), out("a")).collect()}
    assert all(d[k] == d[k[::-1]] for k in d) and all(v == 0 for k, v in d.items() if k[0] == k[1])
    got = G.review(spark, out("p"), out("a"), out("v"), [0.05, 0.1], 92.0, out("x"), 3, 0.3, 0.8)
    assert got["novel"] == 0
    events = tmp_path / "e.csv"
    events.write_text("Method,Start,End,Recombinant,Parent1,Parent2,Pvalue\ngeneconv,5,15,g1,g3,-,0.001\nrdp,6,15,g1,g3,-,0.002\nrdp,x,15,g1,g3,-,0.002\n")
    (tmp_path / "f.tsv").write_text("name\tstart\tend\nrep\t1\t7\ncp\t90\t99\n")
    rows = G.recombination(spark, genomes, out("rec"), [str(events), out("missing.csv")], 2, 0.05, out("f.tsv")).collect()
    assert len(rows) == 1 and rows[0].features == "rep" and rows[0].n_methods == 2
    (tmp_path / "t.tsv").write_text("id\tcluster\titem_class\tthreshold\ng1\tA/1\t\t0.050000\ng2\tA/1\tgenome\t0.050000\ng3\tB\treference\t0.1\n")
    summary = {r.cluster: (r.members, r.genomes, r.references) for r in G.export_clusters(spark, genomes, out("t.tsv"), out("ex"), filter_column="threshold", filter_value="0.05").collect()}
    assert summary == {"A/1": (2, 2, 0)}
    assert (tmp_path / "ex" / "clusters" / "slug=A_1").is_dir()


def test_cli_parses():
    from clademill.cli import parser

    a = parser().parse_args(["collapse-panel", "--input-fasta", "a", "--explorer-dir", "b", "--kmer", "5", "--neighbors", "50", "--min-dist", "0.1", "--outdir", "o"])
    assert a.identity_threshold == 98.1 and a.jaccard_k == 15
