"""Command line: one subcommand per stage."""

from __future__ import annotations

import argparse
import shlex

from pyspark.sql import SparkSession

from clademill.plans import stages


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _ints(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def _floats(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


#: Other names of options, of all commands or of one.
ALSO = {
    "explorer-dir": ("umap-explorer-dir",), "kmer": ("chosen-kmer",), "neighbors": ("chosen-neighbors",), "min-dist": ("chosen-min-dist",),
    ("sample-panel", "resolution"): ("chosen-leiden-resolution",), ("collapse-panel", "resolution"): ("chosen-leiden-resolution",),
    ("umap-explorer", "kmers"): ("kmer-values",), ("umap-explorer", "neighbors"): ("neighbors-values",), ("umap-explorer", "min-dist"): ("min-dist-values",),
    ("umap-explorer", "resolution"): ("leiden-resolution-values", "leiden-resolution"), ("umap-explorer", "graph-neighbors"): ("leiden-neighbor-k",),
    ("umap-explorer", "cg-map"): ("cg-map-tsv",), ("umap-explorer", "validation-subsample"): ("validation-subsample-size",),
    ("distance-explorer", "novelty"): ("novel-threshold",), ("distance-explorer", "explorer-dir"): ("umap-explorer-dir",), ("distance-explorer", "seed"): ("umap-seed",),
    ("recombination", "pvalue-max"): ("pvalue",), ("export-clusters", "clusters"): ("cluster-list",), ("export-clusters", "manifest"): ("manifest-tsv",),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clademill")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, required: list[str], **defaults):
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", *(f"--{x}" for x in ALSO.get((name, r), ALSO.get(r, ()))), required=True)
        for k, v in defaults.items():
            kind = type(v) if v is not None and not isinstance(v, list) else str
            name = "--" + k.replace("_", "-")
            names = [name, *(f"--{x}" for x in ALSO.get((p.prog.split()[-1], name[2:]), ()))]
            if kind is bool:
                p.add_argument(*names, action="store_true")
            else:
                p.add_argument(*names, default=v, type=kind)
        return p

    command("umap-explorer", ["input-fasta", "outdir"], reference_fasta="", cg_map="", kmers="5", neighbors="50,100,150,200", min_dist="0.05,0.1,0.3,0.5,0.8", resolution="1e-6", seed=42, graph_neighbors=300, validation_neighbors="10,30,100", validation_subsample=1000, validation_replicates=1)
    command("sample-panel", ["input-fasta", "explorer-dir", "kmer", "neighbors", "min-dist", "sample-size", "outdir"], reference_fasta="", resolution=1e-6)
    command("collapse-panel", ["input-fasta", "explorer-dir", "kmer", "neighbors", "min-dist", "outdir"], reference_fasta="", resolution=1e-6, identity_threshold=98.1, jaccard_k=15, focal_ids="")
    command("align-panel", ["outdir"], panel_dir="", panel_fasta="", manifest_tsv="", aligner="builtin", mafft="mafft", muscle="muscle")
    command("distance-explorer", ["outdir"], panel_dir="", panel_fasta="", manifest_tsv="", aligned_dir="", identity_matrix="", distance_matrix="", pictures=False, thresholds="0.03,0.04,0.05,0.06,0.07,0.08,0.10", novelty=92.0, explorer_dir="", umap_neighbors=30, umap_min_dist=0.5, umap_spread=0.8, seed=42)
    command("recombination", ["alignment-fasta", "outdir"], events="", min_methods=3, pvalue_max=0.05, feature_tsv="", scan_command="", methods="")
    command("export-clusters", ["sequence-fasta", "cluster-tsv", "outdir"], id_column="id", cluster_column="cluster", filter_column="", filter_value="", clusters="", manifest="", filename_prefix="")
    command("assign-types", ["sequence-fasta", "hits", "types", "outdir"], least_pident=0.0, least_qcovs=0.0)
    command("distinct-records", ["arriving", "outdir", "checkpoints"], delay="1 day")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("clademill").getOrCreate()
    if a.command == "umap-explorer":
        stages.explore(spark, a.input_fasta, a.reference_fasta or None, a.outdir, _ints(a.kmers), _ints(a.neighbors), _floats(a.min_dist), _floats(a.resolution), a.seed, a.graph_neighbors, a.cg_map or None, _ints(a.validation_neighbors), a.validation_subsample, a.validation_replicates)
    elif a.command == "sample-panel":
        stages.sample_panel(spark, a.input_fasta, a.reference_fasta or None, a.explorer_dir, int(a.kmer), int(a.neighbors), float(a.min_dist), int(a.sample_size), a.outdir, a.resolution)
    elif a.command == "collapse-panel":
        stages.collapse_panel(spark, a.input_fasta, a.explorer_dir, int(a.kmer), int(a.neighbors), float(a.min_dist), a.outdir, a.reference_fasta or None, a.resolution, a.identity_threshold, a.jaccard_k, a.focal_ids or None)
    elif a.command == "align-panel":
        stages.align_panel(spark, a.panel_dir or None, a.outdir, a.aligner, {"mafft": a.mafft, "muscle": a.muscle}.get(a.aligner), a.panel_fasta or None, a.manifest_tsv or None)
    elif a.command == "distance-explorer":
        stages.review(spark, a.panel_dir or None, a.aligned_dir or None, a.outdir, _floats(a.thresholds), a.novelty, a.explorer_dir or None, a.umap_neighbors, a.umap_min_dist, a.umap_spread, a.seed, a.pictures, a.panel_fasta or None, a.manifest_tsv or None, a.distance_matrix or None, a.identity_matrix or None)
    elif a.command == "recombination":
        stages.recombination(spark, a.alignment_fasta, a.outdir, _names(a.events), a.min_methods, a.pvalue_max, a.feature_tsv or None, shlex.split(a.scan_command) or None, _names(a.methods))
    elif a.command == "assign-types":
        stages.assign_types(spark, a.sequence_fasta, a.hits, a.types, a.outdir, a.least_pident, a.least_qcovs)
    elif a.command == "distinct-records":
        stages.distinct_records(spark, a.arriving, a.outdir, a.checkpoints, a.delay).awaitTermination()
    else:
        stages.export_clusters(spark, a.sequence_fasta, a.cluster_tsv, a.outdir, a.id_column, a.cluster_column, a.filter_column or None, a.filter_value or None, _names(a.clusters) or None, a.manifest or None, a.filename_prefix)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
