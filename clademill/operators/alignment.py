"""All-pairs alignment identity, in tiles, by the built-in kernel or an external program."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.operators.kernels import align_identities, align_identity
from clademill.plans.shared import partitions

ALIGNERS = ("builtin", "mafft", "muscle")


def usable(path: str | Path) -> bool:
    """Whether a file can be executed; a place that may not be looked at is not usable."""
    try:
        return Path(path).is_file() and os.access(path, os.X_OK)
    except OSError:
        return False


def resolve_executable(hint: str | None, name: str, fallbacks: list[str] | None = None) -> str:
    """The hint if it names a usable file, else ``name`` on PATH, else a usable fallback, else the hint or name as it is."""
    if hint and hint != name and usable(hint):
        return str(Path(hint).resolve())
    found = shutil.which(name) or next((str(Path(f).resolve()) for f in fallbacks or [] if usable(f)), None)
    return found or hint or name


def column_identity(a: str, b: str) -> float:
    """100 * equal / columns without a gap of two aligned rows; 0 if there are none."""
    both = [x == y for x, y in zip(a.upper(), b.upper(), strict=False) if x != "-" and y != "-"]
    return 100.0 * sum(both) / len(both) if both else 0.0


def _rows(fasta: str) -> list[str]:
    return ["".join(part.split("\n")[1:]).replace(" ", "") for part in ("\n" + fasta.replace("\r", "")).split("\n>")[1:]]


def external_identity(a: str, b: str, aligner: str, program: str) -> float:
    """Identity of two sequences as an external program aligns them; an error with its words where it fails."""
    with tempfile.TemporaryDirectory(prefix="align") as folder:
        source, target = Path(folder, "pair.fasta"), Path(folder, "aligned.fasta")
        source.write_text(f">a\n{a}\n>b\n{b}\n")
        if aligner == "mafft":
            commands = [[program, "--quiet", "--thread", "1", str(source)]]
        else:  # the present and the former option names
            commands = [[program, "-align", str(source), "-output", str(target)], [program, "-in", str(source), "-out", str(target)]]
        said = ""
        for command in commands:
            try:
                done = subprocess.run(command, capture_output=True, text=True)
            except OSError as problem:
                raise RuntimeError(f"{aligner} cannot be run as {program}: {problem}") from problem
            said = done.stderr or said
            if done.returncode == 0 and (aligner == "mafft" or target.is_file()):
                rows = _rows(done.stdout if aligner == "mafft" else target.read_text())
                return column_identity(*rows) if len(rows) == 2 else 0.0
    raise RuntimeError(f"{aligner} failed: {said.strip()[:500]}")


def identity_of(aligner: str, program: str | None = None) -> Callable[[str, str], float]:
    """The function that scores two sequences; an external program is looked for where it runs."""
    if aligner not in ALIGNERS:
        raise ValueError(f"aligner must be one of {ALIGNERS}")
    if aligner == "builtin":
        return align_identity
    found = resolve_executable(program, aligner)
    return lambda a, b: external_identity(a, b, aligner, found)


def identity_pairs(seqs: DataFrame, tile: int = 25, aligner: str = "builtin", program: str | None = None) -> DataFrame:
    """``(a, b, identity)`` of all id pairs with ``ord_a < ord_b``.

    Sequences are dealt into tiles of at most about ``tile``, fewer where that leaves cores idle;
    each pair of tiles is one group of rows, so a sequence is shipped once per tile
    and not once per pair. ``program`` is the external aligner's path or name.
    """
    if aligner not in ALIGNERS:
        raise ValueError(f"aligner must be one of {ALIGNERS}")
    spark = seqs.sparkSession
    total, parts = seqs.count(), partitions(spark)
    n = max(1, -(-total // tile), min(total // 4, int((16 * parts) ** 0.5) + 1))
    own = seqs.select("ord", "id", "seq", F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int").alias("t"))
    rows = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), "t", "ord", "id", "seq")
    rows = rows.repartition(min(n * (n + 1) // 2, 4 * parts), "ta", "tb").sortWithinPartitions("ta", "tb", "ord")
    kind = seqs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None if aligner == "builtin" else identity_of(aligner, program)
        score = align_identities if one is None else lambda pairs: [one(x, y) for x, y in pairs]
        held: list[dict] = []
        ids = None

        def out() -> Iterator[pa.RecordBatch]:
            ta, tb = held[0]["ta"], held[0]["tb"]
            both = [(x, y) for i, x in enumerate(held) for y in held[i + 1 :] if ta == tb or x["t"] != y["t"]]
            told = score([(x["seq"], y["seq"]) for x, y in both])
            if both:
                yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x, _ in both], ids), pa.array([y["id"] for _, y in both], ids), pa.array(told)], names=["a", "b", "identity"])

        for batch in batches:
            ids = batch.schema.field("id").type
            for r in batch.to_pylist():
                if held and (held[0]["ta"], held[0]["tb"]) != (r["ta"], r["tb"]):
                    yield from out()
                    held = []
                held.append(r)
        if held:
            yield from out()

    return rows.mapInArrow(run, f"a {kind}, b {kind}, identity double")


def identity_to_distance(pairs: DataFrame) -> DataFrame:
    """``(i, j, v)`` with 1 - identity / 100, both directions, and 0 on the diagonal."""
    d = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), (1 - F.col("identity") / 100).alias("v"))
    ids = pairs.select("a").union(pairs.select("b")).distinct().toDF("i")
    return d.unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).unionByName(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("v")))
