"""The jobs, run again and over input that grows, on copies."""

import hashlib
import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, dereplicate, panel

DOCS = "/root/testdata/sf0.001/documents.parquet"
MEMBERS = ["id", "representative", "letters", "identity", "lang"]


def _rows(frame, columns=MEMBERS):
    return sorted(tuple(str(v) for v in r) for r in frame.select(*columns).collect())


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    return _rows(dereplicate.run(spark, DOCS, str(folder / "out"), str(folder / "mark")))


def _arrive(spark, folder, number, low, high):
    """Adds a file of the documents from ``low`` to ``high`` to a growing table."""
    at = f"{folder}-{number}"
    spark.read.parquet(DOCS).where(F.col("doc_id").between(low, high)).coalesce(1).write.parquet(at)
    Path(folder).mkdir(exist_ok=True)
    for part in Path(at).glob("part-*"):
        shutil.move(part, Path(folder) / f"{number}-{part.name}")


@pytest.mark.parametrize("bounds", [(90, 199), (3, 4, 150, 199), (199,)])
def test_dereplication_does_not_depend_on_how_the_input_arrives(spark, tmp_path, whole, bounds):
    source, out, mark = str(tmp_path / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "mark")
    last, before = -1, {}
    for number, bound in enumerate(bounds):
        _arrive(spark, source, number, last + 1, bound)
        got = dereplicate.run(spark, source, out, mark)
        files = _files(out)
        assert before.items() <= files.items()  # what was written stays as it is
        assert got.count() == spark.read.parquet(source).count()
        last, before = bound, files
    assert _rows(got) == whole
    assert _rows(dereplicate.run(spark, source, out, mark)) == whole and _files(out) == before  # nothing new, nothing written


def test_a_batch_that_is_repeated_gives_the_same(spark, tmp_path, whole):
    """The mark is lost, as if a run had ended between its write and its commit."""
    out = str(tmp_path / "out")
    for mark in ("a", "b"):
        got = dereplicate.run(spark, DOCS, out, str(tmp_path / mark))
    assert _rows(got) == whole


def test_dereplication_of_odd_rows(spark, tmp_path):
    seq = "".join(random.Random(3).choices("ACGT", k=300))
    near, far = seq[:150] + "A" + seq[151:], seq[::-1]
    source, out, mark = (str(tmp_path / x) for x in ("t", "out", "mark"))
    schema = "doc_id bigint, text string, lang string, rep string"
    spark.createDataFrame([(5, seq, "en", "x"), (6, near, None, "x"), (7, None, "", "x"), (7, "ACG", "b", "x"), (None, seq, "en", "x"), (8, seq.lower(), "en", "x")], schema).write.parquet(source)
    dereplicate.run(spark, source, out, mark)
    spark.createDataFrame([(1, near, "a/b", "y"), (6, far, "en", "y"), (9, far, "en", "y"), (10, "no letters: xyz", "en", "y")], schema).write.mode("append").parquet(source)
    got = {r.id: (r.representative, r.lang, r.arrival) for r in dereplicate.run(spark, source, out, mark).collect()}
    assert got == {5: (5, "en", 0), 6: (5, "unknown", 0), 7: (7, "unknown", 0), 8: (5, "en", 0), 1: (5, "a/b", 1), 9: (9, "en", 1), 10: (10, "en", 1)}


def _panel_by_hand(docs, share, seed, least=40, ambiguous=0.9):
    kept = {}
    for d in sorted((d for d in docs if d.doc_id is not None), key=lambda d: d.doc_id):
        upper = (d.text or "").replace("-", "").upper()
        seq = "".join(c for c in upper if c in "ACGT")
        if len(seq) >= least and round(1 - len(seq) / len(upper), 6) <= ambiguous:
            kept.setdefault(seq, (d.doc_id, f"{d.lang or 'unknown'}-{d.source or 'unknown'}"))
    groups = {}
    for i, c in kept.values():
        groups.setdefault(c, []).append(i)
    n, total = len(kept), int(len(kept) * share)
    quota = {c: total * len(g) // n for c, g in groups.items()}
    for c in sorted(groups, key=lambda c: (total * len(groups[c]) % n, c), reverse=True)[: total - sum(quota.values())]:
        quota[c] += 1
    return {c: sorted(sorted(g, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[: quota[c]]) for c, g in groups.items() if quota[c]}


def test_panel_equals_the_rule_by_hand_and_reruns(spark, tmp_path):
    docs = spark.read.parquet(DOCS).collect()
    config = tmp_path / "panel.json"
    for share in (0.3, 0.05):  # the second run into one folder has fewer clusters
        config.write_text(json.dumps({"share": share, "seed": 7}))
        for _ in range(2):
            got = panel.run(spark, DOCS, str(tmp_path / "out"), str(config))
            picked = {}
            for r in got.collect():
                picked.setdefault(r.cluster, []).append(r.id)
            assert {c: sorted(g) for c, g in picked.items()} == _panel_by_hand(docs, share, 7)
    quotas = spark.read.parquet(str(tmp_path / "out" / "quotas"))
    assert quotas.agg(F.sum("quota")).first()[0] == sum(map(len, picked.values()))


def test_panel_of_odd_rows_and_of_none(spark, tmp_path):
    a, c = "ACGT" * 20, "GGTTAACC" * 9
    rows = [(3, a, "en", None, "k"), (2, a.lower(), "de", "s", "k"), (None, c, "en", "s", "k"), (4, c, None, "x/y", "k"), (5, "short", "en", "s", "k"), (6, None, "en", "s", "k")]
    source, schema = str(tmp_path / "t"), "doc_id bigint, text string, lang string, source string, _key string"
    spark.createDataFrame(rows, schema).write.parquet(source)
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"share": 1.0}))
    got = {r.id: (r.copies, r.cluster, r.letters) for r in panel.run(spark, source, str(tmp_path / "out"), str(config)).collect()}
    assert got == {2: (2, "de-s", 80), 4: (1, "unknown-x/y", 72)}
    spark.createDataFrame([], schema).write.parquet(f"{source}-none")
    assert panel.run(spark, f"{source}-none", str(tmp_path / "none")).collect() == []


def test_unknown_settings_are_an_error(tmp_path):
    config = tmp_path / "c.json"
    config.write_text('{"sahre": 1}')
    with pytest.raises(ValueError, match="sahre"):
        common.settings(panel.DEFAULTS, str(config))


def test_config_files_say_the_defaults():
    here = Path(panel.__file__).parent
    assert json.loads((here / "panel.json").read_text()) == panel.DEFAULTS
    assert json.loads((here / "dereplicate.json").read_text()) == dereplicate.DEFAULTS


def test_command_line(tmp_path):
    done = subprocess.run([sys.executable, "-m", "jobs.panel", "--source", DOCS, "--output", str(tmp_path / "out"), "--master", "local[2]"], cwd=Path(panel.__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows read" in done.stderr and "written" in done.stderr
    assert list((tmp_path / "out" / "panel").glob("cluster=*/part-*.parquet"))
