"""The pipeline's stages in order, on planted cases and on unusual tables."""

import numpy as np

import corpus_pipeline as P

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"v{i}q" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    item, passage, copied = text(40), text(80), text(120)
    rows = {i: text(150) for i in range(100)}
    for i in range(0, 100, 4):
        rows[i] += " vile brute"
    for i in (101, 102, 103):
        rows[i] = text(90) + " " + passage + " " + text(90)
    rows |= {110: copied, 111: copied, 112: copied + " extra", 120: text(60) + " " + item + " " + text(60), 130: None, 131: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, kept = str(tmp_path), {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == {i for i in rows if not (i < 100 and i % 4 == 0)}
    cut = kept["line_dedup"]
    assert set(cut) == set(kept["toxicity"]) and passage in cut[101] and passage not in cut[102] and passage not in cut[103]
    assert all(cut[i] == rows[i] for i in cut if i not in (102, 103))
    assert set(cut) - set(kept["near_dup"]) == {111, 112}
    assert set(kept["near_dup"]) - set(kept["decontaminate"]) == {120}
    out = P.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == set(kept["decontaminate"])


def test_shared_passage_in_most_of_a_document(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}q" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    licence, original = text(200), text(150)
    rows = {i: text(100) + " " + licence for i in range(8)} | {20: original, 21: original, 22: original + " extra"}
    rows[30] = rows[3]  # a copy of a document that is cut
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], SCHEMA)
    cut = {r.doc_id: r for r in P.line_dedup(spark, docs, "").collect()}
    assert set(cut) == set(rows) and all(r.n_chars == len(r.text) for r in cut.values())
    assert cut[0].text == rows[0] and all(cut[i].text == rows[i] for i in (20, 21, 22))
    for i in range(1, 8):  # own words stay, the licence goes but for its ends
        left = cut[i].text.split()
        assert left[:100] == rows[i].split()[:100] and len(left) < 140
    assert len(cut[30].text.split()) < 60
    kept = {r.doc_id for r in P.near_dup(spark, spark.createDataFrame(list(cut.values()), SCHEMA), "").collect()}
    assert not kept & {21, 22} and set(range(8)) <= kept


def test_what_only_a_removed_copy_held_before_stays(spark):
    """Document 2 is a copy of 1 and a passage, which 3 holds among other words."""
    rng = np.random.default_rng(6)
    words = [f"v{i}q" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    passage, original = text(90), text(400)
    rows = {1: original, 2: original + " " + passage, 3: text(300) + " " + passage + " " + text(300), 4: text(200) + " " + passage + " " + text(90)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], SCHEMA)
    cut = spark.createDataFrame(P.line_dedup(spark, docs, "").collect(), SCHEMA)
    kept = {r.doc_id: r.text for r in P.near_dup(spark, cut, "").collect()}
    assert set(kept) == {1, 3, 4} and kept[1] == original and kept[3] == rows[3]
    assert passage not in kept[4] and len(kept[4].split()) < 360


def test_empty(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
