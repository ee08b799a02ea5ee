"""Document fingerprints by consistent weighted sampling of words.

A document is a weighted set: its words (lower case, cut at white space), each with
the number of its occurrences. A slot of the fingerprint holds one sample of that
set, drawn so that two sets draw the same sample with the probability of their
generalised Jaccard similarity: the sum of the smaller weights by the sum of the
larger. For a word of weight ``s``, a slot takes ``r`` and ``c`` from Gamma(2, 1) and
``b`` from Uniform(0, 1), all by hash of the word:

    t = floor(ln s / r + b),    ln a = ln c - r * (t - b + 1)

and samples the ``(word, t)`` of the smallest ``a``. As ``a`` is a function of word and
``t``, the smallest ``ln a`` itself stands for the sample, and nothing else is kept. The
slots of a band share ``c`` of a word and draw their own ``r`` and ``b``: each slot by
itself is as above, and only the slots' errors are not quite independent.

All of it is DataFrame expressions: words go to counts and counts to minima inside
the tasks that hold the texts.

Texts without words (null, empty or blank ones) have the fingerprint ``''``; it is
like itself (1) and unlike all others (0). A word is known by its 64-bit hash.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.llm.common import save

#: Slots of a fingerprint, and how many of them share a word's ``c``.
SLOTS, BAND = 40, 8


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """``width`` bits of a hash as a number inside (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(2**width - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def _gamma(u: Column, v: Column) -> Column:
    """Gamma(2, 1) of two uniform numbers."""
    return -F.ln(u * v)


def signatures(texts: DataFrame, keys: list[str], text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(*keys, signature ARRAY<BIGINT>)``, one row per key; texts of one key count together.

    Nulls stand in all slots where there is no word. If ``texts`` is partitioned by some of
    the keys, nothing is shuffled; else counts of words are, and then samples.
    """
    if slots % BAND:
        raise ValueError(f"slots must be a multiple of {BAND}")
    words = texts.select(*keys, F.explode_outer(F.split(F.lower(text), r"[\x09-\x0D\x20]+")).alias("_word"))
    words = words.select(*keys, F.when(F.col("_word") != "", F.xxhash64("_word")).alias("_term"))
    counts = words.groupBy(*keys, "_term").agg(F.ln(F.count(F.lit(1)).cast("double")).alias("_weight"))
    samples = []
    for slot in range(slots):
        bits, c = F.xxhash64("_term", F.lit(slot)), F.col(f"_c{slot // BAND}")
        r, b = _gamma(_uniform(bits, 0, 20), _uniform(bits, 20, 20)), _uniform(bits, 40, 24)
        t = F.when(F.col("_weight") == 0.0, F.lit(0.0)).otherwise(F.floor(F.col("_weight") / r + b).cast("double"))  # most words are there once, and b is below 1
        samples.append(F.min(F.when(F.col("_term").isNotNull(), c - r * (t - b + F.lit(1.0)))).alias(f"_a{slot}"))
    shared = []
    for band in range(slots // BAND):
        bits = F.xxhash64("_term", F.lit(-1 - band))
        shared.append(F.ln(_gamma(_uniform(bits, 0, 31), _uniform(bits, 31, 31))).alias(f"_c{band}"))
    least = counts.select(*keys, "_term", "_weight", *shared).groupBy(*keys).agg(*samples)
    return least.select(*keys, F.array(*(F.when(F.col(f"_a{s}").isNotNull(), F.xxhash64(f"_a{s}").bitwiseAND(F.lit(0xFFFFFFFF))) for s in range(slots))).alias("signature"))


def as_text(signature: Column, slots: int = SLOTS) -> Column:
    """Eight hexadecimal digits a slot; empty where there is no word."""
    digits = [F.lpad(F.lower(F.hex(F.get(signature, F.lit(s)))), 8, "0") for s in range(slots)]
    return F.concat_ws("", *digits)


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of slots that hold the same sample: an estimate of the generalised Jaccard similarity."""
    same = [F.get(a, F.lit(s)).eqNullSafe(F.get(b, F.lit(s))).cast("int") for s in range(slots)]
    return reduce(add, same) / F.lit(float(slots))


def _in_bins(docs: DataFrame) -> DataFrame:
    """``(bin, doc_id, tie, text)``: bins rise with ``(doc_id, tie)`` and hold about as many rows each.

    Bins only deal out the work. Their bounds are percentiles of the ids, two for each
    partition of a shuffle; ids that fill whole bins are split by the hash of their text, and
    so are rows without an id, which come first. Rows equal in id and text stay together.
    """
    spark = docs.sparkSession
    bins = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / bins for i in range(1, bins)]
    found = docs.agg(F.percentile_approx("doc_id", at, min(20 * bins, 1_000_000)).alias("at"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds, nulls = found["at"] or [], 1 + bins * found["nulls"] // max(found["n"], 1)
    step = max(1, round(len(bounds) ** 0.5))
    coarse, fine = F.lit(bounds[::step] or [0]), F.array(*(F.lit(bounds[i : i + step]) for i in range(0, len(bounds), step))) if bounds else F.array(F.lit([0]))
    share = (F.shiftright("tie", 1).cast("double") + F.lit(2.0**62)) * F.lit(2.0**-63)  # of the way through all hashes

    def below(values: Column, strictly: bool) -> Column:
        return F.size(F.filter(values, lambda x: x < F.col("doc_id") if strictly else x <= F.col("doc_id")))

    def count(strictly: bool) -> Column:
        """Bounds below the id: those of whole rows of ``fine``, and of the row in which it falls."""
        row = F.greatest(below(coarse, strictly) - 1, F.lit(0))
        return row * F.lit(step) + below(F.get(fine, row), strictly)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    if not bounds:
        return rows.select(F.floor(share * F.lit(nulls)).cast("bigint").alias("bin"), "doc_id", "tie", "text")
    rows = rows.withColumns({"_low": count(True), "_high": count(False)})
    own = F.lit(nulls) + F.col("_low") + F.floor(share * (F.col("_high") - F.col("_low") + 1))
    return rows.select(F.when(F.col("doc_id").isNull(), F.floor(share * F.lit(nulls))).otherwise(own).cast("bigint").alias("bin"), "doc_id", "tie", "text")


def with_next(docs: DataFrame) -> DataFrame:
    """``(bin, place, doc_id, text, next_text, own)``, dealt out by ``bin``: every document beside the next one.

    Documents follow by id (null ids first), equal ids by the hash of their text, and the
    last is followed by the first. ``place`` counts the rows of a bin in that order. A bin
    ends with a row that is not its ``own``: a copy of the first document after it.
    """
    rows = _in_bins(docs)
    firsts = save(rows.groupBy("bin").agg(F.min(F.struct("doc_id", "tie")).alias("first")), "fingerprint-bins").df
    along = W.orderBy("bin")  # one row for each bin
    before = firsts.select(F.coalesce(F.lag("bin").over(along), F.max("bin").over(W.partitionBy())).alias("_bin"), F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie"))
    after = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    after = after.groupBy("_bin").agg(F.first(F.struct("doc_id", "tie", "text")).alias("x")).select(F.col("_bin").alias("bin"), "x.*", F.lit(False).alias("own"))
    dealt = rows.withColumn("own", F.lit(True)).unionByName(after).repartitionByRange("bin")
    order = W.partitionBy("bin").orderBy(F.desc("own"), F.asc_nulls_first("doc_id"), "tie")
    return dealt.select("bin", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "own")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last ``floor(n / 2)`` code points replaced by the first as many, or all, of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_query(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like its own it and the next document's are.

    Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts are empty. Every row
    counts, those that share an id too; null ids come first. A single document follows
    itself. Other columns are not read. The texts are shuffled once; words, counts and
    samples stay in the tasks that hold them.
    """
    beside = with_next(docs)
    kinds = F.when(F.col("own"), F.array(F.col("text"), edited(F.col("text"), F.col("next_text")))).otherwise(F.array("text"))
    texts = beside.select("bin", "place", "own", F.posexplode(kinds).alias("kind", "text"))
    signed = signatures(texts, ["bin", "place", "own", "kind"], slots=slots)
    along = W.partitionBy("bin").orderBy("place", "kind")
    signed = signed.withColumns({"edited": F.lead("signature", 1).over(along), "following": F.lead("signature", 2).over(along)}).where("own AND kind = 0")
    own = F.col("signature")
    told = signed.select("bin", "place", as_text(own, slots).alias("fingerprint"), as_text(F.col("edited"), slots).alias("edited_fingerprint"), likeness(own, F.col("edited"), slots).alias("near_edited"), likeness(own, F.col("following"), slots).alias("near_next"))
    about = beside.where("own").select("bin", "place", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(edited(F.col("text"), F.col("next_text")), 256).alias("edited_sha256"))
    return about.join(told, ["bin", "place"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
