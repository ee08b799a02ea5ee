"""Benchmark decontamination by template windows, with DataFrame operations only.

Numbers, the units after them and names become typed placeholders. Windows of
template tokens are hash-joined with those of the benchmark; along each diagonal
of hits, literals must agree and every value of the benchmark must stand for one
value of the document. Items too short for a template, and windows of few literals,
are compared by their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import bounded, fresh, save

WINDOW = 8
#: Items with fewer tokens than this are compared by their values, and by values with whole lines below ``LINE``.
SHORTEST, LINE = 4, 3
#: So many consecutive tokens of a diagonal, or half of the item's windows on it, are contamination.
RUN = 13
SHARE = 0.5
#: Benchmark windows up to this count are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

NAME, NUMBER, UNIT = "", "", ""
#: Hashed before the values of a literal-poor window, so that it meets no template.
VALUES = "values"
MARK = f"[{NAME}{NUMBER}{UNIT}]"
# Units that follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|t|lb|lbs|oz|l|ml|cl|s|ms|sec|secs|seconds?|min|mins|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|kilometers?|kilometres?|meters?|metres?|miles?|feet|foot|ft|inch|inches|yards?|grams?|kilograms?|liters?|litres?|dollars?|euros?|cents?|usd|eur|gbp|percent|degrees?|mph|kmh|kwh|kw|w|v|hz|khz|mhz|ghz|kb|mb|gb|tb"
PUNCTUATION = r"[!-/:-@\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u205e\u20a0-\u20bf\u3001-\u303f]+"
SPACE = r"[\x20\x09-\x0D]+"


def marked(text: Column) -> Column:
    """The text with each placeholder's mark put before the value it stands for, punctuation gone.

    A name is a capitalised word that follows a word or comma in its sentence.
    """
    text = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "")
    # each pattern begins with a rare character and looks back from there
    text = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})", f"{NAME}$0")
    text = F.regexp_replace(text, r"\d(?<![^\s(\[$€£+-]\d)[\d.,:/]*(?![\p{L}\p{N}])", f"{NUMBER}$0")
    text = F.regexp_replace(text, rf"(?i)(\d )({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    return F.regexp_replace(text, PUNCTUATION, "")


def tokens(text: Column) -> Column:
    """Tokens with their marks, as values."""
    return F.array_remove(F.split(text, SPACE), "")


def template(text: Column) -> Column:
    """Tokens of a marked text in lower case, values reduced to their marks."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), rf"({MARK})\S*", "$1"), SPACE), "")


def values(raw: Column) -> Column:
    """Tokens in lower case without marks: what literal-poor windows are compared by."""
    return F.transform(raw, lambda t: F.regexp_replace(F.lower(t), MARK, ""))


def _poor(words: Column, width: int) -> Column:
    """Places, from 0, of the runs of ``width`` words with fewer literals than placeholders.

    Made from the places of the placeholders, so that texts with few of them cost little.
    """
    least = width // 2 + 1

    def of(w: Column) -> Column:
        marks = F.filter(F.transform(w, lambda t, i: F.when(F.contains(t, F.lit(NAME)) | F.contains(t, F.lit(NUMBER)) | F.contains(t, F.lit(UNIT)), i)), lambda i: i.isNotNull())

        def near(p: Column) -> Column:
            last = F.size(w) - width
            # placeholder number j and the one `least - 1` after it in one window
            spans = F.transform(p, lambda x, j: F.struct(F.greatest(F.get(p, j + (least - 1)) - (width - 1), F.lit(0)).alias("low"), F.least(x, last).alias("high"), F.get(p, j + (least - 1)).alias("to")))
            fit = F.filter(spans, lambda x: x.to.isNotNull() & (x.low <= x.high))
            return F.array_distinct(F.flatten(F.transform(fit, lambda x: F.sequence(x.low, x.high))))

        return F.when(F.size(w) >= width, F.element_at(F.transform(F.array(marks), near), 1)).otherwise(F.array().cast("array<int>"))

    return F.element_at(F.transform(F.array(words), of), 1)


def _windows(text: Column, widths: dict[int, bool]) -> Column:
    """``(width, pos, hash)`` per run of words of each width of ``widths``; none for fewer words.

    Where the width's flag is set, literal-poor runs have a second one, of their
    values; runs of under ``SHORTEST`` words have only that. The words are bound to
    lambda variables, so that a text is split once for all widths, and its values are
    made only where there are runs to compare by them.
    """
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    none = F.array().cast("array<struct<width:int,pos:int,hash:bigint>>")
    hashed = lambda w, i, h: F.struct(F.lit(w).alias("width"), i.alias("pos"), h.alias("hash"))

    def of(words: Column, marked: Column, width: int) -> Column:
        by_value = lambda at: once(values(tokens(marked)), lambda v: F.transform(at, lambda i: hashed(width, i, F.xxhash64(F.lit(VALUES), F.slice(v, i + 1, width)))))
        places = F.sequence(F.lit(0), F.size(words) - width)
        if width < SHORTEST:
            return F.when(F.size(words) >= width, by_value(places)).otherwise(none)
        every = F.transform(places, lambda i: hashed(width, i, F.xxhash64(F.slice(words, i + 1, width))))
        if widths[width]:
            every = F.concat(every, once(_poor(words, width), lambda at: F.when(F.size(at) > 0, by_value(at)).otherwise(none)))
        return F.when(F.size(words) >= width, every).otherwise(none)

    # marks are made once a text, then words once, by binding each to a variable
    return once(text, lambda m: once(template(m), lambda w: F.concat(*(of(w, m, width) for width in sorted(widths)))))


def row_key() -> Column:
    """A number for a document's id and text."""
    return F.xxhash64("doc_id", F.lit("/"), "text")


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, raw, words, width)`` of the items with words, one row for each id and text, by a number for both."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    m = marked(F.col("text"))
    rows = rows.select(F.xxhash64("item_id", F.lit("/"), "text").alias("item"), "item_id", tokens(m).alias("raw"), template(m).alias("words"))
    return rows.where(F.size("words") > 0).withColumn("width", F.least(F.lit(WINDOW), F.size("words")))


def _whole_lines(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Passages of the items of under ``LINE`` tokens: a document's own lines of just their values."""
    line = F.transform(F.split(F.col("text"), "\n"), lambda x: F.array_join(values(tokens(marked(x))), " "))
    short = items.select("item", "item_id", F.array_join(values(F.col("raw")), " ").alias("line"), "width")
    lines = docs.select("doc", "doc_id", F.posexplode(line).alias("at", "line")).where("line != ''")
    found = lines.join(F.broadcast(short) if short.count() <= BROADCAST_WINDOWS else short, "line").groupBy("doc", "doc_id", "item", "item_id").agg(F.min("at").alias("at"), F.max("width").alias("width"))
    # its place in the document's tokens
    texts = docs.join(bounded(save(found.select("doc").distinct(), "lined").df), "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text"))
    before = F.size(tokens(marked(F.array_join(F.slice(F.split(F.col("text"), "\n"), F.lit(1), F.col("at")), "\n"))))
    rows = found.join(texts, "doc").withColumn("start", F.when(F.col("at") > 0, before).otherwise(0))
    return rows.select("doc", "doc_id", "item_id", "start", (F.col("start") + F.col("width")).alias("end"), F.lit(1).alias("n_windows"), F.lit(True).alias("exact"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc, doc_id, item_id, start, end, n_windows, exact)``: passages of items in documents.

    ``start`` and ``end`` count the document's tokens, ``exact`` tells whether all
    values agree too. Null texts have no tokens. Rows are known by id and text, of documents (``doc``, from
    :func:`row_key`) and of items, so every text of an id counts, and null ids too. The templates of windows of fewer
    literals than placeholders are no evidence; such windows, and items of three
    tokens, are compared by their values; items of one or two tokens with whole lines.
    """
    items = save(_items(benchmark), "items").df
    counts = {r.width: r.n for r in items.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.where("text IS NOT NULL").select(row_key().alias("doc"), "doc_id", "text")
    literal = lambda w: F.size(F.filter(w, lambda t: ~F.rlike(t, F.lit(MARK))))
    found = []
    if any(w < LINE for w in counts):
        found.append(_whole_lines(rows, items.where(F.col("width") < LINE)))
    if any(w >= LINE for w in counts):
        width = F.col("width")
        own = items.where(width >= LINE).withColumn("values", values(F.col("raw")))
        runs = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.struct(F.slice("words", i + 1, width).alias("window"), F.slice("values", i + 1, width).alias("values")))
        own = own.select("item", "width", F.posexplode(runs).alias("ipos", "run")).withColumn("rich", (width >= SHORTEST) & (literal(F.col("run.window")) * 2 >= width))
        side = own.select("item", "ipos", "width", "rich", F.when(F.col("rich"), F.xxhash64("run.window")).otherwise(F.xxhash64(F.lit(VALUES), F.col("run.values"))).alias("hash"))
        side = save(side, "item-windows").df
        widths = {r.width: r.poor for r in side.groupBy("width").agg(F.bool_or(~F.col("rich")).alias("poor")).collect()}
        small = side.count() <= BROADCAST_WINDOWS
        windows = rows.select("doc", "doc_id", F.inline(_windows(marked(F.col("text")), widths)))
        hits = windows.withColumnRenamed("pos", "dpos").join(F.broadcast(side) if small else side, ["width", "hash"])
        found.append(_passages(hits, side, items, rows))
    if not found:
        return docs.where("false").select(F.lit(0).cast("bigint").alias("doc"), "doc_id", F.lit(0).cast("bigint").alias("item_id"), *(F.lit(0).alias(c) for c in ("start", "end", "n_windows")), F.lit(True).alias("exact"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _passages(hits: DataFrame, side: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """The hits of each diagonal as a passage, where they are enough and what they cover agrees."""
    diagonals = hits.groupBy("doc", "doc_id", "item", "width", (F.col("dpos") - F.col("ipos")).alias("diagonal")).agg(
        F.sort_array(F.collect_set("ipos")).alias("at"), F.size(F.collect_set(F.when(F.col("rich"), F.col("ipos")))).alias("n_rich"))
    total = side.groupBy("item").agg(F.count(F.lit(1)).alias("total"), F.count_if("rich").alias("total_rich"))
    # the longest run of neighbouring windows: what lies between two runs is no evidence
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def longer(acc: Column, i: Column) -> Column:
        run = F.when(i == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(i.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    run = F.aggregate("at", zero, longer)["most"]
    # half of the windows of either kind's count: windows by value add hits, and never raise the bar for templates
    share = (F.size("at") >= F.col("total") * SHARE) | ((F.col("n_rich") > 0) & (F.col("n_rich") >= F.col("total_rich") * SHARE))
    enough = (run + F.col("width") - 1 >= RUN) | share
    diagonals = save(diagonals.join(total, "item").where(enough), "diagonals").df
    # the tokens behind the windows, for the documents with hits
    texts = docs.join(bounded(save(diagonals.select("doc").distinct(), "hit").df), "doc", "left_semi")
    texts = texts.groupBy("doc").agg(F.max("text").alias("text")).select("doc", tokens(marked(F.col("text"))).alias("raw"))
    rows = diagonals.join(texts, "doc").join(items.select("item", "item_id", F.col("raw").alias("item_raw")), "item")
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("width") - 1))))
    rows = rows.withColumn("pairs", F.transform(covered, lambda i: F.struct(F.get("item_raw", i).alias("x"), F.get("raw", i + F.col("diagonal")).alias("y"))))
    kind = lambda t: F.regexp_replace(F.lower(t), rf"({MARK})\S*", "$1")
    bare = lambda t: F.regexp_replace(F.lower(t), MARK, "")
    agree = F.forall("pairs", lambda p: p.y.isNotNull() & ((kind(p.x) == kind(p.y)) | (bare(p.x) == bare(p.y))))
    slots = F.array_distinct(F.filter("pairs", lambda p: F.rlike(p.x, F.lit(f"^{MARK}"))))
    consistent = F.size(F.array_distinct(F.transform(slots, lambda p: p.x))) == F.size(slots)
    exact = F.forall("pairs", lambda p: p.y.isNotNull() & (bare(p.x) == bare(p.y)))
    start = F.element_at("at", 1) + F.col("diagonal")
    end = F.element_at("at", -1) + F.col("width") + F.col("diagonal")
    told = rows.withColumns({"exact": exact, "holds": agree & consistent}).where("holds OR exact")
    return told.select("doc", "doc_id", "item_id", start.alias("start"), end.alias("end"), F.size("at").alias("n_windows"), "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage; columns as given."""
    key = fresh("_doc", docs.columns)
    gone = save(contamination(docs, benchmark).select(F.col("doc").alias(key)).distinct(), "contaminated").df
    return docs.withColumn(key, row_key()).join(bounded(gone), key, "left_anti").select(*docs.columns)


def decontaminate_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op7: per document whether it is contaminated, by how many items, and by which first."""
    found = contamination(documents, benchmark).groupBy("doc").agg(F.countDistinct(F.struct("item_id")).alias("n_items"), F.min("item_id").alias("first_item"), F.sum("n_windows").alias("n_windows"))
    out = documents.select("doc_id", row_key().alias("doc")).join(found, "doc", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))
