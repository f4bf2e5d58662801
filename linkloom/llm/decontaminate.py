"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window of an item is its ``window`` consecutive words (a shorter item is one window). A window
occurs in a document only if all its word shingles do, so the necessary prefix of its shingles, in
order of their rarity in the documents, is the rarest one. Pass 1 counts the items' shingles over
all documents; a window with a shingle that no document has is out. Pass 2 joins the documents'
shingles with those prefixes: the place of the shingle in the window says where the window would
begin, which must lie inside the document (positional and length bounds), and the words there are
compared with the window's (exact).

Everything is DataFrame functions. A document is one row of the stream through both passes; what
is exchanged is one narrow row a document and one for each hit. Item tables go to all tasks while
their bytes, measured beforehand, are within ``max_broadcast_bytes``; beyond that shingles meet them
in an exchange, behind a bitmap of the tables' hashes.

Defined cases: null and wordless texts have no words and no windows; items without words take no
part; windows of items with a null id hit words but are no items; an item_id of several rows is one
item; documents repeated with one id and text are returned each; null and repeated doc_ids are kept
apart by their text's hash; empty tables give no hits. Texts of any length are read whole. Columns
beside doc_id, text and item_id, text are ignored, and kept by `keep_clean`, under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .exact_dedup import _bitmaps, _position, filter_bits, probe

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The other ASCII characters that belong to no word.
_BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_RUN = 4096
_BITS, _PROBES = 16, 2


def words(text: Column) -> Column:
    """Runs of digits, letters and what is not ASCII, with A-Z lower-cased: one pass over the characters, no pattern."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(item_id, win): the distinct windows of each item, words joined by spaces."""
    each = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = each.select("item_id", "w", size.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("s"))
    return starts.select("item_id", F.array_join(F.slice("w", F.col("s") + 1, F.col("n")), " ").alias("win")).distinct()


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, n, width, o, h): hashes of the shingles of each window, with the place they start at."""
    w = F.split("win", " ")
    sized = windows.select("win", w.alias("w"), F.size(w).alias("n"), F.least(F.size(w), F.lit(shingle)).alias("width"))
    each = sized.select("win", "w", "n", "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("o"))
    return each.select("win", "n", "width", "o", F.xxhash64(F.slice("w", F.col("o") + 1, F.col("width"))).alias("h"))


def _places(docs: DataFrame, widths: list[int]) -> DataFrame:
    """Rows of (doc_id, of, w, n_words) by shingle (at, h), and one with at = -1 for each document."""
    body = docs.select("doc_id", F.xxhash64("text").alias("of"), words(F.col("text")).alias("w"))
    n = len(widths)
    last = F.size("w") * n - 1
    numbers = F.when(last >= 0, F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), last))).otherwise(F.array(F.lit(-1)))
    each = body.select("doc_id", "of", "w", F.size("w").cast("long").alias("n_words"), F.explode(numbers).alias("i"))
    width = F.lit(widths[0]) if n == 1 else F.element_at(F.array(*map(F.lit, widths)), F.pmod("i", F.lit(n)) + 1)
    at = F.col("i") if n == 1 else F.when(F.col("i") >= 0, F.floor(F.col("i") / n).cast("int")).otherwise(-1)
    placed = each.select("doc_id", "of", "w", "n_words", at.alias("at"), width.alias("width"))
    return placed.withColumn("h", F.when(F.col("at") >= 0, F.xxhash64(F.slice("w", F.greatest("at", F.lit(0)) + 1, F.col("width")))))


def _screened(places: DataFrame, keys: DataFrame, n_keys: int, max_bytes: int) -> DataFrame:
    """Places whose hash may be one of ``keys``, and those without a hash, by a bitmap within ``max_bytes``."""
    n_bits = max(1 << 15, min(filter_bits(n_keys, _BITS), 8 * max_bytes // (1 << 15) * (1 << 15)))
    hits = keys.select(F.explode(F.array(*[_position(F.col("h"), j, n_bits) for j in range(_PROBES)])).alias("p"))
    bitmaps = written(_bitmaps(hits), "shingle-filter")
    return probe(places, "h", bitmaps, n_bits, _PROBES, True).filter("maybe OR at < 0").drop("maybe")


def _rarity(places: DataFrame, keys: DataFrame, n_keys: int, max_bytes: int) -> DataFrame:
    """(h, count) of the shingles ``keys`` that documents have; tasks send sums."""
    narrow = places.select("at", "h")
    if 16 * n_keys <= max_bytes:
        met = narrow.filter("at >= 0").join(F.broadcast(keys), "h")
    else:
        met = _screened(narrow, keys, n_keys, max_bytes).filter("at >= 0").groupBy("h").agg(F.count(F.lit(1)).alias("count")).join(keys, "h")
        return met.select("h", "count")
    return met.groupBy("h").agg(F.count(F.lit(1)).alias("count"))


def spans(docs: DataFrame, windows: DataFrame, shingle: int = 5, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, of, n_words, start, length, win, copies): occurrences of ``windows`` (win) in whole documents.

    ``of`` is the hash of the text, ``start`` counts words from 0. Each document has a row without a
    start as well; ``copies`` is the number of rows with that id and text.
    """
    parts = written(_shingles(windows.select("win").distinct(), shingle), "window-shingles")
    keys = written(parts.select("h").distinct(), "shingles")
    widths = sorted(r[0] for r in parts.select("width").distinct().collect()) or [shingle]
    places = _places(docs, widths)
    rarity = written(_rarity(places, keys, keys.count(), max_broadcast_bytes), "shingle-rarity")
    rarest = parts.join(rarity, "h", "left").groupBy("win", "n").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("h"), F.col("o"))).alias("m")
    )
    prefix = written(rarest.filter("m.count > 0").select(F.col("m.h").alias("h"), F.col("m.o").alias("o"), F.col("n").alias("length"), "win"), "prefixes")
    n_prefix, n_bytes = prefix.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("win")), F.lit(0))).first()
    first, last = F.col("at") - F.col("o"), F.col("at") - F.col("o") + F.col("length")
    inside = (first >= 0) & (last <= F.col("n_words"))
    if n_bytes + 64 * n_prefix <= max_broadcast_bytes:
        met = places.join(F.broadcast(prefix), "h", "left")
        same = F.array_join(F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("length")), " ") == F.col("win")
        found = met.select("doc_id", "of", "n_words", F.when(inside & same, first).alias("start"), "length", "win", "at")
    else:
        # what lies around a place goes with it, as far as a window can reach from there
        reach = windows.select(F.max(F.size(F.split("win", " ")))).first()[0]
        around = F.slice("w", F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.lit(2 * reach))
        near = _screened(places, prefix.select("h"), n_prefix, max_broadcast_bytes)
        near = written(near.select("doc_id", "of", "n_words", "at", "h", around.alias("w"), F.greatest(F.col("at") - reach, F.lit(0)).alias("cut")), "places")
        met = near.filter("at >= 0").join(prefix, "h")
        same = F.array_join(F.slice("w", F.greatest(first - F.col("cut"), F.lit(0)) + 1, F.col("length")), " ") == F.col("win")
        hits = met.select("doc_id", "of", "n_words", F.when(inside & same, first).alias("start"), "length", "win", "at")
        none = near.filter("at < 0").select("doc_id", "of", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("win"), "at")
        found = hits.unionByName(none)
    kept = found.filter("start IS NOT NULL OR at < 0").select("doc_id", "of", "n_words", "start", *[F.when(F.col("start").isNotNull(), F.col(c)).alias(c) for c in ("length", "win")])
    return kept.groupBy("doc_id", "of", "n_words", "start", "length", "win").agg(F.count(F.lit(1)).alias("copies"))


def _hit_words(hits: DataFrame) -> DataFrame:
    """(doc_id, of, n_hit): words inside any span, by what each span adds to those that start before it."""
    ends = hits.select("doc_id", "of", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    earlier = Window.partitionBy("doc_id", "of").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    added = ends.select("doc_id", "of", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0)).alias("added"))
    return added.groupBy("doc_id", "of").agg(F.sum("added").alias("n_hit"))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on id and text hash, null ids alike."""
    other = right.withColumnsRenamed({"doc_id": "__id", "of": "__of"})
    return left.join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), "left").drop("__id", "__of")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings) for each row of ``docs``."""
    windows = written(item_windows(items, window), "item-windows")
    found = written(spans(docs, windows, shingle, max_broadcast_bytes), "spans")
    hits = found.filter("start IS NOT NULL")
    which = hits.select("doc_id", "of", "win").distinct().join(windows.filter("item_id IS NOT NULL"), "win")
    named = which.select("doc_id", "of", F.col("item_id").cast("string").alias("item")).distinct()
    items_of = named.groupBy("doc_id", "of").agg(F.sort_array(F.collect_list("item")).alias("items"))
    each = found.filter("start IS NULL").select("doc_id", "of", "n_words", "copies")
    met = _with(_with(each, _hit_words(hits)), items_of)
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _RUN))
    runned = met.withColumn("__r", F.explode(runs))
    rows = runned.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_RUN), F.col("copies") - F.col("__r") * _RUN))))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        listed.alias("items"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs``, all columns, in which no window of an item occurs."""
    windows = written(item_windows(items, window), "item-windows")
    found = written(spans(docs, windows, shingle, max_broadcast_bytes), "spans")
    hit = found.filter("start IS NOT NULL").select(F.col("doc_id").alias("id"), "of").distinct()
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("of"))
    return body.join(hit, same, "left_anti").select("row.*")
