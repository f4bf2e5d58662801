"""Exact de-duplication: two Bloom passes over hashes; only possible repeats shuffle.

Everything is DataFrame functions. Pass 1 reads each text once, keeps (doc_id, SHA-256 of the
normalised text) as a narrow shared table and sets, in a bitmap table, every filter position that
two of its rows hit. Pass 2 probes that filter: a row whose positions are not all set is unique;
the narrow rows of the others are grouped by hash.

`keep_first` then needs no text but those of rows that may go: ids of rows that go, or of which one
repeat stays, set a second bitmap, which is broadcast; rows whose id is not in it pass straight
through, the others are joined with the decisions. The bitmap grows with the rows that go up to
``max_broadcast_bytes``; beyond that a larger share of the other rows joins too, and no row ever
moves more than once.

Defined cases: null text counts as empty; the smallest id ignores nulls, and if all ids of a
group are null its keep_id is null; a row repeated with the same id and text counts in
group_size each time and one of its repeats may be kept; texts of any length are hashed whole in
the JVM; an empty table gives an empty result. Columns beside doc_id and text are ignored by
`exact_groups` and kept by `keep_first`, under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, written

#: Bits of one bitmap row of Spark's bitmap functions.
_ROW_BITS = 32768
#: Repeats of one (id, text) that one array numbers.
_RUN = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _position(key: Column, probe: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(n_bits)) + 1


def _bitmaps(positions: DataFrame) -> DataFrame:
    """(bucket, bitmap) of positions p; tasks send bitmaps, not positions."""
    return positions.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def repeat_filter(keys: DataFrame, n_bits: int, probes: int) -> DataFrame:
    """(bucket, bitmap): positions that at least two rows of ``keys`` hit."""
    hits = keys.select(
        F.explode(F.array_distinct(F.array(*[_position(F.col("sha"), j, n_bits) for j in range(probes)]))).alias("p")
    )
    return _bitmaps(hits.groupBy("p").count().filter("count >= 2"))


def probe(rows: DataFrame, key: str, bitmaps: DataFrame, n_bits: int, probes: int, broadcast: bool) -> DataFrame:
    """``rows`` plus ``maybe``: whether all positions of ``key`` are set; a false there is certain."""
    kept = rows.columns
    for j in range(probes):
        side = bitmaps.select(F.col("bucket").alias(f"__b{j}"), F.col("bitmap").alias(f"__m{j}"))
        p = _position(F.col(key), j, n_bits)
        bit = F.bitmap_bit_position(p)
        byte = F.conv(F.hex(F.substr(F.col(f"__m{j}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = (F.bitmap_bucket_number(p) == F.col(f"__b{j}")) & (F.getbit(byte, (bit % 8).cast("int")) == 1)
        rows = rows.join(F.broadcast(side) if broadcast else side.hint("merge"), hit, "left")
    flag = F.lit(True)
    for j in range(probes):
        flag = flag & F.col(f"__b{j}").isNotNull()
    return rows.select(*kept, flag.alias("maybe"))


def filter_bits(n_rows: int, bits_per_row: int) -> int:
    bits = _ROW_BITS
    while bits < n_rows * bits_per_row:
        bits *= 2
    return bits


def id_filter(ids: DataFrame, bits_per_row: int, probes: int, max_broadcast_bytes: int) -> tuple[DataFrame, int]:
    """Bitmaps, small enough for a broadcast, of the positions of ``ids`` (one column, id), and the filter's bits."""
    n_bits = max(_ROW_BITS, min(filter_bits(ids.count(), bits_per_row), 8 * max_broadcast_bytes // _ROW_BITS * _ROW_BITS))
    hits = ids.select(F.explode(F.array(*[_position(F.col("id"), j, n_bits) for j in range(probes)])).alias("p"))
    return written(_bitmaps(hits), "id-filter"), n_bits


def _hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _marked(docs: DataFrame, bits_per_row: int, probes: int, max_broadcast_bytes: int) -> DataFrame:
    """(doc_id, sha, maybe) of each row: narrow rows, whatever the size of the filter."""
    keys = written(docs.select("doc_id", _hash(F.col("text")).alias("sha")), "exact-keys")
    n_bits = filter_bits(keys.count(), bits_per_row)
    bitmaps = written(repeat_filter(keys, n_bits, probes), "exact-filter")
    return probe(keys, "sha", bitmaps, n_bits, probes, n_bits // 8 <= max_broadcast_bytes)


def _groups(maybe: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size) of ``maybe`` (doc_id, sha); partial sums go before the shuffle.

    Written, so that the join that follows has no aggregate on its keys and a hot group can be split.
    """
    sums = maybe.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return written(sums, "exact-groups")


def exact_groups(docs: DataFrame, bits_per_row: int = 16, probes: int = 2, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    The filter has at most ``2 * bits_per_row`` bits a row. It is broadcast while its size, known
    beforehand, is within ``max_broadcast_bytes``; beyond that it is joined by bucket, where only
    the narrow (doc_id, hash) rows move.
    """
    marked = _marked(docs, bits_per_row, probes, max_broadcast_bytes)
    alone = marked.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    maybe = marked.filter("maybe")
    least = written(maybe.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "exact-ids")
    # the first of a row's repeats is one row; the others are numbered in bounded runs
    runs = least.filter("copies > 1").select("sha", "doc_id", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / _RUN))).alias("run"))
    nth = F.explode(F.sequence(F.col("run") * _RUN + 2, F.least(F.col("copies"), (F.col("run") + 1) * _RUN + 1)))
    repeats = runs.select("sha", "doc_id", nth.alias("nth"))
    rows = least.select("sha", "doc_id", F.lit(1).cast("long").alias("nth")).unionByName(repeats)
    together = rows.join(_groups(maybe), "sha").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return alone.unionByName(together)


def keep_first(docs: DataFrame, bits_per_row: int = 16, probes: int = 2, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs``, all columns: of equal texts the one with the smallest id.

    Which ids are touched follows from narrow rows alone. Rows whose id cannot be one of them stay
    in their partition at any size of the table.
    """
    maybe = _marked(docs, bits_per_row, probes, max_broadcast_bytes).filter("maybe").select("doc_id", "sha")
    each = maybe.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("copies")).join(_groups(maybe), "sha")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    touched = written(each.filter(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("id"), F.col("sha").alias("of"), stays.alias("stays")), "exact-touched")
    bitmaps, n_bits = id_filter(touched.select("id"), bits_per_row, probes, max_broadcast_bytes)
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"))
    marked = probe(body, "doc_id", bitmaps, n_bits, probes, True)
    passed = marked.filter(~F.col("maybe")).select("row")
    met = marked.filter("maybe").select("row", "doc_id", _hash(F.col("row.text")).alias("sha"))
    judged = met.join(touched, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")
    untouched = judged.filter(F.col("of").isNull()).select("row")
    one = judged.filter("stays").dropDuplicates(["sha"]).select("row")
    return passed.unionByName(untouched).unionByName(one).select("row.*")
