"""Passage removal over small chunks, many shards and key ranges, and with keys that many texts hold."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from linkloom.llm import suffix_dedup
from test_operators import SCHEMA, frame, plain_cuts, prose


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in {"CHUNK_BYTES": 1500, "RANGE_BYTES": 4000, "SHARD_BYTES": 3000, "BUCKET_BYTES": 6000, "HOT_TEXTS": 5, "BLOCK_BYTES": 700}.items():
        monkeypatch.setattr(suffix_dedup, name, value)


def common_passage(seed=3, n=60):
    """Texts that nearly all hold one passage amid words of their own, copies, and long texts."""
    rng = random.Random(seed)
    passage, other = prose(rng, 30), prose(rng, 25)
    texts = [prose(rng, rng.randint(0, 30)) + " " + passage + " " + prose(rng, rng.randint(0, 30)) for _ in range(n)]
    texts += [prose(rng, 15) + other + prose(rng, 15) for _ in range(4)] + texts[:9] + [prose(rng, 3000) + passage, "z" * 4000, None, "", "short"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_a_passage_of_many_documents(spark, small_parts):
    rows = common_passage()
    got = sorted((tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, rows)).collect()), key=str)
    assert got == plain_cuts(rows) and sum(r[2] > 0 for r in got) > 60


def test_repeated_and_null_ids_in_small_chunks(spark, small_parts):
    rows = common_passage(5, 30)
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in rows] + rows[:6] + rows[:6]
    assert sorted((tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, rows)).collect()), key=str) == plain_cuts(rows)


def test_hot_windows_are_merged_over_parts_of_chunks(spark, small_parts, monkeypatch):
    rows = common_passage(11, 50)
    rows += [(None if i % 9 == 0 else i + 1000, t) for i, t in rows[:20]]
    most, merge = [], suffix_dedup.hot_spans

    def spread(hot, parts):
        most.append((parts, hot.groupBy("shard").count().agg({"count": "max"}).first()[0]))
        return merge(hot, parts)

    monkeypatch.setattr(suffix_dedup, "FAN_IN", 2)
    monkeypatch.setattr(suffix_dedup, "hot_spans", spread)
    got = sorted((tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, rows).repartition(6)).collect()), key=str)
    assert got == plain_cuts(rows)
    parts, rows_of_a_shard = most[0]
    assert parts > 2 and rows_of_a_shard > 2


def test_merge_of_parts_is_the_merge_of_all():
    rng = random.Random(2)
    windows = [bytes(rng.choices(b"ab\x00", k=suffix_dedup.WINDOW)) for _ in range(40)]
    rows = []
    for chunk in range(12):
        own = rng.sample(range(40), 15)
        ids = np.array([rng.choice([rng.randrange(90), suffix_dedup.NO_ID]) for _ in own], "<i8")
        rows.append({"shard": 7, "chunk": chunk, "part": chunk % 3, "own": own, "ids": suffix_dedup._squeeze(ids), "regions": suffix_dedup.zstandard.compress(b"".join(windows[w] for w in own))})
    low = {}
    for r in rows:
        for w, i in zip(r["own"], suffix_dedup._spread(r["ids"], "<i8").tolist()):
            low[w] = min(low.get(w, suffix_dedup.NO_ID), i)
    table = lambda part: pa.Table.from_pylist([{k: v for k, v in r.items() if k != "own"} for r in rows if r["part"] == part])
    least = suffix_dedup._merge_parts(pa.concat_tables([suffix_dedup._merge_part(table(p)) for p in range(3)]))
    for part in range(3):
        got = suffix_dedup._part_spans(table(part), least.filter(pa.compute.equal(least.column("part"), part))).to_pylist()
        hits = {(g["chunk"], n) for g in got for n in suffix_dedup._spread(g["spans"], "<u4").reshape(3, -1)[0].tolist()}
        want = {(r["chunk"], n) for r in rows if r["part"] == part for n, (w, i) in enumerate(zip(r["own"], suffix_dedup._spread(r["ids"], "<i8").tolist())) if low[w] < i}
        assert hits == want and want


def test_the_catalogue_keeps_no_table(spark):
    out = suffix_dedup.repeated_passages(frame(spark, common_passage(13, 8)))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks")] and out.count() == 25


def test_a_hot_key_is_spread():
    rng = random.Random(1)
    passage = f"{rng.getrandbits(1200):x}"
    texts = [f"{rng.getrandbits(1200):x} {passage} {rng.getrandbits(1200):x}" for _ in range(400)]
    c = suffix_dedup.Chunk(0, pa.table([pa.array(range(400), pa.int64()), pa.array(texts)], names=["a", "b"]), 0, 1).find_runs()

    def most(hot_texts):
        hashes = pa.Table.from_batches([suffix_dedup.hash_rows(0, c.text, suffix_dedup.codes_of(c.keys, 1))])
        flags = suffix_dedup._flagger(hot_texts)(hashes)
        found = c.regions(dict(zip(flags.column("hash_range").to_pylist(), flags.column("flags").to_pylist())), 1)
        return np.unique(found.keys, return_counts=True)[1].max()

    # contents around the passage differ in every text and share its keys unless they are hot
    assert most(1000) > 200 and most(50) <= 50


def test_columns_with_the_names_of_helpers_come_back(spark, small_parts):
    names = ["chunk", "rows", "id", "id_", "hash_range", "flags", "hot", "values", "counts", "kind", "at", "data", "shard", "spans", "regions", "sizes", "marks", "ids", "bucket", "key", "__key", "__bucket"]
    rows = common_passage(7, 20)
    df = spark.createDataFrame([(i, t, *(f"{n}-{i}" for n in names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    cut = suffix_dedup.cut_repeats(df)
    assert cut.columns == df.columns and sorted(tuple(r)[2:] for r in cut.collect()) == sorted(tuple(r)[2:] for r in df.collect())
    sizes = {r[0]: r[1] - r[2] for r in plain_cuts(rows)}
    assert all(len((r.text or "").encode()) <= sizes[r.doc_id] for r in cut.collect())


def test_empty_table(spark):
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
