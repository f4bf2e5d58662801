"""Benchmark decontamination against a plain search of every window at every place."""

import hashlib
import random
import re
from collections import Counter

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from linkloom.llm import decontaminate
from linkloom.llm.queries import ORACLE_SQL, QUERIES

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def plain_words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["an", "the", "Or", "é", "Über", "naïve", "tion", "x1", "42", "İ", "你好"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, prose(30)), (2, prose(10)), (3, "only four words here"), (4, "word"), (5, None), (6, "  ;;; "), (7, "same " * 14), (None, prose(12)), (8, prose(11)), (8, prose(13)), (10, prose(30))]
    items.append((9, items[0][1]))
    tail = " ".join(plain_words(items[1][1]))
    docs = [(0, None), (1, ""), (2, " \x00\t;"), (3, prose(200)), (4, f"{prose(20)} {items[0][1]} {prose(20)}"), (5, f"{prose(3)}; {tail.upper()}!"), (6, "Only-FOUR_words/here and then the word"), (7, "same " * 40)]
    docs += [(8, items[7][1]), (9, " ".join(items[8][1].split()[1:])), (10, " ".join(items[0][1].split()[:9])), (11, prose(30_000) + " " + items[10][1] + " same" * 5000), (12, "wordy words sword")]
    docs += [(None, docs[4][1]), (None, prose(12)), (4, docs[4][1]), (4, docs[5][1]), (5, docs[5][1]), (5, docs[5][1])]
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(i, t, 1, "s", 2, "w") for i, t in docs], "doc_id long, text string, of long, win string, n_words long, h string").repartition(3)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, win string")
    return left, right


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_equals_a_plain_search_with_and_without_broadcasts(spark, bound):
    docs, items = cases()
    got = decontaminate.contamination(*frames(spark, docs, items), max_broadcast_bytes=bound).select(*NAMES)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(docs, items))


def test_other_windows_and_shingles(spark):
    docs, items = cases()
    got = decontaminate.contamination(*frames(spark, docs, items), window=6, shingle=2).select(*NAMES)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(docs, items, 6))


def test_empty_tables(spark):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    assert decontaminate.contamination(left.limit(0), right).count() == 0
    got = decontaminate.contamination(left, right.limit(0)).select(*NAMES)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(docs, []))


def test_clean_rows_stay_with_all_columns(spark):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    got = decontaminate.keep_clean(left, right)
    assert got.columns == left.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(d for d, p in zip(docs, plain(docs, items)) if not p[5])


def test_spans_are_where_the_windows_are(spark):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    windows = decontaminate.item_windows(right)
    found = decontaminate.spans(left, windows).filter("start IS NOT NULL").join(left.select("doc_id", F.xxhash64("text").alias("of"), "text"), ["doc_id", "of"]).collect()
    assert found
    read = {text: plain_words(text) for _, text in docs}
    for r in found:
        assert read[r.text][r.start : r.start + r.length] == r.win.split(" ")


def test_a_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(2)
    passage = " ".join(f"w{k}" for k in range(25))
    docs = [(i, (passage if i % 3 == 0 else "") + " " + " ".join(f"v{rng.randrange(400)}" for _ in range(40))) for i in range(900)]
    left, right = frames(spark, docs, [(1, passage), (2, passage)])
    got = decontaminate.contamination(left, right).select(*NAMES)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(docs, [(1, passage), (2, passage)]))


def test_query_equals_its_sql_and_runs_no_python(spark, sf):
    df = QUERIES["op11_decontaminate"](spark, sf)
    assert_same(df.toPandas(), connect(sf).sql(ORACLE_SQL["op11_decontaminate"]).df())
    plan = df._jdf.queryExecution().executedPlan().toString()
    places = decontaminate._places(spark.read.parquet(f"{sf}/documents.parquet"), [5])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in p for p in (plan, places) for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    assert "Exchange" not in places
