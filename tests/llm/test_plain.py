"""Verdicts, order and the whole pipeline against plain versions that share no code with the operators."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import language_id, packing, quality_classifier, quality_rules, suffix_dedup
from linkloom.llm.common import held_out
from linkloom.llm.subwords import library_tokenizer
from test_operators import plain_components, plain_counts, plain_fingerprint

WINDOW = 50


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache(), spark.read.parquet(f"{sf}/labels.parquet").cache()


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


# op2


def plain_quality(model, text, n_chars):
    data = (text or "").encode()
    words = [w.lower() for w in words_of(text)]
    n, size = len(words), max(len(data), 1)
    x = {}
    for w in words:
        b = zlib.crc32(w) % quality_classifier.N_WORDS
        x[b] = x.get(b, 0) + 1
    x = {b: math.sqrt(c / n) for b, c in x.items()}
    symbols, lines = len(re.findall(rb"[#*$%&|<>]", data)), [y for y in data.split(b"\n") if words_of(y.decode())]
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    structure = [
        math.log(1 + n) / 8, len(data) / max(n, 1) / 10, 10 * symbols / size, math.log(1 + symbols) / 6, len(set(words)) / max(n, 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1), 1 - len(set(windows)) / max(len(windows), 1),
        10 * len(re.findall(rb"[0-9]", data)) / size, 10 * len(lines) / max(n, 1), len(re.findall(rb"[.,]", data)) / max(n, 1),
        math.log(1 + n_chars) / 8 if n_chars is not None else 0, n_chars is None,
    ]
    x.update({quality_classifier.N_WORDS + k: v for k, v in enumerate(structure)})
    index, value = np.array(list(x)), np.array(list(x.values()))
    each_pair = np.triu((model.v[index] @ model.v[index].T) * np.outer(value, value), 1).sum()
    return 1 / (1 + math.exp(-max(-30, min(30, model.w0 + model.w[index] @ value + each_pair))))


def test_quality_scores_are_the_sum_over_all_pairs(tables):
    docs, labels = tables
    model = quality_classifier.train(*quality_classifier.labelled_rows(docs, labels))
    assert np.abs(model.v).max() > 0.05
    rows = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    for r in quality_classifier.score_quality(docs, labels).collect():
        assert abs(r.score - plain_quality(model, *rows[r.doc_id])) < 1e-6
    bare = docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.lit(-1.0)).otherwise(F.lit(float("nan"))))
    gone = {r.doc_id: r.score for r in quality_classifier.score_quality(docs.drop("n_chars"), labels).collect()}
    named = docs.withColumn("n_chars", F.lit("long"))
    for other in (bare, named):
        assert {r.doc_id: r.score for r in quality_classifier.score_quality(other, labels).collect()} == gone


def test_nothing_is_learnt_from_held_out_rows(tables):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast(labels.schema["quality"].dataType))
    renamed = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert other.exceptAll(labels).count() and renamed.exceptAll(docs).count()
    assert rows(quality_classifier.score_quality(docs, labels)) == rows(quality_classifier.score_quality(docs, other))
    assert rows(quality_rules.apply_rules(docs, labels)) == rows(quality_rules.apply_rules(docs, other))
    assert rows(language_id.predict_language(docs)) == rows(language_id.predict_language(renamed))


# op6


def plain_grams(text):
    b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in f" {(text or '').lower()} ".encode()]
    codes = [(1 << 24) + 256 * x + y for x, y in zip(b, b[1:])] + [(x << 16) + (y << 8) + z for x, y, z in zip(b, b[1:], b[2:])]
    out = {}
    for c in codes:
        d = (c * 2654435761 % (1 << 32)) >> (32 - language_id.BITS)
        out[d] = out.get(d, 0) + 1
    return out


def test_languages_are_those_of_the_nearest_centroid(tables):
    docs, _ = tables
    rows = {r.doc_id: r for r in docs.select("doc_id", "lang", "text").collect()}
    model = language_id.fit(*language_id.labelled_counts(docs))
    learnt = [r for i, r in rows.items() if zlib.crc32(str(i).encode()) % 3 != 1 and r.lang is not None and r.text is not None]
    assert sorted({r.lang for r in learnt}) == model.languages
    seen = np.zeros(language_id.DIMS)
    for r in learnt:
        seen[list(plain_grams(r.text))] += 1
    assert np.allclose(model.idf, np.log((1 + len(learnt)) / (1 + seen)) + 0.1, atol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    for r in language_id.predict_language(docs).collect():
        grams = plain_grams(rows[r.doc_id].text)
        v = {d: math.log(1 + c) * float(model.idf[d]) for d, c in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        best = {}
        for centre, owner in zip(model.centroids, model.owner):
            name = model.languages[owner]
            best[name] = max(best.get(name, -1.0), sum(x * float(centre[d]) for d, x in v.items()) / norm)
        ranked = sorted(best.values())
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in rows[r.doc_id].text or "") and r.score == 0 and r.rejected
            continue
        assert abs(r.score - min(1.0, max(0.0, ranked[-1]))) < 1e-4
        assert best[r.lang_pred] > ranked[-1] - 1e-4
        assert abs(r.score - model.floor) < 1e-4 or r.rejected == (r.score < model.floor)


# op10


def plain_score(forest, x):
    total = 0.0
    for feature, cut, path in zip(forest.feature, forest.cut, forest.path):
        node = 1
        while feature[node] >= 0:
            node = 2 * node + (1 if x[feature[node]] >= cut[node] else 0)
        total += path[node]
    return 2 ** -(total / len(forest.feature) / (forest.norm or 1))


def plain_verdict(model, text):
    """Whether the rules keep a text; a score that equals a threshold, as that of the row that set it, is kept."""
    words, chars, symbols, lines, repeats = plain_counts(text)
    if words < 50 or 100 * repeats > 50 * words:
        return False
    if model.forest is None:
        return True
    share = symbols / max(chars, 1)
    a = plain_score(model.forest, [chars / words, share, math.sqrt(share), math.log(1 + symbols) / math.log(chars + 2), symbols / words]) - model.threshold
    b = plain_score(model.repeats, [lines / words, repeats / words]) - model.repeats_threshold
    return bool(a <= 1e-9 and b <= 1e-9)


def test_rule_verdicts(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality_rules.fit(*quality_rules.labelled_counts(docs, labels))
    assert model.forest is not None
    texts = texts_of(docs)
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    wanted = {i: plain_verdict(model, t) for i, t in texts.items()}
    assert {i: r.kept for i, r in got.items()} == wanted
    assert any(not kept and not got[i].base_failed for i, kept in wanted.items())


# op7


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (4, 3)])
def test_hilbert_keys_step_to_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_follows_the_curve(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library, table = library_tokenizer("byte_bpe_50k.json"), packing.projection(7).astype(np.float64)
    firsts = sorted((p.sequence_id, p.offset, p.doc_id) for p in packing.pack_documents(docs, window_ids=1 << 13).filter("start = 0").collect())
    texts = texts_of(docs)
    assert sorted(f[2] for f in firsts) == sorted(texts)
    places, unit = [], []
    for _, _, i in firsts:
        v = table[library.encode(texts[i] or "", add_special_tokens=False).ids + [0]].sum(axis=0)
        v /= np.linalg.norm(v)
        cells = (v + 1) / 2 * (1 << packing.BITS)
        unit.append(v)
        if np.abs(cells - np.round(cells)).min() > 1e-2:
            places.append((int(packing.hilbert_keys(cells.astype(np.int64)[None])[0]), i))
    assert len(places) > 0.8 * len(firsts) and places == sorted(places)
    unit = np.array(unit)
    shuffled = unit[np.random.default_rng(0).permutation(len(unit))]
    gap = lambda x: np.linalg.norm(np.diff(x, axis=0), axis=1).mean()
    assert gap(unit) < gap(shuffled) / 2


# pipeline


def plain_pipeline(model, rows):
    """(doc_id, text) of what the first four stages leave."""
    rows = {i: t for i, t in rows.items() if plain_verdict(model, t)}
    same = {}
    for i in sorted(rows):
        same.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in same.values()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    component = plain_components(prints.values(), 4)
    least = {}
    for i in sorted(rows):
        least.setdefault(component[prints[i]], i)
    rows = {i: rows[i] for i in sorted(least.values())}
    first, out = {}, {}
    for i, t in rows.items():
        b, gone = t.encode(), set()
        for k in range(len(b) - WINDOW + 1):
            if first.setdefault(b[k : k + WINDOW], i) < i:
                gone.update(range(k, k + WINDOW))
        kept, at = [], 0
        for c in t:
            size = len(c.encode())
            if gone.isdisjoint(range(at, at + size)):
                kept.append(c)
            at += size
        out[i] = "".join(kept)
    return out


def test_pipeline_gives_the_plain_rows(spark, sf, tmp_path, tables):
    docs, labels = tables
    some = [t for t in texts_of(docs).values() if t and len(t) > 600][:4]
    passage = "".join(chr(0x4E00 + 37 * k % 700) for k in range(60))
    extra = [(900001, some[0].replace(" ", "\n")), (900002, some[1] + " changed"), (900003, f"{some[2][:300]} 佀{passage}好 {some[3][:300]}"), (900004, f"{some[3][300:600]} 你{passage}奾 {some[2][300:600]}"), (900005, None), (900006, "")]
    extra = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality_rules.fit(*quality_rules.labelled_counts(both, labels))
    rows = texts_of(both)
    wanted = plain_pipeline(model, rows)
    assert 900001 not in wanted and 900002 not in wanted and passage not in wanted[900004]
    library, pieces = library_tokenizer("byte_bpe_50k.json"), {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert sorted(pieces) == sorted(wanted)
    for i, t in wanted.items():
        ids, at = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)


def test_parts_of_two_characters_make_no_third(spark):
    """A removed run that begins and ends inside characters leaves bytes that would decode together."""
    passage = "".join(chr(0x4E00 + 37 * k % 700) for k in range(60))
    rows = [(1, f"佀{passage}好 a"), (2, f"一{passage}奾 b")]
    got = texts_of(suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1] == rows[0][1] and set(got[2]) <= set(rows[1][1]) and passage not in got[2]
