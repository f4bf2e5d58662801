"""The corpus operators against plain versions, on rows with every defined special case."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom import storage
from linkloom.llm import exact_dedup, induced_sort, language_id, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, token_store, wfst
from linkloom.llm.subwords import CachedEncoder, library_tokenizer, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, kept boolean, fp long, row string, component_id long, root long, ids binary, bucket long"
EXTRA = ("x", True, 1, "r", 2, 3, b"", 4)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "in", "re", "sh", "tion", "é", "ü"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    shared = prose(rng, 25)
    texts = [None, "", "   \t\n", "a", "ab " * 400, "A\tb\r\n c  d", "a b C d", *base, *base[:12]]
    texts += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(6)]
    for _ in range(8):
        words = base[3].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["word " * 3000 + prose(rng, 2000), "x" * 5000, "### %%% " * 60, "same line here\n" * 30, "<|endoftext|> and \x1c 你好 🙂 İ", "12 34 56"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None or (i or 0) % 7 == 0 else ("fr" if "é" in t else "en"), "s", None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(bool(t) and "%" not in t), 0) for i, t in rows if i % 5 != 4], "doc_id long, quality int, toxic int")


# near duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_simhash(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    of = plain_components(set(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        least[of[f]] = min(least.get(of[f], i), i)
    assert len(got) == len(rows)
    for i, f in fps.items():
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == least[of[f]]


def test_simhash_links_at_any_distance_and_in_dense_groups(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre} | {rng.getrandbits(64) for _ in range(300)}
    for _ in range(250):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        values.add(x)
    chain = rng.getrandbits(64)
    for k in range(0, 60, 4):
        chain ^= 0b1111 << k
        values.add(chain)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = {r.fp % (1 << 64): r.root for r in simhash.roots(spark.createDataFrame(signed, "fp long")).collect()}
    expected = plain_components(values, 4)
    assert len({(got[v], expected[v]) for v in values}) == len(set(got.values())) == len(set(expected.values()))


def test_threshold_allocation_is_exact():
    rng = random.Random(2)
    for _ in range(20):
        m = rng.randint(2, 4)
        costs = [[0.0, *sorted(rng.random() * 9 for _ in range(4))] for _ in range(m)]
        total = rng.randint(-1, 2)
        from itertools import product

        best = min(sum(c[k] for c, k in zip(costs, ks)) for ks in product(range(5), repeat=m) if sum(ks) - m == total)
        cost, chosen = simhash.allocate(costs, total)
        assert abs(cost - best) < 1e-12 and sum(chosen) == total


def test_keep_one_keeps_the_smallest(docs, rows):
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    components = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept == {i for i, c in components.items() if i == c}


def test_stages_keep_columns_under_any_name(spark):
    names = ["gone", "gone_fp", "fp", "fp_", "row", "id", "sha", "maybe", "of", "stays", "p", "bucket", "bitmap", "__b0", "__m0", "__gone", "__fp", "doc", "anomaly", "kept"]
    rng = random.Random(12)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (8, None), (9, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, *(f"{n}-{k}" for n in names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    whole = {tuple(r) for r in df.collect()}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (simhash.keep_one(df), exact_dedup.keep_first(df), quality_rules.keep_good(df, none)):
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= whole


def test_keep_one_tells_rows_of_a_repeated_id_apart(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 80) for _ in range(3))
    got = simhash.keep_one(frame(spark, [(1, a), (5, a), (5, b), (6, b), (7, c), (7, c), (None, a)])).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, a), (5, b), (7, c), (7, c), (None, a)], key=repr)


def shuffled_rows(node):
    """Rows that the exchanges of an executed plan wrote."""
    inner = [getattr(node, m)() for m, kind in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if kind in node.nodeName()]
    inner += [node.children().apply(k) for k in range(node.children().size())]
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    return own + sum(map(shuffled_rows, inner))


def test_keep_one_moves_only_rows_that_may_go(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = random.Random(5)
    texts = [prose(rng, 40) for _ in range(400)]
    df = storage.written(frame(spark, [*enumerate(texts), (400, texts[3]), (401, texts[5])]), "few-repeats")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.keep_one(df)
        assert sorted(r.doc_id for r in out.collect()) == list(range(400))
        assert 2 <= shuffled_rows(out._jdf.queryExecution().executedPlan()) < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_simhash_with_null_ids(spark):
    df = frame(spark, [(None, "one two three four five"), (None, "quite other words are here"), (3, "one two three four five"), (3, "one two three four five")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]


# exact duplicates


def norm(text):
    return re.sub(rb"[\x20\x09-\x0d]+", b" ", (text or "").encode())


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_exact_groups(docs, rows, limit):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, max_broadcast_bytes=limit).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for i, t in rows:
        g = groups[norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(g), len(g), i == min(g))
        assert got[i].text_sha256 == hashlib.sha256(norm(t)).hexdigest()


def test_exact_groups_repeats_and_null_ids(spark):
    df = frame(spark, [(4, "a b"), (4, "a  b"), (6, "a b"), (None, "a b"), (None, "z"), (None, "z")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(4, 4, 4, True), (4, 4, 4, False), (6, 4, 4, False), (None, 4, 4, False), (None, None, 2, True), (None, None, 2, False)], key=str)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(((r.doc_id, norm(r.text)) for r in kept.collect()), key=str) == [(4, b"a b"), (None, b"z")]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_keep_first_moves_only_rows_that_may_go(spark, docs, rows, limit):
    kept = exact_dedup.keep_first(docs, max_broadcast_bytes=limit)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))
    # an exchange that carries whole rows comes after the probe's filter, and texts of others stay
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 100 == 0, 0).otherwise(F.col("id")).cast("string")).alias("text"))
    out = exact_dedup.keep_first(df, max_broadcast_bytes=limit)
    assert out.count() == 20_000 - 199
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") > 0 and not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_keep_first_with_null_ids_and_repeats(spark):
    rows = [(4, "a b"), (4, "a  b"), (6, "a b"), (None, "a b"), (None, "z"), (None, "z"), (7, "z2"), (7, "z3"), (8, None), (9, "")]
    got = sorted(((r.doc_id, norm(r.text)) for r in exact_dedup.keep_first(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(4, b"a b"), (None, b"z"), (7, b"z2"), (7, b"z3"), (8, b"")], key=str)


def test_letters_by_category(spark):
    rows = [(1, "½ ²"), (2, "Ⅷ"), (3, "①"), (4, "\u0301 \u0300"), (5, "ª"), (6, "中"), (7, None), (8, "12 _ !"), (9, "ok")]
    learnt = [(i, "the cat and the dog") for i in range(20, 60)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(frame(spark, rows + learnt)).collect()}
    assert {i for i, _ in rows if got[i] == "und"} == {1, 2, 3, 4, 7, 8}


# repeated passages


def plain_cuts(rows, window=50):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w not in first or key(i) < key(first[w]):
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if key(first[b[k : k + window]]) < key(i):
                gone[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages(docs, rows):
    assert sorted((tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()), key=str) == plain_cuts(rows)


def test_repeated_passages_periodic_ties_and_null_ids(spark):
    rng = random.Random(9)
    unit = "".join(rng.choice("ab") for _ in range(7))
    rows = [(3, unit * 30), (5, unit * 40), (1, "q" + unit * 20), (None, unit * 30), (None, "k" * 200), (2, "k" * 120), (2, "k" * 130), (8, "".join(rng.choice("ab") for _ in range(900)))]
    assert sorted((tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, rows)).collect()), key=str) == plain_cuts(rows)


def test_small_memory_and_chunks_give_the_same(spark, docs, rows, monkeypatch):
    assert sorted((tuple(r) for r in suffix_dedup.repeated_passages(docs, budget=2000).collect()), key=str) == plain_cuts(rows)


def test_cut_repeats_keeps_columns(docs, rows):
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    expected = {i: n - gone for i, n, gone, _, _ in plain_cuts(rows)}
    for r in cut.collect():
        assert len((r.text or "").encode()) <= expected[r.doc_id] and (r.n_chars is None if r.text is None else r.sha == "x")


def common(a, b, cap):
    n = 0
    while n < min(len(a), len(b), cap) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_induced_sort(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + int(rng.integers(1, 6)), int(rng.integers(1, 160))).astype(np.uint8)
    if seed % 3 == 0:
        text = np.tile(text[: max(1, len(text) // 7)], 8)
    cap, budget = int(rng.integers(1, 60)), int(rng.choice([1 << 20, 64, 300]))
    blocks = list(induced_sort.sorted_suffixes(text, cap, budget))
    order = np.concatenate([b[0] for b in blocks])[::-1].tolist()
    prefix = np.concatenate([b[1] for b in blocks])[::-1].tolist()
    data = text.tobytes()
    assert sorted(order) == list(range(len(data)))
    assert [data[i : i + cap] for i in order] == [data[i : i + cap] for i in sorted(range(len(data)), key=lambda i: data[i:])]
    assert prefix[:-1] == [common(data[a:], data[b:], cap) for a, b in zip(order, order[1:])]


def test_recursion_is_reached_and_spills(monkeypatch):
    depths, spills = [], []
    plain, spill = induced_sort.sort_names, induced_sort.SpillingFifos._spill
    monkeypatch.setattr(induced_sort, "sort_names", lambda names, *a: depths.append(len(names)) or plain(names, *a))
    monkeypatch.setattr(induced_sort.SpillingFifos, "_spill", lambda self, k: spills.append(k) or spill(self, k))
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 101, 120).astype(np.uint8) for _ in range(300)]
    text = np.concatenate([np.append(parts[k], np.uint8(255)) for k in rng.integers(0, 300, 3000)])
    order = np.concatenate([b[0] for b in induced_sort.sorted_suffixes(text, 50, 1 << 16)])[::-1]
    data = text.tobytes()
    keys = [data[i : i + 50] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(data)))
    # the shard is several times its budget; each level has at most half the names of the one before
    assert len(depths) >= 3 and all(2 * b <= a for a, b in zip(depths, depths[1:])) and len(spills) > 20


@pytest.mark.parametrize("seed", range(20))
def test_induced_sort_recurses_on_short_strings(seed, monkeypatch):
    monkeypatch.setattr(induced_sort, "SMALL", 4)
    test_induced_sort(seed)


# tokens


@pytest.mark.parametrize("name, lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_cached_ids_are_the_library_s(rows, name, lower):
    encoder, library = CachedEncoder(name, lower, max_entries=50), library_tokenizer(name)
    for text in [t for _, t in rows if t is not None] + ["he's can'T 12ab½ x", "a\x0bb \x85 c\xa0d", "naïve ÀÉ ǅ ⅷ"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_without_an_id_spread_over_parts(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    store = token_store.write_tokens(df)
    parts = store.select("part", F.explode("doc_ids").alias("doc_id")).filter("doc_id is null").select("part").distinct().count()
    got = sorted(token_store.read_tokens(store).collect(), key=lambda r: r.start)
    assert parts > 1 and len(got) == 400 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_token_store(docs, rows):
    store = token_store.write_tokens(docs, segment_ids=900)
    got = sorted(tuple(r) for r in token_store.read_tokens(store).collect())
    library, start, expected = library_tokenizer("word_bpe_49k.json"), 0, []
    for i, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_token_blocks_round_trip_and_show_damage():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4095, 4096, 4097, 1_300_000):
        ids = (rng.zipf(1.3, n) % 49_000).astype("<u2")
        row = token_store.pack_segment(0, 0, 0, [1], [ids.tobytes()])
        assert (token_store.unpack_segment(row) == ids).all()
    words = bytearray(row["blocks"][0]["words"])
    words[len(words) // 2] ^= 1
    row["blocks"][0]["words"] = bytes(words)
    with pytest.raises(token_store.BlockDamaged):
        token_store.unpack_segment(row)


def test_token_block_decodes_from_a_checkpoint():
    ids = (np.random.default_rng(1).zipf(1.3, 600_000) % 30_000).astype("<u2")
    row = token_store.pack_segment(0, 0, 0, [1], [ids.tobytes()])
    block = row["blocks"][0]
    coder = token_store.Coder(np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["freqs"], "<u4"))
    states, at = np.frombuffer(block["states"], "<u8").reshape(-1, token_store.LANES), np.frombuffer(block["positions"], "<u4")
    part = coder.decode_span(np.frombuffer(block["words"], "<u4").astype(np.uint64), states[1], int(at[1]), 10)
    first = token_store.CHECKPOINT_STEPS * token_store.LANES
    assert (part == ids[first : first + len(part)]).all()


def test_token_blocks_of_a_repeated_phrase():
    rng = np.random.default_rng(2)
    span = token_store.CHECKPOINT_STEPS * token_store.LANES
    ordinary = [rng.integers(0, 3000, n).astype("<u2") for n in (200_000, 5_000)]
    texts = [ordinary[0], np.tile(np.array([5, 9, 5, 7], "<u2"), 2 * span // 4 + 5_000), ordinary[1], np.full(3 * span, 6, "<u2")]
    row = token_store.pack_segment(0, 0, 0, [1, 2, 3, 4], [t.tobytes() for t in texts])
    assert (token_store.unpack_segment(row) == np.concatenate(texts)).all()


def test_token_counts(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()}
    library = library_tokenizer("word_bpe_49k.json")
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


def test_every_prefix_count():
    counter, library = token_counts.PrefixCounter(), library_tokenizer("word_bpe_49k.json")
    text = "Thethanble's nd 12 über-éction, anor!!! shtion"
    ids = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for k in range(len(text) + 1):
        assert counter.count_at(text, k) == ids(text[:k])
    for budget in range(0, 30, 3):
        cut = counter.truncate(text, budget)
        assert ids(cut) <= budget and text.startswith(cut)


def test_pairs_come_apart_as_merging_says():
    counter, rng = token_counts.PrefixCounter(), random.Random(3)
    pairs, pieces = counter.pairs, sorted(counter.open)
    closed = [p + counter.suffix for p in sorted(counter.closed)]
    for _ in range(40_000):
        a, b = rng.choice(pieces), rng.choice(pieces if rng.random() < 0.5 else closed)
        if rng.random() < 0.7:  # pieces that often meet
            b = rng.choice([p for p in (b, *rng.sample(pieces, 3)) if p[0].isalpha()] or [b])
        assert pairs.allows(a, b) == (pairs.encode(pairs.split(a) + pairs.split(b)) == [a, b])


def test_longest_prefix_within_a_budget(spark):
    counter, library = token_counts.PrefixCounter(), library_tokenizer("word_bpe_49k.json")
    ids = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    rng = random.Random(6)
    for text in [prose(rng, 12), "  Thethanble's  nd 12 über-éction, anor!!!", "a <|endoftext|> bé shtion", "", "naïve İ x yz"]:
        for budget in range(0, 20):
            cut = counter.fit(text, budget)
            assert ids(text[:cut]) <= budget
            if token_counts.settled(text) and "<|" not in text:
                assert cut == max(k for k in range(len(text) + 1) if ids(text[:k]) <= budget)
    rows = [(1, "the an " * 3000), (2, None), (None, "or in")]
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, rows), limit=100).collect()}
    assert got[1].over_limit and ids(rows[0][1][: got[1].fit_chars]) == 100 and got[2].fit_chars == 0 and got[None].fit_chars == 5


def test_longest_prefix_in_every_script():
    counter, library = token_counts.PrefixCounter(), library_tokenizer("word_bpe_49k.json")
    ids = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    rng = random.Random(3)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    cjk, thai, signs = "".join(map(chr, range(0x4E00, 0x5000))), "กขคงจฉชซญดตถทนบปพมยรลวสหอะาิีึืุูเแโใไ่้", "🙂🚀👍🏽❤️✨"
    texts = ["İstanbul naïve ΣΑΣ x \u2003 y", "a <|endoftext|> 你好世界 <|startoftext|>é", unicodedata.normalize("NFD", "über éction 각각 naïve") + " ok", "\x1c x \x85 y's ３４５ Ⅷ ㎏"]
    texts += [some(cjk, 20) + " " + some(thai, 25) + some(signs, 6), some(signs, 12) + "'re " + some(thai, 5)]
    for text in texts:
        assert counter.count(text) == ids(text)
        ends = [0]
        for part in re.split(r"(<\|(?:start|end)oftext\|>)", text):
            for run in [part] if part.startswith("<|") else token_counts.composed_runs(part) if part else []:
                ends.append(ends[-1] + len(run))
        for budget in range(ids(text) + 2):
            assert counter.fit(text, budget) == max(k for k in ends if ids(text[:k]) <= budget)


def test_long_unspaced_texts_are_counted_and_cut_whole():
    counter, library = token_counts.PrefixCounter(), library_tokenizer("word_bpe_49k.json")
    ids = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    rng = random.Random(4)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(30_000)), "x" * 20_000, "é" * 9_000, "an the" + "ab" * 5_000):
        cut = counter.fit(text, 2048)
        assert counter.count(text) == ids(text) and len(counter.tables) < 50
        assert ids(text[:cut]) <= 2048 and (cut == len(text) or all(ids(text[:k]) > 2048 for k in range(cut + 1, cut + 40)))


def test_packing(docs, rows):
    pieces = packing.pack_documents(docs, window_ids=1500).collect()
    library, by_doc, sequences = library_tokenizer("byte_bpe_50k.json"), {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0


def test_hilbert_curve_visits_neighbours():
    grid = [(x, y) for x in range(8) for y in range(8)]
    points = dict(zip(packing.hilbert_keys(np.array(grid), 3).tolist(), grid))
    assert sorted(points) == list(range(64))
    assert all(abs(points[k][0] - points[k + 1][0]) + abs(points[k][1] - points[k + 1][1]) == 1 for k in range(63))


def test_pieces_round_trip(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in wfst.encode_pieces(docs).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert (got[i].n_pieces, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest() and got[i].round_trip


def test_transducer_on_random_strings():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    fst, rng = wfst.Transducer(max_entries=40), random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "▁", "é", "ing", "\n", "你", "🙂", ".", "S", "\x00", "<s>", "1"]) for _ in range(rng.randint(0, 25)))
        ids = sp.encode(text)
        assert np.frombuffer(fst.encode(text), "<u2").tolist() == ids and fst.decode(fst.encode(text)) == sp.decode(ids)


def test_shortest_path_is_the_least_of_all_paths():
    """Every path of short words through arcs of pieces, fallbacks and pairs, listed without pruning."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    fst, rng = wfst.Transducer(), random.Random(8)
    piece_of = {p: i for p, i in fst.ids.items() if fst._merge([*p]) == [p]}

    def paths(word, last=wfst.FREE):
        if not word:
            yield [], 0.0
            return
        for e in range(1, len(word) + 1):
            i = piece_of.get(word[:e])
            if i is not None and fst.pair_weight(last, i) < wfst.ZERO:
                for ids, weight in paths(word[e:], i):
                    yield [i, *ids], weight
        ids, own = fst.fallback_arc(word[0])
        for more, weight in paths(word[1:]):
            yield [*ids, *more], own + weight

    fallbacks = 0
    for _ in range(150):
        word = wfst.MARK + "".join(rng.choice("aeinrstthé你\n🙂龘") for _ in range(rng.randint(1, 6)))
        found = sorted(paths(word), key=lambda p: p[1])
        ids, weight = fst.shortest_path(word)
        assert (ids, weight) == found[0] and (len(found) == 1 or found[1][1] > weight)
        assert ids == sp.encode(word[1:])
        fallbacks += weight > 0
    assert 20 < fallbacks < 150
    assert fst.normalise("a  b") == "▁a▁▁b" and fst.normalise("") == ""


def test_long_words_have_a_path():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    fst, rng = wfst.Transducer(), random.Random(9)
    for text in ("x" * 20_000, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000)), "anthing" * 3_000, "ก็ที่" * 3_000, "🙂" * 5_000):
        assert np.frombuffer(fst.encode(text), "<u2").tolist() == sp.encode(text)


# models


def plain_counts(text):
    data = (text or "").encode()
    words = data.split()
    marked = set()
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            marked |= {p + d for p in places for d in range(3)}
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_rules(docs, rows, labels):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    for i, t in rows:
        c = plain_counts(t)
        assert tuple(got[i][1:6]) == c
        assert got[i].base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (got[i].base_failed and got[i].kept)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(9, 1, (8, 3))])
    score = quality_rules.IsolationForest.grow(x).score(x)
    assert score[400:].min() > np.quantile(score[:400], 0.98)


def test_rules_judge_repeated_lines_and_windows():
    rng = np.random.default_rng(4)
    words = rng.integers(100, 800, 2000)
    clean = np.stack([words, 5 * words, rng.poisson(1, 2000), (rng.random(2000) < 0.05) * 1, (rng.random(2000) < 0.1) * (words // 10)], axis=1)
    symbols, lines, windows = clean[:30].copy(), clean[30:60].copy(), clean[60:90].copy()
    symbols[:, 2], lines[:, 3], windows[:, 4] = symbols[:, 0] * 2, lines[:, 0] // 3, windows[:, 0] * 9 // 20
    counts = np.concatenate([clean, symbols, lines, windows])
    model = quality_rules.fit(counts, np.repeat([1, 0], [len(clean), 90]))
    rejected = model.anomaly(counts) > model.threshold
    assert rejected[2000:].all() and rejected[:2000].mean() <= 2 * quality_rules.MAX_CLEAN_LOSS


def test_rules_without_labels_only_base_rules(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(docs, none).collect())


def test_rules_catch_junk_and_keep_clean_rows(spark):
    """On labelled rows of the held-out third, from which neither forests nor thresholds learn."""
    from linkloom.llm.common import held_out

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.apply_rules(docs, labels).join(labels, "doc_id").filter(held_out(F.col("doc_id")) & ~F.col("base_failed"))
    kept = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_factorisation_machine_matches_all_pairs():
    rng = np.random.default_rng(1)
    model = quality_classifier.FactorisationMachine(0.3, rng.normal(size=quality_classifier.SIZE), rng.normal(size=(quality_classifier.SIZE, 4)))
    rows = [(np.array([3, 8, 20]), np.array([0.5, -1.0, 2.0])), (np.array([1, 2]), np.array([1.0, 1.0]))]
    raw, _ = model.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([0, 3]))
    for got, (i, x) in zip(raw, rows):
        pairs = sum(model.v[i[a]] @ model.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(got - (model.w0 + model.w[i] @ x + pairs)) < 1e-9


def test_quality_scores(docs, rows, labels):
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels, max_rows=1500).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_language(docs, rows):
    got = {r.doc_id: r for r in language_id.predict_language(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
        assert r.lang_pred in ("und", "en", "fr")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language_id.predict_language(docs, 300).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.96


def test_null_ids_repeats_and_long_texts_in_every_operator(spark):
    rng = random.Random(21)
    long = prose(rng, 70_000)
    rows = [(None, "one two three four five"), (None, None), (None, "one two three four five"), (3, prose(rng, 60)), (3, prose(rng, 60)), (4, long), (4, long), (5, "w " * 150_000), (6, ""), (7, "x" * 200_000)]
    df = frame(spark, rows).repartition(2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    library = library_tokenizer("word_bpe_49k.json")
    out = {
        "simhash": simhash.near_duplicates(df), "quality": quality_classifier.score_quality(df, none), "exact": exact_dedup.exact_groups(df), "passages": suffix_dedup.repeated_passages(df),
        "tokens": token_store.read_tokens(token_store.write_tokens(df)), "language": language_id.predict_language(df), "pieces": wfst.encode_pieces(df), "counts": token_counts.token_counts(df), "rules": quality_rules.apply_rules(df, none),
    }
    for name, result in out.items():
        got = result.collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str), name
        if name in ("pieces", "counts", "rules", "quality", "language"):
            assert len({tuple(r) for r in got if r.doc_id == 4}) == 1, name
        if name == "passages":
            assert sorted(map(tuple, got), key=str) == plain_cuts(rows)
        if name == "counts":
            assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (4, 5, 7)} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows if i in (4, 5, 7)}
    packed = packing.pack_documents(df).collect()
    assert sum(p.length for p in packed) == sum(p.doc_tokens for p in packed if p.start == 0) and sum(p.start == 0 for p in packed) == len(rows)


def test_empty_tables(empty, labels, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        simhash.near_duplicates(empty), simhash.keep_one(empty), exact_dedup.exact_groups(empty), exact_dedup.keep_first(empty), suffix_dedup.repeated_passages(empty),
        suffix_dedup.cut_repeats(empty), token_store.read_tokens(token_store.write_tokens(empty)), packing.pack_documents(empty), wfst.encode_pieces(empty),
        token_counts.token_counts(empty), quality_rules.apply_rules(empty, labels), quality_rules.keep_good(empty, none), quality_classifier.score_quality(empty, none), language_id.predict_language(empty),
    ):
        assert df.count() == 0


def test_exact_dedup_has_no_python_on_its_path(docs):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        exact_dedup.exact_groups(docs).explain()
    assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow"))
