"""Scans and sinks (S rows), projections and filters (P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import determinism as D
from ..operators import links as L
from ..operators.determinism import ranked
from ..operators.pairwise import KERNELS
from ..operators.splits import first_rows
from ..registry import query, table
from ..sources import files as S
from ..sources import npy
from ..storage import shared_dir, written
from .fixtures import HIER, LINKS, PAIRS, SCORED, hashed, hier, scored


def _place(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_delimited_round_trip", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s1(spark, sf):
    path = _place(spark, "s1")
    S.write_delimited(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return S.read_delimited(spark, path, T.StructType.fromDDL("s_suppkey long, s_name string, s_nationkey int"))


@query("s11_delimited_write", "SELECT concat_ws(',', s_suppkey, s_name, s_nationkey) AS value FROM supplier")
def s11(spark, sf):
    """The lines of a comma-separated table as written, without its headers."""
    path = _place(spark, "s11")
    S.write_delimited(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, ",")
    return S.read_lines(spark, path).filter(F.col("value") != "s_suppkey,s_name,s_nationkey")


@query("s2_parquet_scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 3 AND l_returnflag = 'R'")
def s2(spark, sf):
    return table(spark, sf, "lineitem").filter((F.col("l_quantity") < 3) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_quantity")


@query("s3_json_documents", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE CAST(props->>'k' AS INTEGER) > 50")
def s3(spark, sf):
    props = F.from_json("props", "map<string,int>")
    return table(spark, sf, "events").select("event_id", F.explode(props).alias("name", "k")).filter("name = 'k' AND k > 50").select("event_id", "k")


@query("s3_json_store", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def s3_store(spark, sf):
    """Customers as JSON objects in files, written by partition and read back in ranges of bytes."""
    path = _place(spark, "s3")
    S.write_json_store(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "c_custkey", path)
    back = S.read_json_store(spark, path, T.StructType.fromDDL("c_name string, c_acctbal double, c_nationkey int"), 1 << 20)
    return back.select(F.col("key").cast("long").alias("c_custkey"), "c_name", "c_acctbal", "c_nationkey")


@query("s4_nested_records", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s4(spark, sf):
    enzyme = F.to_json(F.struct(F.col("n_name").alias("uniprot_id"), F.array(F.col("n_regionkey").cast("string")).alias("ec")))
    kept = table(spark, sf, "nation").select("n_nationkey", F.from_json(enzyme, "uniprot_id string, ec array<string>, organism string").alias("e"))
    return kept.select("n_nationkey", F.col("e.uniprot_id").alias("n_name"), F.col("e.ec")[0].cast("int").alias("n_regionkey"))


@query("s5_vector_files", "SELECT vec_id, len(embedding)::INTEGER AS size, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def s5(spark, sf):
    """One file a vector, as they come from an encoder, read back by file name."""
    path = _place(spark, "s5")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    npy.write_rows(ranked(rows, "row", "vec_id"), "row", "embedding", path, block_rows=1)
    names = ranked(rows.select("vec_id"), "row", "vec_id")
    found = S.read_vectors(spark, f"{path}/*.npy").select(X.trailing_number(F.col("id")).alias("row"), "embedding")
    r6 = lambda k: F.round(F.element_at("embedding", k).cast("double"), 6)
    return names.join(found, "row").select("vec_id", F.size("embedding").alias("size"), r6(1).alias("first"), r6(64).alias("last"))


@query("s13_matrix_files", f"WITH {PAIRS}, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT a.k AS i, b.k AS j, round(sim, 6) AS sim FROM pairs JOIN r a ON a.vec_id = i JOIN r b ON b.vec_id = j WHERE sim <> 0")
def s13(spark, sf):
    """A similarity matrix as blocks of rows in files, read back in ranges of bytes."""
    path = _place(spark, "s13")
    numbered = written(ranked(table(spark, sf, "embeddings").select("vec_id", "embedding"), "row", "vec_id"), "numbered")
    S.write_similarity(numbered, "row", "embedding", KERNELS["cosine"], path, block_rows=256, kind="<f8")
    return S.read_matrix(spark, path).select("i", "j", F.round("sim", 6).alias("sim"))


@query("s6_cached_table", "SELECT vec_id, label FROM embeddings WHERE label < 5")
def s6(spark, sf):
    path = _place(spark, "s6")
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    S.cached_table(rows, path)
    return S.cached_table(rows, path).filter("label < 5")


@query(
    "s7_cluster_report_fill_forward",
    """WITH t AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cluster, role FROM conversations)
    SELECT concat('m', conv_id, '_', turn) AS member, cluster FROM t WHERE role <> 'user'""",
)
def s7(spark, sf):
    text = F.when(F.col("role") == "user", F.concat(F.lit(">Cluster "), "turn")).otherwise(F.concat(F.lit("0\t10aa, >m"), "conv_id", F.lit("_"), "turn", F.lit("... *")))
    lines = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))
    return S.fill_headers(lines, ["conv_id"], "turn", "text").select("member", F.col("cluster").cast("long").alias("cluster"))


@query("s7_cluster_report_file", "SELECT concat('o', o_orderkey) AS member, o_custkey AS cluster FROM orders")
def s7_file(spark, sf):
    """Orders as members of their customers' clusters, in report files that are read in splits."""
    path = _place(spark, "s7")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    heads = o.select("o_custkey", F.lit(None).cast("long").alias("o_orderkey")).distinct()
    text = F.when(F.col("o_orderkey").isNull(), F.concat(F.lit(">Cluster "), "o_custkey")).otherwise(F.concat(F.lit("0\t10aa, >o"), "o_orderkey", F.lit("... at 90%")))
    placed = o.unionByName(heads).repartitionByRange("o_custkey").sortWithinPartitions("o_custkey", F.asc_nulls_first("o_orderkey"))
    S.write_lines(placed.select(text.alias("line")), "line", path)
    return S.read_cluster_report(spark, path).select("member", F.col("cluster").cast("long").alias("cluster"))


@query("s8_fasta_rows", "SELECT concat('>', p_partkey, chr(10), p_name) AS record FROM part")
def s8(spark, sf):
    return table(spark, sf, "part").select(S.fasta(F.col("p_partkey").cast("string"), F.col("p_name")).alias("record"))


@query("s9_line_list", "SELECT p_partkey FROM part WHERE p_size > 25")
def s9(spark, sf):
    path = _place(spark, "s9")
    S.write_lines(table(spark, sf, "part").filter("p_size > 25").select("p_partkey"), "p_partkey", path)
    return S.read_lines(spark, path).select(F.col("value").cast("long").alias("p_partkey"))


@query("s10_partitioned_write", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 2")
def s10(spark, sf):
    path = _place(spark, "s10")
    S.write_split(table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 5).cast("int").alias("split")), path)
    return S.read_split(spark, path, 2).select("c_custkey", "c_name")


@query("s12_json_object", "SELECT n_regionkey, concat('{', string_agg(concat('\"', n_nationkey, '\":\"', n_name, '\"'), ',' ORDER BY n_nationkey::VARCHAR), '}') AS document FROM nation GROUP BY n_regionkey")
def s12(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(S.json_object(F.col("n_nationkey"), F.col("n_name")).alias("document"))


@query("s15_run_search", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def s15(spark, sf):
    return S.search_runs(table(spark, sf, "orders"), "o_orderstatus = 'F' and o_orderpriority != '5-LOW'").select("o_orderkey")


@query("s16_directory_listing", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS id")
def s16(spark, sf):
    return S.file_ids(spark, f"{sf}/*.parquet").select("id")


@query("s18_trial_store", "SELECT o_orderkey AS number, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' ORDER BY value DESC, number LIMIT 20")
def s18(spark, sf):
    """The best trials of a store that was exported as a headed table."""
    path = _place(spark, "s18")
    S.write_delimited(table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("state")), path)
    trials = S.read_delimited(spark, path, T.StructType.fromDDL("number long, value double, state string"))
    return S.search_runs(trials, "state = 'F'").select("number", "value").orderBy(F.desc("value"), "number").limit(20)


@query("p1_select_rename_drop", "SELECT c_custkey AS id, c_name AS name FROM customer")
def p1(spark, sf):
    return table(spark, sf, "customer").withColumnRenamed("c_custkey", "id").withColumnRenamed("c_name", "name").select("id", "name")


@query("p2_derived_columns", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity > 25 AS large FROM lineitem")
def p2(spark, sf):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (F.col("l_quantity") > 25).alias("large"))


@query("p3_conditional", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE -1 END AS state FROM orders")
def p3(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(-1).alias("state"))


@query("p4_conjunctive_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL")
def p4(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter((o.o_orderstatus == "O") & (o.o_totalprice < 100000) & o.o_orderpriority.isin("1-URGENT", "2-HIGH") & o.o_custkey.isNotNull()).select("o_orderkey", "o_custkey")


@query("p5_half_open_range", f"WITH {SCORED} SELECT doc_id, score FROM scored WHERE score >= 0.8::DOUBLE AND score < 1")
def p5(spark, sf):
    return scored(spark, sf).filter((F.col("score") >= 0.8) & (F.col("score") < 1)).select("doc_id", "score")


@query(
    "p6_evidence_whitelist",
    "SELECT o_custkey, list_sort(list(o_orderkey)) AS kept FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey",
)
def p6(spark, sf):
    records = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("r"))
    good = F.filter("r", lambda x: x["o_orderpriority"].isin("1-URGENT", "2-HIGH"))
    kept = records.select("o_custkey", F.array_sort(F.transform(good, lambda x: x["o_orderkey"])).alias("kept"))
    return kept.filter(F.size("kept") > 0)


@query("p7_explode_labels", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part")
def p7(spark, sf):
    return L.explode_labels(table(spark, sf, "part"), "p_partkey", "p_name", " ")


@query("p8_implode_labels", f"WITH {LINKS} SELECT pid, string_agg(rid::VARCHAR, ';' ORDER BY rid::VARCHAR) AS labels FROM links GROUP BY pid")
def p8(spark, sf):
    return L.implode_labels(L.links(spark, sf), "pid", "rid")


@query("p9_dictionary_encode", f"WITH {LINKS}, d AS (SELECT DISTINCT rid FROM links) SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS idx FROM d")
def p9(spark, sf):
    return L.dictionary_encode(L.links(spark, sf), "rid", "idx")


@query(
    "p10_index_extension",
    """WITH k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part WHERE p_size <= 25),
    u AS (SELECT p_partkey, (SELECT max(idx) FROM k) + row_number() OVER (ORDER BY p_partkey) AS idx FROM part WHERE p_size > 25)
    SELECT * FROM k UNION ALL SELECT * FROM u""",
)
def p10(spark, sf):
    part = table(spark, sf, "part")
    known = L.dictionary_encode(part.filter("p_size <= 25").select("p_partkey"), "p_partkey", "idx")
    return L.extend_index(known, part.select("p_partkey"), "p_partkey", "idx")


@query("p11_map_replace", "SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END, c_mktsegment) AS segment, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'other' END AS strict FROM customer")
def p11(spark, sf):
    names = spark.createDataFrame([("BUILDING", "B"), ("MACHINERY", "M")], "c_mktsegment string, new string")
    met = table(spark, sf, "customer").join(F.broadcast(names), "c_mktsegment", "left")
    return met.select("c_custkey", F.coalesce("new", "c_mktsegment").alias("segment"), F.coalesce("new", F.lit("other")).alias("strict"))


@query(
    "p12_id_unification",
    """WITH ids AS (SELECT l_partkey AS id, l_orderkey AS idx, l_linenumber AS pos FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem)
    SELECT id, max(idx) AS idx FROM ids GROUP BY id""",
)
def p12(spark, sf):
    melted = table(spark, sf, "lineitem").select("l_orderkey", F.expr("stack(2, 'p', l_partkey, 's', l_suppkey) AS (kind, id)"))
    return melted.groupBy("id").agg(F.max("l_orderkey").alias("idx"))


@query(
    "p14_permuted_column",
    f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM scored),
    h AS (SELECT score AS dealt, row_number() OVER (ORDER BY {hashed(7, 'doc_id')}, doc_id) AS r FROM scored)
    SELECT doc_id, y, dealt AS score FROM n JOIN h USING (r)""",
)
def p14(spark, sf):
    return D.permute_column(scored(spark, sf).select("doc_id", "y", "score"), "score", 7, "doc_id").select("doc_id", "y", "score")


@query(
    "p15_downsample_negatives",
    f"""WITH {SCORED}, k AS (SELECT count(*) AS n FROM scored WHERE toxic = 1),
    r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hashed(5, 'doc_id')}, doc_id) AS o FROM scored)
    SELECT doc_id, toxic FROM r, k WHERE toxic = 1 OR o <= 3 * n""",
)
def p15(spark, sf):
    return D.downsample_negatives(scored(spark, sf).select("doc_id", "toxic"), "toxic", 3, 5, "doc_id")


@query("p16_sample_rows", f"SELECT c_custkey, c_name FROM customer ORDER BY {hashed(3, 'c_custkey')}, c_custkey LIMIT 100")
def p16(spark, sf):
    return D.take_hashed(table(spark, sf, "customer").select("c_custkey", "c_name"), 100, 3, "c_custkey")


@query("p18_stride", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) SELECT event_id FROM r WHERE n % 10 = 1")
def p18(spark, sf):
    return D.ranked(table(spark, sf, "events").select("event_id", "ts"), "n", "ts", "event_id").filter("n % 10 = 0").select("event_id")


@query(
    "p19_first_match_fallback",
    """WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT c_custkey, coalesce(p, c_mktsegment) AS code FROM customer LEFT JOIN f ON c_custkey = o_custkey""",
)
def p19(spark, sf):
    found = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    met = table(spark, sf, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select("c_custkey", F.coalesce("p", "c_mktsegment").alias("code"))


@query("p20_near_value", f"WITH {SCORED} SELECT doc_id, score FROM scored WHERE abs(score - 0.5::DOUBLE) < 0.0205::DOUBLE")
def p20(spark, sf):
    return scored(spark, sf).filter(F.abs(F.col("score") - 0.5) < 0.0205).select("doc_id", "score").orderBy("score", "doc_id")


@query("a5_dedup_subset", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1")
def a5(spark, sf):
    """Of each order the first line; lines of one number, which the SQL leaves open, go by their place in the files."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *place)
    return first_rows(lines, ["l_orderkey"], "l_linenumber", "file", "row").drop("file", "row")


@query("x12_code_prefix", f"WITH {HIER} SELECT c_custkey, array_to_string(string_split(code, '.')[1:2], '.') AS prefix FROM hier")
def x12(spark, sf):
    from ..functions.text import code_prefix

    return hier(spark, sf).select("c_custkey", code_prefix(F.col("code"), 2).alias("prefix"))


