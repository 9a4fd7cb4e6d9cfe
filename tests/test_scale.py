"""What larger tables showed: plans that may not grow on the driver or in one task, and whole numbers."""

import contextlib
import io

from pyspark.sql import functions as F

from millrace.operators import lookup


def planned(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def product_records(spark, n):
    return spark.range(n).selectExpr(
        "id", "concat('steel plate ', id) as product_name", "concat('IS ', id) as is_standard_number", "'plate of steel' as standard_title",
        "'Quality Control Order' as qco_reference", "'curated' as extraction_method",
    )


def test_lookup_broadcasts_queries_only(spark):
    """Records are no broadcast side, however small their file says they are."""
    asked = spark.createDataFrame([(1, "steel plate, is 7 or is 7"), (2, "zzz")], "query_id int, query string")
    hits = lookup.scored(product_records(spark, 1000), asked)
    plan = planned(hits)
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastExchange") > 0 and "SortMergeJoin" not in plan
    assert plan.count("Range (") <= 2  # records are read once for each branch of the normalisation
    rows = {r["id"]: r["score"] for r in hits.collect()}
    assert len(rows) == 1000 and rows[7] == 2 + 2 + 5 + 5 + 2 and rows[8] == 2 + 2 + 2


def test_lookup_keeps_the_best_of_each_query(spark):
    asked = spark.createDataFrame([(1, "steel plate is 7"), (2, "is 9 of steel")], "query_id int, query string")
    records = product_records(spark, 50)
    every = lookup.structured(records, asked)
    assert every.count() == 100
    assert sorted(lookup.cut(every).collect()) == sorted(lookup.cut(lookup.structured(records, asked, lookup.ROWS)).collect())
    told = {r["query_id"]: (r["best"], r["cutoff"], r["scored"], r["above"]) for r in lookup.cutoffs(lookup.scored(records, asked)).collect()}
    assert told == {1: (11.0, 5.5, 50, 50), 2: (9.0, 4.5, 50, 1)}


def test_lookup_in_blocks(spark, monkeypatch):
    asked = spark.range(40).selectExpr("cast(id as int) as query_id", "concat('steel plate is ', id) as query")
    want = sorted(lookup.scored(product_records(spark, 60), asked).collect())
    monkeypatch.setattr(lookup, "KEYS", 30)
    assert sorted(lookup.scored(product_records(spark, 60), asked).collect()) == want


def test_references_have_whole_numbers(spark):
    from millrace.functions import text as T

    rows = spark.createDataFrame([("see IS 123456 and IS 123457 (Part 2): 2016, IS 12345",)], "t string")
    assert rows.select(T.references(F.col("t"))).first()[0] == ["IS 123456", "IS 123457 (Part 2): 2016", "IS 12345"]


def test_guard_replaces_whole_numbers(spark):
    from millrace.operators import dialogue as D

    rows = spark.createDataFrame([("IS 123456, IS 12345, IS 23456: 2016, IS 1234567", "IS 12345 ; IS 234567")], "a string, c string")
    clean, removed = D.guard(F.col("a"), F.col("c"))
    got = rows.select(clean.alias("a"), removed.alias("r")).first()
    assert got["a"] == f"{D.UNVERIFIED}, IS 12345, {D.UNVERIFIED}, {D.UNVERIFIED}"
    assert got["r"] == ["IS 123456", "IS 23456: 2016", "IS 1234567"]


def test_html_references_need_their_semicolon():
    from millrace.operators import html as H

    page = "<main><h1>a &amp; b&amp</h1><p id='x&amp;y'>one &notit; two &eacute; &#233; &#xe9; &#233 a&&b &middot; end</p></main>"
    tree = H.parse(page)
    assert tree.told(True) == [("h1", "a & b&amp"), ("p", "one &notit; two é é é &#233 a&&b · end")]
    assert tree.elements[2][2] == "x&y"
    assert H.parse("<p> a&b is long enough</p>").told(True) == [("p", " a&b is long enough")]


def test_inline_numbers_are_whole(spark):
    from millrace.operators import markdown as M

    rows = spark.createDataFrame([("a IS 123456 b",), ("a IS 12345 b",)], "t string").select(M.inline(F.col("t")).alias("p"))
    assert [[tuple(x) for x in r["p"]] for r in rows.collect()] == [[("text", "a IS 123456 b")], [("text", "a "), ("standard", "IS 12345"), ("text", " b")]]


def test_row_groups_round_halves_to_even(spark, tmp_path):
    """As SQL's cast does: 888.5 counts as 888, so that the three rows fill a group to its last character."""
    from millrace.plans import catalog

    spark.createDataFrame([(1, 1, 888.5), (2, 1, 898.0), (3, 1, 8.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalog.QUERIES["table_row_groups"](spark, str(tmp_path)).collect()
    assert {(r["k"], r["g"]) for r in rows} == {(1, 1), (2, 1), (3, 1)}


def test_legacy_splitter_at_its_bound(spark, tmp_path):
    """A line as long as the bound fits; so does a single one without its margins."""
    import duckdb

    from millrace.plans import catalog

    a = "a" * 2999
    texts = ["b\n" + a + "c", a + "c\nd", "b\n" + a + "cd", "  " + a, "  " + a + "cd", " " * 3100, "\n" + "e" * 2000 + "\n" + "f" * 2000, "x\n " + a + "c \ny"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE["legacy_splitter"]).fetchall())
    assert {r[0] for r in want} == {0, 1, 3, 5, 6, 7}
    assert sorted(tuple(r) for r in catalog.QUERIES["legacy_splitter"](spark, str(tmp_path)).collect()) == want


def test_reports_read_documents_once_for_lines_and_once_for_chunks(spark):
    """Texts with and without page marks are planned apart, so lines take two scans."""
    from millrace.plans import catalog

    for name in ("structure_report", "chunk_report"):
        assert planned(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).count("FileScan") <= 3, name


def test_lines_of_whole_texts_are_lines_cleaned_one_by_one(spark):
    from millrace.functions import text as T
    from millrace.operators import documents as D

    texts = [
        "", "\n", " a \n\tb\t\nc", "a\r\nb\x0b\n\fc", "x  y　\n z\n", "​ a\n ‎\n​b", "\u0085a\n ", "  ", "a  ​  b\n[Page 3]\n c ",
        " a", "tidy\nlines only", "a\t\t\tb\n\n\n c  d ", "\x1fa\n b\x1f", "न ी \n क",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1))).select("doc_id", "pos", T.clean_line(F.col("col")).alias("text")).where(~F.col("text").rlike(D.PAGE_MARK))
    assert sorted(tuple(r) for r in D.page_lines(rows).select("doc", "line_no", "text").collect()) == sorted(tuple(r) for r in want.collect())


def test_split_and_counts_agree_with_the_chunks(spark):
    from millrace.operators import documents as D

    texts = ["ab. " * 30 + "x" * 90 + ". cd; ef", "same one. same one. same one. same one.", "", "z" * 200, "; ".join(map(str, range(90)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, t string")
    made = rows.select("doc", F.posexplode(D.hard_split(F.col("t"), 40, 5)).alias("piece", "text")).withColumns({"chunk": F.lit(1), "clauses": F.array().cast("array<string>")})
    assert made.agg(F.max(F.length("text"))).first()[0] <= 40
    kept = made.groupBy("doc").agg(F.count("*")).join(D.emitted(made).groupBy("doc").agg(F.count("*")), "doc")
    assert sorted(tuple(r) for r in D.chunk_counts(made).collect()) == sorted(tuple(r) for r in kept.collect())


def test_postings_are_dealt_by_size(spark, monkeypatch):
    """As many partitions as there is text for, which AQE may not join again."""
    from millrace.operators import retrieval as R

    docs = spark.range(200).selectExpr("id as doc_id", "repeat(concat('w', id, ' x '), 20) as text")
    monkeypatch.setattr(R, "DEALT", 1000)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    posts = R.postings(docs)
    assert "hashpartitioning(doc_id#" in planned(posts) and f", {-(-size // 1000)}), REPARTITION_BY_NUM" in planned(posts)
    assert posts.count() == 400


def test_vectors_are_dealt_by_pairs(spark, monkeypatch):
    """A task ranks so many pairs at most, however many vectors a file has; results are the same."""
    from millrace.operators import retrieval as R

    vectors = spark.range(0, 300, 1, 1).selectExpr("id as vec_id", "array(float(id % 7), float(id % 11), 1f) as embedding")
    asked = vectors.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "item_id")
    want = sorted(tuple(r) for r in R.dense(vectors, asked).collect())
    assert len(want) == 10 * 12
    monkeypatch.setattr(R, "PAIRS", 100)
    assert "hashpartitioning(vec_id#" in planned(R.dense(vectors, asked)) and ", 30), REPARTITION_BY_NUM" in planned(R.dense(vectors, asked))
    assert sorted(tuple(r) for r in R.dense(vectors, asked).collect()) == want
    monkeypatch.setattr(R, "ASKED", 4)
    near = R.dense(vectors, asked)
    assert ", 12), REPARTITION_BY_NUM" in planned(near) and sorted(tuple(r) for r in near.collect()) == want


def test_embedding_holds_one_request_of_texts(spark):
    """Vectors leave Python request by request, not with the last text of a whole batch."""
    import pyarrow as pa

    from millrace.operators import index as I

    class Rows:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    batch = pa.RecordBatch.from_pydict({"chunk_id": [str(i) for i in range(45)], "text": [None] + [f"a b {i}" for i in range(44)]})
    got = list(I.embed(Rows(), 8)([batch]))
    assert [b.num_rows for b in got] == [20, 20, 5]
    assert [x for b in got for x in b.column(0).to_pylist()] == [str(i) for i in range(45)]
