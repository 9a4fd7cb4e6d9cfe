import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dialogue, documents, html, index, quality
from millrace.operators import retrieval as R
from millrace.plans import gate, structure
from millrace.sources import tables as S
from millrace.streaming import thinking


def test_shredded_rows_come_together(spark):
    assert sorted(tuple(r) for r in gate.row_reassembly(spark, "").collect()) == [
        (1, 1, 1, "IS 694|Cables"),
        (1, 2, 1, "IS 13334 (Part 1)|Pumps and parts"),
        (1, 3, 2, "IS 15500 (Part 3)|Deepwell handpumps 1234567 9 tools"),
        (1, 5, 2, "IS 44|Oil seals"),
        (1, 10, 3, "IS 45"),
        (2, 1, 0, "Alpha Labs Delhi|Active|77|100 Beta"),
    ]


def test_continued_rows_join_their_record(spark):
    got = {(r["page"], r["serial"]): (r["is_number"], r["product"], r["number_ok"]) for r in gate.continuation_merge(spark, "").collect()}
    assert got == {
        (1, "1"): ("IS 10", "Coarse thread and fittings", True), (1, "2"): ("IS 20 (Part 1)", "Bolts of steel", True), (2, "5"): ("ISX", "Nuts", False), (3, "6"): ("IS 30", "Washers", True),
    }


def test_units_take_words_and_labels(spark):
    got = {(r["doc"], r["unit"]): r for r in documents.units(structure.CLAUSED.df(spark)).collect()}
    assert got[1, 1]["text"] == "1. Overview of the order first words broken inside a line" and got[1, 1]["section"] == "Overview of the order"
    # in a numbered document a clause wins over a question, and names the section
    assert got[1, 3]["kind"] == "clause" and got[1, 4]["section"] == "Can anyone apply?"
    assert got[1, 5]["section"] == "Conformity to standards" and got[2, 1]["kind"] == "faq"


def test_chunks_stay_within_the_budget_and_keep_order(spark):
    rows = [(1, i, "word " * n, "prose", "", "", 0, 0) for i, n in enumerate((300, 90, 10, 399, 1, 900, 5, 5))]
    units = spark.createDataFrame(rows, "doc int, unit long, text string, kind string, clause string, section string, page_start int, page_end int").withColumn("text", F.trim("text"))
    groups = [r["chunk"] for r in documents.packed(units).orderBy("unit").collect()]
    assert groups == sorted(groups)
    made = documents.chunks(units).orderBy("chunk", "piece").collect()
    assert all(len(r["text"]) <= 2000 for r in made)
    again = documents.emitted(documents.chunks(units))
    assert again.count() == again.select("doc", "chunk_id").distinct().count()


def test_quality_gate(spark):
    rows = [("Steel tubes", "IS 1161", "curated", "Steel Quality Control Order"), ("Page", "", "text_proximity", ""), ("Helmets", "IS 1", "table_parse", "Simplified procedure"), ("Bolts", "ISX", None, "")]
    got = quality.validate(spark.createDataFrame(rows, "product_name string, is_standard_number string, extraction_method string, qco_reference string")).collect()
    assert [r["reasons"] for r in got] == [[], ["untrusted_extraction:text_proximity", "table_header", "missing_is_number"], [], ["untrusted_extraction:unknown", "is_number_has_no_digits"]]
    assert [r["status_basis"] for r in got][:3] == ["established", "unknown", "unknown"] and got[2]["mandatory_or_voluntary"] == quality.UNKNOWN_STATUS
    wide = spark.createDataFrame([("‭Ｓteel‬ ­ tubes—",)], "n string").select(T.normalize(F.col("n"))).first()[0]
    assert wide == "Steel tubes"


def test_fusion_does_not_depend_on_the_scale_of_scores(spark):
    near = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2)], "item_id long, doc_id long, similarity double, rank int")
    lex = [(1, 6, 3.0, 1), (1, 7, 1.5, 2)]
    one = R.fuse(near, spark.createDataFrame(lex, "item_id long, doc_id long, score double, rank int"))
    ten = R.fuse(near, spark.createDataFrame([(a, b, s * 10, r) for a, b, s, r in lex], "item_id long, doc_id long, score double, rank int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, ten.collect()))
    assert [r["doc_id"] for r in one.orderBy("position").collect()] == [6, 5, 7]


def test_guard_and_follow_up(spark):
    row = spark.createDataFrame([("Use IS 302 and IS 999, see IS 1.", "We know IS 302 (Part 1) : 2012")], "a string, c string")
    clean, removed = dialogue.guard(F.col("a"), F.col("c"))
    got = row.select(clean.alias("x"), removed.alias("y")).first()
    assert got["x"] == f"Use IS 302 and {dialogue.UNVERIFIED}, see {dialogue.UNVERIFIED}." and got["y"] == ["IS 999", "IS 1"]
    turns = spark.createDataFrame([(1, 0, "user", "Which helmets follow IS 4151?"), (1, 1, "assistant", "IS 4151:2015 covers helmets."), (1, 2, "user", "is it mandatory?")], "conv_id long, turn long, role string, text string")
    last = dialogue.resolve(turns).where("turn = 2").first()
    assert last["needs"] and last["terms"][:2] == ["IS 4151:2015", "4151"] and "helmets" in last["terms"]


def test_think_stripper_in_batch_and_stream(spark, tmp_path):
    deltas = [(1, 0, "a<think>x"), (1, 1, "y"), (1, 2, "z</think>b"), (2, 0, "<thi"), (2, 1, "nk>kept"), (3, 0, "<THINK>no</THINK>"), (4, 0, "p<think>q</think>r<think>s")]
    schema = "stream_id long, seq long, delta string"
    table = spark.createDataFrame(deltas, schema)
    want = [(1, 0, "a"), (1, 2, "b"), (2, 0, "<thi"), (2, 1, "nk>kept"), (3, 0, "<THINK>no</THINK>"), (4, 0, "pr")]
    assert sorted(map(tuple, thinking.strip_batch(table).collect())) == want
    table.write.parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = thinking.strip_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    try:
        q = out.writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.table("told").collect())) == want


def test_events_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, "token", "a\nb"), (1, 1, "done", None)], "stream_id long, seq long, type string, text string")
    sent = S.events(rows)
    back = S.parse_events(sent.select("stream_id", "event"), "type string, text string")
    assert sorted((r["type"], r["text"]) for r in back.collect()) == [("done", None), ("token", "a\nb")]


def test_index_checks_its_fingerprint(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "red plate"), ("b", "blue bolt"), ("c", "")], "chunk_id string, text string")
    vectors = index.embed(chunks, 16)
    path = index.build(vectors, f"file://{tmp_path}", "offline", "words", 16)
    assert index.load(spark, path, "offline", "words", 16).count() == 3
    with pytest.raises(index.FingerprintMismatch):
        index.load(spark, path, "offline", "other", 16)
    with pytest.raises(index.FingerprintMismatch):
        index.load(spark, f"file://{tmp_path}/none", "offline", "words", 16)
    with pytest.raises(ValueError):
        index.build(vectors, f"file://{tmp_path}", "offline", "words", 8)
    new = index.embed(spark.createDataFrame([("b", "green nut"), ("d", "new")], "chunk_id string, text string"), 16)
    assert sorted(r[0] for r in index.merged(spark, path, new).select("chunk_id").collect()) == ["a", "b", "c", "d"]
    assert len(T.collection_name("x" * 80, "p:m:3")) == 63


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"source_url": "u", "raw_text": "t", "scraped_at": "2024-01-02T03:04:05Z"}, {"title": "x"}]))
    docs = S.read_json(spark, f"file://{tmp_path}/d.json")
    assert sorted((r["source_url"], r["title"], r["scraped_at"] is None) for r in docs.collect()) == [("", "x", True), ("u", "", False)]
    (tmp_path / "bad.json").write_text('{"title": "broken')
    good, bad = S.read_json_checked(spark, f"file://{tmp_path}/*.json")
    assert sorted(r["title"] for r in good.collect()) == ["", "x"] and [r["file"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]
    assert S.read_or_empty(spark, f"file://{tmp_path}/nothing", "a int").count() == 0
    S.append_csv(docs, f"file://{tmp_path}/c", ["title", "missing"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["title", "missing"]
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "c")], "doc int, page int, text string")
    assert S.paged_text(pages).first()["text"] == "[Page 1]\na\n\n[Page 3]\nc"
    old = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, S.upsert_ignore(old, new, ["k"], "seq").collect())) == [(1, "a", 1), (2, "c", 1)]
    assert sorted(map(tuple, S.upsert_replace(old, new, ["k"], "seq").collect())) == [(1, "b", 1), (2, "c", 1)]
    S.write_run(docs, docs.agg(F.count("*").alias("n")), f"file://{tmp_path}/runs", "r1")
    assert S.latest(spark, f"file://{tmp_path}/runs/*_summary/*.json").first()["n"] == 2


def told(page, spans=True):
    return html.parse(page).told(spans)


def test_nested_markup_is_told_twice(spark):
    page = "<body><nav><p>menu entry that is long</p></nav><ul><li>outer text here <p>inner text here</p> tail</li></ul><h2>Hi</h2></body>"
    want = [("li", "outer text here inner text here tail"), ("p", "inner text here"), ("h2", "Hi")]
    got = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(html.extracted(F.col("html")).alias("x")).collect()
    assert [(r["tag"], r["text"]) for r in got[0]["x"]["blocks"]] == want
    assert got[0]["x"]["text"] == "outer text here inner text here tail\ninner text here\n\n## Hi"
    assert got[1]["x"] == got[2]["x"] and got[1]["x"]["text"] == ""


def test_content_is_found_by_structure():
    a, b = "text in the first place", "text in the second place"
    assert told(f'<div class="page-content"><div><p>{a}</p></div><p>{b}</p></div><p>outside of the content</p>') == [("p", a), ("p", b)]
    assert told(f'<div id="primary"><p>{a}</p></div><div class="x faq-list"><p>{b}</p></div>') == [("p", b)]
    assert told(f"<article><p>{a}</p></article><main><p>{b}</p></main>") == [("p", b)]
    assert told(f"<aside>a <aside>b</aside> <p>{a}</p></aside><p>{b}</p>") == [("p", b)]
    assert told(f"<svg><p>{a}</p></svg><span>{b}</span>") == [("span", b)] and told(f"<span>{b}</span>", False) == []
    # end tags left out; comments and line breaks part strings
    assert told(f"<p><b>{a}<br>more<p>{b}<ul><li>one long entry<li>two<!-- x -->halves here</ul>") == [("p", a + " more"), ("p", b), ("li", "one long entry"), ("li", "two halves here")]
    assert told("<h1>A <i>b</i> c</h1><table><tr><td>cell number one<td>cell number two<tr><td>cell number three</table>") == [("h1", "Abc"), ("td", "cell number one"), ("td", "cell number two"), ("td", "cell number three")]
    assert html.as_text(html.parse("just words"), True) == "just words"
    assert told("<script>var t='</p>';</script><p>R&amp;D and more text</p>") == [("p", "R&D and more text")]


def test_legacy_splitter(spark):
    def brute(text, most, overlap):
        if len(text) <= most:
            return [text.strip()] if text.strip() else []
        for sep in ("\n\n", "\n", ". ", " "):
            if sep not in text:
                continue
            out, cur = [], ""
            for part in text.split(sep):
                longer = cur + sep + part if cur else part
                if len(longer) > most and cur:
                    out.append(cur.strip())
                    cur = (cur[-overlap:] if overlap else "") + sep + part
                else:
                    cur = longer
            out += [cur.strip()] if cur.strip() else []
            if all(len(x) <= most for x in out):
                return [x for x in out if x]
        return [x for i in range(0, len(text), most - overlap) if (x := text[i : i + most].strip())]

    r = random.Random(1)
    texts = ["", "  ", "a\n\nb", "x" * 25, "a b " * 9] + ["".join(r.choices(["ab", " ", ". ", "\n", "\n\n", "longerword"], k=r.randint(1, 20))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for overlap in (0, 3):
        got = {x["i"]: x["p"] for x in rows.select("i", documents.legacy_split(F.col("text"), 14, overlap).alias("p")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == brute(text, 14, overlap), repr(text)


def test_states_of_a_fold(spark):
    from millrace.functions.folds import states

    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 5, 100, 1000)], "a array<int>")
    for x in rows.select("a", states(F.col("a"), F.lit(7), lambda s, i: s + i).alias("s")).collect():
        total, want = 7, []
        for i in x["a"]:
            total += i
            want.append(total)
        assert x["s"] == want


def test_providers_are_asked_again():
    from millrace.operators import index

    calls, waits = [], []

    def flaky(texts, dim):
        calls.append(texts)
        if len(calls) < 3:
            raise index.Unavailable("busy", 9.0 if len(calls) == 2 else None)
        return index.hashed_words(texts, dim)

    assert index.retried(flaky, wait=waits.append)(["a"], 4).shape == (1, 4) and waits == [1.5, 9.0]
    calls.clear()
    with pytest.raises(RuntimeError, match="after 2 attempts"):
        index.retried(flaky, attempts=2, wait=waits.append)(["a"], 4)
    seen = []
    index.prefixed(lambda t, d: seen.append(t), "query")(["x"], 4)
    assert seen == [["search_query: x"]]


def test_index_folders(spark, tmp_path):
    from millrace.operators import index

    root = f"file://{tmp_path}"
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    assert index.verified(spark, root, "p", "m", 2) == "missing"
    path = index.build(v, root, "p", "m", 2)
    index.upsert(spark, path, spark.createDataFrame([("b", [0.5, 0.5]), ("c", [1.0, 1.0])], v.schema))
    assert {r["chunk_id"]: r["embedding"] for r in index.load(spark, path, "p", "m", 2).collect()} == {"a": [1.0, 0.0], "b": [0.5, 0.5], "c": [1.0, 1.0]}
    index.build(v, root, "p", "m", 2)  # whole again
    assert index.verified(spark, root, "p", "m", 2) == "ok" and index.load(spark, path, "p", "m", 2).count() == 2
    index.build(v.limit(0), root, "p", "n", 2)
    assert index.verified(spark, root, "p", "n", 2) == "empty"
    assert index.prune(spark, root, path.rsplit("/", 1)[1]) == ["chunks_p_n_2"] and index.listed(spark, root).count() == 1


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """In a copy without the corpus operators the entry imports, lists the other queries and runs one."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = (
        "import __spark_entry__ as e\n"
        "from millrace.session import local_session\n"
        "q = e.queries()\n"
        "assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in [*q, *e.oracle_sql()])\n"
        "spark = local_session('copy', 2, '1g')\n"
        "assert q['route_fixture'](spark, '/root/testdata/sf0.001').count() > 0 and q['html_main_text'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_a_missing_dependency_is_no_missing_package(tmp_path):
    """Only the absence of the corpus operators themselves is passed over."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "millrace").mkdir()
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    for d in ("", "plans", "llm"):
        (tmp_path / "millrace" / d).mkdir(exist_ok=True)
        (tmp_path / "millrace" / d / "__init__.py").write_text("")
    (tmp_path / "millrace/plans/catalog.py").write_text("QUERIES, ORACLE = {}, {}")
    (tmp_path / "millrace/llm/registry.py").write_text("import a_library_that_is_not_there")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.returncode and "a_library_that_is_not_there" in got.stderr
