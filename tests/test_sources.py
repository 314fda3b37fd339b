"""Files in, files out, and the stream."""

import json

from pyspark.sql import functions as F

from tripleframe.operators import corpus, extract
from tripleframe.sources import kb, records
from tripleframe.streaming.extraction import stream_triples


def test_prompt_arrays_and_runs(spark, tmp_path):
    prompts = tmp_path / "prompts"
    prompts.mkdir()
    (prompts / "one_prompts_test.json").write_text(json.dumps(["first\nline", "zwei ü"], ensure_ascii=False, indent=4))
    (prompts / "two_prompts_test.json").write_text("[]")
    got = [tuple(r) for r in records.read_prompt_arrays(spark, str(prompts)).orderBy("doc_id").collect()]
    assert got == [("one_prompts_test", 0, "first\nline"), ("one_prompts_test", 1, "zwei ü")]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "a.json").write_text(json.dumps([{"index": 0, "prompt": "p", "generated_text": "x"}], indent=4))
    (runs / "b.json").write_text(json.dumps([{"index": 0, "prompt": "p", "extraction": "y"}]))
    got = sorted(tuple(r) for r in records.read_runs(spark, str(runs)).collect())
    assert got == [("a", 0, "p", "x"), ("b", 0, "p", "y")]


def test_corpus_round_trip(spark, tmp_path):
    raw = {
        "docid": "d-0", "title": "t", "uri": "U1", "text": "Tiny ümlaut", "split": "test",
        "entities": [{"uri": "U1", "surfaceform": "tiny", "type": "MISC", "start": 0, "end": 4}],
        "relations": [],
    }
    source = tmp_path / "raw" / "split=test"
    source.mkdir(parents=True)
    (source / "part.jsonl").write_text(json.dumps(raw, ensure_ascii=False))
    docs = records.read_corpus(spark, str(tmp_path / "raw"))
    assert [tuple(r) for r in corpus.split_counts(docs).collect()] == [("test", 1)]
    records.write_split(corpus.convert_documents(docs), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["Entity Types"] == ["Tiny is a/an miscellaneous."] and back["split"] == "test"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\nnot json\n')
    assert sorted((r.a for r in records.read_records(spark, str(bad), "a int").collect()), key=str) == [1, None]


def test_templates(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "one_prompt.json").write_text(json.dumps({"formatter": "F {Text}", "input variables": ["Text"]}, indent=4))
    assert records.template_texts(records.read_templates(spark, str(folder))) == {"one_prompt": {"prefix": "", "formatter": "F {Text}", "suffix": ""}}
    few = {"two": {"prefix": "P", "formatter": "F", "example variables": ["a b"], "input variables": ["Text"], "suffix": "S"}}
    records.write_templates(spark, few, str(tmp_path / "w"))
    back = records.read_written_templates(spark, str(tmp_path / "w")).first()
    assert (back["name"], back["prefix"], back["example variables"]) == ("two", "P", ["a b"])


def test_runs_replace_only_their_own(spark, tmp_path):
    out = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run string, v int")
    records.write_runs(df, out)
    records.write_runs(df.where("run = 'a'").withColumn("v", F.lit(9)), out)
    assert sorted((r.run, r.v) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 2)]


def test_knowledge_base_round_trip(spark, tmp_path):
    tables = kb.KnowledgeBase(
        spark.createDataFrame([("Q1", "item", "x", ["y"], None, 1)], kb.LABELS),
        spark.createDataFrame([("Q1", "P31", "Q2")], kb.STATEMENTS), spark.createDataFrame([("P1", "domain", "Q2", "c")], kb.CONSTRAINTS),
    )
    kb.write_kb(tables, str(tmp_path))
    back = kb.read_kb(spark, str(tmp_path))
    assert back.label.first().asDict() == tables.label.first().asDict()
    assert back.statement.collect() == tables.statement.collect() and back.constraint.collect() == tables.constraint.collect()


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    line = lambda i, t: json.dumps({"index": i, "prompt": "p", "generated_text": t})
    (tmp_path / "in" / "a.jsonl").write_text(line(0, '[["a","b","c"]]') + "\n" + line(1, "nothing"))
    assert stream_triples(spark, source, out, state, once=True).awaitTermination(120)
    (tmp_path / "in" / "b.jsonl").write_text(line(0, "It is [{'subject': 's', 'predicate': 'p', 'object': 'o'}] then"))
    assert stream_triples(spark, source, out, state, once=True).awaitTermination(120)
    columns = ["run", "doc_id", "pos", "reader", "s", "p", "o"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select(columns).collect())
    batch = extract.extract_triples(records.read_runs(spark, source, lines=True)).select(columns)
    assert streamed == sorted(tuple(r) for r in batch.collect()) and len(streamed) == 2


def test_broken_lines_are_told_apart(spark, tmp_path):
    from tripleframe.sources import records

    (tmp_path / "a.jsonl").write_text('{"doc_id": 1, "x": "a"}\nnot json\n\n{"doc_id": 2}\n{"doc_id": "three"}\n')
    rows, broken = records.read_checked_records(spark, str(tmp_path), "doc_id long, x string")
    assert sorted((r["doc_id"], r["x"] or "") for r in rows.collect()) == [(1, "a"), (2, "")]
    assert sorted((r["file"], r["line"]) for r in broken.collect()) == [("a.jsonl", 'not json'), ("a.jsonl", '{"doc_id": "three"}')]


def test_one_array_file_is_read_in_ranges(spark, tmp_path):
    import json
    import random

    from tripleframe.sources import arrays, records

    rng = random.Random(2)
    signs = ['"', "\\", "[", "]", "{", "}", ",", "a", "é", "\n", " ", "\U0001f600"]
    prompts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(200)] + [None, "", "\\" * 40, '"' * 30, "[" * 50]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps(prompts, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "p" / "two.json").write_text(json.dumps(prompts[:3]), encoding="utf-8")
    (tmp_path / "p" / "none.json").write_text(" [ ] ")
    for size in (97, 1 << 20):
        read = records.read_prompt_arrays(spark, str(tmp_path / "p"), size)
        got = {(r["run"], r["doc_id"]): r["prompt"] for r in read.collect()}
        assert got == {("one", i): p for i, p in enumerate(prompts)} | {("two", i): p for i, p in enumerate(prompts[:3])}
    assert records.read_prompt_arrays(spark, str(tmp_path / "p" / "one.json"), 2000).rdd.getNumPartitions() >= 4
    runs = [{"index": i, "prompt": p, "extraction" if i % 2 else "generated_text": json.dumps([p, [1, {"a": "]"}]])} for i, p in enumerate(prompts)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "run.x.json").write_text(json.dumps(runs))
    got = {r["doc_id"]: (r["run"], r["prompt"], r["generated_text"]) for r in records.read_runs(spark, str(tmp_path / "r"), size=301).collect()}
    assert got == {i: ("run.x", p, json.dumps([p, [1, {"a": "]"}]])) for i, p in enumerate(prompts)}


def test_bucketed_tables_are_joined_where_they_lie(spark):
    from tripleframe.operators import kb, linking
    from tripleframe.sources import kb as kb_files

    label = spark.createDataFrame([(f"Q{i}", "item", f"n{i}", None, "d", i) for i in range(50)], kb_files.LABELS)
    statement = spark.createDataFrame([(f"Q{i}", "P1", f"Q{i + 1}") for i in range(50)], kb_files.STATEMENTS)
    constraint = spark.createDataFrame([("P1", "domain", "C", "c")], kb_files.CONSTRAINTS)
    kb_files.write_kb_tables(kb_files.KnowledgeBase(label, statement, constraint), "bucketed_kb", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = kb_files.read_kb_tables(spark, "bucketed_kb")
        asked = spark.createDataFrame([("Q1", "P1", "Q2"), ("Q1", "P1", "Q3")], "s_id string, p_id string, o_id string")
        for df, n in ((kb.statement_exists(asked, held.statement), 2), (linking.describe_ids(asked.selectExpr("o_id AS id"), held.label), 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            above, level = [], depth(lines[scan])
            for line in reversed(lines[:scan]):
                if depth(line) < level:
                    above.append(line)
                    level = depth(line)
            assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in above), plan
            assert df.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for table in ("label", "statement", "constraint"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_kb_{table}")
