"""Template filling, few-shot assembly, generation with retries."""

from pyspark.sql import functions as F

from tripleframe.operators import generate as gen
from tripleframe.operators import prompts


def test_slots_and_braces(spark):
    df = spark.createDataFrame([(1, "a {Wiki Triples} b", "[x]", None)], "doc_id int, Text string, `Wiki Triples` string, C string")
    templates = {"t": "{{{Text}}} = {Wiki Triples}, {C}", "u": "fixed"}
    got = {r.template: r.prompt for r in prompts.fill_template(df, templates).collect()}
    assert got == {"t": "{a {Wiki Triples} b} = [x], None", "u": "fixed"}


def test_few_shot(spark):
    queries = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id int, Text string")
    demos = spark.createDataFrame([(1, 2, "second {Text}"), (1, 1, "first")], "query_id int, rank int, Text string")
    template = {"prefix": "Go", "formatter": "Ex: {Text}", "suffix": "Now {Text}"}
    got = {r.query_id: r.prompt for r in prompts.few_shot_prompts(queries, demos, template).collect()}
    assert got == {1: "Go\nEx: first\nEx: second {Text}\nNow q one", 2: "Go\nNow q two"}
    bare = prompts.few_shot_prompts(queries, demos.where("false"), {"prefix": "", "formatter": "", "suffix": "S"})
    assert {r.prompt for r in bare.collect()} == {"S"}


def test_generation_retries_and_resumes(spark):
    def flaky():
        calls = {"n": 0}

        def run(texts):
            calls["n"] += 1
            if "bad" in texts:
                raise ValueError("bad prompt")
            if calls["n"] == 1:
                raise TimeoutError("try again")
            return [t[::-1] for t in texts]

        return run

    df = spark.createDataFrame([("r", i, p) for i, p in enumerate(["one", "bad", "two", "three"])], "run string, doc_id int, prompt string").coalesce(1)
    out = gen.generate(df, flaky, batch=3, delay=0.0)
    got = {r.doc_id: (r.generated_text, r.error) for r in out.collect()}
    assert got == {0: ("eno", None), 1: (None, "ValueError: bad prompt"), 2: ("owt", None), 3: ("eerht", None)}
    assert [r.doc_id for r in gen.unfinished(df, out).collect()] == [1]


def test_answers_must_match_their_prompts(spark):
    from tripleframe.operators import generate

    def make():
        def answer(prompts):
            if len(prompts) > 1:
                return ["shifted"] * (len(prompts) - 1)  # one too few: the batch is a failed try
            return [None if prompts[0] == "none" else prompts[0].upper()] if prompts[0] != "two" else ["a", "b"]

        return answer

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["one", "none", "two", "four"])], "doc_id long, prompt string")
    got = {r["prompt"]: (r["generated_text"], r["error"]) for r in generate.generate(rows, make, retries=1, delay=0.0, tasks=1).collect()}
    assert got["one"] == ("ONE", None) and got["four"] == ("FOUR", None)
    assert got["none"] == (None, "no answer") and got["two"][0] is None and "2 answers to 1 prompts" in got["two"][1]


def test_python_literals_spell_unprintable_characters(spark):
    from pyspark.sql import functions as F

    from tripleframe.functions.text import list_literal

    texts = ["a\xa0b", "z​w", "nul\x00", "\x7f\x85", "tab\tnew\nline", "é 中 \U0001f600", " \U000e0001", "it's", 'say "x" it\'s', " 　"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(list_literal(F.array("t"))).collect()] == [repr([t]) for t in texts]


def test_stopped_generation_repeats_one_batch_at_most(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    log, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    log.mkdir()

    class Stopped(BaseException):
        pass

    def make(limit):
        folder = str(log)

        def build():
            import os
            import uuid

            def answer(texts):
                if len(os.listdir(folder)) >= limit:
                    raise Stopped("the machine is gone")
                for text in texts:
                    open(f"{folder}/{uuid.uuid4()}-{text}", "w").close()
                if "bad" in texts:
                    raise ValueError("bad prompt")
                return [t.upper() for t in texts]

            return answer

        return build

    rows = [("r", i, f"p{i % 90}") for i in range(100)] + [("r", 100, None)]
    df = spark.createDataFrame(rows, "run string, doc_id int, prompt string")
    options = dict(batch=5, retries=1, delay=0.0, tasks=2)
    with pytest.raises(PySparkException):
        gen.generate_durably(df, make(40), ledger, **options)
    first = len(list(log.iterdir()))
    assert 40 <= first <= 50
    got = {r.doc_id: r.generated_text for r in gen.generate_durably(df, make(10**9), ledger, **options).collect()}
    assert got == {i: p and p.upper() for _, i, p in rows}
    calls = len(list(log.iterdir()))
    assert 90 <= calls <= 90 + 2 * 5
    assert gen.generate_durably(df, make(0), ledger, **options).where("generated_text IS NULL").count() == 1
    assert len(list(log.iterdir())) == calls
    more = spark.createDataFrame([("r", 1, "bad"), ("r", 2, "good")], "run string, doc_id int, prompt string")
    got = {r.prompt: (r.generated_text, r.error) for r in gen.generate_durably(more, make(10**9), ledger, per_second=1000.0, **options).collect()}
    assert got == {"bad": (None, "ValueError: bad prompt"), "good": ("GOOD", None)}


def test_examples_named_by_id_give_the_prompts_of_joined_ones(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, None)], "query_id int, Text string")
    chosen = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 1, "c"), (2, 2, "zz"), (4, 1, "a"), (4, 2, "a")], "query_id int, rank int, id string")
    shown = spark.createDataFrame([("a", "A"), ("b", "B2"), ("b", "B1"), ("c", None), ("d", "D")], "id string, Text string")
    template = {"prefix": "P", "formatter": "demo {Text}", "suffix": "S {Text} {Size}"}
    widen = lambda df: df.withColumn("Size", F.length("Text"))
    joined = prompts.few_shot_prompts(widen(queries), chosen.join(shown, "id"), template)
    want = sorted(map(str, joined.collect()))
    few = prompts.few_shot_prompts(queries, chosen, template, shown=shown, widen=widen)
    monkeypatch.setattr(prompts, "SHOWN_BYTES", 0)
    many = prompts.few_shot_prompts(queries, chosen, template, shown=shown, widen=widen)
    for got in (few, many):
        assert sorted(map(str, got.select(*joined.columns).collect())) == want
    assert {r.query_id: r.prompt for r in few.collect()}[1] == "P\ndemo B1\ndemo B2\ndemo A\nS one 3"
    # texts of examples are not collected per query
    optimized = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in optimized and "collect_list" not in optimized
