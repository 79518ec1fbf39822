"""Empty tables, nulls, repeated rows and columns with clashing names; every stage of the pipeline on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diptych.llm import chat, decontaminate, html, jaccard, langid, lines, mixing, quality, substrings, toxicity
from diptych.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import rows, sql_rows
from tests.llm import plain
from tests.llm.test_short_lines import deduped

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "n_words string, chunk string, __x string, size string, score string, items string, n_lines string, position string, kept string, component_id string"


def clashing(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.lit("c").alias(c.split()[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="module")
def odd(spark):
    same = (7, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 10)
    return clashing(spark, [(1, None, "en", None, None), (2, "", None, "a", 0), same, same, (None, "x y z", "en", "b", 5), (9, "long " * 50_000, "en", "a", 1)])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")


OPERATORS = {
    "mixing": lambda d, b: mixing.planned(d),
    "mix": lambda d, b: mixing.mix(d),
    "jaccard": lambda d, b: jaccard.similar(d),
    "one_of_each": lambda d, b: jaccard.one_of_each(d),
    "lines": lambda d, b: lines.dedup_lines(d),
    "substrings": lambda d, b: substrings.remove_repeats(d),
    "quality": lambda d, b: quality.judge(d),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b),
    "remove_documents": lambda d, b: decontaminate.remove_documents(d, b),
}


#: What each operator makes of ``odd``, sorted by doc_id, null last: of columns that say it.
ODD = {
    "mixing": (("doc_id", "size"), [(1, 0), (2, 0), (7, 12), (7, 12), (9, 50_000), (None, 3)]),
    "mix": (("doc_id", "words_taken"), None),
    "jaccard": (("doc_id", "n_shingles", "component_id"), [(1, 0, 1), (2, 0, 2), (7, 10, 7), (7, 10, 7), (9, 1, 9), (None, 1, None)]),
    "one_of_each": (("doc_id", "n_chars"), [(1, None), (2, 0), (7, 10), (9, 1), (None, 5)]),
    "lines": (("doc_id", "n_lines", "n_dropped", "n_near", "n_links"), [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (7, 1, 0, 0, 0), (7, 1, 0, 0, 0), (9, 1, 0, 0, 0), (None, 0, 0, 0, 0)]),
    "substrings": (("doc_id", "n_words", "n_removed"), [(1, 0, 0), (2, 0, 0), (7, 12, 0), (7, 12, 0), (9, 50_000, 0), (None, 3, 0)]),
    "quality": (("doc_id", "n_words", "base_failed"), [(1, 0, True), (2, 0, True), (7, 12, False), (7, 12, False), (9, 50_000, True), (None, 3, True)]),
    "decontaminate": (("doc_id", "n_words", "n_hit", "items"), [(1, 0, 0, []), (2, 0, 0, []), (7, 12, 10, ["1"]), (7, 12, 10, ["1"]), (9, 50_000, 0, []), (None, 3, 0, [])]),
    "remove_documents": (("doc_id", "n_chars"), [(1, None), (2, 0), (9, 1), (None, 5)]),
}
REPLACED = {"mixing": {"size", "position"}, "mix": {"position"}, "lines": {"n_lines"}, "substrings": {"n_words", "kept"}, "decontaminate": {"n_words", "items"}, "one_of_each": set(), "remove_documents": set()}


def _sorted(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=lambda r: (r[0] is None, r[0]))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, bench, name):
    found, (columns, wanted) = OPERATORS[name](odd, bench), ODD[name]
    if wanted is None:
        rows = _sorted(found, columns)
        assert rows and {r[0] for r in rows} <= {7, 9, None} and all(r[1] > 0 for r in rows)
    else:
        assert _sorted(found, columns) == wanted
    for c in set(odd.columns[5:]) - REPLACED.get(name, set(odd.columns)):
        assert {r[0] for r in found.select(c).collect()} == {"c"}, c


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, odd, bench, name):
    assert OPERATORS[name](odd.where("false"), bench).collect() == []
    if name in ("decontaminate", "remove_documents"):
        assert OPERATORS[name](odd, bench.where("false")).count() == 6


def test_learned_operators_on_odd_rows(odd):
    twice = odd.unionByName(odd)
    model = langid.fit(odd)
    told = langid.identify(twice, model)
    assert {(r.doc_id, r.lang_pred) for r in told.collect()} == {(1, "und"), (2, "und"), (7, "en"), (None, "en"), (9, "en")} and told.count() == 12
    rated = toxicity.score(twice, toxicity.Model({"long": 2.0}, {}, (-3.0, 4.0, 1.0, 1.0)))
    assert {(r.doc_id, r.predicted) for r in rated.collect()} == {(1, 0), (2, 0), (7, 0), (None, 0), (9, 1)} and rated.count() == 12
    pages = twice.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<article><p>"), "text").alias("html"), F.lit("c").alias("text"), "size")
    found = html.extract(pages, html.Model({"in article": 4.0}))
    assert {(r.page_id, r.n_chars) for r in found.collect()} == {(1, 0), (2, 0), (7, 62), (None, 5), (9, 249_999)}
    assert {r["size"] for r in found.collect()} == {"c"}


def test_chat_with_odd_rows(spark):
    """A null conv_id is a conversation; rows of one turn are in the order of role and text; clashing columns do no harm."""
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "x"), (1, 0, "assistant", "long " * 50_000), (1, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("c")).withColumn("piece", F.lit("c"))
    found = {r.conv_id: r for r in chat.digest(frame).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {None: 2, 1: 3}
    assert found[1].loss_chars == 250_000 and found[None].loss_chars == 1
    again = {r.conv_id: r.turns_sha256 for r in chat.digest(frame.repartition(5)).collect()}
    assert again == {k: r.turns_sha256 for k, r in found.items()}


def test_no_conversations_or_pages(spark):
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(pages, html.fit(pages)).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_no_rows(spark, odd, folder, stage):
    name, work = corpus_pipeline.STAGES[stage]
    kept = {"language_id": [7, 7, 9, None], "line_dedup": [1, 2, 7, 7, 9, None], "near_duplicates": [1, 2, 7, 9, None], "benchmark_decontamination": [1, 2, 7, 7, 9, None]}
    found = work(spark, odd, folder)
    if name == "mix":
        assert {r.doc_id for r in found.collect()} <= {7, 9, None} and found.count()
    else:
        assert [r[0] for r in _sorted(found, ["doc_id"])] == kept[name]
        assert found.columns == odd.columns
        for c in odd.columns[5:]:
            assert {r[0] for r in found.select(c).collect()} == {"c"}
    assert work(spark, odd.where("false"), folder).collect() == []


def test_stages_against_plain_versions(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = langid.fit(docs)
    told = {r.doc_id: langid.predict(r.text, model.languages, model.coders()) for r in docs.collect()}
    first = stages["language_id"](spark, docs, folder)
    assert {r.doc_id for r in first.collect()} == {i for i, (lang, _, margin) in told.items() if lang != "und" and margin >= langid.MARGIN}
    small = docs.where("length(text) < 2000")
    given = [(r.doc_id, r.text) for r in small.collect()]
    found = {r.doc_id: r.text for r in stages["line_dedup"](spark, small, folder).collect()}
    assert found == {i: t for i, t, _, n, *_ in deduped(given, lines.EDITS, lines.LEAST_CHARS) if not n or t.strip(plain.SPACE)}
    assert {r.doc_id for r in stages["near_duplicates"](spark, small, folder).collect()} == {i for i, _, c in plain.components(given, 80, 5) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {r.doc_id for r in stages["benchmark_decontamination"](spark, small, folder).collect()} == {i for i, *_, hit in plain.contaminated(given, items, 10) if not hit}
    mixed = stages["mix"](spark, small, folder)
    plan = {r.doc_id: r.taken for r in mixing.planned(small).collect() if r.taken}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("words_taken").alias("n")).collect()} == plan


def test_pipeline_runs(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() and {"repeat", "words_taken", "position"} <= set(found.columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, folder, name):
    found, wanted = QUERIES[name](spark, folder), sql_rows(folder, ORACLE_SQL[name])
    assert rows(found.select(list(wanted.columns)).toPandas()) == rows(wanted)
