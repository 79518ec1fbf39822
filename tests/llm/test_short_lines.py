"""Lines too short for the edit join: equal ones are dropped, others stay."""

import random
from collections import defaultdict

import corpus_pipeline
from diptych.llm import exchange, lines
from diptych.llm.queries import QUERIES
from tests.llm import plain

SCHEMA = "doc_id long, text string"


def deduped(rows, edits, least, shortest=1):
    """As plain.lines, and of lines under ``least`` but of ``shortest`` code points or more, all but the first copy dropped."""
    first, places = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = line.strip(plain.SPACE)
            if len(s) >= shortest:
                first.setdefault(s, (i, k))
                places.append((i, k, s))
    linked, long = defaultdict(set), [s for s in first if len(s) >= least]
    for a in long:
        for b in long:
            if a < b and abs(len(a) - len(b)) <= edits and plain.distance(a, b) <= edits:
                linked[a].add(b)
                linked[b].add(a)
    late = {s for s in linked if any(first[o] < first[s] for o in linked[s])}
    told, gone = defaultdict(lambda: [0, 0, 0, 0]), set()
    for i, k, s in places:
        dropped = s in late or first[s] != (i, k)
        told[i] = [x + y for x, y in zip(told[i], (1, dropped, s in late, len(linked[s])), strict=True)]
        if dropped:
            gone.add((i, k))
    return sorted((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), *told[i]) for i, t in rows)


def test_copies_of_short_lines(spark, monkeypatch):
    monkeypatch.setattr(exchange, "sizes", lambda d, *a: exchange.Sizes(5, 7))
    rng = random.Random(8)
    some = ["Les.", "Yes.", "a", "b", "é日", "x" * 19, "x" * 18 + "y", "x" * 20, "x" * 19 + "y", "nineteen characters", "twenty characters..."]
    rows = [(k, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([*some, "", f"only {k}"]) for _ in range(rng.randint(0, 6)))) for k in range(60)] + [(90, None), (91, ""), (92, "\n \n")]
    for edits, least in ((2, 20), (1, 3), (2, 1)):
        found = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), edits, least, shortest=1)
        assert sorted((tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped", "n_near", "n_links").collect()), key=lambda r: r[0]) == deduped(rows, edits, least)


def test_query_and_stage_drop_short_copies(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 2000")
    wanted = deduped([(r.doc_id, r.text) for r in docs.collect()], lines.EDITS, lines.LEAST_CHARS)
    assert {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, folder).collect()} == {i: t for i, t, _, n, *_ in wanted if not n or t.strip(plain.SPACE)}
    whole = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    stripped = [x.strip(plain.SPACE) for r in whole for x in (r.text or "").split("\n")]
    short = [x for x in stripped if 0 < len(x) < lines.LEAST_CHARS]
    copies = len(short) - len(set(short))
    longer = sum(r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(whole, SCHEMA)).collect())
    found = QUERIES["op5_line_dedup"](spark, folder).collect()
    assert copies and sum(r.n_dropped for r in found) == longer + copies
