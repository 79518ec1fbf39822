"""Captions as wholes: nothing is cut from them, and what is encoded decodes again."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from diptych import registry
from diptych.operators import captions

TEXTS = {0: " ".join(f"w{k % 7}" for k in range(40)), 1: "w0 once w1", 2: "", 9: "w2 w3", 10: None}


def _captions(spark):
    rows = [(i, t.split() if t is not None else None, i // 8) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "id long, words array<string>, batch long")


def test_batches_are_padded_to_their_longest_and_decode(spark):
    frame = _captions(spark)
    words = captions.vocabulary(frame)
    number = {r.word: r.word_id for r in words.collect()}
    rows = captions.batched(frame, words, "batch")
    found = {r.id: r.ids for r in rows.collect()}
    whole = {i: [1, *[number.get(w, 3) for w in (t or "").split()], 2] for i, t in TEXTS.items()}
    longest = {b: max(len(whole[i]) for i in TEXTS if i // 8 == b) for b in (0, 1)}
    assert longest == {0: 42, 1: 4}
    assert found == {i: x + [0] * (longest[i // 8] - len(x)) for i, x in whole.items()}
    assert {r.id: r.caption for r in captions.decoded(rows, words).collect()} == {i: " ".join(w for w in (t or "").split() if w in number) for i, t in TEXTS.items()}


@pytest.mark.parametrize("most", [8, 1 << 21])
def test_captions_are_coded_where_they_lie(spark, monkeypatch, most):
    """Many chunks or one, batches across chunks, rows of one id and rows of none: ids are those of one table of words, and no word is a row."""
    monkeypatch.setattr(captions, "CODED_LEAST", 1)
    monkeypatch.setattr(captions, "CODED_MOST", most)
    rows = [(i, t.split() if t is not None else None, i // 8) for i, t in TEXTS.items()]
    rows += [(17, ["w0", "w1"], 2), (17, ["w3"], 2), (18, [], 2), (None, ["far", "w0", "far"], None), (19, ["w4", "far"], 2), (None, ["off", "off"], None), (20, ["\u00e9\u00df"], 2)]
    frame = spark.createDataFrame(rows, "id long, words array<string>, batch long").repartition(3)
    words = captions.vocabulary(frame)
    assert [r.word for r in words.orderBy("word_id").collect()] == [*[f"w{k}" for k in range(7)], "far", "off"]
    number = {r.word: r.word_id for r in words.collect()}
    assert sorted(number.values()) == list(range(4, 13))
    told = captions.round_trip(frame, words, "batch")
    found = sorted((r.id, r.ids, r.caption) for r in told.collect())
    assert [f[0] for f in found] == [0, 1, 2, 9, 10, 17, 17, 18, 19, 20]
    assert [f[1:] for f in found[5:]] == [("1 4 7 5 2", "w0 w3 w1")] * 2 + [("1 2 0 0 0", ""), ("1 8 11 2 0", "w4 far"), ("1 3 2 0 0", "")]
    padded = captions.batched(frame, words, "batch")
    assert sorted((r.id, " ".join(map(str, r.ids)), r.batch) for r in padded.collect()) == sorted((i, x, i // 8) for i, x, _ in found)
    once = padded.where("id <> 17")
    assert {r.id: r.caption for r in captions.decoded(once, words).collect()} == {i: c for i, _, c in found if i != 17}
    with pytest.raises(Exception, match="a word has a space"):
        captions.batched(spark.createDataFrame([(1, ["a b"], 1)], frame.schema), words, "batch").collect()
    assert captions.round_trip(frame.where("false"), words, "batch").collect() == []


def test_query_keeps_ends(spark, folder):
    rows = registry.queries()["encode_decode_pad"](spark, folder)
    ids = F.split("ids", " ")
    wanted = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("n"))
    told = rows.join(wanted, "id").select("n", F.size(F.filter(ids, lambda x: x != "0")).alias("m"), F.exists(ids, lambda x: x == "2").alias("ended")).collect()
    assert told and all(r.ended and r.m == max(r.n, 0) + 2 for r in told)


def test_following_passes_over_parts(spark):
    rows = [(1, "a"), (5, "b"), (7, "a"), (3100, "a"), (3101, "b"), (9000, "a"), (9001, "c")]
    found = captions.following(spark.createDataFrame(rows, "id long, lang string"), "lang").collect()
    assert {r.id: r.next for r in found} == {1: 7, 7: 3100, 3100: 9000, 5: 3101}


def test_whole_texts_are_scored_and_counted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").orderBy("doc_id").collect()
    words: dict = {}
    for r in docs:
        for w in (r.text or "").lower().split():
            words[w] = words.get(w, 0) + 1
    found = {r.word: r.n for r in registry.queries()["vocab_build"](spark, folder).collect()}
    assert sum(found.values()) == sum(n for n in words.values() if n > 1)
    last: dict = {r.lang or "": r for r in docs}
    rouge = {r.id: (r.precision, r.recall) for r in registry.queries()["rouge_l_best_ref"](spark, folder).collect()}
    assert set(rouge) == {r.doc_id for r in docs} - {r.doc_id for r in last.values()}
    for lang in last:
        same = [r for r in docs if (r.lang or "") == lang][:6]
        for a, b in zip(same, same[1:], strict=False):
            x, y = (b.text or "").lower().split(), (a.text or "").lower().split()
            n = captions.common_length(x, y)
            assert rouge[a.doc_id] == (round(n / max(len(x), 1), 6), round(n / max(len(y), 1), 6))


def _grams(words, n):
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def plain_bleu(said, refs):
    hit, of, h, r = [0] * 5, [0] * 5, 0, 0
    for i, words in said.items():
        for n in range(1, 5):
            most = Counter()
            for ref in refs[i]:
                most |= _grams(ref, n)
            hit[n] += sum((_grams(words, n) & most).values())
            of[n] += max(1, len(words) - n + 1)
        h += len(words)
        r += min((abs(len(x) - len(words)), len(x)) for x in refs[i])[1]
    if not hit[1]:
        return [0.0] * 4
    out, total, missed = [], 0.0, 0
    for n in range(1, 5):
        top = hit[n]
        if not top:
            missed += 1
            top = 1 / (2**missed * 5 / math.log(h))
        total += math.log(top / of[n])
        out.append((1 if h > r else math.exp(1 - r / h)) * math.exp(total / n))
    return out


def plain_cider(said, refs):
    out = {}
    for i, words in said.items():
        scores = []
        for n in range(1, 5):
            df = Counter(g for x in refs.values() for g in _grams(x[0], n))
            vector = lambda x, n=n, df=df: {g: k / sum(_grams(x, n).values()) * math.log((len(refs) + 1) / (df[g] + 1)) for g, k in _grams(x, n).items() if g in df}
            a, b = vector(words), Counter()
            for x in refs[i]:
                for g, v in vector(x).items():
                    b[g] += v / len(refs[i])
            length = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
            scores.append(sum(v * b[g] for g, v in a.items() if g in b) / length if length else 0.0)
        out[i] = 10 * sum(scores) / 4
    return out


@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrstuvwxyz"])
def test_several_references(spark, letters):
    rng = random.Random(4)
    some = lambda: [rng.choice(letters) for _ in range(rng.randint(1, 6))]
    said = {i: some() for i in range(12)}
    refs = {i: [some() for _ in range(rng.randint(1, 3))] for i in said}
    a = spark.createDataFrame([(i, " ".join(x)) for i, x in said.items()] + [(99, "no reference")], "id long, hypothesis string")
    b = spark.createDataFrame([(i, k, " ".join(x)) for i, xs in refs.items() for k, x in enumerate(xs)], "id long, place int, reference string")
    assert list(captions.bleu_of_several(a, b).first()) == pytest.approx(plain_bleu(said, refs), abs=2e-6)
    assert {r.id: r.score for r in captions.consensus_of_several(a, b).collect()} == pytest.approx(plain_cider(said, refs), abs=1e-9)


def test_shift(spark):
    row = captions.shifted(spark.createDataFrame([(1, [1, 7, 2, 0])], "id long, ids array<long>")).first()
    assert (row.given, row.target) == ([1, 7, 2], [7, 2, 0])


def test_common_length_of_long_texts_is_by_bits():
    import time

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0] * (len(b) + 1)
            for k, y in enumerate(b):
                row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
        return row[-1]

    rng = random.Random(6)
    for size in (0, 1, 5, 70, 200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, size))] for _ in range(2))
        assert captions.common_length(a, b) == plain(a, b)
    a, b = ([rng.choice("abcdefgh") for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    assert captions.common_length(a, a) == 20_000 and captions.common_length(a, b) > 10_000
    assert time.perf_counter() - began < 2


def test_neighbours_pass_over_chunks(spark):
    rows = [(k * 3, "ab"[k % 5 == 0], f"t{k}") for k in range(60)] + [(1000, "a", "last"), (5000, "c", "alone")]
    wanted = {}
    for i, lang, _ in rows:
        later = [t for _, t in sorted((j, t) for j, of, t in rows if of == lang and j > i)[:2]]
        wanted[i] = (*later, None, None)[:2]
    frame = spark.createDataFrame(rows, "id long, lang string, text string")
    for chars in (1, 40, 10**6):
        assert {r.id: (r.next1, r.next2) for r in captions.neighbours(frame, "lang", 2, chars).collect()} == wanted


@pytest.mark.parametrize("name", ["bleu_several", "cider_like", "cider_several"])
def test_no_gram_is_a_row(spark, folder, name):
    plan = registry.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "gram" not in plan


def test_rows_are_held_in_slices(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    words = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(50)]
    said, meant = pa.array(words, pa.list_(pa.string())), pa.array([[x, y] for x, y in zip(words[1:] + [[]], words[::-1], strict=True)], pa.list_(pa.list_(pa.string())))
    whole = {}
    for n, g in captions.counted_grams(said, meant):
        whole[n] = sorted(map(tuple, [[r, *k] for r, k in zip(g.row.tolist(), g.counts.tolist(), strict=True)]))
        plain = [(i, *[_grams(x, n)[gram] for x in (a, *b)]) for i, (a, b) in enumerate(zip(words, meant.to_pylist(), strict=True)) for gram in set().union(*[_grams(x, n) for x in (a, *b)])]
        assert whole[n] == sorted(plain)
    monkeypatch.setattr(captions, "TOKENS", 40)
    parts = list(captions._slices(said, meant))
    assert len(parts) > 10 and [i for i, _ in parts] == [0, *[j for _, j in parts[:-1]]] and parts[-1][1] == 50
    assert all(sum(len(said[k]) + sum(len(x) for x in meant[k]) for k in range(i, j)) <= 40 for i, j in parts if j - i > 1)


def test_pairs_are_counted_before_they_are_sent(spark, folder, monkeypatch):
    rows = [(1, "A b a B a b"), (2, "a b"), (2, "a b c"), (None, "a b"), (3, None), (4, "one"), (5, "")]
    frame = spark.createDataFrame(rows, "id long, text string")
    assert {(r.gram, r.n, r.df) for r in captions.pair_counts(frame).collect()} == {("a b", 6, 2), ("b a", 2, 1), ("b c", 1, 1)}
    assert captions.pair_counts(frame.where("false")).collect() == []
    plan = registry.queries()["ngram_counts"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "doc_id" not in plan.split("MapInArrow")[0]


ODD = [None, "", " \t\r\n", "a", "\x0bb a\x0cB  a\n", "a\x1cb a\u00a0b \u2003a", "\u0130 \u00c9\u00df a b", "b a b a b a"]


@pytest.mark.parametrize("chars", [1, 60, 1 << 20])
def test_texts_in_a_row_are_weighed_as_sets(spark, monkeypatch, chars):
    """One chunk or many, texts lent by broadcast or by a join, odd white space, groups of one or two, ids far apart and none."""
    monkeypatch.setattr(captions, "WEIGHED_LEAST", chars)
    monkeypatch.setattr(captions, "WEIGHED_MOST", chars)
    if chars == 60:
        monkeypatch.setattr(captions, "LENT", 0)
    rng = random.Random(8)
    rows = [(k * 2 + (k > 50) * 10**6, "ab"[k % 5 == 0], " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for k in range(70)]
    rows += [(500 + 3 * k, "c", t) for k, t in enumerate(ODD)] + [(900, "d", "a b"), (901, "e", "a"), (905, "e", "a b c"), (None, "a", "none"), (7, None, "none")]
    frame = spark.createDataFrame(rows, "id long, lang string, text string")
    words = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w]
    in_order = sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0])
    refs = {i: found for i, of, _ in in_order if (found := [words(t) for j, lang, t in in_order if lang == of and j > i][:2])}
    said = {i: words(t) for i, _, t in in_order if i in refs}
    assert len(refs) == 70 - 2 + len(ODD) - 1 + 1
    assert {r.id: r.score for r in captions.consensus_along(frame, "lang", 2).collect()} == pytest.approx(plain_cider(said, refs), abs=1e-9)
    pairs = spark.createDataFrame([(i, " ".join(said[i]), " ".join(refs[i][0])) for i in refs], "id long, reference string, hypothesis string")
    wanted = {r.id: r.score for r in captions.consensus(pairs).collect()}
    assert {r.id: r.score for r in captions.consensus_along(frame, "lang", 1, backward=True).collect()} == pytest.approx(wanted, abs=1e-9)
    assert captions.consensus_along(frame.where("false"), "lang", 2).collect() == []


@pytest.mark.parametrize("name", ["cider_like", "cider_several"])
def test_a_text_is_sent_and_counted_once(spark, folder, name):
    """Not as the words of each set that it is in, and not with each language as a chunk of its own."""
    plan = registry.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "next1" not in plan and "concat_ws" not in plan


def test_runs_do_not_hang_on_the_order_of_texts():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    texts = [[rng.choice(["a", "b", "c", "\u00e9", "long" * 70_000]) for _ in range(rng.randint(0, 8))] for _ in range(60)]
    flat = lambda xs: (pa.array([w for t in xs for w in t], pa.string()), np.array([len(t) for t in xs]))
    there, back = list(captions.runs_of(*flat(texts))), list(captions.runs_of(*flat(texts[::-1])))
    for n, (one, other) in enumerate(zip(there, back, strict=True), 1):
        assert one.n == n and one.digests.tolist() == other.digests.tolist() and len(set(one.digests.tolist())) == len(one.digests)
        plain = [_grams(t, n) for t in texts]
        assert len(one.digests) == len(set().union(*plain))
        assert sorted(zip(one.text.tolist(), one.count.tolist(), strict=True)) == sorted((i, k) for i, p in enumerate(plain) for k in p.values())
        keys = list(zip(one.gram.tolist(), one.text.tolist(), strict=True))
        assert keys == sorted(set(keys)) and sorted(keys) == sorted((g, len(texts) - 1 - t) for g, t in zip(other.gram.tolist(), other.text.tolist(), strict=True))
    assert list(captions.runs_of(*flat([[], []])))[3].digests.tolist() == []
    sliced = flat([["x", *t] for t in texts])[0].slice(1)
    assert captions._hashes(sliced).tolist() == [captions._hashes(pa.array([w.as_py()])).tolist()[0] for w in sliced]


def test_equal_numbers_come_together():
    import numpy as np

    near = np.array([9 << 40 | 1, 9 << 40, 5, 9 << 40 | 1, 9 << 40, 3 << 50, 5], np.uint64)
    for x in (near, near[:1], near[:0], np.random.default_rng(1).integers(0, 40, 500).astype(np.uint64) << np.uint64(50)):
        at, fresh = captions._alike(x)
        assert at.tolist() == np.argsort(x, kind="stable").tolist() and fresh.sum() == len(set(x.tolist()))
    at = np.array([1, 4, 6, 7])
    for key in (np.array([5, 2, 5, 2]), np.array([5, 2, 5, 2]) << 59):
        assert [x.tolist() for x in captions._by_key(key, at)] == [[4, 7, 1, 6], [True, False, True, False]]


def test_ranges_follow_where_ids_lie(spark):
    """Ids in heaps far apart, as of copies with shifted keys: no range has much more than its share."""
    frame = spark.range(4000).selectExpr("id + floor(id / 1000) * 1000000000 AS id", "'a' AS lang", "'ten letters' AS text")
    sizes = [r["count"] for r in captions.neighbours(frame, "lang", 1, 1100).groupBy("chunk").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 200 and len(sizes) >= 25
