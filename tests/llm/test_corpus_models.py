"""Source divergence, clusters and the hidden Markov model against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from diptych.llm import clusters, divergence, hidden, vocabulary
from diptych.llm.queries import QUERIES

# --- perfect hashes


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_slots_are_minimal_and_verified(n):
    terms = pa.array([f"t{k}é" for k in range(n)], pa.large_string())
    shard = vocabulary.shard_of(terms, 3)
    slots = vocabulary.Slots([vocabulary.perfect(terms.take(pa.array(np.flatnonzero(shard == k)))) for k in range(3)])
    found = slots.find(shard, terms)
    assert sorted(found.tolist()) == list(range(n))
    assert slots.terms.take(pa.array(found)).equals(terms)
    assert all(slots.first[s] <= f < slots.first[s + 1] for s, f in zip(shard, found))
    others = pa.array([f"x{k}" for k in range(500)], pa.large_string())
    assert (slots.find(vocabulary.shard_of(others, 3), others) == -1).all()


def test_a_shard_hashed_anew(monkeypatch):
    """Keys that collide under one seed get another, which the search uses, too."""
    real = vocabulary.hashes
    monkeypatch.setattr(vocabulary, "hashes", lambda terms, seed: np.zeros(len(terms), np.uint64) if seed == 0 else real(terms, seed))
    terms = pa.array(["a", "b", "c"], pa.large_string())
    made = vocabulary.perfect(terms)
    assert made.seed == 1
    slots = vocabulary.Slots([made])
    assert sorted(slots.find(np.zeros(3, np.int64), terms).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError, match="distinct"):
        vocabulary.perfect(pa.array(["a", "a"], pa.large_string()))


def test_shares_need_no_wide_products():
    counts = np.array([0, 1, 5, 10**12, 10**15 - 1])
    for whole in (1, 7, 10**9, 10**12 + 3, 10**15):
        fit = counts[counts < whole]
        assert divergence.scaled(fit, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in fit.tolist()]


# --- divergence


def plain_divergence(rows, least=3, ranks=200):
    """rows: lang, source, text."""
    words = [((lang or ""), (source or ""), [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")]) for lang, source, text in rows]
    seen = Counter((lang, w) for lang, _, ws in words for w in set(ws))
    kept = {}
    for (lang, w), n in seen.items():
        if n >= least:
            kept.setdefault(lang, []).append(w)
    counts = {}
    for lang, source, ws in words:
        counts.setdefault((lang, source), Counter()).update(w for w in ws if w in set(kept.get(lang, ())))
    share = lambda c, w, v: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v)
    out = []
    for (lang, source), mine in counts.items():
        terms = kept.get(lang, [])
        whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())
        f = lambda a, b, w: (share(a, w, len(terms)) - share(b, w, len(terms))) ** 2 // share(b, w, len(terms))
        pairs = [(-sum(f(mine, c, w) for w in terms), s) for (x, s), c in counts.items() if x == lang and s != source]
        tops = [(-f(mine, whole, w), w) for w in terms if mine[w] and share(mine, w, len(terms)) > share(whole, w, len(terms))]
        for part, items, most in (("pair", pairs, None), ("term", tops, ranks)):
            order = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, -v, k) for k, (v, item) in enumerate(order, 1)]
    return sorted(out)


def some_rows(n=80, seed=3):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzÉ"]
    rows = [(draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s3", None]), " ".join(draw.choices(words, k=draw.randint(0, 30)))) for _ in range(n)]
    return rows + [("xx", "a", "only here"), ("xx", "b", None), ("xx", None, "1 2 3"), ("yy", "alone", "q q q"), ("en", "s4", None), ("", "", "Ab ab AB"), *[("en", "s1", "same same words")] * 4]


AUDIT = "lang string, source string, text string"


def test_divergence(spark, monkeypatch):
    rows = some_rows()
    frame = spark.createDataFrame(rows, AUDIT).repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(frame).collect()) == plain_divergence(rows)
    # Many shards, blocks, ranges and flushes.
    for name, value in (("SHARD_TERMS", 3), ("BLOCK_TERMS", 7), ("MOST_CELLS", 5), ("RANGE_CELLS", 6)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(tuple(r) for r in divergence.audit(frame, ranks=4).collect()) == plain_divergence(rows, ranks=4)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], AUDIT)).collect() == []
    found = divergence.audit(spark.createDataFrame([(None, None, None, "v", 1), ("", "x", "", "v", 1)], AUDIT + ", value string, shard int"))
    assert sorted(tuple(r) for r in found.collect()) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


# --- clusters


def plain_clusters(rows, k=40, rounds=5, width=64):
    kept = [(i, [math.floor(float(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    of = Counter()
    for _, j, d in found:
        of[j] += d
    key = lambda r: (r[0] is None, r)
    return sorted(((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found), key=key)


def test_clusters(spark):
    draw = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(draw.normal(0, 0.3, (150, 64)).round(2))]
    # Ties: copies, and vectors on a coarse grid; and those that are left out.
    rows += [(200 + k, rows[7][1]) for k in range(30)] + [(300 + k, [float((k >> b) & 1) for b in range(6)] + [0.0] * 58) for k in range(64)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (400, None), (401, [1.0] * 63), (402, [None] + [1.0] * 63), (403, [math.nan] + [0.0] * 63), (404, [-math.inf] + [0.0] * 63), (405, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = sorted((tuple(r) for r in clusters.digest(*clusters.cluster(frame)).collect()), key=lambda r: (r[0] is None, r))
    assert found == plain_clusters(rows)


def test_few_clusters_and_none(spark):
    schema = "vec_id long, embedding array<float>, cluster string, distance string"
    rows = [(k, [float(k)] * 64, "c", "d") for k in range(3)]
    found = clusters.digest(*clusters.cluster(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in found) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert clusters.digest(*clusters.cluster(spark.createDataFrame([], schema))).collect() == []
    with pytest.raises(Exception, match="steps"):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 64, "c", "d")], schema))


def test_pivots_spare_exact_distances():
    """Bounds rule out most centroids of vectors in groups, and none that is nearest."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-2000, 2000, (30, 64))
    vectors = np.concatenate([c + draw.integers(-20, 20, (50, 64)) for c in centres])
    fixed = clusters.pivots_among(centres, 8)
    now = clusters.Centroids(centres, clusters.distances(centres, fixed))
    cluster, least, computed = now.nearest(vectors, clusters.distances(vectors, fixed))
    every = ((vectors[:, None] - centres) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all()
    assert (least == every.min(1)).all()
    assert computed < 0.3 * every.size
    tied = clusters.Centroids(np.zeros((3, 64), np.int64), np.zeros((3, len(fixed))) + clusters.distances(np.zeros((1, 64), np.int64), fixed))
    assert (tied.nearest(vectors, clusters.distances(vectors, fixed))[0] == 0).all()


# --- the hidden Markov model


def tokens_of(text):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(6)
    sides = [[f"{s}{k}" for k in range(60)] for s in ("le", "der", "il")]
    rows = [(k, " ".join(draw.choices(sides[k % 3], k=draw.randint(1, 60)))) for k in range(300)]
    return rows + [(1000, None), (1001, ""), (1002, "Le1 LE1 le1"), (None, "unseen words only"), (1003, "never " * 3000), (1004, " \n"), (5, rows[5][1])]


@pytest.fixture(scope="module")
def scored(spark, corpus):
    frame = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    return hidden.score(frame.selectExpr("*", "'x' AS score", "'y' AS classes"), "crc32(cast(doc_id as string)) % 7 <> 2").collect()


def test_base_scores(corpus, scored):
    train = Counter(w for i, t in corpus if i is not None and not is_held_out(i) for w in tokens_of(t))
    total, distinct = sum(train.values()), len(train)
    wanted = sorted((str(i), len(ws := tokens_of(t)), sum(train[w] > 0 for w in ws), total, round(sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, t in corpus)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == wanted
    assert set(scored[0].asDict()) == {"doc_id", "classes", "n_tokens", "n_known", "train_tokens", "base_score", "score"}


def test_states_help_texts_not_seen(corpus, scored):
    held = [r for r in scored if is_held_out(r.doc_id) and r.n_tokens > 5 and r.doc_id < 1000]
    assert len(held) > 20
    better = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert better > 0.25, "three vocabularies of equal size: up to log10(3) a token"
    assert all(r.score <= 0 for r in scored)


def _model(classes=7, states=3, seed=1):
    draw = np.random.default_rng(seed)
    first, steps = draw.random(states), draw.random((states, states))
    return hidden.Model(first / first.sum(), steps / steps.sum(1, keepdims=True), draw.random((classes, states)) + 0.05)


def _packed(rows):
    return pa.array([np.array(r, np.uint16).tobytes() for r in rows], pa.binary())


def test_likelihood_is_the_sum_over_all_paths():
    model, draw = _model(), random.Random(2)
    rows = [[draw.randrange(7) for _ in range(draw.randint(1, 5))] for _ in range(20)]
    wanted = []
    for row in rows:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(row)):
            p = model.first[path[0]] * model.ratios[row[0], path[0]]
            for a, b, c in zip(path, path[1:], row[1:]):
                p *= model.steps[a, b] * model.ratios[c, b]
            total += p
        wanted.append(math.log10(total))
    assert np.allclose(hidden.gains(_packed(rows), model), wanted)


def test_counts_are_those_of_all_paths(monkeypatch):
    model, draw = _model(), random.Random(3)
    rows = [[draw.randrange(7) for _ in range(draw.randint(1, 5))] for _ in range(12)]
    first, steps, classes = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for row in rows:
        paths = {}
        for path in itertools.product(range(3), repeat=len(row)):
            p = model.first[path[0]] * model.ratios[row[0], path[0]]
            for a, b, c in zip(path, path[1:], row[1:]):
                p *= model.steps[a, b] * model.ratios[c, b]
            paths[path] = p
        for path, p in paths.items():
            p /= sum(paths.values())
            first[path[0]] += p
            for k, c in enumerate(row):
                classes[c, path[k]] += p
            for a, b in zip(path, path[1:]):
                steps[a, b] += p
    # As a whole, and in windows so short that every sequence spans several.
    for held, lanes in ((1 << 18, 1024), (4, 3)):
        monkeypatch.setattr(hidden, "_HELD", held)
        monkeypatch.setattr(hidden, "_LANES", lanes)
        found = hidden.Expected.none(7, 3)
        found.add(_packed(rows), model)
        assert np.allclose(found.first, first)
        assert np.allclose(found.steps * model.steps, steps)
        assert np.allclose(found.classes, classes)
        assert np.isclose(found.gain, hidden.gains(_packed(rows), model).sum() * math.log(10))


def test_rounds_raise_the_likelihood_and_shares_sum_to_one():
    draw = random.Random(4)
    rows = [[draw.randrange(3) + 3 * (k % 2) for _ in range(30)] for k in range(40)]
    sizes = np.array([9.0, 5, 4, 3, 2, 2, 1])
    model, gains = hidden.started(7, 2), []
    for _ in range(12):
        found = hidden.Expected.none(7, 2)
        found.add(_packed(rows), model)
        gains.append(found.gain)
        found.steps *= model.steps
        model = hidden.learned(found, sizes, sizes.sum())
    assert all(b > a - 1.0 for a, b in zip(gains[1:], gains[2:]))
    assert gains[-1] > gains[1]
    assert np.allclose((model.ratios * sizes[:, None] / sizes.sum()).sum(0), 1)
    assert np.allclose(model.steps.sum(1), 1)


@pytest.mark.parametrize("least, parts", [(20, 12), (65, 4), (500, 1)])
def test_first_rounds_take_every_document(spark, corpus, monkeypatch, least, parts):
    """Each training document, however long, is in one part; the parts are the whole, and the last rounds take it at once."""
    real, met = hidden.expected, []

    def watched(sequences, model):
        met.append(real(sequences, model))
        return met[-1]

    monkeypatch.setattr(hidden, "expected", watched)
    monkeypatch.setattr(hidden, "PART_DOCUMENTS", least, raising=False)
    train = [t for i, t in corpus if i is not None and not is_held_out(i)]
    hidden.score(spark.createDataFrame(corpus, SCHEMA), "crc32(cast(doc_id as string)) % 7 <> 2", states=2)
    texts, tokens = [round(float(e.first.sum())) for e in met], [float(e.classes.sum()) for e in met]
    assert len(met) == hidden.PART_ROUNDS + hidden.ROUNDS and texts[-hidden.ROUNDS :] == [len(train)] * hidden.ROUNDS
    for k in range(0, hidden.PART_ROUNDS, parts):
        assert sum(texts[k : k + parts]) == len(train)
        assert math.isclose(sum(tokens[k : k + parts]), sum(len(tokens_of(t)) for t in train), rel_tol=1e-4)


def test_no_training_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    found = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in hidden.score(frame, "false").collect())
    assert found == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert hidden.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_beats_counts_alone(spark, folder):
    """On the given documents, words of states that last fit held-out texts better than one distribution of words."""
    rows = [r for r in QUERIES["op13_hidden_markov"](spark, folder).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
