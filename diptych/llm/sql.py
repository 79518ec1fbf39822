"""SQL, as DuckDB runs it, of the operators that SQL can express, for comparison on small tables."""

from __future__ import annotations

from .mixing import SCHEDULES
from .quality import STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))



def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _position(schedule: tuple[tuple[float, float], ...]) -> str:
    """The training time at which a schedule has asked for ``share`` of its tokens."""
    areas = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        areas.append(areas[-1] + (u - t) * (w + v) / 2)
    cases = []
    for k, ((t, w), (u, v)) in enumerate(zip(schedule, schedule[1:], strict=False)):
        rest = f"greatest(share * {_number(areas[-1])} - {_number(areas[k])}, {_number(0.0)})"
        root = f"({_number(w)} + sqrt(greatest({_number(w * w)} + {_number(2 * (v - w) / (u - t))} * {rest}, {_number(0.0)})))"
        cases.append(f"WHEN share * {_number(areas[-1])} <= {_number(areas[k + 1])} THEN {_number(t)} + CASE WHEN {root} > 0 THEN 2 * {rest} / {root} ELSE 0 END")
    return f"CASE {' '.join(cases)} ELSE {_number(schedule[-1][0])} END"


_POSITION = " ".join(f"WHEN weight = {w} THEN {_position(s)}" for w, s in SCHEDULES.items())

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '{_SPACED}')) AS BIGINT) AS size FROM documents),
o AS (SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS digest FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER) AS weight, CAST(3 AS DOUBLE) * source_size AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level FROM w WINDOW r AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, most / weight) AS level FROM f WHERE most > level * weight),
t AS (SELECT source, source_size, weight, CASE WHEN most <= f.level * weight THEN most ELSE least(most, (SELECT level FROM l) * weight) END AS target FROM f),
b AS (SELECT doc_id, size, source_size, target, weight, CAST(coalesce(sum(size) OVER (PARTITION BY o.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(round(target) AS BIGINT) AS goal FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(goal / source_size) AS BIGINT) ELSE 0 END AS turns, CASE WHEN target > 0 THEN before / target ELSE 0 END AS share FROM b),
k AS (SELECT *, CAST(turns * size + least(greatest(goal - turns * source_size - before, 0), size) AS BIGINT) AS taken FROM g)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE {_POSITION} ELSE share END END AS position, weight, before FROM k"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*k >= 90*(x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL
 SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role='assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role='assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(role) + len(regexp_extract_all(role, '<\\*n?\|')) + 2*(length(role) - length(replace(role, chr(10), ''))) + length(text) + len(regexp_extract_all(text, '<\\*n?\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-48, 1))) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS f FROM x GROUP BY 1),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM x JOIN f USING (h), (SELECT unnest(range(50)) AS k) WHERE doc_id > f),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w)+1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM p ANTI JOIN g USING (doc_id, p) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '{_SPACED}') AS w, list_filter(string_split(coalesce(text,''), chr(10)), lambda l: regexp_matches(l, '{_SPACED}')) AS lines FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3, 1))) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x), (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda v: lower(v) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
 CAST(length(t) - length(translate(t, '!?', '')) AS BIGINT) AS n_shouts FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100*n_repeat_words > 20*n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars/greatest(n_words,1) BETWEEN 2 AND 20 AND n_symbols/greatest(n_words,1) <= 0.3 AND n_shouts/greatest(n_words,1) <= 0.3 AND n_dup_lines/greatest(n_lines,1) <= 0.3 AND n_stop_words/greatest(n_words,1) >= 0.01 AS kept FROM b"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i+size-1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w)-least(10, len(w))+2, 1))) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, size, array_to_string(w[i:i+size-1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w)-size+2, 1))) AS i FROM d, (SELECT DISTINCT size FROM v))),
h AS (SELECT doc_id, i, x.size, item_id FROM x JOIN v USING (size, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i+size)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source, regexp_extract_all(translate(coalesce(text,''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM x) GROUP BY 1, 2 HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM x JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT)*(coalesce(c.c, 0)+1)) // (coalesce(n.n, 0)+v.v) AS HUGEINT) AS p
 FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang=g.lang AND n.source=g.source LEFT JOIN c ON c.lang=g.lang AND c.source=g.source AND c.term=k.term),
q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT)*(c+1)) // (sum(c) OVER (PARTITION BY lang) + v) AS HUGEINT) AS q FROM (SELECT lang, term, sum(c) AS c FROM p GROUP BY 1, 2) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p-b.p)*(a.p-b.p)//b.p) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY 1, 2, 3),
o AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM g JOIN g h ON g.lang=h.lang AND g.source<>h.source LEFT JOIN s ON s.lang=g.lang AND s.source=g.source AND s.item=h.source
 UNION ALL SELECT p.lang, source, 'term', p.term, (p-q)*(p-q)//q FROM p JOIN q ON p.lang=q.lang AND p.term=q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) WHERE part='pair' OR rank <= 200"""


def _clustering(rounds: int, centroids: int, components: int) -> str:
    """The rounds one after another: a{k} has each vector's cluster and distance, c{k} the centroids before round k."""
    out = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE)*256) AS BIGINT)) AS v FROM embeddings WHERE len(embedding)={components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))={components})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY cluster < {centroids})",
    ]
    for k in range(rounds + 1):
        out.append(f"e{k} AS MATERIALIZED (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, {components + 1}), lambda i: (v[i]-c[i])*(v[i]-c[i]))) AS BIGINT) AS distance FROM v, c{k})")
        out.append(f"a{k} AS MATERIALIZED (SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if k < rounds:
            out.append(f"m{k} AS (SELECT cluster, list(CAST(floor(s/n) AS BIGINT) ORDER BY i) AS c FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, {components + 1})) AS i) GROUP BY 1, 2) GROUP BY 1)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.cluster = c{k}.cluster)")
    last = f"SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"
    return f"WITH {', '.join(out)} {last}"


CLUSTERING = _clustering(5, 40, 64)
