"""Line dedup by a segment-partition edit join: lines within an edit distance of an earlier line are dropped.

With threshold k, a line is cut into k + 1 segments; k edits leave one of them whole.  A line of length L indexes its
segments under (L, number of the segment, content); a line of length R probes, for each L from R - k to R, the substrings
that a whole segment can have moved to (shifts that k edits before it and after it allow).  Lengths and places are in
code points.  Pairs that meet are verified with a bit-parallel edit distance over a band of 2k + 1 diagonals.

First only the lower halves of the signatures' hashes meet, to tell which of them occur twice; lines without such a
signature, most of a corpus, go no further.  Equal lines become one class, so a line of all documents is one row from then
on.  Only classes that share a signature are compared, and a pair counts where its smallest shared signature is.

A signature of more than ``block`` lines (those made from one template share whole segments) is hot: its segment is cut out of
its lines, and as k edits must also make the rest of one of the rest of the other, the rests are cut into segments and meet
in turn.  So of lines that share a third of their text only those whose other parts meet, too, are compared.  Lines that
meet there as well are mostly near ones; they are dealt into blocks, each pair of blocks is a task's work, and numbers of
letters rule most others out.  A pair that shares hot signatures alone counts where its smallest shared path, a signature and
one of the rest, is.  What leaves a task is a count for each class, never a pair.

Lines too short for edits to mean anything take part by their whole hash alone: it meets as a signature does, and makes
them a class, but no cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .components import looked_up, paired
from .frames import checkpointed
from .words import keyed, mix, new_key, powers, slices

#: Edits between lines that count as one, code points from which edits are allowed, and from which equal lines are dropped.
EDITS, LEAST_CHARS, SHORTEST_CHARS = 2, 20, 1
#: Texts of a signature up to which all are compared with each other; beyond it their rests meet, in blocks of as many.
BLOCK = 256

ADDED = ("n_lines", "n_dropped", "n_near", "n_links")

_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
_K1, _K2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_BLANK = np.zeros(0x21, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Lines:
    """The lines of some texts: code points, and for each line that counts its text, number there, place and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, key: int = 0):
        raw = data[int(offsets[0]) : int(offsets[-1])]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets - offsets[0]]
        n = len(points)
        breaks = np.flatnonzero(points == 10)
        nonblank = np.flatnonzero(~((points < 0x21) & _BLANK[np.minimum(points, 0x20)]))
        # A line begins with a text and after each break; one after a text's last break is that text's, though the next begins there.
        begin = np.r_[place[:-1], breaks + 1]
        doc = np.r_[np.arange(len(place) - 1), np.searchsorted(place, breaks, "right") - 1]
        by_doc = np.lexsort((begin, doc))
        begin, doc = begin[by_doc], doc[by_doc]
        end = np.empty_like(begin)
        same = np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.zeros(0, bool)
        end[:-1] = begin[1:] - 1
        end[~same] = place[1:][doc[~same]]
        first = np.searchsorted(doc, np.arange(len(place) - 1))
        self.number_all = np.arange(len(doc)) - first[doc]
        self.doc_all, self.begin_all, self.end_all = doc, begin, end
        a, b = np.searchsorted(nonblank, begin), np.searchsorted(nonblank, end)
        padded = np.r_[nonblank, 0]
        start, stop = np.where(b > a, padded[np.minimum(a, len(nonblank))], begin), np.where(b > a, padded[np.maximum(b - 1, 0)] + 1, begin)
        self.used = np.flatnonzero(stop - start >= least)
        self.points, self.start, self.stop = points, start[self.used], stop[self.used]
        self.doc, self.number, self.length = doc[self.used], self.number_all[self.used], (stop - start)[self.used]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.hash = keyed(points.view(np.uint8), 4 * self.start, 4 * self.stop, key)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def text(self, k: int) -> str:
        return self.points[self.start[k] : self.stop[k]].tobytes().decode("utf-32-le")

    def segments(self, rows: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Of the lines in rows, a column for each substring that they probe: its signature (0 for none), place and size; and
        the columns of their own segments."""
        start, length = self.start[rows], self.length[rows]
        probes, places, sizes, own = [], [], [], []
        for less in range(edits + 1):
            of = length - less
            short, longer = of // (edits + 1), of % (edits + 1)
            for i in range(edits + 1):
                size = short + (i >= edits + 1 - longer)
                at = i * short + np.maximum(0, i - (edits + 1 - longer))
                tag = of.astype(np.uint64) * _K1 + np.uint64((i + 1) * int(_K2) & (1 << 64) - 1)
                for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                    place = at + shift
                    fits = (place >= 0) & (place + size <= length) & (of >= least)
                    place = np.where(fits, place, 0)
                    found = np.where(fits, mix(self.of(start + place, start + np.where(fits, place + size, 0)) ^ mix(tag)), np.uint64(0))
                    if not less and not shift:
                        own.append(len(probes))
                    probes.append(found)
                    places.append(place)
                    sizes.append(size)
        return (*(np.array(x).T.reshape(len(rows), len(probes)) for x in (probes, places, sizes)), own)

    def signatures(self, rows: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the lines in rows: their segments' signatures (a row each), and those that they probe (with 0 for none)."""
        length = self.length[rows]
        probes, _, _, at = self.segments(rows, edits, least)
        own = probes[:, at]
        # A line under ``least`` meets its equals only, by its hash in place of segments.
        under = length < least
        whole = mix(self.hash[rows[under]] ^ _K2)
        own[under], probes[under], probes[under, 0] = whole[:, None], 0, whole
        return own, probes


class Rests(Lines):
    """Texts as they are, each one line: what is left of lines when segments are cut out."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.stop = np.cumsum(self.length)
        self.start, self.hash = self.stop - self.length, np.zeros(len(texts), np.uint64)
        n = len(self.points)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)


def _rests(batch: pa.RecordBatch, edits: int, least: int, first: bool) -> pa.RecordBatch:
    """Rows (path, hash, own, rest): for segments of a text their paths, and the text without them.

    ``first``: the texts are whole lines, and only segments whose signature is the row's path are cut out, which keeps the
    path.  Else all are, and the path goes on with each one's signature.  A text that only probes owns no segment.
    """
    paths, own, texts = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
    part = Rests(texts)
    with np.errstate(over="ignore"):
        found, place, size, mine = part.segments(np.arange(len(texts)), edits, least)
        row, column = np.nonzero(found == paths[:, None] if first else found != 0)
        path = paths[row] if first else mix(paths[row] ^ mix(found[row, column]))
    is_own = own[row] & np.isin(column, mine)
    rests = [texts[r][:a] + texts[r][a + n :] for r, a, n in zip(row.tolist(), place[row, column].tolist(), size[row, column].tolist(), strict=True)]
    # Of equal rows of a text the one of its own is kept.
    once: dict[tuple, bool] = {}
    for r, p, o, rest in zip(row.tolist(), path.view(np.int64).tolist(), is_own.tolist(), rests, strict=True):
        once[r, p, rest] = once.get((r, p, rest), False) or o
    hashes = batch.column(1).to_pylist()
    columns = [pa.array([p for _, p, _ in once], pa.int64()), pa.array([hashes[r] for r, _, _ in once], pa.int64()), pa.array(list(once.values()), pa.bool_()), pa.array([t for _, _, t in once], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "hash", "own", "rest"])


def _lines(table: pa.Table, least: int, key: int):
    for i, j, data, offsets in slices(table.column("text")):
        yield i, j, data, offsets, Lines(data, offsets, least, key)


def _shared(a: str, b: str, most: int) -> int:
    """How many code points both begin with, ``most`` at most: a search by halves over slices."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions of code points make a of b.

    What both begin and end with is cut off.  Of the rest, a column of the edit matrix is kept as differences between
    neighbouring rows, a bit each for +1 and -1, within ``most`` rows of the diagonal; the band moves down a row a column.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    high = min(len(a), len(b))
    low = _shared(a, b, high)
    tail = _shared(a[::-1], b[::-1], high - low)
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    rows, columns = len(a), len(b)
    if not rows or not columns:
        return max(rows, columns) <= most
    width = 2 * most + 1
    mask = (1 << width) - 1
    up, down, score = (mask >> (most + 1)) << (most + 1), 0, 0
    for j in range(1, columns + 1):
        up, down = (up >> 1) | (1 << (width - 1)), down >> 1
        equal, c = 0, b[j - 1]
        for t in range(max(0, most + 1 - j), min(width, rows - j + most + 1)):
            if a[j - most + t - 1] == c:
                equal |= 1 << t
        kept = ((((equal & up) + up) ^ up) | equal | down) & mask
        plus, minus = (down | ~(kept | up)) & mask, kept & up
        score += not kept >> most & 1
        if score > most + columns - j and score > 2 * most:
            return False
        plus = (plus << 1 | 1) & mask
        up, down = ((minus << 1) | ~(kept | plus)) & mask, kept & plus
    for step in range(abs(rows - columns)):
        bit = most + (step + 1 if rows > columns else -step)
        delta = (up >> bit & 1) - (down >> bit & 1)
        score += delta if rows > columns else -delta
    return score <= most


class Meetings:
    """Lines with their signatures, to tell which pairs that meet are near, and at which signature they are counted."""

    def __init__(self, lines: list[str], edits: int, least: int):
        part = Rests(lines)
        self.own, self.probes = part.signatures(np.arange(len(lines)), edits, least)
        self.lines, self.edits, self.length = lines, edits, part.length
        # Numbers of code points by their last five bits: an edit changes two of them by one at most.
        self.bins = np.zeros((len(lines), 32), np.int32)
        np.add.at(self.bins, (np.repeat(np.arange(len(lines)), part.length), part.points % 32), 1)

    def shared(self, x: int, y: int) -> set[int]:
        """The signatures at which lines x and y meet."""
        one, two = (set(self.own[k].tolist()) & set(self.probes[other].tolist()) for k, other in ((x, y), (y, x)))
        return (one | two) - {0}

    def may_be_near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the other lines have lengths and numbers of code points that the edits can explain."""
        return (np.abs(self.length[others] - self.length[x]) <= self.edits) & (np.abs(self.bins[others] - self.bins[x]).sum(1) <= 2 * self.edits)

    def near(self, x: int, y: int) -> bool:
        return within(self.lines[x], self.lines[y], self.edits)


def _met(table: pa.Table, edits: int, least: int):
    """The rows of the near pairs of each group (group, i, j: a pair of blocks) that count there.

    A pair counts at the smallest signature that both share and that is not hot; with ``paths`` (of signatures of rests), if
    there is none, at the smallest path.  The smallest may be no path of theirs in truth, but both have it, so it is one place.
    """
    group, i, j, hashes = (table.column(c).to_pylist() for c in ("group", "i", "j", "hash"))
    place, own = table.column("place").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
    # Lines are the same in all rows of a hash.
    index: dict[int, int] = {}
    line_of = np.array([index.setdefault(h, len(index)) for h in hashes], np.int64)
    first = pa.array(np.unique(line_of, return_index=True)[1])
    one_each = {c: table.column(c).take(first).to_pylist() for c in table.column_names if c in ("line", "hot", "own_paths", "paths")}
    meetings = Meetings(one_each["line"], edits, least)
    hot = [{h & ((1 << 64) - 1) for h in x or ()} for x in one_each["hot"]]
    by_path = "paths" in one_each
    own_paths, paths = ([frozenset(x) for x in one_each[c]] if by_path else [] for c in ("own_paths", "paths"))
    groups: dict[tuple, list[int]] = {}
    for k, name in enumerate(zip(group, i, j, strict=True)):
        groups.setdefault(name, []).append(k)
    for (name, one, two), rows in groups.items():
        rows = np.array(rows)
        for x in rows[own[rows]].tolist():
            # Of two owners the pair is taken once; of two blocks only pairs across them.
            ys = rows[(line_of[rows] != line_of[x]) & ~(own[rows] & (rows < x)) & ((one == two) | (place[rows] != place[x]))]
            a = int(line_of[x])
            for y in ys[meetings.may_be_near(a, line_of[ys])].tolist():
                b = int(line_of[y])
                if by_path:
                    here = min(own_paths[a] & paths[b] | own_paths[b] & paths[a]) == name and not meetings.shared(a, b) - hot[a]
                else:
                    here = min(meetings.shared(a, b) - hot[a]) == name & ((1 << 64) - 1)
                if here and meetings.near(a, b):
                    yield x, y


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def dedup_lines(documents: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, block: int = BLOCK, shortest: int | None = None) -> DataFrame:
    """The documents with the lines dropped from their text, and n_lines, n_dropped, n_near and n_links.

    A line is a part of the text between line breaks, compared without space and U+0009..U+000D at its ends, if ``shortest``
    code points or more are left (None for ``least``); others stay.  One of fewer than ``least`` has no other text within
    ``edits``, so only equal ones are dropped.  Lines are ordered by doc_id and place.  An occurrence is dropped if an
    earlier one is equal, or if the first occurrence of its text comes after that of another text within ``edits`` of it
    (n_near counts these).  n_lines counts lines that are compared, n_links the other texts within ``edits`` of them.

    A null text stays null; an empty one has no lines; a null doc_id comes last, and rows of one doc_id are ordered by
    place alone, so that equal rows keep one copy of each line between them only if it is in one place of one row; input
    columns stay, but for those named as an added one.
    """
    documents = documents.select([f"`{c}`" for c in documents.columns if c.lower() not in ADDED])
    names, fields = documents.columns, documents.schema.fields
    shortest = least if shortest is None else min(shortest, least)
    n = X.sizes(documents.select("text"), 0.4)
    chunks, key = X.chunked(documents, n), new_key()

    def keys(table: pa.Table) -> np.ndarray:
        return table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()

    def send(table: pa.Table) -> pa.Table:
        seen, own, probes = [], [], []
        for _, _, _, _, lines in _lines(table, shortest, key):
            o, p = lines.signatures(np.arange(len(lines.hash)), edits, least)
            seen.append(lines.hash)
            own.append(X.short(o, n))
            probes.append(np.where(p == 0, np.uint64(_LAST), X.short(p, n)))
        seen, own, probes = np.concatenate(seen), np.concatenate(own), np.concatenate(probes)
        _, at, times = np.unique(seen, return_index=True, return_counts=True)
        again = np.unique(own[at[times > 1]])
        own, probes = np.unique(own[at]), np.sort(probes[at].ravel())
        probes = probes[: np.searchsorted(probes, np.uint64(_LAST))]
        starts, ends = X.runs(probes)
        more, every = np.union1d(probes[starts[ends - starts > 1]], again), probes[starts]
        chunk = table.column(X.CHUNK)[0].as_py()
        rows = [(b, chunk, *rest) for b, *rest in X.dealt(n, every, more, own)]
        return _table(rows, bucket=pa.int32(), chunk=pa.int32(), every=pa.binary(), more=pa.binary(), own=pa.binary())

    def meet(table: pa.Table) -> pa.Table:
        every = X.unpack(table.column("every"), np.uint32)
        ordered = np.sort(np.concatenate(every))
        twice = np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *X.unpack(table.column("more"), np.uint32)])
        live = np.intersect1d(twice, np.concatenate(X.unpack(table.column("own"), np.uint32)))
        found = [x[X.is_in(x, live)] for x in every]
        keep = [i for i, x in enumerate(found) if len(x)]
        return pa.table({"chunk": table.column("chunk").take(X.places(keep)), "bucket": table.column("bucket").take(X.places(keep)), "hits": pa.array([X.pack(found[i]) for i in keep], pa.binary())})

    def gather(table: pa.Table, hits: pa.Table) -> pa.Table:
        found = [x.astype(np.uint64) | np.uint64(b << 32) for x, b in zip(X.unpack(hits.column("hits"), np.uint32), hits.column("bucket").to_pylist(), strict=True)]
        live = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
        ids, first = keys(table), {}
        chunk = table.column(X.CHUNK)[0].as_py() if table.num_rows else 0
        for i, _, _, _, lines in _lines(table, shortest, key) if len(live) else ():
            _, p = lines.signatures(np.arange(len(lines.hash)), edits, least)
            met = ((p != 0) & X.is_in(X.short(p, n).ravel(), live).reshape(p.shape)).any(axis=1)
            for k in np.flatnonzero(met).tolist():
                place = (int(ids[i + lines.doc[k]]), int(lines.number[k]))
                h = int(lines.hash[k].view(np.int64))
                if h not in first:
                    first[h] = (*place, lines.text(k))
                elif place < first[h][:2]:
                    first[h] = (*place, first[h][2])
        return _table([(h, chunk, *v) for h, v in first.items()], hash=pa.int64(), chunk=pa.int32(), id=pa.int64(), number=pa.int64(), line=pa.string())

    met = X.per_bucket(X.per_chunk(chunks, send, "bucket int, chunk int, every binary, more binary, own binary"), meet, "chunk int, bucket int, hits binary")
    lines = checkpointed(X.answered(chunks, met, gather, "hash long, chunk int, id long, number long, line string"))
    texts = lines.groupBy("hash").agg(F.min(F.struct("id", "number")).alias("owner"), F.min("line").alias("line"))

    def sign(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, j, data, offsets in slices(batch.column(1)):
                part = Lines(data, offsets, least)
                own, probes = part.signatures(np.arange(len(part.doc)), edits, least)
                # A line probes its own segments, so one row says both; the first of equal ones is the one of its own.
                every = np.concatenate([own, probes], axis=1)
                at = np.flatnonzero(every.ravel() != 0)
                line, value, kind = at // every.shape[1], every.ravel()[at], at % every.shape[1] >= own.shape[1]
                order = np.lexsort((kind, value, line))
                line, value, kind = line[order], value[order], kind[order]
                first = np.r_[True, (line[1:] != line[:-1]) | (value[1:] != value[:-1])] if len(line) else np.zeros(0, bool)
                rows.append((batch.column(0).to_numpy()[i:j][part.doc][line[first]], value[first].view(np.int64), ~kind[first]))
            columns = [np.concatenate([r[k] for r in rows]) if rows else [] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["hash", "signature", "own"])

    signed = checkpointed(texts.select("hash", "line").mapInArrow(sign, "hash long, signature long, own boolean"))
    live = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("met")).where("size > 1 and met").drop("met")
    met = checkpointed(looked_up(signed, live, "signature", "size", signed.count()))
    hot = met.where(F.col("size") > block).groupBy("hash").agg(F.collect_set("signature").alias("hot"))
    known = texts.select("hash", "owner.id", "owner.number", "line").join(hot, "hash", "left")

    def cut_out(first: bool):
        def work(batches):
            for batch in batches:
                yield _rests(batch, edits, least if first else 0, first)

        return work

    # The lines of hot signatures meet again by their rests.
    shape = "path long, hash long, own boolean, rest string"
    rests = met.where(F.col("size") > block).join(texts.select("hash", "line"), "hash").select(F.col("signature").alias("path"), "hash", "own", "line").mapInArrow(cut_out(True), shape)
    rests = rests.mapInArrow(cut_out(False), shape).groupBy("path", "hash").agg(F.max("own").alias("own"))
    rests = checkpointed(rests)
    again = rests.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("met")).where("size > 1 and met").drop("met")
    again = checkpointed(looked_up(rests, again, "path", "size", rests.count()))
    paths = again.groupBy("hash").agg(F.collect_list(F.when(F.col("own"), F.col("path"))).alias("own_paths"), F.collect_list("path").alias("paths"))

    def late(table: pa.Table, x: int, y: int) -> int:
        ids, numbers = table.column("id"), table.column("number")
        return x if (ids[x].as_py(), numbers[x].as_py()) > (ids[y].as_py(), numbers[y].as_py()) else y

    def compare(table: pa.Table) -> pa.Table:
        hashes, out = table.column("hash").to_pylist(), {}
        for x, y in _met(table, edits, least):
            later = late(table, x, y)
            for k in (x, y):
                told = out.setdefault(hashes[k], [0, 0])
                told[0] += 1
                told[1] |= k == later
        return _table([(h, *v) for h, v in out.items()], hash=pa.int64(), links=pa.int64(), late=pa.int32())

    # Work goes with the square of a group, not with bytes, so the number of tasks is set here and not by bytes.
    def dealt(groups: DataFrame, lines: DataFrame) -> DataFrame:
        return paired(groups.join(lines, "hash"), "group", "hash", "size", block, 4 * n.buckets).repartition(n.buckets, "unit").groupBy("unit")

    shape = "hash long, links long, late int"
    ends = dealt(met.where(F.col("size") <= block).withColumnRenamed("signature", "group"), known).applyInArrow(compare, shape)
    ends = ends.unionByName(dealt(again.withColumnRenamed("path", "group"), known.join(paths, "hash")).applyInArrow(compare, shape))
    ends = ends.groupBy("hash").agg(F.max("late").alias("late"), F.sum("links").alias("links"))
    told = texts.select("hash", "owner.id", "owner.number").join(ends, "hash", "left")
    told = lines.select("hash", "chunk").join(told, "hash").select("chunk", "hash", "id", "number", F.coalesce("late", F.lit(0)).alias("late"), F.coalesce("links", F.lit(0)).alias("links"))

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("hash").to_numpy().view(np.uint64)) if told.num_rows else np.zeros(0, np.int64)
        known, owner, number, late, links = (told.column(c).to_numpy()[order] for c in ("hash", "id", "number", "late", "links"))
        known = known.view(np.uint64) if len(known) else np.zeros(0, np.uint64)
        ids, out = keys(table), []
        texts = table.column("text")
        for i, j, _, _, lines in _lines(table, shortest, key):
            at = np.minimum(np.searchsorted(known, lines.hash), max(0, len(known) - 1))
            is_known = known[at] == lines.hash if len(known) else np.zeros(len(lines.hash), bool)
            near, linked_to, gone = np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            if len(known):
                near = is_known & (late[at] > 0)
                gone = is_known & ~((ids[i:j][lines.doc] == owner[at]) & (lines.number == number[at]))
                linked_to = np.where(is_known, links[at], 0)
            gone |= near
            counts = [np.bincount(lines.doc, weights=w, minlength=j - i).astype(np.int64) for w in (np.ones(len(at)), gone, near, linked_to)]
            stays = np.ones(len(lines.doc_all), bool)
            stays[lines.used[gone]] = False
            firsts = np.searchsorted(lines.doc_all, np.arange(j - i + 1))
            for d in range(j - i):
                text = texts[i + d]
                if not counts[1][d]:
                    kept = text.as_py()
                else:
                    rows = [k for k in range(firsts[d], firsts[d + 1]) if stays[k]]
                    kept = "\n".join(lines.points[lines.begin_all[k] : lines.end_all[k]].tobytes().decode("utf-32-le") for k in rows)
                out.append((kept, *(int(c[d]) for c in counts)))
        made = _table(out, text=pa.string(), n_lines=pa.int64(), n_dropped=pa.int64(), n_near=pa.int64(), n_links=pa.int64())
        return pa.table({c: made["text"] if c == "text" else table.column(c) for c in names} | {c: made[c] for c in ADDED})

    schema = T.StructType([*(T.StructField("text", T.StringType()) if f.name == "text" else f for f in fields), *(T.StructField(c, T.LongType()) for c in ADDED)])
    return X.answered(chunks, told, cut, schema)


def digest(marked: DataFrame) -> DataFrame:
    return marked.select("doc_id", "n_lines", "n_dropped", "n_near", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


__all__ = ["ADDED", "EDITS", "LEAST_CHARS", "SHORTEST_CHARS", "Lines", "dedup_lines", "digest", "within"]
