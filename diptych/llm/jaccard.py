"""N-gram Jaccard join: documents whose sets of word shingles are alike, by token-combination prefixes.

A token is a shingle, a 64-bit hash of ``width`` words.  Tokens have one order everywhere: rarest first, by the class of
their document frequency, then by hash.  Two sets of Jaccard t or more share o tokens at least, o = ceil(t * size), so
each lacks at most e = size - o of them, and the first shared one is among the first e + 1 tokens of both.

* Rare tokens (in up to ``frequent`` documents) of that prefix are signatures by themselves.
* If the first shared token is frequent, so are all shared ones.  Only a set whose prefix reaches its frequent tokens can
  be in such a pair.  Its prefix over them is extended until neighbours must survive: of s shared tokens the e of either
  side can part fewer than s - 1 neighbours, so some two tokens that stand next to each other in one set do in the other.
  These 2-token combinations are its signatures.
* A token of one document alone can't be shared; a set whose prefix has no other is done.

Equal sets are one class from the start.  What is asked is which classes are connected, not every pair, so classes that share
a signature are compared in two steps, exactly:

1. Each class is compared with the first class of a few of its signatures, the first by a hash, so that near copies choose
   the same ones; links that hold join classes into components.
2. Of all signatures, those that still have classes of more than one component form cells (classes that they reach).  Where a cell has
   fewer pairs than its signatures together, it is compared as a whole, so that copies with many common signatures are not
   compared for each; else each signature is by itself, so that chains of rare ones cost no more than their own pairs.  All
   pairs across components are compared, in blocks of ``block`` classes, each pair of blocks a task's work; shared tokens are
   counted through an inverted index.

Texts are read again only for the sets of classes that have a signature, once.  Hashes are keyed anew in each run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .components import components, looked_up, paired
from .frames import checkpointed
from .words import SPACED, Words, mix, new_key, slices, text_bytes, words_of

#: Document frequency from which a token is signed in combination; classes of a signature that a task compares with as many.
FREQUENT, BLOCK = 1024, 256
#: Signatures of a class, the first by a hash, by which it is compared with hubs; all others are looked at after that.
FIRST = 4
_ODD = np.uint64(0x9FB21C651E98DF25)


def _tokens(words: Words, width: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes; with fewer words the whole sequence is one, without words none."""
    hashes, _ = words.windows(width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(hashes[a : b - width + 1]))
        elif n:
            mixed = np.uint64(n)
            for h in words.hashes[a:b]:
                mixed = mix(np.array([mixed * _ODD + h], np.uint64))[0]
            out.append(np.array([mixed], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(table: pa.Table, width: int, key: int):
    """Row and token set of each text of the table, lower-cased."""
    for i, _, data, offsets in slices(table.column("text")):
        with np.errstate(over="ignore"):
            for k, tokens in enumerate(_tokens(words_of(data, offsets, SPACED, lower=True, key=key), width)):
                yield i + k, tokens


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int, frequent_class: int) -> np.ndarray:
    """The signatures of a set, given its tokens and their classes (0: of this document alone)."""
    n = len(tokens)
    e = n - -(-percent * n // 100)
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    prefix = slice(0, e + 1)
    rare = tokens[prefix][(classes[prefix] > 0) & (classes[prefix] < frequent_class)]
    often = tokens[classes >= frequent_class]
    if n - len(often) > e:
        return rare
    if len(often) == 1 or n == 1:
        return np.r_[rare, mix(often * _ODD)]
    # A partner has n * 100 / percent tokens at most and so lacks at most `other` of them.
    largest = n * 100 // percent
    other = largest * (100 - percent) // 100
    extended = often[: 2 * e + other + 2]
    return np.r_[rare, mix(extended[:-1] * _ODD + extended[1:])]


def _merge(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(keys: np.ndarray, sets: list[np.ndarray], percent: int, apart: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * shared >= percent * together that ``apart`` tells apart.

    With ``left`` (which sets are of the first of two blocks), only pairs across the blocks count.
    """
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(inverse, kind="stable")
    postings, starts = owner[order], np.searchsorted(inverse[order], np.arange(len(values) + 1))
    firsts = np.r_[0, np.cumsum(sizes)]
    parent, out = {i: i for i in range(len(sets))}, []
    for i in range(len(sets)):
        asked = apart != apart[i]
        asked[: i + 1] = False
        if left is not None:
            asked &= left != left[i]
        if not asked.any():
            continue
        mine = inverse[firsts[i] : firsts[i + 1]]
        mine = mine[starts[mine + 1] - starts[mine] > 1]
        if not len(mine):
            continue
        lengths = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(postings[at], minlength=len(sets))
        for j in np.flatnonzero(asked & (100 * shared >= percent * (sizes + sizes[i] - shared))).tolist():
            a, b = _merge(parent, i), _merge(parent, j)
            if a != b:
                parent[a] = b
                out.append((int(keys[i]), int(keys[j])))
    return out


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def similar(documents: DataFrame, percent: int = 90, width: int = 3, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of the documents.

    Two documents link when 100 * (shared shingles) >= percent * (shingles of either).  A-Z are lowered; words are runs of
    characters other than space and U+0009..U+000D.  With fewer than ``width`` words the sequence is one shingle; an empty
    or null text has none and is linked with nothing.  Repeated rows, and rows of one doc_id with different texts, each
    get a row; a null doc_id is never a component's name unless the row stands alone.  Other columns are not read.
    """
    n = X.sizes(documents.select("text"), 0.75)
    return _grouped(X.chunked(documents.select("doc_id", "text"), n), n, percent, width, frequent, block).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, percent: int = 80, width: int = 5, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """The documents without those that are not the first of their component; their columns as they were.

    The first has the smallest doc_id, null last; of rows with one doc_id (or none) the first by a hash of the text, and of
    equal rows any one.  Documents without words all stay.
    """
    names, schema = documents.columns, documents.schema
    n = X.sizes(documents.select("text"), 0.75)
    chunks = X.chunked(documents, n)
    rows = _grouped(chunks, n, percent, width, frequent, block).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    winners = rows.groupBy("component").agg(F.min(place).alias("first"))
    # Only components of several rows have losers; a row alone is its own winner.
    losers = rows.join(winners, "component").where(place != F.col("first")).select("doc_id", "digest", "chunk").distinct()

    def keep(table: pa.Table, gone: pa.Table) -> pa.Table:
        dropped = set(zip(gone.column("doc_id").to_pylist(), gone.column("digest").to_pylist(), strict=True))
        data, offsets = text_bytes(table.column("text"))
        kept, seen = [], set()
        for row, doc in enumerate(table.column("doc_id").to_pylist()):
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            key = (doc, _digest(text))
            if key not in dropped and key not in seen:
                kept.append(row)
                if SPACED[data[offsets[row] : offsets[row + 1]]].any():
                    seen.add(key)
        return table.select(names).take(X.places(kept))

    return X.answered(chunks, losers, keep, schema)


def _grouped(chunks: DataFrame, n: X.Sizes, percent: int, width: int, frequent: int, block: int) -> DataFrame:
    """doc_id, chunk, digest (of the text), n_shingles, component_id and component (unique, other than component_id) of each row."""
    if not 75 <= percent <= 100:
        raise ValueError("signatures are complete for a similarity of 75 to 100 per cent")
    frequent_class, key = int(np.log2(frequent)), new_key()

    def send(table: pa.Table) -> pa.Table:
        every = np.sort(X.short(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in _sets(table, width, key))]), n))
        starts, ends = X.runs(every)
        every, counts = every[starts], np.minimum(ends - starts, 255).astype(np.uint8)
        buckets, chunk = every >> np.uint64(32), table.column(X.CHUNK)[0].as_py()
        rows = [(int(buckets[a]), chunk, X.pack(every[a:b].astype(np.uint32)), X.pack(counts[a:b])) for a, b in zip(*X.runs(buckets), strict=True)]
        return _table(rows, bucket=pa.int32(), chunk=pa.int32(), tokens=pa.binary(), counts=pa.binary())

    def count(table: pa.Table) -> pa.Table:
        tokens, counts = X.unpack(table.column("tokens"), np.uint32), X.unpack(table.column("counts"), np.uint8)
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        starts, _ = X.runs(every[order])
        sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), starts)
        shared, classes = every[order][starts][sums > 1], np.log2(sums[sums > 1]).astype(np.uint8)
        rows = []
        for i, t in enumerate(tokens):
            if (told := X.is_in(t, shared)).any():
                rows.append((i, X.pack(t[told]), X.pack(classes[np.searchsorted(shared, t[told])])))
        out = _table(rows, at=pa.int32(), tokens=pa.binary(), classes=pa.binary())
        return pa.table({"chunk": table.column("chunk").take(out["at"]), "bucket": table.column("bucket").take(out["at"]), "tokens": out["tokens"], "classes": out["classes"]})

    def sign(table: pa.Table, told: pa.Table) -> pa.Table:
        buckets = told.column("bucket").to_pylist()
        tokens = [t.astype(np.uint64) | np.uint64(b << 32) for t, b in zip(X.unpack(told.column("tokens"), np.uint32), buckets, strict=True)]
        tokens, classes = np.concatenate([np.zeros(0, np.uint64), *tokens]), np.concatenate([np.zeros(0, np.uint8), *X.unpack(told.column("classes"), np.uint8)])
        order = np.argsort(tokens)
        tokens, classes = tokens[order], classes[order]
        ids, rows = table.column("doc_id").cast(pa.int64()).to_pylist(), []
        chunk = table.column(X.CHUNK)[0].as_py() if table.num_rows else None
        data, offsets = text_bytes(table.column("text"))
        with np.errstate(over="ignore"):
            for row, mine in _sets(table, width, key):
                kind = np.zeros(len(mine), np.uint8)
                if len(mine):
                    small = X.short(mine, n)
                    known = X.is_in(small, tokens)
                    kind[known] = classes[np.searchsorted(tokens, small[known])]
                signed = signatures(mine, kind, percent, frequent_class) if kind.any() else mine[:0]
                both = _names(mine) if len(mine) else (0, 0)
                rows.append((ids[row], chunk, _digest(data[offsets[row] : offsets[row + 1]].tobytes()), len(mine), *both, signed.view(np.int64).tolist()))
        return _table(rows, doc_id=pa.int64(), chunk=pa.int32(), digest=pa.int64(), n_shingles=pa.int64(), set_a=pa.int64(), set_b=pa.int64(), signed=pa.list_(pa.int64()))

    classes = X.per_bucket(X.per_chunk(chunks, send, "bucket int, chunk int, tokens binary, counts binary"), count, "chunk int, bucket int, tokens binary, classes binary")
    rows = checkpointed(X.answered(chunks, classes, sign, "doc_id long, chunk int, digest long, n_shingles long, set_a long, set_b long, signed array<long>"))

    # One class for equal sets, with a number of its own: ids may repeat or be null.
    same = ["n_shingles", "set_a", "set_b"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk")).alias("first")
    equal = rows.where("n_shingles > 0").groupBy(same).agg(first, F.first("signed").alias("signed"), F.count(F.lit(1)).alias("size"))
    equal = checkpointed(equal.select(*same, "first.doc_id", "first.chunk", "signed", "size", F.monotonically_increasing_id().alias("class")))
    n_rows, n_signed = (x or 0 for x in equal.agg(F.sum("size"), F.sum(F.size("signed"))).first())

    # A hub and the classes that share one of their first signatures with it, in parts of a block; a class goes to several hubs.
    first = F.slice(F.array_sort(F.transform(F.array_distinct("signed"), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, FIRST)
    leading = equal.where(F.size("signed") > 0).select("class", F.explode(first).alias("s")).select("class", F.col("s.x").alias("signature"))
    heads = leading.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("hub")).where("n > 1")
    pairs = checkpointed(looked_up(leading, heads, "signature", "n", n_signed).where("class <> hub").select("class", "hub").distinct())
    hubs = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    parts = F.ceil(F.col("members") / block).cast("int")
    sent = looked_up(pairs, hubs, "hub", "members", pairs.count()).select("class", "hub", F.pmod(F.xxhash64("class"), parts).cast("int").alias("part"))
    sent = sent.unionByName(hubs.select(F.col("hub").alias("class"), "hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")))
    to = sent.groupBy("class").agg(F.collect_list(F.struct("hub", "part")).alias("to"))
    wanted = equal.where(F.size("signed") > 0).select("class", "doc_id", "chunk", *same).join(to, "class", "left")

    # The classes' sets, each from a row that has it.
    def fetch(table: pa.Table, wanted: pa.Table) -> pa.Table:
        asked = {(d, *k): i for i, (d, *k) in enumerate(zip(*(wanted.column(x).to_pylist() for x in ("doc_id", *same)), strict=True))}
        docs = {k[0] for k in asked}
        part, found = table.take(X.places([i for i, x in enumerate(table.column("doc_id").to_pylist()) if x in docs])), {}
        ids = part.column("doc_id").to_pylist()
        with np.errstate(over="ignore"):
            for k, tokens in _sets(part, width, key) if len(ids) else ():
                name = (ids[k], len(tokens), *_names(tokens))
                if name in asked:
                    found[asked[name]] = X.pack(tokens)
        taken = wanted.select(["class", "to"]).take(X.places(list(found)))
        return pa.table({"class": taken["class"], "tokens": pa.array(list(found.values()), pa.binary()), "to": taken["to"]})

    fetched = T.StructType([T.StructField("class", T.LongType()), T.StructField("tokens", T.BinaryType()), wanted.schema["to"]])
    sets = checkpointed(X.answered(chunks, wanted, fetch, fetched))

    def with_hub(table: pa.Table) -> pa.Table:
        names, hubs, part = (table.column(c).to_numpy() for c in ("class", "hub", "part"))
        sets, out = X.unpack(table.column("tokens"), np.uint64), []
        order = np.lexsort((names != hubs, part, hubs))
        changes = np.flatnonzero(np.r_[True, (np.diff(hubs[order]) != 0) | (np.diff(part[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(changes, np.r_[changes[1:], len(order)], strict=True):
            hub, others = sets[order[a]], order[a + 1 : b]
            if not len(others):
                continue
            sizes = np.array([len(sets[k]) for k in others])
            inside = X.is_in(np.concatenate([sets[k] for k in others]), hub)
            shared = np.add.reduceat(inside.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            alike = names[others[100 * shared >= percent * (len(hub) + sizes - shared)]]
            out += [(x, int(names[order[a]])) for x in alike.tolist()]
        return _table(out, a=pa.int64(), b=pa.int64())

    units = sets.select("class", "tokens", F.explode("to").alias("to")).select("class", "tokens", "to.hub", "to.part")
    units = units.withColumn("unit", F.pmod(F.xxhash64("hub", "part"), F.lit(4 * n.buckets)))
    known = checkpointed(components(units.repartition(n.buckets, "unit").groupBy("unit").applyInArrow(with_hub, "a long, b long")))

    # Signatures that are still of several components, with all their classes; of those with the same classes, one.
    top = known.select(F.col("node").alias("class"), "component")
    signed = equal.where(F.size("signed") > 0).join(top, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.explode(F.array_distinct("signed")).alias("signature"))
    code = F.xxhash64(F.lit(17), "class")
    same_classes = [F.min("class").alias("first"), F.count(F.lit(1)).alias("n"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 1).cast("decimal(38,0)")).alias("y")]
    open_ = signed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), *same_classes).where("low < high")
    open_ = open_.groupBy("n", "first", "x", "y").agg(F.min("signature").alias("signature")).select("signature", "first", "n")
    tied = checkpointed(looked_up(signed, open_, "signature", "n", n_signed))
    of = equal.select(*same, "size", "doc_id", "class").join(top, "class", "left").withColumn("component", F.coalesce("component", "class"))
    if not tied.isEmpty():
        last = components(_across(tied, sets, top, n, percent, block))
        of = of.join(last.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left").withColumn("component", F.coalesce("last", "component")).drop("last")
    named = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = checkpointed(of.drop("doc_id", "class").join(named, "component"))
    out = rows.select("doc_id", "chunk", "digest", *same)
    found = looked_up(out.where("n_shingles > 0"), of, same, "size", n_rows)
    empty = out.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return found.drop("size", "set_a", "set_b").unionByName(empty.drop("set_a", "set_b"))


def _across(tied: DataFrame, sets: DataFrame, top: DataFrame, n: X.Sizes, percent: int, block: int) -> DataFrame:
    """Links between components (a, b), from all pairs of classes of different components that share a signature."""
    cells = checkpointed(components(tied.select(F.col("class").alias("a"), F.col("first").alias("b"))))
    cells = cells.withColumnRenamed("component", "cell")
    costs = tied.where("class = first").join(cells, F.col("first") == F.col("node")).groupBy("cell").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    sized = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).join(costs, "cell")
    sized = sized.withColumn("whole", F.col("members").cast("double") * F.col("members") <= F.col("apart")).drop("apart")
    placed = looked_up(cells, sized, "cell", "members", tied.count()).withColumnRenamed("node", "class")
    by_class = tied.select("class", "component").distinct().join(placed.where("whole"), "class")
    by_class = by_class.select("class", "component", F.xxhash64(F.lit(0), "cell").alias("group"), F.col("members").alias("n"))
    by_signature = tied.join(placed.where("not whole").select("class"), "class").select("class", "component", F.xxhash64(F.lit(1), "signature").alias("group"), "n")
    groups = by_class.unionByName(by_signature)

    def compare(table: pa.Table) -> pa.Table:
        names, group, place, apart = (table.column(c).to_numpy() for c in ("class", "group", "place", "component"))
        i, j, sets = table.column("i").to_numpy(), table.column("j").to_numpy(), X.unpack(table.column("tokens"), np.uint64)
        order, out = np.lexsort((names, j, i, group)), []
        changes = np.flatnonzero(np.r_[True, (np.diff(group[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])
        for a, b in zip(changes, np.r_[changes[1:], len(order)], strict=True):
            part = order[a:b]
            if len(part) > 1:
                p, q = i[part[0]], j[part[0]]
                out += linked(names[part], [sets[x] for x in part], percent, apart[part], place[part] == p if p != q else None)
        return _table(out, a=pa.int64(), b=pa.int64())

    units = paired(groups, "group", "class", "n", block, 4 * n.buckets).join(sets.select("class", "tokens"), "class")
    more = units.repartition(n.buckets, "unit").groupBy("unit").applyInArrow(compare, "a long, b long")
    up = lambda c: F.coalesce(F.col(f"{c}.component"), F.col(f"more.{c}"))
    ends = more.alias("more").join(top.alias("a"), F.col("more.a") == F.col("a.class"), "left").join(top.alias("b"), F.col("more.b") == F.col("b.class"), "left")
    return ends.select(up("a").alias("a"), up("b").alias("b"))


def _names(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums by which sets are told apart, with their sizes."""
    return int(mix(tokens).sum().view(np.int64)), int(mix(tokens ^ _ODD).sum().view(np.int64))
