"""Operator 3, n-gram Jaccard join by parity sketches.

A document is its set of distinct shingles of ``width`` words, as 64-bit hashes. Tokens are XOR-hashed into sketches: each
shingle flips one random word of K words by its hash, and one of 512 bits. Each differing word, and each differing bit, needs a
shingle that one set has and the other hasn't, so both Hamming distances are at most the symmetric difference, which at
similarity s is at most d = a + b - 2 ceil(s (a + b) / (1 + s)) for sizes a and b.

* Size bands: a band ends where the next size cannot reach the similarity with its first size, so partners lie in one band or
  in neighbours. For the pairs of band j (the smaller set) K exceeds the largest d, so by pigeonhole two partners have an
  equal word. Each document gives its words as smaller partner (own band) and as larger one (band before).
* Words that hold no shingle say nothing and aren't joined on. K has ``spare`` words more than d + 1, so partners can share only
  such words if both have more than ``spare``; a document with so many gives its words under the next hash function too, and so
  on. (After 32 functions, it gives one common key.)
* Keys that two sets share are found beside each other in one exchange. A key that many sets give (found beforehand in a sample
  of the texts) is dealt by key and set, and all its sets are taken to share it, so no task holds a large group.
* Candidates: of the documents with equal words, each is paired with the smallest one (a star); linked ones become a
  component. Then, in the groups that still hold several components, documents of different components are compared by size
  and bit sketches, block by block inside a task, and only those that may be linked come out: first each one's closest partner,
  after these are verified and joined its sixteen closest, at last all. Sketches have at least as many bits as a set has
  shingles (up to ``WIDEST``), so that sets without a link seldom pass. So no link between components is lost, and no group
  is expanded into all its pairs.
* Candidates are verified on the whole sets.

Documents with equal sets are one class from the start. Defined cases: a null or empty text, or one without words, has
the empty set and is linked with nothing; fewer than ``width`` words are one shingle; a null doc_id is passed over in
the smallest doc_id of a component (null if all are); repeated rows are documents of one class; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace, maybe_broadcast, numbered
from cloudloom.llm._graph import components

U = np.uint64
SKETCH_WORDS = 8  # of 64 bits
WIDEST = 1 << 15  # bits of the widest sketch
FUNCTIONS = 32
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def most_different(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of sets of a and b shingles that are linked."""
    total = a + b
    return total - 2 * -(-percent * total // (100 + percent))


@functools.cache
def bands(percent: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands up to ``limit``; for each band's pairs the number of words (0: only equal sets) and spare words."""
    starts = [1]
    while starts[-1] <= limit:
        starts.append(100 * starts[-1] // percent + 1)
    starts += [100 * starts[-1] // percent + 1]
    starts += [100 * starts[-1] // percent + 1]
    words, spare = [], []
    for j in range(len(starts) - 2):
        a, b = starts[j + 1] - 1, starts[j + 2] - 1
        d = max(most_different(a, b, percent), most_different(a, a, percent))
        # d rises by steps: the sizes below the largest can reach one more
        d = max([d] + [most_different(x, y, percent) for x in range(max(starts[j], a - 2), a + 1) for y in range(max(x, b - 4), b + 1)])
        s = 1 + d // 24
        spare.append(s)
        words.append(d + 1 + s if d > 0 else 0)
    return np.array(starts[:-2]), np.array(words), np.array(spare)


def word_keys(h: np.ndarray, ends: np.ndarray, band: np.ndarray, words: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets ``h[ends[i]:ends[i+1]]`` in the pairs of band ``band[i]``: join keys and the set each belongs to."""
    keys, owners = [], []
    left = np.flatnonzero((words > 0) & (np.diff(ends) > 0))
    for function in range(FUNCTIONS + 1):
        if not len(left):
            break
        if function == FUNCTIONS:
            keys.append(T.mixed(band[left].astype(U) * T.multiplier(7) + U(5)))
            owners.append(left)
            break
        sizes = (ends[1:] - ends[:-1])[left]
        at = np.repeat(ends[left] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        x = T.mixed(h[at] + T.multiplier(200 + function))
        k = words[left]
        first = np.concatenate([[0], np.cumsum(k)])
        word = np.repeat(first[:-1], sizes) + ((x >> U(33)).astype(np.int64) % np.repeat(k, sizes))
        order = np.argsort(word, kind="stable")
        word, x = word[order], x[order]
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        value, word = np.bitwise_xor.reduceat(x, begin), word[begin]
        who = np.searchsorted(first, word, side="right") - 1
        place = (word - first[who]).astype(U)
        keys.append(T.mixed(value + T.mixed((band[left][who].astype(U) << U(34)) + (U(function) << U(28)) + place)))
        owners.append(left[who])
        empty = k - np.bincount(who, minlength=len(left))
        left = left[empty > spare[left]]
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, U), np.empty(0, np.int64))


def digests(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each set: equal sets have equal ones."""
    out = []
    for seed in (300, 301):
        total = np.concatenate([[U(0)], np.cumsum(T.mixed(h + T.multiplier(seed)), dtype=U)])
        out.append(T.mixed(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(U)).view(np.int64))
    return out[0], out[1]


def bit_sketches(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, bits = len(ends) - 1, SKETCH_WORDS * 64
    owner = np.repeat(np.arange(n), np.diff(ends))
    odd = np.bincount(owner * bits + (h >> U(55)).astype(np.int64), minlength=n * bits)[: n * bits] & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(np.int64)


def wide_sketches(h: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """Sketches of more bits for larger sets: half of one, XORed with its other half, is the sketch of half the bits."""
    out: list[bytes | None] = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        bits = SKETCH_WORDS * 64
        while bits < min(b - a, WIDEST):
            bits *= 2
        if bits == SKETCH_WORDS * 64:
            out.append(None)
            continue
        place = ((h[a:b] >> U(20)) & U(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(sketches: list[bytes | None]) -> np.ndarray | None:
    """The sketches as rows of 64-bit words, all as wide as the least wide one; None if some set has none."""
    if not sketches or any(s is None for s in sketches):
        return None
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), U)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, U)
        while x.nbytes > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def summaries(width: int):
    """(rid, doc_id, text) → (rid, doc_id, n, d1, d2, s0..s7, wide)."""

    def run(batches):
        for batch in T.slices(batches):
            h, ends = T.shingle_sets(T.texts_of(batch), width)
            d1, d2 = digests(h, ends)
            s = bit_sketches(h, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(d1), pa.array(d2), *(pa.array(s[:, i]) for i in range(SKETCH_WORDS)), pa.array(wide_sketches(h, ends), pa.binary())],
                ["rid", "doc_id", "n", "d1", "d2", *SKETCH, "wide"],
            )

    return run


def candidate_keys(width: int, percent: int):
    """(text) → (d1, keys): the join keys of each set, once for equal sets of a batch."""

    def run(batches):
        for batch in T.slices(batches):
            h, ends = T.shingle_sets(T.texts_of(batch), width)
            d1, _ = digests(h, ends)
            sizes = np.diff(ends)
            starts, words, spare = bands(percent, 1 << max(10, int(sizes.max(initial=1)).bit_length()))
            once = np.zeros(len(d1), bool)
            once[np.unique(d1, return_index=True)[1]] = True
            once &= sizes > 0
            own = np.searchsorted(starts, np.maximum(sizes, 1), side="right") - 1
            keys, owners = [], []
            for band in (own, own - 1):
                at = np.maximum(band, 0)
                k, who = word_keys(h, ends, at, np.where(once & (band >= 0), words[at], 0), spare[at])
                keys.append(k)
                owners.append(who)
            keys, owners = np.concatenate(keys).view(np.int64), np.concatenate(owners)
            order = np.argsort(owners, kind="stable")
            keys, owners = keys[order], owners[order]
            ends_of = np.searchsorted(owners, np.arange(len(d1) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.ListArray.from_arrays(pa.array(ends_of), pa.array(keys))], ["d1", "keys"])

    return run


def whole_sets(width: int):
    """(rid, text) → (rid, hashes)."""

    def run(batches):
        for batch in T.slices(batches):
            h, ends = T.shingle_sets(T.texts_of(batch), width)
            offsets = pa.array((ends * 8).astype(np.int64))
            sets = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, offsets.buffers()[1], pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), sets.cast(pa.binary())], ["rid", "hashes"])

    return run


def verified(percent: int):
    """(a, b, x, y) → (a, b, linked): similarity of the whole sets x and y, in whole numbers."""

    def run(batches):
        for batch in T.slices(batches, "x"):
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            linked = []
            for x, y in zip(xs, ys, strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def fits(percent: int) -> Column:
    """Whether sizes and bit sketches of ``p`` and ``q`` leave a link possible."""
    n, m = F.col("p.n"), F.col("q.n")
    d = n + m - 2 * F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (distance() <= d)


def distance() -> Column:
    total = F.lit(0)
    for i in range(SKETCH_WORDS):
        total = total + F.bit_count(F.col(f"p.s{i}").bitwiseXOR(F.col(f"q.s{i}")))
    return total


def frequent_keys(texts: DataFrame, width: int, percent: int, sampled: int, least: int) -> DataFrame:
    """(key): keys of at least ``least`` different sets among one text in ``sampled``, by a hash of the text."""
    some = texts.where(F.pmod(F.xxhash64(F.lit(41), "text"), F.lit(sampled)) == 0)
    keys = some.select("text").mapInArrow(candidate_keys(width, percent), KEYS).select("d1", F.explode("keys").alias("key"))
    return keys.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key")


KEYS = "d1 long, keys array<long>"
SALTS = 64


def shared_keys(ws: Workspace, texts: DataFrame, width: int, percent: int, sampled: int, least: int) -> DataFrame:
    """(key, d1) of the keys that two different sets give, and of all frequent ones."""
    keys = texts.select("text").mapInArrow(candidate_keys(width, percent), KEYS).select("d1", F.explode("keys").alias("key"))
    hot = ws.table(frequent_keys(texts, width, percent, sampled, least))
    if ws.is_empty(hot):
        keys = keys.withColumn("salt", F.lit(0))
    else:
        keys = keys.join(maybe_broadcast(hot.withColumn("hot", F.lit(1))), "key", "left").select("key", "d1", F.when(F.col("hot") == 1, F.pmod("d1", F.lit(SALTS)).cast("int") + 1).otherwise(0).alias("salt"))
    # one exchange and sort: of the rows of a key, a set's first or last one has another set beside it
    beside = "{}(d1) over (partition by key, salt order by d1)"
    near = keys.select("key", "d1", "salt", F.expr(beside.format("lag")).alias("lo"), F.expr(beside.format("lead")).alias("hi"))
    return near.where("salt > 0 or lo <> d1 or hi <> d1").select("key", "d1")


def similar(ws: Workspace, docs: DataFrame, width: int = 4, percent: int = 85, rid: str | None = None, sampled: int = 128, least: int = 32) -> DataFrame:
    """One row per row of ``docs``: rid (the column named so, if it is given), doc_id, n_shingles, component_id, root (the component's smallest rid).

    Links are tested apart. Keys of at least ``least`` sets among one text in ``sampled`` are dealt out as frequent ones; this
    doesn't change results.
    """
    texts = docs.select(F.col(rid).alias("rid"), "doc_id", "text") if rid else numbered(ws, docs, "doc_id", "text")
    schema = "rid long, doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in SKETCH) + ", wide binary"
    rows = ws.table(texts.mapInArrow(summaries(width), schema))
    classes = ws.table(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("rid").alias("c"), *(F.first(x).alias(x) for x in ("n", *SKETCH, "wide"))))
    slim = ws.table(rows.select("rid", "doc_id", "n", "d1", "d2"))
    ws.drop(rows)
    shared = ws.table(shared_keys(ws, texts, width, percent, sampled, least).distinct())
    members = ws.table(shared.join(classes.select("d1", "c"), "d1").select("key", "c"))
    ws.drop(shared)
    roots = linked_roots(ws, texts, members, classes, width, percent)
    ws.drop(members)

    roots = slim.where("n > 0").join(classes.select("d1", "d2", "c"), ["d1", "d2"]).join(roots, F.col("c") == F.col("v"), "left").select("rid", "doc_id", F.coalesce("root", "c").alias("root"))
    roots = ws.table(roots)
    least_ids = ws.table(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    ws.drop(classes)
    placed = roots.join(least_ids, "root").select("rid", "root", "component_id")
    return slim.select("rid", "doc_id", F.col("n").alias("n_shingles")).join(placed, "rid", "left").select(
        "rid", "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "rid").alias("root")
    )


BLOCK = 4096  # documents of a group that one task compares with each other, or with another block


def close_pairs(percent: int, partners: int | None):
    """Rows of groups in order (key, bi, bj, block, c, root, lead, n, s0..s7, wide) → pairs (a, b) that may be linked, of different components."""

    def most(total: np.ndarray) -> np.ndarray:
        return total - 2 * -(-percent * total // (100 + percent))

    def pairs(g: dict[str, np.ndarray]) -> list[np.ndarray]:
        c, root, n, block, s = g["c"], g["root"], g["n"], g["block"], g["s"]
        m, out = len(c), []
        inside = g["bi"][0] == g["bj"][0]
        free = c != g["lead"][0]  # the pairs with the leader are tested
        wide = folded(g["wide"].tolist())
        for i in range(0, m, 64):
            e = slice(i, min(m, i + 64))
            total = n[e, None] + n[None]
            small = 100 * np.minimum(n[e, None], n[None]) >= percent * np.maximum(n[e, None], n[None])
            ok = small & (root[e, None] != root[None]) & free[e, None] & free[None]
            if not inside:
                ok &= block[e, None] != block[None]
            h = np.zeros(ok.shape, np.int64)
            for w in range(s.shape[1]):  # of signed words the absolute value's bits would be counted
                h += np.bitwise_count(s[e, None, w] ^ s[None, :, w])
            ok &= h <= most(total)
            if wide is not None:
                x, y = np.nonzero(ok)
                for at in range(0, len(x), 4096):
                    u, v = x[at : at + 4096], y[at : at + 4096]
                    far = np.bitwise_count(wide[i + u] ^ wide[v]).sum(1, dtype=np.int64)
                    h[u, v] = far
                    ok[u, v] = far <= most(total[u, v])
            if partners is None:
                x, y = np.nonzero(ok & (c[e, None] > c[None]))
            else:
                k = min(partners, m - 1)
                far = np.where(ok, h, 1 << 40)
                y = np.argpartition(far, k, axis=1)[:, :k] if k < m - 1 else np.argsort(far, axis=1)[:, :k]
                x = np.repeat(np.arange(len(y)), k)
                y = y.ravel()
                keep = ok[x, y]
                x, y = x[keep], y[keep]
            x = c[e][x]
            y = c[y]
            out.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
        return out

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        got = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "bi", "bj", "block", "c", "root", "n", "lead")}
        wide = np.empty(batch.num_rows, object)
        wide[:] = batch.column("wide").to_pylist()
        return got | {"s": np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in SKETCH], 1).view(U), "wide": wide}

    def run(batches):
        held: list[dict[str, np.ndarray]] = []

        def flush() -> list[np.ndarray]:
            g = {k: np.concatenate([p[k] for p in held]) for k in held[0]}
            held.clear()
            return pairs(g) if len(g["c"]) > 1 else []

        for batch in batches:
            t, found = columns(batch), []
            same = (t["key"][1:] == t["key"][:-1]) & (t["bi"][1:] == t["bi"][:-1]) & (t["bj"][1:] == t["bj"][:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = {k: v[a:b] for k, v in t.items()}
                if held and (held[0]["key"][0], held[0]["bi"][0], held[0]["bj"][0]) != (part["key"][0], part["bi"][0], part["bj"][0]):
                    found += flush()
                if b > a:
                    held.append(part)
            if found:
                found = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        if held:
            for p in flush():
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    return run


def linked_roots(ws: Workspace, texts: DataFrame, members: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(v, root) of the classes whose component has a smaller one; each link that joins two components is verified."""

    def verify(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of a written table of pairs: only sets that are in a pair are made."""
        wanted = ws.table(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
        sets = ws.table(texts.select("rid", "text").join(maybe_broadcast(wanted), "rid", "left_semi").mapInArrow(whole_sets(width), "rid long, hashes binary"))
        first = pairs.join(sets.select(F.col("rid").alias("b"), F.col("hashes").alias("y")), "b")
        both = first.join(sets.select(F.col("rid").alias("a"), F.col("hashes").alias("x")), "a")
        tested = ws.table(both.select("a", "b", "x", "y").mapInArrow(verified(percent), "a long, b long, linked boolean"))
        ws.drop(wanted, sets)
        return tested

    lead = ws.table(members.groupBy("key").agg(F.min("c").alias("lead"), F.count(F.lit(1)).alias("m")))
    stars = ws.table(members.join(lead, "key").where("c <> lead").select(F.col("c").alias("a"), F.col("lead").alias("b")).distinct())
    described = classes.select("c", "n", *SKETCH, "wide")
    near = ws.table(stars.join(described.drop("wide").alias("p"), F.col("a") == F.col("p.c")).join(described.drop("wide").alias("q"), F.col("b") == F.col("q.c")).where(fits(percent)).select("a", "b"))
    ws.drop(stars)
    tested = verify(near)
    ws.drop(near)
    roots = components(ws, tested.where("linked").select("a", "b"))
    for partners in (1, 16, None):
        at = members.join(roots, F.col("c") == F.col("v"), "left").select("key", "c", F.coalesce("root", "c").alias("root"))
        mixed = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        blocks = ws.table(lead.where("m > 2").join(mixed, "key").select("key", "lead", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")))
        rows = at.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, nb - 1)")))
        rows = rows.select("key", F.least("block", "j").alias("bi"), F.greatest("block", "j").alias("bj"), "block", "c", "root", "lead").distinct()
        rows = rows.join(described, "c").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        near = rows.mapInArrow(close_pairs(percent, partners), "a long, b long").distinct()
        near = ws.table(near.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        ws.drop(blocks)
        if ws.is_empty(near):
            continue
        more = verify(near)
        before, tested = tested, ws.table(tested.unionByName(more))
        linked = not ws.is_empty(more.where("linked"))
        ws.drop(near, before, more)
        if linked:
            roots = components(ws, tested.where("linked").select("a", "b"))
    return roots
