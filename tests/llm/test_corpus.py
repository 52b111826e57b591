"""The training-data operators against brute force, on small tables with nulls, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import _text, _tokens, exact_dedup, html_text, mixing, packing, quality, sharding, sketch_join, toxicity, warc, wavelet
from cloudloom.llm._common import Workspace, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, name string, n long, c string"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(spark, rows):
    """(doc_id, text[, lang, source]) as documents, with columns that clash with inner names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, 7, "x", 1, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "A b c"), (5, "a B c"), (5, "a B c"), (None, "a b c"), (None, None), (6, "one two"), (7, "É a"), (8, "é a")]
    for k in range(12):
        words = prose(k, 60 + 25 * k).split()
        for j in range(r.randrange(1, 7)):
            w = list(words)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"z{r.randrange(9999)}"
            out.append((100 * k + 20 + j, " ".join(w)))
    long = prose(77, 9000, 5000)
    out += [(9001, long), (9002, long.upper()), (9003, long + " more"), (9004, long[:-1])]
    return out


def test_exact_dedup(spark, rows):
    got = exact_dedup.exact_dedup(Workspace(spark), table(spark, rows), block_chars=64).drop("rid").collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[lowered(t)].append(d)
    want = collections.Counter()
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        kept_once = False
        for d in ids:
            keep = d == best and not kept_once
            kept_once |= keep
            want[(d, best, len(ids), keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in got) == want


def test_exact_dedup_is_native(spark, rows):
    plan = exact_dedup.exact_dedup(Workspace(spark), table(spark, rows[:5]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def shingle_set(text, width):
    w = WORD.findall(lowered(text))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_sketch_join(spark, rows, width, percent):
    got = sketch_join.similar(Workspace(spark), table(spark, rows), width, percent).select("doc_id", "n_shingles", "component_id").collect()
    sets = [shingle_set(t, width) for _, t in rows]
    roots = brute_components(sets, percent)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = collections.Counter((d, len(s), least.get(r) if s else d) for (d, _), s, r in zip(rows, sets, roots, strict=True))
    assert collections.Counter(tuple(r) for r in got) == want


def test_partners_share_a_word():
    """Pigeonhole: sets at the similarity or above have a key in common, whatever their sizes."""
    r = np.random.default_rng(3)
    starts, words, spare = sketch_join.bands(85, 2000)
    for _ in range(200):
        a = int(r.integers(7, 400))
        x = r.integers(0, 1 << 63, a, dtype=np.uint64)
        gone = int(r.integers(0, a // 10 + 1))
        y = np.concatenate([x[gone:], r.integers(0, 1 << 63, int(r.integers(0, a // 10 + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        same = len(np.intersect1d(x, y))
        if 100 * same < 85 * (len(x) + len(y) - same) or np.array_equal(x, y):
            continue
        small, large = sorted((x, y), key=len)
        band = np.searchsorted(starts, len(small), side="right") - 1
        keys = [set(sketch_join.word_keys(z, np.array([0, len(z)]), np.array([band]), words[[band]], spare[[band]])[0].tolist()) for z in (small, large)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("percent", [80, 85])
def test_close_pairs_miss_no_linked_pair(percent):
    """Sketch words whose sign bits differ, in pairs without the group's leader, against brute force."""
    r = np.random.default_rng(8)
    sets = []
    for size in [30, 60, 120, 300, 1000] * 8:
        x = r.integers(0, 1 << 64, size, dtype=np.uint64)
        gone = size * (100 - percent) // (100 + percent)  # of each: the most that leaves them linked
        sets += [x, np.concatenate([x[gone:], r.integers(0, 1 << 64, gone, dtype=np.uint64)])]
    sets = [np.unique(x) for x in sets]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    s = sketch_join.bit_sketches(np.concatenate(sets), ends)
    linked = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        same = len(np.intersect1d(sets[i], sets[j]))
        if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
            linked.add((j, i))
    assert len(linked) == 40 and any(((s[a] ^ s[b]) < 0).any() for a, b in linked)
    n = len(sets)
    same = {k: np.zeros(n, np.int64) for k in ("key", "bi", "bj", "block")}
    group = same | {"c": np.arange(n), "root": np.arange(n), "n": np.diff(ends), "lead": np.full(n, -1)} | {f"s{i}": s[:, i] for i in range(s.shape[1])} | {"wide": sketch_join.wide_sketches(np.concatenate(sets), ends)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in group.items()})
    for partners in (1, None):
        found = {pair for out in sketch_join.close_pairs(percent, partners)([batch]) for pair in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
        assert linked <= found


def test_wide_sketches_bound_the_symmetric_difference():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (600, 900, 5000)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    wide = sketch_join.folded(sketch_join.wide_sketches(np.concatenate(sets), ends))
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        h = int(np.bitwise_count(wide[i] ^ wide[j]).sum())
        assert 0 < h <= len(np.setxor1d(x, y))
    assert sketch_join.folded([None, b"x" * 128]) is None and len(sketch_join.wide_sketches(sets[2], np.array([0, 5000]))[0]) == 1024


def test_sketch_join_of_frequent_keys_and_small_blocks(spark, rows, monkeypatch):
    """Every key dealt as a frequent one, groups of more than a block, the common key of sets that stay empty under all functions."""
    monkeypatch.setattr(sketch_join, "FUNCTIONS", 2)
    group = [(70_000 + i, " ".join([*prose(1, 60).split()[: 60 - i % 5], f"u{i}"])) for i in range(40)] + [(80_000 + i, f"p{i} q{i} r{i} s{i} t{i}") for i in range(12)]
    every = rows + group
    want = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in sketch_join.similar(Workspace(spark), table(spark, every), 4, 80).collect()}
    sets = [shingle_set(t, 4) for _, t in every]
    least = {}
    roots = brute_components(sets, 80)
    for (d, _), g in zip(every, roots, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    assert {w[0]: w[2] for w in want if w[1]} == {d: least[g] for (d, _), g, x in zip(every, roots, sets, strict=True) if x and (d is not None or g not in least)} | ({None: least[next(g for (d, _), g, x in zip(every, roots, sets, strict=True) if d is None and x)]})
    monkeypatch.setattr(sketch_join, "BLOCK", 3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in sketch_join.similar(Workspace(spark), table(spark, every), 4, 80, sampled=1, least=2).collect()}
    assert got == want


def test_slices_of_long_texts():
    """A batch of more than a slice: all slices' texts are whole, and their sets those of the texts alone."""
    texts = ["É" * 40 + f" Word{i} " + prose(i, 50) for i in range(300)] + ["W\u00e9 " * 30_000, None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    seen = []
    for part in _text.slices([batch], limit=9000):
        h, ends = _text.shingle_sets(_text.texts_of(part), 3)
        seen += [h[a:b].tolist() for a, b in itertools.pairwise(ends)]
    alone = [_text.shingle_sets(pa.array([t or ""], pa.large_string()), 3)[0].tolist() for t in texts]
    assert seen == alone
    assert _text.texts_of(batch.slice(7, 5)).to_pylist() == texts[7:12] and _text.first_offset(_text.texts_of(batch.slice(7, 5))) == 0


def test_sharding_cuts_less_than_the_start(spark, rows):
    every = rows + [(30_000 + i, f"copy {i // 6}") for i in range(240)]
    got = sharding.shard(Workspace(spark), table(spark, every), shards=7)
    before = sharding.cut_rows(got.withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(7))), "text_group").first()
    after = sharding.cut_rows(got, "text_group").first()
    assert after["linked"] == before["linked"] > 240 and after["cut_pairs"] == 0 < before["cut_pairs"]


def test_exchanges_between_full_shards():
    asks = np.array([[0, 5, 0], [3, 0, 4], [2, 0, 0]])
    assert sharding.allowed(asks, np.array([0, 0, 0])).tolist() == [[0, 5, 0], [3, 0, 2], [2, 0, 0]]  # an exchange, then a ring
    out = sharding.allowed(asks, np.array([0, 1, 0]))
    assert (out <= asks).all() and out.sum() >= 10 and all(out[:, t].sum() - out[t].sum() <= [0, 1, 0][t] for t in range(3))


def test_sharding(spark, rows):
    rows = rows + [(20_000 + i, "hot") for i in range(60)]
    got = sharding.shard(Workspace(spark), table(spark, rows), shards=7).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    cut = collections.defaultdict(set)
    for r in got:
        cut[r["text_group"]].add(r["shard"])
    hot = hashlib.sha256(b"hot").hexdigest()
    assert len(cut.pop(hot)) >= 4  # more than a shard holds
    groups = collections.Counter(r["text_group"] for r in got)
    assert all(len(v) == 1 for g, v in cut.items() if groups[g] > 1)  # propagation joins the groups that fit


def test_mixing(spark):
    rows = [(i, "x" * (i % 50), "en", ["a", "b", "c", None][min(3, i % 9 // 2)]) for i in range(900)] + [(None, "y", "en", "a"), (5, None, "en", "d")]
    docs = table(spark, rows).withColumnRenamed("n", "copy").withColumnRenamed("c", "_mix_rate")
    got = mixing.mix(docs).select("doc_id", "source", "text", "copy", "n_copies", "shuffle_key").collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    want = con.execute(f"select doc_id, source, text, copy, n_copies, shuffle_key from ({mixing.ORACLE})").fetchall()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)
    sent = collections.Counter()
    for r in got:
        sent[r["source"]] += len(r["text"] or "")
    own = collections.Counter()
    for _, t, _, s in rows:
        own[s] += len(t or "")
    powers = {s: own[s] ** 0.7 for s in "abc"}
    assert abs(sent["a"] / (sent["a"] + sent["b"] + sent["c"]) - powers["a"] / sum(powers.values())) < 0.1


def test_mixing_at_large_rates(spark):
    """Counts against the Poisson distribution function by logarithms of gammas; a source that the weights don't name has no copies."""
    rows = [(i, "x" * 10, "en", "a") for i in range(400)] + [(1000 + i, "x" * 100, "en", "b") for i in range(4000)] + [(9000, "y" * 4, "en", "c"), (9001, "y" * 4, "en", None)]
    docs = table(spark, rows)
    rate = {r["_mix_source"]: r["_mix_rate"] for r in mixing.rates(docs, 0.7, 1.0, {"a": 0.4, "b": 0.2, None: 0.4}).collect()}
    assert set(rate) == {"a", "b", None} and rate[None] > mixing.LARGE * 10
    got = mixing.mix(docs, weights={"a": 0.4, "b": 0.2, None: 0.4}).groupBy("doc_id", "source", "n_copies").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("k"), F.max("copy").alias("top")).collect()
    counts = {r["doc_id"]: r["n_copies"] for r in got}
    assert all(r["n"] == r["k"] == r["n_copies"] == r["top"] + 1 for r in got)
    for d, _, _, source in rows:
        u = int(hashlib.md5(f"7:{d}".encode()).hexdigest()[:12], 16) / 2**48
        n, below = counts.get(d, 0), [0.0, 0.0]
        if source == "c":
            assert n == 0
            continue
        for k in (0, 1):  # the distribution function at n - 1 and n
            top = n - 1 + k
            below[k] = math.fsum(math.exp(j * math.log(rate[source]) - rate[source] - math.lgamma(j + 1)) for j in range(max(0, int(rate[source] - 14 * rate[source] ** 0.5 - 40)), top + 1))
        assert below[0] - 1e-7 <= u <= below[1] + 1e-7


def brute_quality(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality(spark, rows):
    clean = [(50_000 + i, "The " + prose(i, 150, 80).replace("w", "the") + ".", "en") for i in range(40)]
    junk = [(60_000 + i, prose(i, 150, 80).replace("w", "%%%### $$$"), "en") for i in range(5)]
    lines = [(70_000, "a b\nc\n\na b\n\n a b\na b", None), (70_001, "x y\n" * 40, None)]
    every = [(*r, "en") for r in rows] + clean + junk + lines
    got = quality.judge(Workspace(spark), table(spark, every)).collect()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter((r["doc_id"], *(r[c] for c in counts)) for r in got) == collections.Counter((r[0], *brute_quality(r[1])) for r in every)
    by = {r["doc_id"]: r for r in got}
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert all(by[r[0]]["kept"] for r in clean) and not any(by[r[0]]["kept"] for r in junk)


def test_quality_of_null_languages(spark):
    """Odd words in rows without a language, beside rows of the empty language with words of their own."""
    usual = [(i, " ".join(["the", "of", "and", "to"][(i + j // 2) % 4] if j % 2 else f"w{j}x{i}" for j in range(150)), None) for i in range(30)]
    empty = [(100 + i, " ".join("abcd"[(i + j // 2) % 4] if j % 2 else f"v{j}x{i}" for j in range(150)), "") for i in range(30)]
    odd = (200, " ".join(f"zq{j}" for j in range(150)), None)
    got = {r["doc_id"]: r for r in quality.judge(Workspace(spark), table(spark, [*usual, *empty, odd]), max_class=1).collect()}
    assert all(0 < got[r[0]]["word_distance"] < quality.MAX_WORD_DISTANCE and got[r[0]]["kept"] for r in usual + empty)
    assert got[200]["word_distance"] > quality.MAX_WORD_DISTANCE and not got[200]["kept"] and not got[200]["base_failed"]


def test_quality_of_many_languages(spark, rows):
    """References that come with the rows judge as those that tasks hold; the verdict by brute force."""
    every = [(*r, ["en", "de", None][i % 3]) for i, r in enumerate(rows)] + [(50_000 + i, "The " + prose(i, 150, 80).replace("w", "the") + (" ###%" * 90 if i % 9 == 0 else ""), ["en", "de"][i % 2]) for i in range(60)]
    docs = table(spark, every)
    want = sorted(map(tuple, quality.judge(Workspace(spark), docs, "doc_id", "source").collect()), key=repr)
    assert sorted(map(tuple, quality.judge(Workspace(spark), docs, "doc_id", "source", languages=0).collect()), key=repr) == want
    by_lang = collections.defaultdict(list)
    for _, t, lang in every:
        words = WORD.findall(t or "")
        by_lang[lang].append((words, brute_classes(words)))
    medians, common = {}, {}
    for lang, texts in by_lang.items():
        steps = [sorted(int((2 * 1000 * c[i] + sum(c)) // (2 * sum(c))) for _, c in texts if sum(c)) for i in range(6)]
        medians[lang] = np.array([s[(len(s) - 1) // 2] / 1000 for s in steps])
        held = collections.Counter(w for words, _ in texts for w in {x.lower().strip(quality.MARKS) for x in words} - {""})
        common[lang] = dict(sorted(held.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON])
    got = {r[0]: r for r in quality.judge(Workspace(spark), docs).select("doc_id", "kept", "base_failed", "class_distance", "word_distance").collect()}
    for d, t, lang in every[len(rows) :]:
        words = WORD.findall(t)
        own = collections.Counter(x.lower().strip(quality.MARKS) for x in words)
        p = np.array([own[w] for w in common[lang]] + [len(words) - sum(own[w] for w in common[lang])], float)
        q = np.array([*common[lang].values()], float)
        q = np.append(q / q.sum() / 2, 0.5)
        far = (brute_distance(brute_classes(words), medians[lang]), brute_distance(p, q))
        assert np.allclose(got[d][3:], far)
        assert got[d][1] == (not got[d][2] and far[0] <= quality.MAX_CLASS_DISTANCE and far[1] <= quality.MAX_WORD_DISTANCE)


def brute_classes(words):
    kinds = collections.Counter()
    for c in "".join(words):
        k = unicodedata.category(c)
        kinds[{"Ll": 0, "Lu": 1, "Nd": 2}.get(k, 3 if c in ".,;:!?'\"()-" else 4 if c in "#*$%&|<>" else 5)] += 1
    return [kinds[i] for i in range(6)]


def brute_distance(p, q):
    p, q = np.array(p, float) / max(sum(p), 1e-300), np.array(q, float) / max(sum(q), 1e-300)
    m = (p + q) / 2
    return math.sqrt(max(0.0, sum((a * math.log2(a / c) if a else 0) + (b * math.log2(b / c) if b else 0) for a, b, c in zip(p, q, m, strict=True)) / 2))


def test_divergence_is_a_distance():
    p = np.array([[1.0, 0, 0], [1, 1, 0], [0.2, 0.3, 0.5]])
    assert np.allclose(quality.distance(p, p), 0)
    assert np.allclose(quality.distance(np.array([[1.0, 0]]), np.array([[0, 1.0]])), 1)


def test_marginals_by_enumeration():
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = r.integers(1, 6, 4)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        unary, pairs = r.normal(size=lengths.sum()), r.normal(size=(2, 2))
        want = []
        for f, n in zip(first, lengths, strict=True):
            total, ones = 0.0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=int(n)):
                w = np.exp(sum(unary[f + i] for i in range(n) if y[i]) + sum(pairs[y[i - 1], y[i]] for i in range(1, n)))
                total += w
                ones += w * np.array(y)
            want.extend(ones / total)
        got = toxicity.marginals(unary, first, pairs)
        assert np.allclose(got, want)
        edge = toxicity.pair_expectations(unary, first, pairs, got)
        assert np.isclose(edge.sum(), (lengths - 1).sum()) and (edge >= -1e-9).all()


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [(-1, None), (-2, ""), (None, "vile words"), (-3, "vile")], []
    for i in range(600):
        words = prose(i, r.randrange(8, 60)).split()
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["vile", "Rotten.", "gruntish", "gruntled"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows.append(rows[4])
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(table(spark, rows), marked).collect()
    assert len(got) == len(rows)
    for g in got:
        d = g["doc_id"]
        assert g["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.7)
    held = [g for g in got if g["held_out"] and g["doc_id"] >= 0]
    assert sum(g["predicted"] == (g["doc_id"] % 4 == 0) for g in held) >= 0.97 * len(held)
    texts = dict(rows)
    hits = [texts[g["doc_id"]][s["start"] : s["end"]] for g in held for s in g["spans"]]
    assert hits and sum(bool(re.search("vile|Rotten|grunt", h)) for h in hits) >= 0.95 * len(hits)
    none = toxicity.score(table(spark, rows[:5]), marked.where("false")).collect()
    assert all(g["predicted"] == 0 for g in none)


def test_toxicity_reads_whole_texts(spark):
    """Toxic words far behind in long texts count in training and in scores, and so does the rarer one."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, r.randrange(10, 40)).split()
        if i % 2 == 0:
            words = prose(i, 3000, 2000).split() + (["vile."] * 3 if i % 8 else ["grubby"] * 3) + words
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 2 == 0)))
    rows += [(1000 + i, prose(1000 + i, 3000, 2000)) for i in range(30)]
    labels += [(1000 + i, 1, 0) for i in range(30)]
    got = {g["doc_id"]: g for g in toxicity.score(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_rows=100).collect()}
    assert all(g["predicted"] == (d < 1000 and d % 2 == 0) for d, g in got.items())


def test_sentences_of_the_field():
    """Sentences counted together train as the tokens one by one would."""
    texts = pa.array(["a vile B1 b. c vile", "a b. x y."], pa.string())
    batch = pa.RecordBatch.from_pydict({"toxic": pa.array([1, 0]), "text": texts})
    out = next(iter(toxicity.chains(["vile", "vil*"])([batch])))
    rows = list(zip(*(out[c].to_pylist() for c in ("toxic", "chain", "n")), strict=True))
    table, shapes, labels, starts, often = toxicity.read_chains(rows, 2)
    assert sum(n * k for n, k in zip(often, np.diff([*starts, len(table)]), strict=True)) == 10
    assert sorted((y, n, len(c) // 4) for y, c, n in rows) == [(0, 2, 2), (1, 1, 4), (1, 1, 6)]
    assert labels.sum() == 2 and (table[labels == 1][:, :2] == [0, 1]).all() and (shapes == 4).sum() == 0 and (shapes & 4).any()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a>menu</a></li></ul></nav><!-- ad 0 --><div class="ad">buy</div><div class="cookie-notice">ok</div>
<article><header><h1>Head &amp; line</h1></header><p><b>One   two<br>three<p>x&nbsp;&eacute; &#8364;</p><form><input>no</form><aside>side</aside><ul><li>a<li>b</ul><section class="comments"><p>reader</p></section></article>
<footer>&copy; foot</footer></body>"""


def test_html_blocks(spark):
    assert " ".join(t for inside, t in html_text.blocks(PAGE) if inside) == "Head & line One two three x é € a b"
    share = "we use cookies and other things on this site so please agree to them now"
    open_pages = [(10 + i, f"http://h.example/{i}", f"<body><div>{share}</div><p>{prose(i, 30, 10_000)}</p></body>") for i in range(5)]
    pages = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "bad url", ""), (1, "http://a.example/x", PAGE), *open_pages]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, rid long")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract(Workspace(spark), df).collect()}
    want = "Head & line One two three x é € a b"
    assert got[(1, "http://a.example/x")] == (want, len(want)) and got[(2, None)] == ("", 0) and got[(3, "bad url")] == ("", 0)
    for i, (k, url, _) in enumerate(open_pages):
        assert got[(k, url)][0] == prose(i, 30, 10_000)


def test_html_of_odd_markup(spark):
    odd = '<body><article><a title="x>y" href=z>A</a> <b title="q>B</b><p class="lead share-note">kept</p><div class="related-work">work</div><div class="social-share">no</div><div id="siteFooter">no</div><p class=comments>no</p>end</article></body>'
    assert " ".join(t for _, t in html_text.blocks(odd)) == "A B kept work end"


def test_large_hosts_are_cut_as_small_ones(spark):
    share = prose(3, 15, 40)
    pages = [(i, f"http://h{i % 2}.example/{i}", f"<body><div>{prose(100 + i, 9, 30)} {share if i % 7 < 2 else ''} {prose(i, 20, 9 if i % 5 == 0 else 5000)}</div></body>") for i in range(60)]
    df = spark.createDataFrame([*pages, pages[3], (99, None, "<p>a b</p>")], "page_id long, url string, html string")
    every = [sorted(map(tuple, html_text.extract(Workspace(spark), df, group_tokens=g).drop("rid").collect()), key=repr) for g in (0, 1000, 10**6)]
    assert every[0] == every[1] == every[2] and len(every[0]) == 62
    words = {p: html_text.blocks(h)[0][1].split(" ") for p, _, h in pages}
    for page_id, url, text, n in every[0]:
        if page_id in (3, 99):
            continue
        w, host = words[page_id], page_id % 2
        others = {tuple(v[i : i + 12]) for p, v in words.items() if p != page_id and p % 2 == host for i in range(len(v) - 11)}
        covered = {j for i in range(len(w) - 11) if tuple(w[i : i + 12]) in others for j in range(i, i + 12)}
        assert text == " ".join(x for j, x in enumerate(w) if j not in covered) and n == len(text)


def test_suffix_array_marks_what_pages_share():
    r = random.Random(4)
    for _ in range(150):
        streams = [np.array([r.randrange(3) for _ in range(r.randrange(12))], np.int64) for _ in range(r.randrange(1, 5))]
        least = r.randrange(1, 5)
        for i, (s, got) in enumerate(zip(streams, html_text.repeated(streams, least), strict=True)):
            want = np.zeros(len(s), bool)
            for a in range(len(s) - least + 1):
                w = s[a : a + least].tolist()
                if any(t[c : c + least].tolist() == w for j, t in enumerate(streams) if j != i for c in range(len(t) - least + 1)):
                    want[a : a + least] = True
            assert (want == got).all()


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a\r\nb", big), (2, None, big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (None, "u", ""), (6, "u", big + "!"), (2, None, big), (7, "u", "y" * 5000)]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, rid long, same long")
    ws = Workspace(spark)
    index = warc.write(ws, df, f"{ws.path}/warc", frame_bytes=2000, bundle_bytes=1500)
    got = warc.read(index).collect()
    assert len(got) == len(pages)
    want = collections.Counter((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in pages)
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    same = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (1, 2))
    assert same == sorted([(1, "revisit", 2), (2, "revisit", 2), (2, "response", None)], key=str) or sorted(same, key=str) == sorted([(1, "revisit", 2), (2, "revisit", 2), (2, "response", None)], key=str)
    assert all(r["record_type"] == "response" for r in got if r["page_id"] not in (1, 2))
    one = index.where("page_id = 7").first()
    fields, body = warc.lookup(one["bundle"], one["frame_at"], one["frame_size"], one["at"], one["size"])
    assert fields["WARC-Record-ID"] == "<urn:page:7>" and body == b"y" * 5000
    assert warc.read(warc.write(ws, df.where("false"), f"{ws.path}/none")).count() == 0


ODD = ["", " ", "  ", "a  b", " a", "a ", "x\n \ny", "x \n y", "a\n\n b", "\n", "a\tb", "a  　b", "A<|endoftext|>b <|startoftext|> c", "don't we'll  I'M 12.5", "\x0b a\x0cb", "x\x85 y", "a \n", "  \n "]


@pytest.mark.parametrize(("name", "by_words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_tokens_of_pieces_are_tokens_of_texts(name, by_words):
    from tokenizers import Tokenizer

    r = random.Random(6)
    texts = ODD + ["".join(r.choice(["a", "B", " ", "\n", "\t", "'s", "1", ".", " ", "é"]) for _ in range(r.randrange(14))) for _ in range(1500)]
    marks = ["a", "B", "é", "İ", "Σ", "ß", "中", "x\u0301", "\u0301", "'", "’", ".", ",", "!?", "&&", "-", "_", "<", "|", "\x1f", "\n", "\n\n", " ", "3", " the", "don't"]
    texts += ["".join(r.choice(marks) for _ in range(r.randrange(20))) for _ in range(3000)]
    whole = Tokenizer.from_file(_tokens.vocabulary_path(name))
    encode = _tokens.Encoder(_tokens.vocabulary_path(name), by_words).encode
    for _ in range(2):
        ends, ids = encode(pa.array(texts, pa.large_string()))
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(_tokens.vocabulary_path("word_bpe_49k.json"))
    got = packing.pack(Workspace(spark), table(spark, rows), capacity=256, groups=8).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 256)):
            x = np.array(ids[s : s + 256], "<u4")
            want[(d, k, s, len(x), zlib.crc32(x.tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r["length"] for r in got) // 256)
    assert len(sequences) <= least * 1.15 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_best_fit_decreasing(seed):
    r = random.Random(seed)
    counts = collections.Counter(int(min(2048, r.expovariate(1 / (100 + 400 * seed)) + 1)) for _ in range(4000))
    kinds = packing.plan(counts)
    held = collections.Counter()
    for lengths, n in kinds:
        assert sum(lengths) <= 2048
        for s in lengths:
            held[s] += n
    assert held == counts
    rooms = []
    for s in sorted(counts.elements(), reverse=True):
        fit = [x for x in range(len(rooms)) if rooms[x] >= s]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= s
        else:
            rooms.append(2048 - s)
    assert sum(n for _, n in kinds) <= len(rooms) * 1.01 + 1


def test_wavelet(spark, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(_tokens.vocabulary_path("byte_bpe_50k.json"))
    ws = Workspace(spark)
    shards = wavelet.write(ws, table(spark, rows), f"{ws.path}/shards", shard_ids=3000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read(shards).collect())
    want = collections.Counter()
    for d, t in rows:
        x = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(d, len(x), zlib.crc32(x.tobytes()))] += 1
    assert collections.Counter(g[1:] for g in got) == want
    at, last = 0, -1
    for start, d, n, _ in got:
        assert start == at and (-1 if d is None else d) >= last
        at, last = at + n, -1 if d is None else d
    r = random.Random(1)
    for s in shards.collect()[:2]:
        with wavelet.WaveletFile(s["file"]) as w:
            ids = w.ids()
            for _ in range(20):
                i = r.randrange(w.n)
                v = int(ids[r.randrange(w.n)])
                places = np.flatnonzero(ids == v)
                k = r.randrange(len(places))
                assert w.access(i) == ids[i] and w.rank(v, i) == (ids[:i] == v).sum() and w.select(v, k) == places[k] and w.select(v, len(places)) == -1


def test_empty_tables(spark):
    ws, none = Workspace(spark), spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(ws, none).count() == 0
    assert sketch_join.similar(ws, none).count() == 0
    assert sharding.shard(ws, none).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality.judge(ws, none).count() == 0
    assert toxicity.score(none, labels).count() == 0
    assert html_text.extract(ws, pages).count() == 0
    assert packing.pack(ws, none).count() == 0
    assert wavelet.read(wavelet.write(ws, none, f"{ws.path}/empty")).count() == 0


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    clean = [(50_000 + i, f"The {prose(i, 150, 80).replace('w', 'the')}.", "en", f"s{i % 3}") for i in range(30)]
    near = [(60_000 + i, clean[i][1] + " end", "en", "s1") for i in range(5)]
    docs = table(spark, [(*r, "en", "s0") for r in rows] + clean + near + [clean[3]])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    state = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = state
        state = stage(spark, state, str(tmp_path)).cache()
        seen.append((name, before.count(), state.count()))
        if name == "quality_rules":
            assert {c[0] for c in clean} <= {r["doc_id"] for r in state.select("doc_id").collect()}
            assert all(brute_quality(r["text"])[0] >= 20 for r in state.collect())
        if name == "exact_dedup":
            left = [lowered(r["text"]) for r in state.collect()]
            assert len(left) == len(set(left)) == len({lowered(r["text"]) for r in before.collect()})
        if name == "ngram_jaccard_join":
            was = before.collect()
            sets = [shingle_set(r["text"], 5) for r in was]
            groups = collections.defaultdict(set)
            for r, g in zip(was, brute_components(sets, 80), strict=True):
                groups[g].add(r["doc_id"])
            now = [r["doc_id"] for r in state.collect()]
            assert len(now) == len(groups) and all(sum(d in g for d in now) == 1 for g in groups.values())
        if name != "best_fit_packing":
            assert state.columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1][2]


@pytest.fixture
def recut(spark, tmp_path, monkeypatch):
    """A table in files of many sizes whose scans are cut otherwise after each written table, as when executors come and go."""
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    written = Workspace.table

    def table_then_recut(self, df, *args, **kwargs):
        out = written(self, df, *args, **kwargs)
        spark.conf.set(limit, "9000000" if spark.conf.get(limit) == "9000" else "9000")
        return out

    def make(df):
        for k in range(9):
            df.where(f"pmod(hash(doc_id), 45) between {k * (k + 1) // 2} and {(k + 1) * (k + 2) // 2 - 1}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/recut")
        spark.conf.set(limit, "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        monkeypatch.setattr(Workspace, "table", table_then_recut)
        return spark.read.parquet(f"{tmp_path}/recut")

    yield make
    spark.conf.set(limit, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


STEADY = {
    "quality_rules": lambda spark, docs: corpus_stages()["quality_rules"](spark, docs, ""),
    "exact_dedup": lambda spark, docs: corpus_stages()["exact_dedup"](spark, docs, "").select("doc_id"),
    "ngram_jaccard_join": lambda spark, docs: corpus_stages()["ngram_jaccard_join"](spark, docs, ""),
    "op3": lambda spark, docs: sketch_join.similar(Workspace(spark), docs).select("doc_id", "n_shingles", "component_id"),
    "op4": lambda spark, docs: quality.judge(Workspace(spark), docs).drop("rid"),
    "op6": lambda spark, docs: warc.read(warc.write(Workspace(spark), docs.selectExpr("doc_id as page_id", "lang as url", "text as html"), shared_dir(spark) + f"/warc{random.random()}", least=1)).drop("html"),
}


def corpus_stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STEADY)
def test_numbers_stay_with_their_rows(spark, recut, name):
    every = [(i, prose(i % 70, 40 + i % 70, 200) + (" end" if i % 3 == 0 else ""), "en", "s") for i in range(210)] + [(1000 + i, "junk", "en", "s") for i in range(40)]
    docs = table(spark, every)
    want = collections.Counter(tuple(r) for r in STEADY[name](spark, docs.coalesce(1)).collect())
    got = collections.Counter(tuple(r) for r in STEADY[name](spark, recut(docs)).collect())
    assert got == want
