"""Source divergence against plain Python with exact integers: odd and even rings, nulls, ties, lone groups, empty tables."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from cloudloom.llm import divergence as D
from cloudloom.llm._common import Workspace

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, block int, place int, team int"


def brute(rows, min_docs=3, top=200):
    docs, whole, counts = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        group = (lang or "", source or "")
        counts[group].update(terms)
        whole.update((group[0], t) for t in terms)
        docs.update((group[0], t) for t in set(terms))
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    for lang in {g[0] for g in counts}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        v, total = len(kept), sum(whole[lang, t] for t in kept)
        p = {g[1]: [share(c[t], sum(c[k] for k in kept), v) for t in kept] for g, c in counts.items() if g[0] == lang}
        for source, own in p.items():
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(own, other)), item) for item, other in p.items() if item != source]
            q = [share(whole[lang, t], total, v) for t in kept]
            terms = [((a - b) ** 2 // b, t) for a, b, t in zip(own, q, kept) if counts[lang, source][t] and a > b]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def run(spark, rows, **how):
    table = spark.createDataFrame([(k, *r, 0, "t", 1, 2, 3) for k, r in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(map(tuple, D.audit(Workspace(spark), table, **how).collect()))


def test_audit(spark):
    r = random.Random(2)
    words = ["alpha", "Beta", "gamma", "é", "Éa", "straße", "日本", "zeta", "eta", "theta", "x", "don't", "a1b", "iota", "\U0001F600", "kappa"]
    rows = [(None, None, None), ("", "en", "s0"), ("!? 12", "en", "empty"), ("alone here alone", "solo", "only"), ("one two", "few", "a"), ("two three", "few", "b")]
    for lang, sources in (("en", 7), ("de", 4), ("fr", 2), (None, 3)):
        for _ in range(40):
            source = min(r.randrange(sources), r.randrange(sources))  # one source has most rows
            rows.append((" ".join(r.choice(words[: 4 + 2 * source]) for _ in range(r.randrange(0, 30))), lang, f"s{source}" if source else None))
    rows += [("rare rare rare", "en", "s1")] * 3 + [("word " * 50_000, "en", "s2")]
    want = brute(rows)
    assert run(spark, rows, block=4, team=1) == want
    assert run(spark, rows) == want
    assert run(spark, rows, block=3, team=2, top=2, min_docs=1) == brute(rows, 1, 2)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_share_is_exact():
    r = random.Random(1)
    for _ in range(200):
        total, width = r.randrange(10**15), r.randrange(1, 10**9)
        n = r.randrange(total + 1)
        assert int(D.share(n, total, width)) == 1 + 10**9 * (n + 1) // (total + width)


def test_vectors_round_trip():
    places, counts = np.array([0, 3, 9, 16383]), np.array([1, 2**40, 7, 1])
    got = D.unpacked(D.packed(places, counts), 4)
    assert got[0].tolist() == places.tolist() and got[1].tolist() == counts.tolist()
    assert [x.size for x in D.unpacked(D.packed(places[:0], counts[:0]), 0)] == [0, 0]


def test_terms_of_slices():
    texts = pa.array(["zz", "", "A bÉ-c", "12", "d\x00E"], pa.large_string())
    for cut in (texts, texts.slice(1), texts.slice(2, 2)):
        offsets, terms = D.terms_of(cut)
        assert [terms.slice(a, b - a).to_pylist() for a, b in zip(offsets, offsets[1:])] == [[t for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s))] for s in cut.to_pylist()]
