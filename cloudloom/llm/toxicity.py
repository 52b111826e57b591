"""Operator 2, toxic spans by a linear-chain conditional random field.

* Labelled tokens: a word, or a stem of 3 to 7 letters, is a marker if far more of the texts labelled toxic hold it than of
  others: the smoothed ratio is at least ``ratio``, and so many toxic texts by chance are less likely than ``chance``. Texts are
  counted on at most ``max_counted`` training rows of each label, in the order of a hash. Tokens of toxic texts with a marker
  have label 1.
* The field: two labels, weights for each marker, for markers in the token before and after, for the token's shape, and for
  label pairs; trained by gradient ascent (Adam) on the penalised likelihood of all sentences of at most ``max_rows`` whole texts of
  each label. Sentences that look alike to the field are counted together, so the driver holds kinds of sentences, not texts.
* Scores: forward-backward marginals of every token of every whole text, sentence by sentence (long ones in runs of
  ``LONGEST`` tokens). Largest marginal, their sum and their share make the text's score by a logistic model, fitted on the texts
  of the sample; runs of tokens with a marginal of half or more are the spans, as character offsets.

Training uses only rows whose crc32(doc_id as text) mod 3 is not 1; both bounds are on labelled rows, and every text is read whole.

Defined cases: a null or empty text has no token and gets the score of a text without toxic tokens, and no spans; a null
doc_id isn't trained on and counts as not held out; repeated rows are scored alike; without labels of both kinds every score
is 0; an empty table gives an empty result; columns besides ``doc_id, text`` are ignored.
"""

from __future__ import annotations

import collections
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace, maybe_broadcast

LONGEST = 64
THRESHOLD = 0.7
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def plain(words: pa.Array) -> list[str]:
    return [EDGE.sub("", w) for w in pc.utf8_lower(words).to_pylist()]


def shape(word: str, raw: str) -> int:
    return (raw.isupper() and len(raw) > 1) * 1 + (not word) * 2 + any(c.isdigit() for c in word) * 4


def ends_sentence(raw: str) -> bool:
    return raw[-1:] in ".!?"


@dataclass
class Field:
    """Weights of label 1 for each marker (words, and stems written ``abc*``) and the token's surroundings; of label pairs; of the score."""

    own: dict[str, float] = field(default_factory=dict)
    near: np.ndarray = field(default_factory=lambda: np.zeros(2))
    shapes: np.ndarray = field(default_factory=lambda: np.zeros(8))
    bias: float = 0.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.array([-40.0, 0.0, 0.0, 0.0]))


STEMS = range(3, 8)


def forms(word: str) -> list[str]:
    """A word and its stems."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)] if word else []


def marker_table(names: list[str], index: dict[str, int]) -> np.ndarray:
    """For each word the markers among its forms, filled up with the number of markers."""
    out = np.full((len(names) + 1, 1 + len(STEMS)), len(index), np.int64)
    for i, w in enumerate(names):
        for j, f in enumerate(forms(w)):
            if (m := index.get(f)) is not None:
                out[i, j] = m
    return out


def runs_of(offsets: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """First tokens of the chains: at each text's begin, after each sentence's end, and every LONGEST tokens."""
    n = int(offsets[-1])
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin[1:] |= stop[:n]
    begin = begin[:n]
    first = np.flatnonzero(begin)
    at = np.arange(n) - first[np.cumsum(begin) - 1] if n else np.empty(0, np.int64)
    return np.flatnonzero(at % LONGEST == 0)


def marginals(unary: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """P(label 1) of each token: ``unary`` holds the log odds of label 1, ``first`` the chains' first tokens."""
    out = np.zeros(len(unary))
    if not len(unary):
        return out
    length = np.diff(np.concatenate([first, [len(unary)]]))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    top = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, top + 1), side="right")  # chains with a token at each step
    t = np.exp(pairs)
    odds = np.exp(np.clip(unary, -30, 30))
    alpha = []
    for i in range(top):
        n = active[i]
        e = odds[first[:n] + i]
        if i == 0:
            a = np.stack([np.ones(n), e])
        else:
            p = alpha[-1][:, :n]
            a = np.stack([p[0] * t[0, 0] + p[1] * t[1, 0], (p[0] * t[0, 1] + p[1] * t[1, 1]) * e])
        alpha.append(a / a.sum(0))
    beta = np.ones((2, active[-1]))
    for i in range(top - 1, -1, -1):
        n = active[i]
        if beta.shape[1] < n:
            beta = np.hstack([beta, np.ones((2, n - beta.shape[1]))])
        both = alpha[i] * beta
        out[first[:n] + i] = both[1] / both.sum(0)
        if i:
            e = odds[first[:n] + i]
            b = np.stack([t[0, 0] * beta[0] + t[0, 1] * e * beta[1], t[1, 0] * beta[0] + t[1, 1] * e * beta[1]])
            beta = b / b.sum(0)
    return out


def pair_expectations(unary: np.ndarray, first: np.ndarray, pairs: np.ndarray, p: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Expected counts of neighbouring labels, from marginals and the edges' local odds; ``weight`` says how often each token is there."""
    n = len(unary)
    inner = np.ones(n, bool)
    inner[first] = False
    j = np.flatnonzero(inner)
    if not len(j):
        return np.zeros((2, 2))
    # the joint of two neighbours has the model's odds ratio and the given margins
    ratio = np.exp(pairs[0, 0] + pairs[1, 1] - pairs[0, 1] - pairs[1, 0])
    a, b = p[j - 1], p[j]
    if abs(ratio - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (ratio - 1) * (a + b)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * a * b, 0))) / (2 * (ratio - 1))
    both = np.clip(both, 0, np.minimum(a, b))
    w = np.ones(len(j)) if weight is None else weight[j]
    return np.array([[(w * (1 - a - b + both)).sum(), (w * (b - both)).sum()], [(w * (a - both)).sum(), (w * both).sum()]])


def tokens(texts: pa.Array):
    """Words of all texts: offsets, words, codes; by code: plain words, shapes, sentence ends."""
    offsets, words = T.split_words(texts)
    codes, vocabulary = T.coded(words)
    raw = vocabulary.to_pylist()
    names = plain(vocabulary)
    shapes = np.array([shape(w, r) for w, r in zip(names, raw, strict=True)], np.int64) if raw else np.empty(0, np.int64)
    stops = np.array([ends_sentence(r) for r in raw], bool) if raw else np.empty(0, bool)
    return offsets, words, codes, names, shapes, stops


def features(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(p)])
    mass = total[offsets[1:]] - total[offsets[:-1]]
    n = np.diff(offsets)
    most = np.zeros(len(n))
    full = n > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, offsets[:-1][full])
    return np.stack([np.ones(len(n)), most, np.log1p(np.maximum(mass, 0)), np.sqrt(mass / np.maximum(n, 1))], axis=1)


def counted(index: dict[str, int] | None):
    """(text) → (form, texts): in how many texts of a batch each form is; with an index, only its forms are counted."""

    def run(batches):
        for batch in T.slices(batches):
            offsets, words = T.split_words(T.texts_of(batch))
            if not len(words):
                continue
            codes, vocabulary = T.coded(words)
            names = plain(vocabulary)
            found: dict[str, int] = {}
            owner, form = [], []
            for i, w in enumerate(names):
                for f in forms(w):
                    if index is None or f in index:
                        owner.append(i)
                        form.append(found.setdefault(f, len(found)))
            if not found:
                continue
            owner, form = np.array(owner), np.array(form)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            v = len(names)
            pairs = np.unique(doc * v + codes)
            first = np.searchsorted(owner, np.arange(v + 1))
            n = np.diff(first)[pairs % v]
            at = np.repeat(first[pairs % v] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.unique(np.repeat(pairs // v, n) * len(found) + form[at])
            texts = np.bincount(both % len(found), minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(texts)], ["form", "texts"])

    return run


def sampled(train: DataFrame, most: int) -> DataFrame:
    """Of each label the first rows in the order of a hash of doc_id and text, ``most`` different ones."""
    hashed = train.withColumns({"h": F.xxhash64("doc_id"), "x": F.xxhash64("text")})
    chosen = F.lit(False)
    for y in (0, 1):
        own = hashed.where(F.col("toxic") == y).select(F.struct("h", "x").alias("k")).distinct()
        last = own.orderBy("k").limit(most).agg(F.max("k").alias("k")).select("k.h", "k.x").first()
        if last["h"] is not None:
            upto = (F.col("h") < F.lit(last["h"])) | ((F.col("h") == F.lit(last["h"])) & (F.col("x") <= F.lit(last["x"])))
            chosen = chosen | ((F.col("toxic") == y) & upto)
    return hashed.where(chosen)


def markers(train: DataFrame, least: int = 3, ratio: float = 20.0, chance: float = 1e-4) -> dict[str, float]:
    """Forms that far more of the toxic texts hold than of the others; the rows of ``train`` bound their number."""
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}  # two rows
    if not n.get(1) or not n.get(0):
        return {}
    kind = "form string, texts long"
    bad = train.where("toxic = 1").select("text").mapInArrow(counted(None), kind).groupBy("form").agg(F.sum("texts").alias("n"))
    share = n[1] / (n[0] + n[1])

    def odds(b: int, g: int) -> float:
        return float(np.log((b + 0.5) / (n[1] + 1)) - np.log((g + 0.5) / (n[0] + 1)))

    def passes(b: int, g: int) -> bool:
        """By Chernoff's bound on so many toxic ones among texts dealt by chance."""
        q = b / (b + g)
        divergence = q * np.log(q / share) + ((1 - q) * np.log((1 - q) / (1 - share)) if g else 0.0)
        return odds(b, g) >= np.log(ratio) and q > share and (b + g) * divergence >= -np.log(chance)

    # even without a clean text that holds it, a form needs so many toxic ones
    while least < n[1] and not passes(least, 0):
        least += 1
    bad = {r["form"]: r["n"] for r in bad.where(F.col("n") >= least).collect()}
    good = train.where("toxic = 0").select("text").mapInArrow(counted(dict.fromkeys(bad, 0)), kind).groupBy("form").agg(F.sum("texts").alias("n"))
    good = {r["form"]: r["n"] for r in good.collect()}  # no other forms than those of ``bad``
    return {f: odds(b, good.get(f, 0)) for f, b in sorted(bad.items()) if passes(b, good.get(f, 0))}


def chains(marks: list[str]):
    """(toxic, text) → (toxic, chain, n): the sentences of a batch as the field sees them, each token as its shape and its markers."""
    index = {f: i for i, f in enumerate(marks)}

    def run(batches):
        for batch in T.slices(batches):
            offsets, _, codes, names, shapes, stops = tokens(T.texts_of(batch))
            if not len(codes):
                continue
            first = runs_of(offsets, stops[codes])
            table = marker_table(names, index)
            seen = [struct.pack(f"<{len(m) + 1}i", int(s) + 8 * len(m), *m) for m, s in zip(([int(x) for x in row if x < len(index)] for row in table[:-1]), shapes, strict=True)]
            labels = np.repeat(batch.column("toxic").to_numpy(), np.diff(offsets))[first].tolist()
            found: collections.Counter = collections.Counter()
            ends = [*first[1:].tolist(), len(codes)]
            listed = codes.tolist()
            for y, a, b in zip(labels, first.tolist(), ends, strict=True):
                found[y, b"".join([seen[c] for c in listed[a:b]])] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(found.values()), pa.int64())], ["toxic", "chain", "n"])

    return run


def read_chains(rows: list[tuple[int, bytes, int]], n_markers: int) -> tuple[np.ndarray, ...]:
    """Of all kinds of sentences: markers (a row for each token, filled up with ``n_markers``), shapes, labels, first tokens, how often."""
    table, shapes, labels, starts = [], [], [], []
    width = 1 + len(STEMS)
    for y, raw, _ in rows:
        starts.append(len(table))
        x = struct.unpack(f"<{len(raw) // 4}i", raw)
        at = 0
        while at < len(x):
            k, shape_of = divmod(x[at], 8)
            own = x[at + 1 : at + 1 + k]
            table.append((*own, *[n_markers] * (width - k)))
            shapes.append(shape_of)
            labels.append(float(y == 1 and k > 0))
            at += 1 + k
    return np.array(table, np.int64).reshape(-1, width), np.array(shapes, np.int64), np.array(labels), np.array(starts, np.int64), np.array([n for *_, n in rows], float)


def train_field(rows: list[tuple[int, bytes, int]], marks: list[str], steps: int = 150, rate: float = 0.15, penalty: float = 1.0) -> Field:
    """Fits the field to (label of the text, sentence, how often)."""
    model = Field()
    if not marks or len({y for y, *_ in rows}) < 2:
        return model
    table, shape_of, label, starts, often = read_chains(rows, len(marks))
    n = len(label)
    weight = np.repeat(often, np.diff(np.concatenate([starts, [n]])))
    marker = (table < len(marks)).any(1)
    begin = np.zeros(n, bool)
    begin[starts] = True
    near = np.zeros((n, 2))
    near[1:, 0] = marker[:-1] & ~begin[1:]
    near[:-1, 1] = marker[1:] & ~begin[1:]
    theta = {"own": np.zeros(len(marks) + 1), "near": np.zeros(2), "shape": np.zeros(8), "bias": np.array([-3.0]), "pairs": np.zeros((2, 2))}
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in theta.items()}
    j = np.flatnonzero(~begin)
    a, b, w = label[j - 1], label[j], weight[j]
    seen = np.array([[(w * (1 - a) * (1 - b)).sum(), (w * (1 - a) * b).sum()], [(w * a * (1 - b)).sum(), (w * a * b).sum()]])
    total = weight.sum()
    for step in range(1, steps + 1):
        unary = theta["own"][table].sum(1) + near @ theta["near"] + theta["shape"][shape_of] + theta["bias"][0]
        p = marginals(unary, starts, theta["pairs"])
        r = weight * (label - p)
        gradient = {
            "own": np.bincount(table.ravel(), np.repeat(r, table.shape[1]), len(marks) + 1), "near": near.T @ r, "shape": np.bincount(shape_of, r, 8), "bias": np.array([r.sum()]),
            "pairs": seen - pair_expectations(unary, starts, theta["pairs"], p, weight),
        }
        for k, g in gradient.items():
            g = (g - penalty * theta[k] * (k != "bias")) / total
            m, q = moment[k]
            m[:] = 0.9 * m + 0.1 * g
            q[:] = 0.999 * q + 0.001 * g * g
            theta[k] = theta[k] + rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-10)
        theta["own"][len(marks)] = 0
    model.own = {f: float(theta["own"][i]) for i, f in enumerate(marks)}
    model.near, model.shapes, model.bias, model.pairs = theta["near"], theta["shape"], float(theta["bias"][0]), theta["pairs"]
    return model


def fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic model of the texts' features, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-3, 0.05, 0.05, 0.05])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(h, x.T @ (y - q) - ridge * w)
    return w


def measured(model: Field):
    """(toxic, text) → (toxic, x): the features of whole texts."""

    def run(batches):
        for batch in T.slices(batches):
            offsets, _, codes, names, shapes, stops = tokens(T.texts_of(batch))
            x = features(tag(model, offsets, codes, names, shapes, stops)[0], offsets)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def fitted(ws: Workspace, train: DataFrame, max_rows: int, max_counted: int) -> Field:
    """The field and the score's model, from (doc_id, text, toxic)."""
    marks = list(markers(sampled(train, max_counted).select("text", "toxic")))
    if not marks:
        return Field()
    texts = ws.table(sampled(train, max_rows).dropDuplicates(["h", "x", "toxic"]).select("toxic", "text"))
    kinds = texts.mapInArrow(chains(marks), "toxic long, chain binary, n long").groupBy("toxic", "chain").agg(F.sum("n").alias("n"))
    model = train_field([(r["toxic"], bytes(r["chain"]), r["n"]) for r in kinds.orderBy("toxic", "chain").collect()], marks)
    rows = texts.mapInArrow(measured(model), "toxic long, x array<double>").collect()  # two times ``max_rows`` rows of four numbers
    rows = sorted((r["toxic"], r["x"]) for r in rows)
    if model.own:
        model.score = fit_score(np.array([x for _, x in rows]), np.array([y for y, _ in rows], float))
    ws.drop(texts)
    return model


def tag(model: Field, offsets, codes, names, shapes, stops) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens, and the chains' first tokens."""
    first = runs_of(offsets, stops[codes])
    if not len(codes):
        return np.empty(0), first
    index = {f: i for i, f in enumerate(model.own)}
    table = marker_table(names, index)
    own = np.array([*model.own.values(), 0.0])[table].sum(1)
    marker = (table < len(index)).any(1)
    v = len(names)
    prev = np.concatenate([[v], codes[:-1]])
    prev[first] = v
    nxt = np.concatenate([codes[1:], [v]])
    nxt[np.concatenate([first[1:], [len(codes)]]) - 1] = v
    unary = own[codes] + marker[prev] * model.near[0] + marker[nxt] * model.near[1] + model.shapes[shapes[codes]] + model.bias
    return marginals(unary, first, model.pairs), first


def span_list(text: str, chain: np.ndarray) -> list[dict]:
    """Character offsets of the runs of marked tokens."""
    out, last = [], None
    wanted = set(chain.tolist())
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if i in wanted:
            if last is not None and last[1] == i - 1:
                last[1] = i
                out[-1]["end"] = m.end()
            else:
                last = [i, i]
                out.append({"start": m.start(), "end": m.end()})
    return out


def scorer(model: Field):
    """(doc_id, text, ...) → (doc_id, held_out, score, predicted, toxic_tokens, spans)."""

    def run(batches):
        for batch in T.slices(batches):
            texts = T.texts_of(batch)
            offsets, _, codes, names, shapes, stops = tokens(texts)
            p, _ = tag(model, offsets, codes, names, shapes, stops)
            x = features(p, offsets)
            score = 1 / (1 + np.exp(-np.clip(x @ model.score, -40, 40)))
            marked = np.concatenate([[0], np.cumsum(p >= 0.5)])
            number = marked[offsets[1:]] - marked[offsets[:-1]]
            spans = [span_list(texts[i].as_py(), np.flatnonzero(p[offsets[i] : offsets[i + 1]] >= 0.5)) if number[i] else [] for i in range(len(number))]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(number), pa.array(spans, kind)],
                ["doc_id", "held_out", "score", "predicted", "toxic_tokens", "spans"],
            )

    return run


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 600, max_counted: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, toxic_tokens, spans."""
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("long").alias("toxic")).where(~held_out())
    texts = docs.select("doc_id", "text")
    train = texts.where(~held_out()).join(maybe_broadcast(known, 200_000), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    model = fitted(Workspace(docs.sparkSession), train, max_rows, max_counted)
    return texts.withColumn("held_out", held_out()).mapInArrow(scorer(model), "doc_id long, held_out boolean, score double, predicted int, toxic_tokens long, spans array<struct<start:int,end:int>>")
