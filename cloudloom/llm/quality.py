"""Operator 4, quality rules by distribution divergence.

Each text's histogram of character classes and of common words is compared to its language's reference by the
Jensen-Shannon distance (base 2, 0 to 1). References come from all rows of the corpus: for each language and class the
median of the texts' shares, each share rounded to 1/``STEPS`` (so that junk moves little, even a third of all rows), and the
``COMMON`` words that most texts of the language hold. Short texts are noisy: below ``CLASS_CHARS`` characters and below
``COMPARED_WORDS`` words the comparisons are not made (the guards), and the base rules alone decide.

Two passes over the texts: one counts words and rounded shares, the other measures and judges each text where it lies.

Base: too few words, or too many words in repeated windows of eight words.

Defined cases: a null text is the empty text; it fails the base (0 words); a null language is a language of its own; a
language with few texts is its own reference; repeated rows are judged alike; an empty table gives an empty result;
columns besides ``doc_id, text, lang`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace, is_small

CLASSES = ("lower", "upper", "digit", "stop", "symbol", "other")
SYMBOLS = "#*$%&|<>"
STEPS = 1000
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.5
CLASS_CHARS, COMPARED_WORDS, COMMON = 100, 100, 64


def repeated_words(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Words of each text in 8-word windows that it holds twice or more."""
    n = len(offsets) - 1
    windows, doc = T.window_hashes(h, offsets, WINDOW)
    if not len(windows):
        return np.zeros(n, np.int64)
    order = np.lexsort((windows, doc))
    w, d = windows[order], doc[order]
    same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(w), bool)
    twice[1:] |= same
    twice[:-1] |= same
    counts = np.diff(offsets)
    per = np.maximum(counts - WINDOW + 1, 0)  # windows of each text
    first_window = np.concatenate([[0], np.cumsum(per)[:-1]])
    at = order[twice]
    begin = offsets[:-1][doc[at]] + (at - first_window[doc[at]])
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[offsets[1:]] - covered[offsets[:-1]]


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def class_counts(words: pa.Array) -> np.ndarray:
    """Characters of each class; a row for each word."""
    count = lambda pattern: pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [count(p) for p in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]")]
    every = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([*parts, every - sum(parts), every], axis=1)


def counts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Offsets, codes and vocabulary of a batch's words; the characters of each class by text."""
    offsets, words = T.split_words(T.texts_of(batch))
    codes, vocabulary = T.coded(words)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    per_word = class_counts(vocabulary)
    return offsets, codes, vocabulary, np.stack([np.bincount(doc, per_word[codes, i], batch.num_rows).astype(np.int64) for i in range(len(CLASSES) + 1)], axis=1)


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
MARKS = ".,;:!?'\"()-" + SYMBOLS


def plain(words: pa.Array) -> pa.Array:
    """Lower-cased words without the marks around them."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)


def frequencies(batches):
    """(lang, text) → (lang, class, key, n): texts of a batch that hold word ``key`` (class -1), or whose share of a class rounds to step ``key``."""
    for batch in T.slices(batches):
        offsets, codes, vocabulary, counts = counts_of(batch)
        langs = batch.column("lang").dictionary_encode(null_encoding="encode")  # a null is a language of its own
        lang_codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        again, names = T.coded(plain(vocabulary))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        width = max(1, len(names))
        pairs = np.unique(doc * width + again[codes]) if len(codes) else np.empty(0, np.int64)
        both, n = np.unique(lang_codes[pairs // width] * width + pairs % width, return_counts=True)
        word = names.take(pa.array(both % width)).cast(pa.string())
        parts = [(both // width, np.full(len(both), -1), word, n)]
        full = np.flatnonzero(counts[:, -1] > 0)
        mass = counts[full, -1]
        for i in range(len(CLASSES)):
            step = (2 * STEPS * counts[full, i] + mass) // (2 * mass)
            both, n = np.unique(lang_codes[full] * (STEPS + 1) + step, return_counts=True)
            parts.append((both // (STEPS + 1), np.full(len(both), i), pa.array(both % (STEPS + 1)).cast(pa.string()), n))
        lang, kind, n = (np.concatenate([p[j] for p in parts]) for j in (0, 1, 3))
        key = pa.concat_arrays([p[2] for p in parts])
        out = pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)).cast(pa.string()), pa.array(kind, pa.int32()), key, pa.array(n)], ["lang", "class", "key", "n"])
        yield out.filter(pc.not_equal(key, ""))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p and q; 0 for rows without mass."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.round(np.sqrt(np.clip((left + right) / 2, 0, 1)), 12)  # whatever the order of the sums


@dataclass
class Reference:
    """What a language's texts are held against: the median share of each class (all 0 if unknown), its common words and their counts."""

    shares: np.ndarray
    words: dict[str, int]


def reference_rows(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(lang, class, key, n): of each language the ``COMMON`` commonest words (class -1), and the median step of each class."""
    counts = ws.table(docs.select("lang", "text").mapInArrow(frequencies, "lang string, class int, key string, n long").groupBy("lang", "class", "key").agg(F.sum("n").alias("n")))
    place = F.expr("row_number() over (partition by lang order by n desc, key)")
    words = counts.where("class < 0").withColumn("place", place).where(F.col("place") <= COMMON).select("lang", "class", "key", "n")
    steps = counts.where("class >= 0").select("lang", "class", F.col("key").cast("int").alias("step"), "n")
    below, every = F.expr("sum(n) over (partition by lang, class order by step)"), F.expr("sum(n) over (partition by lang, class)")
    steps = steps.withColumns({"below": below, "every": every}).where("2 * below >= every").groupBy("lang", "class").agg(F.min("step").alias("step"))
    rows = ws.table(words.union(steps.select("lang", "class", F.col("step").cast("string"), F.lit(0).cast("long"))))
    ws.drop(counts)
    return rows


def reference(rows) -> Reference:
    """Of a language's (class, key, n)."""
    shares, words = np.zeros(len(CLASSES)), {}
    for kind, key, n in rows:
        if kind < 0:
            words[key] = n
        else:
            shares[kind] = int(key) / STEPS
    return Reference(shares, words)


def word_divergence(references: dict[str | None, Reference]):
    """(languages, offsets, codes, vocabulary) of texts → their word distances."""
    index: dict[str, int] = {}
    for r in references.values():
        for w in r.words:
            index.setdefault(w, len(index))
    known = pa.array(list(index), pa.large_string())
    langs = {lang: i for i, lang in enumerate(references)}
    weights = np.zeros((len(references) + 1, len(index)))
    for lang, r in references.items():
        for w, n in r.words.items():
            weights[langs[lang], index[w]] = n

    def measure(of: list[str | None], offsets: np.ndarray, codes: np.ndarray, vocabulary: pa.Array) -> np.ndarray:
        n = len(of)
        at = pc.fill_null(pc.index_in(plain(vocabulary), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        own = np.bincount(doc[at >= 0] * max(1, len(index)) + at[at >= 0], minlength=n * max(1, len(index))).reshape(n, -1)[:, : len(index)].astype(float) if index else np.zeros((n, 0))
        which = np.array([langs.get(x, len(references)) for x in of], np.int64)
        mask = weights[which] > 0
        own = own * mask
        rest = np.diff(offsets) - own.sum(1)
        # common words against each other, with the others as one more place: half of a language's words are common ones
        p = np.hstack([own, rest[:, None]])
        q = weights[which]
        q = np.hstack([q / np.maximum(q.sum(1, keepdims=True), 1) * 0.5, np.full((n, 1), 0.5)])
        return distance(p, q)

    return measure


def describe(batch: pa.RecordBatch, references: dict[str | None, Reference], measure, max_class: float, max_word: float) -> list[pa.Array]:
    """The columns of ``BASE``."""
    texts = T.texts_of(batch)
    offsets, codes, vocabulary, counts = counts_of(batch)
    h = T.hashes(vocabulary)[codes] if len(codes) else np.empty(0, np.uint64)
    langs = batch.column("lang").to_pylist()
    # a line is equal to an earlier one only if its words are; most texts have one line or none such
    lines = [repeated_lines(t) if "\n" in t else 0 for t in texts.to_pylist()]
    n_words, repeats = np.diff(offsets), repeated_words(offsets, h)
    unknown = np.zeros(len(CLASSES))
    medians = np.array([references[x].shares if x in references else unknown for x in langs]).reshape(len(langs), -1)
    class_distance = np.where((counts[:, -1] > 0) & (medians.sum(1) > 0), distance(counts[:, :-1].astype(float), medians), 0.0)
    word_distance = measure(langs, offsets, codes, vocabulary)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n_words)
    far = ((counts[:, -1] >= CLASS_CHARS) & (class_distance > max_class)) | ((n_words >= COMPARED_WORDS) & (word_distance > max_word))
    return [pa.array(x) for x in (n_words, counts[:, -1], counts[:, CLASSES.index("symbol")], np.array(lines, np.int64), repeats, failed, ~failed & ~far, class_distance, word_distance)]


def judged(references: dict[str | None, Reference] | None, carried: list[str], max_class: float, max_word: float):
    """(carried columns, text, lang[, _reference]) → carried columns and ``BASE``; without references, each row brings its language's."""
    names = [*carried, *(x.split()[0] for x in BASE.split(", "))]

    def run(batches):
        known = references
        measure = word_divergence(known) if known is not None else None
        for batch in T.slices(batches):
            if references is None:
                known = {}
                for lang, rows in zip(batch.column("lang").to_pylist(), batch.column("_reference"), strict=True):
                    if lang not in known:
                        known[lang] = reference((r["class"], r["key"], r["n"]) for r in rows.as_py() or [])
                measure = word_divergence(known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *describe(batch, known, measure, max_class, max_word)], names)

    return run


def judge(ws: Workspace, docs: DataFrame, *carried: str, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, languages: int = 1000) -> DataFrame:
    """One row per row of ``docs``: the carried columns (doc_id if none is named), base counts, base_failed, kept, class_distance, word_distance.

    References of at most ``languages`` languages are held by each task; those of more come with the rows, by a join. Both give the
    same results.
    """
    carried = carried or ("doc_id",)
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], *[c for c in ("text", "lang") if c not in carried])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carried)]) + ", " + BASE
    found = reference_rows(ws, docs)
    if is_small(found, languages * (COMMON + len(CLASSES))):
        by_lang: dict[str | None, list[tuple]] = {}
        for r in found.collect():
            by_lang.setdefault(r["lang"], []).append((r["class"], r["key"], r["n"]))
        return rows.mapInArrow(judged({k: reference(v) for k, v in by_lang.items()}, list(carried), max_class, max_word), kind)
    tables = found.groupBy(F.col("lang").alias("_of")).agg(F.collect_list(F.struct("class", "key", "n")).alias("_reference"))  # at most 70 rows a language
    joined = rows.join(ws.table(tables), F.col("lang").eqNullSafe(F.col("_of")), "left").drop("_of")
    return joined.mapInArrow(judged(None, list(carried), max_class, max_word), kind)
