"""Operator 7, mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture's bytes (its share of the corpus to the power ``alpha``, or a given
weight), hence a mean repetition rate = target bytes / own bytes. A document's uniform number comes from the MD5 of
seed and doc_id; the Poisson distribution of its source is inverted at it; the document is exploded into so many copies,
and copies are dealt over all partitions and ordered by another MD5. Of a distribution only the counts within 12 standard
deviations (and 30) of the mean are tabled, where all of its mass lies in double precision. Documents of sources with a rate
above ``LARGE`` are exploded in two steps with an exchange between, so that no task makes all copies of one.

Defined cases: a null source is a source of its own; a null doc_id hashes as the empty string; a null text has no
bytes; a source without bytes is never repeated (rate 0), as nothing of it can reach a share of bytes; a source that given
``weights`` don't name has the weight 0, and no copies (None names the null source); repeated rows are
replicated each by itself, alike; an empty table gives an empty result; columns besides ``doc_id, source, text`` pass
through, but for ``copy, n_copies, shuffle_key`` and names that begin with ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._common import Workspace, maybe_broadcast


LARGE = 1000
EXACT = 30  # logarithms of factorials are summed up to here; beyond, Stirling's series is exact to double precision


def rates(docs: DataFrame, alpha: float, epochs: float, weights: dict[str | None, float] | None) -> DataFrame:
    """``(_mix_source, _mix_rate)``: mean repetitions of a document of each source."""
    sizes = docs.groupBy(F.col("source").alias("_mix_source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("double").alias("bytes")).where("bytes > 0")
    if weights is None:
        sizes = sizes.withColumn("w", F.pow("bytes", F.lit(alpha)))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()), "name string, w double").where("w > 0")
        sizes = sizes.join(F.broadcast(table), F.col("_mix_source").eqNullSafe(F.col("name")))
    all_of = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("w").alias("all_w"))
    return sizes.crossJoin(F.broadcast(all_of)).select("_mix_source", (F.lit(epochs) * F.col("w") / F.col("all_w") * F.col("all_bytes") / F.col("bytes")).alias("_mix_rate"))


def with_steps(rate: DataFrame) -> DataFrame:
    """Adds ``_mix_from`` and ``_mix_cdf``: the Poisson distribution function from a count where it is 0 to where it is 1, in double precision."""
    spread = 12 * F.sqrt("_mix_rate") + 30
    low = F.floor(F.col("_mix_rate") - spread)
    ends = rate.where("_mix_rate > 0").withColumn("_mix_from", F.when(low >= EXACT, low).otherwise(0).cast("long")).withColumn("top", F.ceil(F.col("_mix_rate") + spread).cast("long"))
    counts = ends.select("_mix_source", "_mix_rate", "_mix_from", F.explode(F.expr("sequence(_mix_from, top)")).alias("j"))
    few = "aggregate(sequence(1L, greatest(j, 1L)), 0D, (s, i) -> s + ln(cast(i as double)))"
    # for many: j ln(rate) - rate - ln j!, with what cancels taken together
    many = "j * ln(_mix_rate / j) - (_mix_rate - j) - 0.5 * ln(2 * pi() * j) - 1 / (12D * j) + 1 / (360D * j * j * j) - 1 / (1260D * j * j * j * j * j)"
    mass = counts.withColumn("p", F.expr(f"exp(case when j < {EXACT} then j * ln(_mix_rate) - _mix_rate - {few} else {many} end)"))
    running = mass.withColumn("cdf", F.expr("sum(p) over (partition by _mix_source order by j)"))
    steps = F.expr("transform(array_sort(collect_list(struct(j, cdf))), s -> s.cdf)")  # some 24 square roots of the rate
    return running.groupBy("_mix_source", "_mix_rate", "_mix_from").agg(steps.alias("_mix_cdf"))


def mix(docs: DataFrame, alpha: float = 0.7, epochs: float = 1.0, seed: int = 7, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The mixture: ``docs``' columns, ``copy`` (from 0), ``n_copies``, ``shuffle_key``; no copy for a count of 0."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_mix")])
    rate = Workspace(docs.sparkSession).table(rates(docs.select("source", "text"), alpha, epochs, weights))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    steps = maybe_broadcast(with_steps(rate), 10_000)
    drawn = docs.drop("copy", "n_copies").join(steps, F.col("source").eqNullSafe(F.col("_mix_source")))
    drawn = drawn.withColumn("n_copies", F.col("_mix_from") + F.size(F.filter("_mix_cdf", lambda c: c <= u))).where("n_copies > 0").drop("_mix_cdf")
    if rate.where(F.col("_mix_rate") > LARGE).isEmpty():
        copies = drawn.withColumn("copy", F.explode(F.expr("sequence(0L, n_copies - 1)")))
    else:
        few = drawn.where(F.col("_mix_rate") <= LARGE).withColumn("copy", F.explode(F.expr("sequence(0L, n_copies - 1)")))
        blocks = drawn.where(F.col("_mix_rate") > LARGE).withColumn("_mix_block", F.explode(F.expr(f"sequence(0L, n_copies - 1, {LARGE}L)"))).repartition("doc_id", "_mix_block")
        many = blocks.withColumn("copy", F.explode(F.expr(f"sequence(_mix_block, least(n_copies, _mix_block + {LARGE}) - 1)")))
        copies = few.unionByName(many.drop("_mix_block"))
    out = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.col("copy").cast("string"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")], "copy", "n_copies", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = """
with sizes as (select source, cast(sum(coalesce(strlen(text), 0)) as double) as bytes from documents group by source),
weighed as (select source, bytes, pow(bytes, 0.7) as w from sizes where bytes > 0),
rates as (select source, w / (select sum(w) from weighed) * (select sum(bytes) from weighed) / bytes as rate from weighed),
terms as (select source, j, exp(j * ln(rate) - rate - coalesce(
            (select sum(ln(cast(i as double))) from range(1, 200) t(i) where i <= j), 0)) as p
          from rates, range(0, 120) s(j) where j <= ceil(rate + 12 * sqrt(rate) + 30)),
steps as (select source, j, sum(p) over (partition by source order by j) as cdf from terms),
drawn as (select d.doc_id, d.source, d.text, (select count(*) from steps s where s.source is not distinct from d.source
            and s.cdf <= cast(('0x' || substr(md5('7:' || coalesce(cast(d.doc_id as varchar), '')), 1, 12)) as bigint) / 281474976710656.0) as n_copies
          from documents d)
select doc_id, source, text, copy, n_copies, md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(copy as varchar)) as shuffle_key
from (select *, unnest(range(0, n_copies)) as copy from drawn where n_copies > 0)
"""
