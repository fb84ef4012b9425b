"""Mixing sources to target weights.

Sizes are added up per source, each source gets a target, and the quotient of the two is the
source's repetition rate: every document is taken floor(rate) times, and once more if a hash of
its id and the seed falls below the fraction of the rate.  The draws are the same in every run.

Cases: a null text has size 0; a null source is a source of its own, ranked last; a source of size
0 has target 0 and gives nothing; repeated rows are documents of their own with the same draw; a
null doc_id draws as an empty id; a text of any length is counted whole; sources that tie do so by no
rule but their code points, which differ; other columns stay, and clashing ones give way; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import BROADCAST_ROWS, WORD, cut, ranked, salted, table

#: Weights of the sources in their order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: No source is taken more than this many times.
LIMIT = 3


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target, rate) for rows (source, size).

    Targets share the sum of all sizes by weight; what a target would have above limit times its
    source's size is shared among the others, by weight, until none is above.  That is one level
    for all: target = min(limit * size, level * weight).  The level rises from round to round, and
    each round asks the small table of sources for three sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(limit)).alias("most")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        above = F.col("most") < F.col("weight") * level
        n, taken, rest = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == full:
            break
        level, full = (total - taken) / rest, n
    target = F.least(F.col("most"), F.col("weight") * level)
    return sources.select("source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"))


def mix(documents: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents with size, source_size, target, rate and copies (how often the mix takes each); other columns stay."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sources = targets(documents.select(F.col(source).alias("source"), size.alias("size")), weights, limit)
    # a null source has a name of its own here, so that the join is on plain equality
    named = lambda c: [F.coalesce(F.col(c), F.lit("")).alias("_source"), F.col(c).isNull().alias("_none")]
    sources = sources.select(*named("source"), "source_size", "target", "rate")
    names = [c for c in documents.columns if c not in ("size", "source_size", "target", "rate", "copies", "_source", "_none")]
    sized = documents.select(*names, size.alias("size"), *named(source))
    few = sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mixed = sized.join(F.broadcast(sources), ["_source", "_none"]) if few else salted(sized, sources, ["_source", "_none"], key)
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / float(1 << 52)
    whole = F.floor("rate")
    return mixed.withColumn("copies", whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).drop("_source", "_none")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, 3.0::double * sum(size)::double as most,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as weight
  from d group by source
), r as (
  select *, row_number() over w as k, sum(source_size) over ()::double as total,
         coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as below,
         sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following)::double as rest
  from s window w as (order by most / weight, source nulls last)
), l as (
  select coalesce((select (total - below) / rest from r where most >= weight * ((total - below) / rest) order by k limit 1), 0)::double as level
), t as (
  select source, source_size, least(most, weight * level) as target,
         case when source_size > 0 then least(most, weight * level) / source_size else 0 end as rate
  from s, l
), u as (
  select d.doc_id, d.size, t.source_size, t.target, t.rate,
         ('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || ':42'), 1, 13))::bigint::double / 4503599627370496.0 as draw
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken
from u
"""
