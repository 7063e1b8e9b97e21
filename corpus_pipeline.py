"""A training-data pipeline of five stages over `documents`: quality rules, near duplicates, repeated passages,
benchmark decontamination and the mix of sources.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of `documents`. NULL and empty texts fail the quality rules; a document
whose words all repeat earlier ones stays with the text that is left, and the mix takes nothing from it. Documents with a
NULL doc_id are near duplicates of nothing and lose no passages; near duplicates stay or go by doc_id, in all other stages
each row of one doc_id has a result of its own. What a stage decides is
written as a small table, and the tables made on the way to it are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontamination, jaccard_join, mixing, quality_rules, repeated_phrases
from panelwright.llm.queries import O as _O
from panelwright.llm.queries import contamination_sql, jaccard_sql, repeats_sql, table
from panelwright.session import cut_lineage, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LIKENESS = jaccard_join.Likeness(n=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. The row travels with its measures, so nothing is joined."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = quality_rules.judge(quality_rules.measure(rows, keep=("row",)))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked documents."""
    first = settle(lambda: jaccard_join.link_components(docs.where("doc_id is not null"), LIKENESS).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(first, "doc_id", "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that an earlier document has."""
    kept = repeated_phrases.remove_ranges(docs, settle(lambda: repeated_phrases.removal_ranges(docs)))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=row)
    return marked.where("not contaminated").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of them as their text."""
    new = ("size", "source_size", "target", "taken")
    rows = mixing.mix_documents(docs.drop(*new), keep=True).where("taken > 0").select("row.*", *new)
    rows = rows.withColumn("text", mixing.taken_text(F.col("text"), F.col("size"), F.col("taken")))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("source_mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


def _on(name: str, source: str) -> str:
    return _O[name].replace("documents", source)


_WS = r"\x20\x09-\x0D"

ORACLE_SQL = rf"""
with s1 as materialized (
  select * from documents where doc_id in (select doc_id from ({_on("op1_quality_rules", "documents")}) where kept)
),
s2 as materialized (
  select * from s1 where doc_id in (
    select doc_id from (with recursive {jaccard_sql(LIKENESS.n, LIKENESS.percent, "s1")} select * from joined) where component_id = doc_id) or doc_id is null
),
s3 as materialized (
  with {repeats_sql("s2")},
  cut as (
    select s2.*, places, regexp_extract(text, '^[{_WS}]*') || array_to_string(
        list_filter(regexp_extract_all(text, '[^{_WS}]+[{_WS}]*'), lambda x, i: not list_contains(places, i)), '') as rest
    from s2 left join lists using (doc_id)
  ),
  done as (
    select *, case when places is null then text when regexp_matches(text, '[{_WS}]$') then rest
      else regexp_replace(rest, '[{_WS}]+$', '') end as kept
    from cut
  )
  select doc_id, kept as text, lang, source, length(kept)::bigint as n_chars from done
),
s4 as materialized (
  select * from s3 where doc_id not in (select doc_id from (with {contamination_sql("s3")} select * from marked) where contaminated)
),
s5 as (
  select doc_id, text, lang, source, size, source_size, target, taken, taken // size as whole, taken % size as part
  from s4 join ({_on("op4_source_mix", "s4")}) using (doc_id) where taken > 0
),
texts as (
  select * exclude (text), array_to_string(list_concat(
      list_transform(range(whole), lambda k: text),
      case when part > 0 then [array_to_string(regexp_extract_all(text, '[^{_WS}]+')[1:part], ' ')] else [] end), chr(10)) as text
  from s5
)
select doc_id, text, lang, source, length(text)::bigint as n_chars, size, source_size, target, taken from texts
"""

Q = {"pipeline": run}
O = {"pipeline": ORACLE_SQL}  # noqa: E741
