"""A corpus pipeline: toxic documents go, near copies and benchmark passages go, secrets are masked, sources are mixed.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``,
and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import crc_fold, read_table, scratch, staged
from nearfield.llm.decontam import contamination
from nearfield.llm.mixing import mix
from nearfield.llm.ngram_join import ngram_jaccard
from nearfield.llm.secrets import find_secrets, redact_secrets
from nearfield.llm.toxicity import score, train


#: Ids up to this number are broadcast (32 MB).
MOST_BROADCAST = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic (score below 0.5).

    Null and empty texts score as texts without words; repeated rows stay or go
    together; without labels nothing goes.  Very long texts are read whole.
    """
    with scratch(spark):
        model = train(docs, read_table(spark, sf_dir, "labels"), crc_fold("doc_id", 5) != 0)
    return _aside(docs, lambda d: score(d, model).where("score < 0.5"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, null last.

    Rows are told apart by doc_id and text, so repeated and null ids lose no text
    of their own; of rows that agree in both any one stays.  Texts without words
    are copies of nothing and all stay.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    with scratch(spark):
        found = staged(ngram_jaccard(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id"))
        twice = staged(found.groupBy("key").count().where("count > 1").select("key"), stays=True)
        groups = found.distinct().groupBy("component_id").count().where("count > 1").select("component_id")
        own = docs.select(key.alias("key"), "doc_id").distinct()
        members = staged(found.distinct().join(groups, "component_id", "left_semi").join(own, "key"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        stays = members.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("key"))
        going = staged(members.select("key").join(stays, "key", "left_anti"), stays=True)
    if going.count() <= MOST_BROADCAST:  # else texts and keys are joined by shuffle
        going = F.broadcast(going)
    name = _fresh(docs, "key")
    rows = docs.withColumn(name, key).join(going.withColumnRenamed("key", name), name, "left_anti")
    many = twice.count()
    if not many:
        return rows.select(docs.columns)
    again = (F.broadcast(twice) if many <= MOST_BROADCAST else twice).withColumnRenamed("key", name)
    single = rows.join(again, name, "left_semi").groupBy(name).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return rows.join(again, name, "left_anti").select(docs.columns).unionByName(single.select(docs.columns))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark passages they held; one that held nothing else goes.

    Null and empty texts stay as they are; very long ones are searched whole;
    repeated rows are cut alike; an empty benchmark cuts nothing.
    """
    benchmark = read_table(spark, sf_dir, "benchmark")
    emptied = (F.size("spans") > 0) & (F.trim("text") == "")
    return _sized(_aside(docs, lambda d: contamination(d, benchmark, cut=True).where(~emptied)), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by its kind; all rows stay, null and empty texts as they are."""
    return _sized(_aside(docs, lambda d: redact_secrets(find_secrets(d))), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words and how many words it takes of them.

    Texts without words are never taken; rows with equal ids are drawn by size.
    Columns of the input named size, source_size, target or taken give way to the mix's own.
    """
    return mix(docs, docs.columns).where("taken > 0")


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _aside(docs: DataFrame, stage) -> DataFrame:
    """Runs a stage while columns with the names that operators add stand aside under other names."""
    own: dict[str, str] = {}
    moved = docs
    for c in docs.columns:
        if c.lower() in ("score", "n_words", "items", "spans", "base"):
            own[c] = _fresh(moved, f"_{c}")
            moved = moved.withColumnRenamed(c, own[c])
    return stage(moved).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def _sized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text where it was known."""
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(kind)).select(docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The stages learn a classifier and test strings for randomness; SQL does not express them.  Tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and goes at the end."""
    with scratch(spark):
        docs = read_table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
