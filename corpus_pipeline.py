"""From raw documents to packed training sequences: five stages, each one operator.

Every stage reads what its predecessor kept as a Parquet table and judges that input alone. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm import decontaminate, jaccard, packing, pii, tokens, toxicity
from almanac.session import materialize, scratch_path

#: Ids, of eight bytes each, that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
PACKING_TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents predicted toxic. Labels are those of the rows that are not held out.
    A null or empty text is no sentence and stays unless the bias alone says otherwise."""
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out(3, 1))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where("predicted = 0").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links, the one with the smallest id stays.

    Documents with an empty set, and those with a null id, are in no group and stay. Rows that
    repeat an id are one document; the one with the least text and other columns stays.
    """
    gone = materialize(jaccard.join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select("doc_id").join(gone, "doc_id", "left_anti"), "repeated")
    single = docs.join(_small(gone.unionByName(repeated)), "doc_id", "left_anti")
    if repeated.isEmpty():
        return single.select(*docs.columns)
    row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    again = docs.join(_small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return single.select(*docs.columns).unionByName(again.select(*docs.columns))


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if its counted rows are few enough for every executor."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that contain a benchmark item. Null and empty texts contain none and stay."""
    found = decontaminate.search(docs, _table(spark, sf_dir, "benchmark"), "__matches")
    return found.where(F.size("__matches") == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in ``text`` by its kind in brackets; ``n_chars`` follows the text. All rows stay."""
    clean = pii.redact(pii.detect(docs, pii.fit(docs)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.tokenizer_path(PACKING_TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack),
]

#: No SQL can train and apply the stages' models; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
