"""Training-data pipeline over documents: each stage reads what its predecessor wrote.

Rows are told apart by doc_id and a hash of the text, since a doc_id may be null or stand on many
texts. Stages filter rows in place, or by a join with the rows that go, so that texts are
shuffled only when they are written in order of their doc_id. Texts may be of any length, and
documents may have further columns of any name, which are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontaminate, language, mixing, ngram_join, token_store
from keystrata.llm.shared import table, written

#: Most rows to drop that are broadcast; more are shuffled to the documents.
MOST_BROADCAST = 1 << 20


def _content() -> Column:
    return F.xxhash64("text")


def _listed(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with or without the listed rows, by content and, where it is listed, doc_key; null equals null."""
    rows = rows.toDF(*(f"listed_{c}" for c in rows.columns))
    rows = F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows
    own = {"listed_content": _content(), "listed_doc_key": F.col("doc_id")}
    return docs.join(rows, [own[c].eqNullSafe(F.col(c)) for c in rows.columns], how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language, and gives every other document the language that the model reads.

    The labels only teach the model: where they are missing or wrong for a text, the later
    stages, which mix by language, go by the prediction. Null texts and texts without a letter
    go. With no label to learn from, texts with letters stay as they are. A null or repeated
    doc_id changes nothing, since each row is judged by its own text; no rows give no rows.
    """
    marked = docs.select("text", "lang", _content().alias("mark"))
    model = language.fit(marked, key="mark")
    if not model.langs:
        return docs.filter(language.letters_in(F.col("text")))
    judged = docs.withColumn("stage_judged", language.judgement(spark, model, F.col("text")))
    kept = judged.filter(F.col("stage_judged.lang_pred") != language.UNDETERMINED)
    return kept.withColumn("lang", F.col("stage_judged.lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies, a null one only if there is no other.

    Of rows with one doc_id in a group the one with the smaller hash of its text stays, of rows
    that are equal in both the least by their other columns. Texts without words are copies of
    each other if doc_id and text are equal. No rows give no rows.
    """
    gone, twice = ngram_join.copies(docs, k=5, percent=80)
    kept = _listed(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    again = _listed(kept, twice, "left_semi").groupBy("doc_id", _content()).agg(F.min(F.struct(*docs.columns)).alias("whole")).select("whole.*")
    return _listed(kept, twice, "left_anti").unionByName(again)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a full window of a benchmark item, or with two items that are shorter.

    Equal texts share their fate, whatever their doc_id. No rows give no rows.
    """
    found = decontaminate.occurrences(docs.select(_content().alias("mark"), "text"), table(spark, sf_dir, "benchmark"), key="mark")
    return _listed(docs, written(found.filter((F.size("full_items") > 0) | (F.size("items") > 1)).select("content").distinct(), "contaminated"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the calibrated sample takes; rows of one doc_id and text share their fate."""
    return mixing.sample(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards; doc_id, start, n_tokens and ids_crc32 of each row in them, null doc_ids first."""
    import public_tokenizers

    # Workers come from the stages before and hold memory of theirs.
    return token_store.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), ready=400_000)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token output", write_token_ids),
]

#: Language models and raking are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
