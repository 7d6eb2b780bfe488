"""The corpus pipeline: language ID, quality, near duplicates, mixing, encoding. Counts as part of plumbline.llm."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard, langid, mixing, quality, tokens
from plumbline.llm.queries import BPE_RANKS
from plumbline.tables import begun, new_path, removed, removed_since, written

#: A text is in no known language if it is und or its profile is this far from all.
LEAST_LANGUAGE_SCORE = 0.2
#: Near duplicates share this percentage of the union of their shingles of so many words.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 80


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(docs: DataFrame, row: str) -> DataFrame:
    """The documents with a name for each row, since doc_id may be null or repeat.

    It is the row's place in its file, which stays the same however often and on however many executors a plan runs. Rows
    that come from no file are numbered and written down first.
    """
    try:
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        return docs.withColumn(row, place)
    except AnalysisException:
        return written(docs.withColumn(row, F.monotonically_increasing_id().cast("string")), "numbered")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the documents themselves name.

    Null texts, texts without a letter and those too far from every profile go; so do all where no row names a language.
    Rows with a null language are judged like others. Repeated rows are judged alike; an empty table stays empty. Whatever
    columns there are stay as they are.
    """
    known = langid.profiles(docs)
    lang, score = fresh("lang_found", docs), fresh("lang_score", docs)
    told = langid.identify(docs, known, docs.columns, names=(lang, score))
    return told.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null texts and texts without words go. Repeated rows are judged alike, and a table of one text repeated has one
    judgement; an empty table stays empty. Whatever columns there are stay as they are.
    """
    names = tuple(fresh(n, docs) for n in ("good_posterior", "good_score", "good_found"))
    return quality.score(docs, quality.learn(docs), docs.columns, names=names).where(F.col(names[2])).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id, null ones last.

    Of repeated rows one stays, and of rows without words each, since an empty set is near nothing. An empty table stays
    empty. Whatever columns there are stay as they are.
    """
    row = fresh("row_name", docs)
    numbered = rows_of(docs, row)
    groups = written(jaccard.similar_groups(numbered, row, "text", k=SHINGLE_WORDS, percent=LEAST_SIMILARITY).select(row, "component_id"), "groups")
    first = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row))
    stay = numbered.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(first.alias(row))
    return numbered.join(stay.select(row), row, "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them.

    Null sources are one source; rows without words are taken as often as their source's whole copies say. Repeated rows
    are documents of their own; an empty table stays empty. Whatever columns there are stay as they are.
    """
    row, copy = fresh("row_name", docs), fresh("copy_no", docs)
    numbered = rows_of(docs, row)
    taken = mixing.mix(numbered, carry=[row]).where("copies > 0").select(row, F.col("copies").alias(copy))
    again = F.explode(F.sequence(F.lit(1), F.col(copy)))
    return numbered.join(taken, row).withColumn(copy, again).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their hashes: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids.

    Null texts count as empty; repeated rows each give a row; other columns go; an empty table gives none.
    """
    import public_tokenizers

    return tokens.encode_texts(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [("language_id", language), ("quality_classifier", good), ("ngram_jaccard_join", distinct), ("mix_sources", mixed), ("byte_bpe", encoded)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    A stage's table is deleted once the next one is written, and the tables within a stage once it is, so that one copy of
    the texts is left at the end.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        mark, path = begun(), new_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), name, path)
        removed_since(spark, mark, path)
        if last is not None:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
