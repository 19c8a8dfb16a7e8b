"""Stages of a corpus pipeline, each over whatever its predecessor kept.

A stage takes ``(spark, docs, sf_dir)``; ``docs`` has the columns of documents
(``doc_id, text, lang, source, n_chars``) and may have any others.  These come
back as they were, whatever their names, since operators see them as fields of
one struct only.  Common to all stages: rows without an id are rows like any
other, a very long text is one value and is read whole, and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm import language, minhash, mixing, packing, secrets
from wayside.llm.rows import unwrapped, wrapped

#: A text is rejected if its language knows a smaller share of its n-grams.
LEAST_KNOWN = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing ``lang`` is filled in.

    Null and empty texts, texts without letters and those with n-grams that no
    language knows go; so does everything if no row of ``docs`` has a language
    to learn from.  Equal texts share one fate, repeated rows all stay or go.
    """
    names = ("doc_id", "text", "lang")
    found = language.identify(wrapped(docs, *names), language.learn(docs.select(*names)))
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_KNOWN))
    return unwrapped(kept, docs.columns, names, lang=F.coalesce("lang", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Of repeated rows one stays.  Null and blank texts have no near-duplicates;
    rows without an id all stay.
    """
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark.

    Of documents with a secret ``n_chars`` is that of the new text; all others,
    those with null and empty texts too, stay as they are.
    """
    names = ("doc_id", "text", "n_chars")
    found = secrets.scan(wrapped(docs, *names)).withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans")))
    n_chars = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return unwrapped(found, docs.columns, names, n_chars=n_chars)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that the domains' expected tokens match the targets.

    Equal rows are repeated equally often.  Null and empty texts have no tokens,
    so their rate moves no total; it follows from their posterior as any.
    """
    names = ("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(wrapped(docs, *names), mixing.domains_of(labels), mixing.TARGETS).where("copies > 0")
    return unwrapped(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns, names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens.

    Null and empty texts are a piece with the end id alone, repeated rows give
    their pieces again, longer texts are cut; further columns are left behind.
    """
    return packing.pack(packing.tokenize(docs))
