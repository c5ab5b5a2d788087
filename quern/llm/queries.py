"""Registered queries of the operators on training text, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import conversations, mixing, packing, pii, secrets, subjects
from quern.session import cut, table


def _archive(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("messages", "parts", "sessions", "hosts")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.dropped(*_archive(spark, sf))


def p2_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.rebuilt(*_archive(spark, sf))


def p2_fragments(spark: SparkSession, sf: str) -> DataFrame:
    messages, _, _, hosts = _archive(spark, sf)
    deliveries = cut(conversations.timed(messages, hosts), "deliveries")
    return conversations.contigs(deliveries, cut(conversations.survivors(deliveries), "survivors"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find(table(spark, sf, "parts"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.redact(table(spark, sf, "parts"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "parts"), table(spark, sf, "messages"))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "parts"), table(spark, sf, "messages"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_jobs(table(spark, sf, "documents"), table(spark, sf, "packing_jobs"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf), table(spark, sf, "packing_jobs"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets")
    return mixing.membership(table(spark, sf, "documents"), targets), targets


def p9_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.draw(*_mix(spark, sf)).select("mix_name", "doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    members, targets = _mix(spark, sf)
    return mixing.report(cut(mixing.draw(members, targets), "drawn"), members, targets)


def p9_posteriors(spark: SparkSession, sf: str) -> DataFrame:
    """What the source classifier says of every document, beside the source it names."""
    documents = table(spark, sf, "documents")
    return documents.select("doc_id", "source").join(mixing.posteriors(documents, table(spark, sf, "mix_targets")), "doc_id")


def _subject_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("documents", "doc_labels", "subjects")]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.found(*_subject_tables(spark, sf))


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.composition(*_subject_tables(spark, sf))


QUERIES = {f.__name__: f for f in (p2_found, p2_conversations, p2_fragments, p4_found, p4_redacted, p6_found, p6_redacted, p8_packed, p8_fill, p9_drawn, p9_shares, p9_posteriors, p10_found, p10_composition)}
ORACLES: dict[str, str] = {}
