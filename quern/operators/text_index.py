"""Stored postings for ranked full-text search.

``TextIndex.build`` writes, once, the postings of a table of texts in the order of term and document (ranges, so a term
of any frequency is spread over as many files as it needs) and the corpus figures beside them. A query
reads the row groups that can hold its terms, by their bounds; no text is tokenised again. ``refresh`` adds the texts that are
new since; a manifest names what counts, so readers see one state.

Defined results: NULL texts and texts without words are not indexed; a document is its key columns; scores
equal those of ``bm25.scores`` on the same texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.ledger import Ledger
from quern.operators import bm25
from quern.session import cut, fresh_path

class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, self.path)

    @property
    def state(self) -> dict | None:
        at = self.ledger.version()
        return self.ledger.read(at) if at else None

    def _write(self, texts: DataFrame, keys: list[str], text: str, stemming: bool) -> dict:
        folder = f"part-{uuid.uuid4().hex}"
        rows = cut(bm25.postings(texts.select(*keys, text), keys, text, stemming), "postings")
        rows.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys).write.parquet(f"{self.path}/{folder}")
        # A document's length is the sum of its counts; the first of its terms tells it once.
        docs, words = rows.agg(F.count_if("first"), F.coalesce(F.sum("tf"), F.lit(0))).first()
        return {"folder": folder, "docs": docs, "words": int(words)}

    def build(self, texts: DataFrame, keys: list[str], text: str, stemming: bool = False) -> TextIndex:
        part = self._write(texts, keys, text, stemming)
        schema = ", ".join(f"`{k}` {t}" for k, t in texts.select(*keys).dtypes) + ", term string, tf bigint, length int, first boolean"
        self.ledger.change(lambda _: {"keys": keys, "text": text, "stemming": stemming, "parts": [part], "schema": schema})
        return self

    def refresh(self, texts: DataFrame) -> int:
        """Index the texts whose key is not in the index yet; returns how many documents came in."""
        state = self.state
        known = self._postings(state).where("first").select(*state["keys"])
        new = texts.join(known, state["keys"], "left_anti")
        part = self._write(new, state["keys"], state["text"], state["stemming"])
        if part["docs"]:
            self.ledger.change(lambda old: {**old, "parts": [*old["parts"], part]})
        return part["docs"]

    def _postings(self, state: dict) -> DataFrame:
        folders = [f"{self.path}/{p['folder']}" for p in state["parts"] if p["docs"]]
        if not folders:
            return self.spark.createDataFrame([], state["schema"])
        frames = [self.spark.read.schema(state["schema"]).parquet(f) for f in folders]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def scores(self, query: str, operator: str = "or") -> DataFrame:
        """(keys.., score) as ``bm25.scores`` gives it, from the postings of the query's terms alone."""
        state = self.state
        terms = bm25.query_terms(query, state["stemming"])
        docs, words = sum(p["docs"] for p in state["parts"]), sum(p["words"] for p in state["parts"])
        hits = self._postings(state).where(F.col("term").isin(terms))
        return bm25.rank(hits, state["keys"], docs, words / docs if docs else 1.0, len(terms), operator)


def index_of(texts: DataFrame, keys: list[str], text: str, label: str, stemming: bool = False) -> TextIndex:
    """The index of a table that this application has built before under ``label``, else a new one in the run's folder."""
    spark = texts.sparkSession
    name = f"quern.index.{label}.{int(stemming)}"
    path = spark.conf.get(name, None)
    if path is None:
        path = fresh_path(spark, "index")
        TextIndex(spark, path).build(texts, keys, text, stemming)
        spark.conf.set(name, path)
    return TextIndex(spark, path)
