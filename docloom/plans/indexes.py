"""Registered queries of the stored indexes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.analyzer import analyzed, query_terms
from docloom.operators import retrieval
from docloom.operators.hdbscan import hdbscan
from docloom.operators.text_index import TextIndex
from docloom.operators.vector_index import VectorIndex
from docloom.plans import search
from docloom.sources.shared import shared_folder
from docloom.sources.tables import items, vectors

QUERIES, SQL = {}, {}
QUESTION = "Licensed under the Apache Licenses, versions of running software"


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("bm25_analyzed")
def bm25_analyzed(spark, d):
    """A question in words, over the terms of the analyzer."""
    return retrieval.bm25(items(spark, d), query_terms(QUESTION), 10, analyzed)


@register("bm25_segments", search.SQL["bm25_top10"].replace("from documents)", "from documents where doc_id % 10 <> 3)"))
def bm25_segments(spark, d):
    """An index that grew in four steps and lost a tenth of its items: one half, the other half with some of the first again, a deletion, a merge."""
    it = items(spark, d).select("item_id", "content")
    index = TextIndex.create(spark, fresh(spark, "segments"), "plain")
    index.add(it.where("item_id % 2 = 0"))
    index.add(it.where("item_id % 2 = 1 or item_id % 10 = 4"))
    index.delete(it.where("item_id % 10 = 3").select("item_id"))
    index.merge(1)
    return index.search(list(search.TERMS), 10)


@register("vector_index_knn")
def vector_index_knn(spark, d):
    """The 10 nearest of every vector whose id is divisible by 50, from an index of all; its recall is held against brute force in tests."""
    v = vectors(spark, d).select("item_id", "embedding")
    index = VectorIndex.create(spark, fresh(spark, "vectors"), v)
    return index.search(v.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"))


@register("hdbscan_clusters")
def hdbscan_clusters(spark, d):
    """Clusters of the vectors by HDBSCAN; tests hold the operator against the definitions."""
    return hdbscan(vectors(spark, d).select("item_id", "embedding"))
