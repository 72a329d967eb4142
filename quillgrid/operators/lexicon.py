"""Word lists of one's own against many documents: words are cut once and joined with the list by equality, so its length costs nothing per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import n_words

#: Rows of a list up to which it is broadcast.
MOST_BROADCAST = 100_000


def hits(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, n and the other columns of words (word in lower case, ...) of every word found."""
    cut = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))).alias("word"))
    table = F.broadcast(words) if words.count() <= MOST_BROADCAST else words
    # the join comes first: only words of the list are grouped
    return cut.join(table, "word").groupBy(key, *words.columns).agg(F.count("*").alias("n"))


def dense(docs: DataFrame, words: DataFrame, kinds: int = 2, least: int = 2, rate: float = 4.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hits, kinds, density, weighted (by words.weight) of documents with so many different words of the list, or so many hits and hits per 1000 words."""
    found = hits(docs, words, key, text).groupBy(key).agg(F.sum("n").alias("hits"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.col("weight")).alias("weighted"))
    out = docs.select(key, F.greatest(n_words(F.col(text)), F.lit(1)).alias("of")).join(found, key)
    out = out.withColumns({"density": F.col("hits") * 1000 / F.col("of"), "weighted": F.col("weighted") * 1000 / F.col("of")})
    return out.filter((F.col("kinds") >= kinds) | (F.col("hits") >= least) & (F.col("density") >= rate)).drop("of")
