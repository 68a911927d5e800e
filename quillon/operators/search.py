"""Lexical search through an inverted index: folded words lead to the items that have them.

An item's text is its title and its creators. A query asks for all its words. It goes into the index by its rarest word alone, and the items
found there are checked for the others against their own words, so the list of a frequent word is never read for the sake of a rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

c = F.col


def words_of(*texts: Column) -> Column:
    """The distinct folded words of some texts."""
    return F.array_distinct(F.filter(F.split(C.fold_spaced(F.concat_ws(" ", *texts)), " "), lambda w: w != ""))


def index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (library, item_key, title, creators) to postings (word, library, item_key, words) and frequencies (word, n)."""
    held = items.select("library", "item_key", words_of(c("title"), F.array_join("creators", " ")).alias("words"))
    postings = held.select(F.explode("words").alias("word"), "library", "item_key", "words")
    return postings, postings.groupBy("word").agg(F.count("*").alias("n"))


def search(queries: DataFrame, postings: DataFrame, frequencies: DataFrame, readable: DataFrame, limit: int = 25) -> DataFrame:
    """Queries (query, user_id, text) to (query, place, library, item_key): the first `limit` items in order of library and key.

    Queries of the same words are one: they meet the items once, a library's first `limit` are kept, then those of each user's libraries.
    Only libraries that the user may read are searched (readable: user_id, library). A query without words finds nothing, and one
    with a word that no item has finds nothing either.
    """
    asked = queries.select("query", "user_id", F.sort_array(words_of(c("text"))).alias("wanted")).where(F.size("wanted") > 0)
    texts = asked.select("wanted").distinct()
    known = texts.select("wanted", F.explode("wanted").alias("word")).join(frequencies, "word", "left")
    rarest = known.groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0").select("wanted", c("r.word").alias("word"))
    met = rarest.join(postings, "word").where(F.size(F.array_except("wanted", "words")) == 0).select("wanted", "library", "item_key")
    first = lambda rows, per, by: rows.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*by))).where(c("place") <= limit)
    met = first(met, ["wanted", "library"], ["item_key"]).drop("place")
    asks = asked.select("user_id", "wanted").distinct().join(readable.select("user_id", "library").distinct(), "user_id")
    held = first(asks.join(met, ["wanted", "library"]), ["user_id", "wanted"], ["library", "item_key"]).drop("place")
    mine = first(asked.join(held, ["user_id", "wanted"]), ["query"], ["library", "item_key"])
    return mine.select("query", "place", "library", "item_key")
