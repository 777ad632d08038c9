"""Item-name translation: dictionary lookup, then word-by-word fallback.

* the dictionary may hold a key several times; the last row (highest ``pos``)
  wins, and its value may be null;
* an item whose key is in the dictionary takes that value, even a null one;
* only items absent from the dictionary are translated word by word: split on
  whitespace, each word replaced by its lexicon entry (or kept when missing),
  words joined with one space in their original order; a name without words
  translates to ''.

All work is on the distinct item names, so a name held by millions of rows is
translated once; the result is joined back on the name, hot names apart
(``joins.spread_join``), so that no task gathers one name's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words
from .joins import spread_join


def dedupe_lookup(lookup: DataFrame, key: str = "item", value: str = "item_gr",
                  pos: str = "pos") -> DataFrame:
    """One row per key: the value of the last row (highest ``pos``)."""
    return lookup.groupBy(key).agg(F.max_by(value, pos).alias(value))


def dedupe_lexicon(lexicon: DataFrame, word: str = "word", word_tr: str = "word_tr") -> DataFrame:
    """One translation per word (the greatest, if a word is listed twice)."""
    return lexicon.groupBy(word).agg(F.max(word_tr).alias(word_tr))


def translate_words(names: DataFrame, lexicon: DataFrame, item: str = "item",
                    out: str = "item_gr") -> DataFrame:
    """Word-by-word translation of the distinct names in ``names[item]``.

    ``lexicon`` is (word, word_tr), unique on word. Returns (item, out).
    """
    words = names.select(item, F.posexplode_outer(split_words(item)).alias("pos", "word"))
    tr = words.join(lexicon, "word", "left").select(
        item, "pos", F.coalesce("word_tr", "word").alias("w"))
    agg = tr.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("_ws"))
    text = F.array_join(F.transform("_ws", lambda s: s["w"]), " ")
    return agg.select(item, F.when(F.col(item).isNotNull(), text).alias(out))


def lexicon_from_function(names: DataFrame, translate_word, item: str = "item") -> DataFrame:
    """Build a lexicon (word, word_tr) by applying ``translate_word`` - a
    function from a pandas Series of words to a Series of translations - to
    the distinct words of ``names[item]``.

    The words are deduplicated by Spark first, then translated in Arrow
    batches with ``mapInPandas``; each distinct word is translated once,
    whatever the number of rows or names holding it.
    """
    words = names.select(F.explode(split_words(item)).alias("word")).distinct()

    def run(batches):
        for pdf in batches:
            yield pdf.assign(word_tr=translate_word(pdf["word"]))

    return words.mapInPandas(run, "word string, word_tr string")


def translation_table(names: DataFrame, lookup: DataFrame, lexicon: DataFrame,
                      item: str = "item", out: str = "item_gr") -> DataFrame:
    """(item, out) for every distinct name: dictionary hit, else fallback.

    ``lookup`` must be unique on ``item`` (see ``dedupe_lookup``).
    """
    hits = lookup.select(F.col("item").alias(item), F.col("item_gr").alias(out), F.lit(True).alias("_hit"))
    looked = names.select(item).distinct().join(hits, item, "left")
    fallback = translate_words(looked.where("_hit IS NULL").select(item), lexicon, item, out)
    return looked.where("_hit").select(item, out).unionByName(fallback)


def add_translation(items: DataFrame, lookup: DataFrame, lexicon: DataFrame | None = None,
                    item: str = "item", out: str = "item_gr", translate_word=None,
                    names: DataFrame | None = None) -> DataFrame:
    """Add (or replace) column ``out`` on ``items``; row count is unchanged.

    ``names`` may give the names to translate more cheaply than ``items``
    itself (any frame whose ``item`` column holds at least every name of
    ``items``; extra names are harmless, since a translation depends only on
    the name). By default the distinct names of ``items`` are used.

    ``lookup`` is (item, item_gr[, pos]) and ``lexicon`` (word, word_tr); both
    are deduplicated here. Instead of a lexicon, ``translate_word`` (pandas
    Series -> Series) may translate the words of the names the dictionary
    misses (see ``lexicon_from_function``). How often a name comes is counted in
    ``names`` too (it decides only how the join spreads).
    """
    if "pos" in lookup.columns:
        lookup = dedupe_lookup(lookup)
    else:  # no row order given: keys are expected unique; max keeps it deterministic
        lookup = lookup.groupBy("item").agg(F.max("item_gr").alias("item_gr"))
    counts = (names if names is not None else items).groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    names = counts.where("n > 0").select(item)      # the filter keeps this the same aggregate, which is then run once
    if translate_word is not None:
        missing = names.distinct().join(lookup.select(F.col("item").alias(item)), item, "left_anti")
        lexicon = lexicon_from_function(missing, translate_word, item)
    lexicon = dedupe_lexicon(lexicon)
    table = translation_table(names, lookup, lexicon, item, out)
    base = items.drop(out) if out in items.columns else items
    return spread_join(base, table, [item], counts)
