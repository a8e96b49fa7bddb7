"""Terms as the lexical operators take them, and tables that are sent whole only where they are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between terms; A-Z and all beyond ASCII belong to terms.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes up to which a table made of the items, or of row numbers, is broadcast.
MOST_BROADCAST = 16 << 20


def folded(term: Column) -> Column:
    """A-Z in lower case, nothing else changed; lower() alone would change other letters too."""
    return F.when(F.length(term) == F.octet_length(term), F.lower(term)).otherwise(F.translate(term, _UPPER, _UPPER.lower()))


def item_terms(text: str = "text") -> Column:
    """The terms of a short text, in order."""
    return F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BREAK), lambda w: w != ""), folded)


def listed(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, pos, term: the terms of every document, from 1 (or 2) on without gaps, and a head entry with
    an empty term at 0. row numbers the documents."""
    words = F.split(F.coalesce(F.col("text"), F.lit("")), BREAK)  # far faster than extracting matches
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    edge = lambda c: (c == "").cast("int")
    last = F.when(F.size("words") > 1, edge(F.element_at("words", -1))).otherwise(0)
    n = (F.size("words") - edge(F.element_at("words", 1)) - last).cast("long")
    found = rows.select("row", "doc_id", n.alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "raw"))
    return found.where("pos = 0 or raw <> ''").select("row", "doc_id", "n_words", "pos", folded(F.col("raw")).alias("term"))


def sized(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small as measured."""
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"), F.lit(0))
    held = table.agg(F.sum(wide + 16 * len(table.columns))).first()[0] or 0
    return F.broadcast(table) if held <= MOST_BROADCAST else table
