"""Snippets around query terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termforge.functions.text import query_terms

NEAR = 50


def snippet(content: Column, query: Column, max_length: int = 200) -> Column:
    """At most max_length characters of content near the query's terms, with ... where it was cut.

    For each term of the query the first place it occurs as a substring is rated by how many terms
    of the query lie within 50 characters; the best place wins, the earlier term among equals,
    and the snippet starts 50 characters before it. Without any hit, for an empty query or for
    empty content it is the start of content. Null content or query gives null.
    """
    low = F.lower(content)
    terms = query_terms(query)

    def place(term: Column) -> Column:
        pos = F.instr(low, term) - 1
        start = F.greatest(F.lit(0), pos - NEAR)
        window = F.substring(low, start + 1, pos + NEAR - start)
        hits = F.size(F.filter(terms, lambda o: F.contains(window, o)))
        return F.when(pos >= 0, F.struct(hits.alias("hits"), start.alias("start")))

    none = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("start"))
    best = F.aggregate(F.transform(terms, place), none, lambda acc, x: F.when(x.isNotNull() & (x["hits"] > acc["hits"]), x).otherwise(acc))["start"]
    start = F.when((content == "") | (query == ""), F.lit(0)).otherwise(best)
    body = F.substring(content, start + 1, F.lit(max_length))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + max_length < F.length(content), "...").otherwise(""))
