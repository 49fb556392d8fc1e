"""Snippet quality rules: truncation test, longer description, best snippet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from serpframe.functions.text import strip
from serpframe.functions.truthy import _col, let

# Characters that end a sentence (fixed values).
SENTENCE_END = ".!?…"


def is_truncated(c) -> Column:
    """Holds ``...`` or does not end with a sentence mark; blank is not truncated."""
    def body(t):
        last = F.substring(t, -1, 1)
        return (F.coalesce(t, F.lit("")) != "") & (t.contains("...") | ~F.lit(SENTENCE_END).contains(last))
    return F.coalesce(let(strip(_col(c)), body), F.lit(False))


def pick_longer(*cols) -> Column:
    """Longest trimmed non-blank candidate; the first one wins a tie; else null."""
    best = None
    for c in cols:
        t = F.nullif(strip(_col(c)), F.lit(""))
        if best is None:
            best = t
        else:
            best = let(F.struct(best.alias("b"), t.alias("t")), lambda x: (
                F.when(x["t"].isNull(), x["b"]).when(x["b"].isNull(), x["t"])
                .when(F.length(x["t"]) > F.length(x["b"]), x["t"]).otherwise(x["b"])))
    return best


def best_snippet(snippet, og, twitter) -> Column:
    """Search-item rule: the longer meta description replaces a snippet that
    holds ``...`` or is shorter than it."""
    pair = F.struct(_col(snippet).alias("s"), pick_longer(og, twitter).alias("b"))
    return let(pair, lambda x: F.when(x["b"].isNotNull() & (x["s"].contains("...") | (F.length(x["b"]) > F.length(x["s"]))),
                                      x["b"]).otherwise(x["s"]))


def replace_snippet(snippet, best_meta) -> Column:
    """Normalizer rule: the meta description replaces a truncated or shorter snippet."""
    pair = F.struct(_col(snippet).alias("s"), _col(best_meta).alias("b"))

    def body(x):
        s, b = x["s"], x["b"]
        return F.when(b.isNotNull() & (is_truncated(s) | (F.length(b) > F.length(F.coalesce(s, F.lit(""))))), b) \
                .otherwise(s)
    return let(pair, body)
