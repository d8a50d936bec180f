"""Query expansion as a column: the terms by which a question's entities are searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question forms in the order they are tried, with what is added to their subject, and words that aren't searched.
FORMS = (
    (r"what (?:is|are) (.+?)(?:\?|$)", "definition"),
    (r"tell me about (.+?)(?:\?|$)", "information"),
    (r"who (?:was|is|were) (.+?)(?:\?|$)", "person"),
    (r"what (?:caused|led to) (.+?)(?:\?|$)", "cause"),
    (r"describe (.+?)(?:\?|$)", "information"),
)
ADDED = {"definition": (), "information": ("information", "details"), "person": ("biography", "role"), "cause": ("cause", "reason", "led to", "resulted in")}
STOP = ("the", "a", "an", "is", "are", "was", "were", "what", "who", "when", "where", "why", "how", "of", "to", "in", "for", "on", "at", "by")


def _variants(subject: Column, kind: str, titles: tuple[str, ...]) -> Column:
    more = [F.array(subject, *[F.concat(subject, F.lit(f" {x}")) for x in ADDED[kind]])]
    if kind in ("definition", "information"):
        number = F.when(subject.endswith("s"), F.substring(subject, F.lit(1), F.length(subject) - 1)).otherwise(F.concat(subject, F.lit("s")))
        more.append(F.array(F.regexp_replace(subject, r"^(the|a|an)\s+", ""), number))
    if kind == "person":
        for title in titles:
            name = F.trim(F.replace(subject, F.lit(title), F.lit("")))
            more.append(F.when(F.contains(subject, F.lit(title)), F.array(name, F.concat(F.lit(f"{title} "), name))).otherwise(F.array().cast("array<string>")))
    return F.concat(*more)


def expand_query(query: Column, related: dict[str, tuple[str, ...]] | None = None, titles: tuple[str, ...] = ()) -> Column:
    """Sorted distinct search terms of a question: itself in lower case, its subject's variants by the first form that fits, the
    terms ``related`` gives for phrases in it with the words of these phrases, and its words of three characters or more.

    A domain's dictionary is the caller's. A null question has null terms, an empty one itself.
    """
    low = F.lower(query)
    none = F.array().cast("array<string>")
    forms = F.lit(None).cast("array<string>")
    for pattern, kind in reversed(FORMS):
        forms = F.when(low.rlike(pattern), _variants(F.regexp_extract(low, pattern, 1), kind, titles)).otherwise(forms)
    known = [
        F.when(F.contains(low, F.lit(phrase)), F.array(*[F.lit(x) for x in (*terms, *phrase.split())])).otherwise(none)
        for phrase, terms in (related or {}).items()]
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))
    every = reduce(F.concat, [F.array(low), F.coalesce(forms, none), *known, words])
    return F.when(query.isNotNull(), F.array_sort(F.array_distinct(every)))
