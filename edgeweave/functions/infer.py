"""Types inferred from names and modifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

# Keywords of the two inference rules, in the order of precedence.
KEYWORDS = {"Agent": ("agent", "actor", "person", "user", "system"), "Event": ("event", "action", "process", "happened", "occurred"), "Relational": ("relation", "relationship", "between", "link")}
ANALYSIS = (("Event", "Event_", ("event", "process", "action")), ("Question", "Question_", ("question", "hypothesis", "?")), ("Agent", "Agent_", ("agent", "actor")), ("Verifier", "Verifier_", ("verifier", "test")), ("PathSegment", "Process_", ("process", "transition")))


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def anchor_type(name) -> Column:
    """The type that validation infers from a name."""
    n, low = col(name), F.lower(col(name))
    return (
        F.when(_any(low, KEYWORDS["Agent"]), "Agent")
        .when(_any(low, KEYWORDS["Event"]), "Event")
        .when(low.startswith("question") | low.endswith("question") | n.contains("?"), "Question")
        .when(_any(low, KEYWORDS["Relational"]), "Relational")
        .when(n.rlike(r"^\p{Lu}") & ~low.rlike("^(the|a|an) "), "Name")
        .otherwise("Concept")
    )


def analysis_type(name, given=None) -> Column:
    """The type that statistics use: the given one, else one inferred from the name."""
    n, low = col(name), F.lower(col(name))
    out = F.when(col(given).isNotNull(), col(given)) if given is not None else F.when(F.lit(False), "")
    for kind, prefix, words in ANALYSIS:
        out = out.when(n.startswith(prefix) | _any(low, words), kind)
    name_like = n.rlike(r"^\p{Lu}") & ~n.contains("_") & ~F.substring(n, 2, 2**31 - 1).rlike("[A-Z][a-z]")
    return out.when(name_like, "Name").otherwise("Concept")


def path_type(m="modifiers") -> Column:
    """The type that validation infers from modifiers; null if none applies."""
    c = col(m)
    has = lambda f: F.coalesce(c[f] != "", F.lit(False))
    return F.when(c["rule"] == "causal", "Causal").when(c["rule"] == "logical", "Inferential").when(c["rule"] == "definitional", "Semantic").when(has("intent"), "Action").when(has("focus") | has("perspective"), "Cognitive")


def analysis_path_type(given="path_type", m="modifiers") -> Column:
    """The type that statistics use: the given one, else by rule, intent or focus, else UNKNOWN."""
    c = col(m)
    has = lambda f: F.coalesce(c[f] != "", F.lit(False))
    return (
        F.when(col(given).isNotNull(), col(given))
        .when(c["rule"] == "causal", "Causal")
        .when(c["rule"].isin("logical", "empirical", "inferential"), "Inferential")
        .when(c["rule"] == "definitional", "Semantic")
        .when(has("intent"), "Action")
        .when(has("focus") | has("perspective"), "Cognitive")
        .otherwise("UNKNOWN")
    )
