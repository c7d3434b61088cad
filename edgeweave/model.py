"""The edge table: one row a statement, typed modifiers, an open bag, document order.

``extra`` maps the keys outside the typed fields to literals as the text form
writes them ("86", "true", "\\"class\\""), so that value types survive and rows
stay comparable. ``priority`` may be text or number and is kept as a literal too.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
ANCHOR_TYPES = ("Concept", "Relational", "Event", "Entity", "Name", "Agent", "Question", "Verifier", "PathSegment")
PATH_TYPES = ("Semantic", "Action", "Cognitive", "Causal", "Inferential", "Reflexive")
RESERVED = ("NULL", "UNDEFINED", "ANY", "NONE", "TRUE", "FALSE", "SYSTEM", "GLOBAL", "LOCAL")
FIELDS = (
    "time", "duration", "frequency", "tense", "location", "domain", "scope", "certainty", "confidence", "necessity", "rule", "source", "author", "timestamp", "version",
    "emotion", "intensity", "valence", "value", "alignment", "priority", "cause", "effect", "strength", "conditionality", "intent", "focus", "perspective", "mood", "modality",
)
DOUBLES = ("confidence", "certainty", "strength", "intensity")
SPECIAL = ("source", "target", "source_namespace", "target_namespace", "arrow")
ARROW = "→"

MODIFIERS = T.StructType([T.StructField(f, T.DoubleType() if f in DOUBLES else T.StringType()) for f in FIELDS])
STATEMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("stmt_idx", T.IntegerType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_namespace", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("target", T.StringType(), False),
        T.StructField("target_namespace", T.StringType()),
        T.StructField("target_type", T.StringType()),
        T.StructField("arrow", T.StringType(), False),
        T.StructField("path_type", T.StringType()),
        T.StructField("has_modifiers", T.BooleanType(), False),
        T.StructField("modifiers", MODIFIERS),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
DIAGNOSTICS = "doc_id string, severity string, code string, message string, line int, statement_index int, field string"
