"""Tables, vocabularies and constants of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 7
TOKENIZER_VERSION = 3
CHUNKER_VERSION = 3
DAY_MS = 86_400_000

# Fixed values.
LAYERS = ("semantic", "episodic", "procedural", "artifact")
LAYER_WEIGHT = {"semantic": 10, "procedural": 7, "artifact": 3, "episodic": 2}
HALF_LIFE_DAYS = {"episodic": 30, "procedural": 180, "artifact": 365}
OTHER_HALF_LIFE = 90
EDGE_TYPES = ("RESOLVES", "SUPERSEDES", "CONTRADICTS", "DERIVED_FROM", "OCCURRED_IN", "CONSTRAINS")
CONFIDENCE = {"type": 1.0, "file": 0.95, "receiver": 0.9, "import": 0.85, "unique": 0.7}
OTHER_CONFIDENCE = 0.5
TYPE_KINDS = ("class", "interface", "struct", "trait", "enum", "type", "protocol", "record", "module", "object")


_TYPES = {"STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def _table(spec: str) -> T.StructType:
    """A schema from "name TYPE, ..."; unlike the session's own parser this needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.strip().split(" ") for c in spec.split(","))])


MEMORY = _table(
    "id STRING, layer STRING, title STRING, body STRING, source_ref STRING, file_path STRING, importance DOUBLE, confidence DOUBLE, created_at BIGINT, last_seen_at BIGINT, "
    "access_count BIGINT, superseded_at BIGINT, embedding_model STRING, embedding_dims INT, embedding_provider STRING, embedding ARRAY<FLOAT>"
)
MEMORY_EDGE = _table("src STRING, dst STRING, type STRING, weight DOUBLE, created_at BIGINT, evidence_ref STRING")
SYMBOL = _table("id STRING, name STRING, file_path STRING, kind STRING, start_line INT, end_line INT")
FILE = _table("path STRING, language STRING, container STRING, uses ARRAY<STRING>")
ABOUT = _table("memory_id STRING, symbol_id STRING, weight DOUBLE, created_at BIGINT")
CALLS = _table("src STRING, dst STRING, name STRING, line INT, confidence STRING")
INHERITS = _table("src STRING, dst STRING, confidence STRING")
IMPORTS = _table("src STRING, dst STRING, module STRING")
PENDING_CALL = _table("id STRING, file_path STRING, from_symbol STRING, name STRING, receiver STRING, receiver_type STRING, line INT, kind STRING, reason STRING")
POSTINGS = _table("term STRING, node_id STRING, tf INT, doc_len INT")
FILE_STAMP = _table("path STRING, stamp STRING")
HUNK = _table("file STRING, status STRING, old_start INT, old_lines INT, new_start INT, new_lines INT")
LINE = _table("file_path STRING, line INT, text STRING")
_NODE = _table("id STRING, layer STRING, title STRING, body STRING, source_ref STRING, importance DOUBLE, created_at BIGINT")
_LINK = _table("src STRING, dst STRING, type STRING, weight DOUBLE")
JOURNAL = T.StructType([*_table("kind STRING, at BIGINT").fields, T.StructField("node", _NODE), T.StructField("edge", _LINK)])

#: Recorded tables are what people wrote; derived ones can be rebuilt from files and may be dropped.
RECORDED = ("memory", "memory_edge", "about")
DERIVED = ("symbol", "file", "calls", "inherits", "imports", "pending_call", "postings", "file_stamp", "site", "import_site", "base_site")


def parse_dimensions(text: str) -> int:
    """A vector width: digits only, from 8 to 8192."""
    if not str(text).isascii() or not str(text).isdigit() or not 8 <= int(text) <= 8192:
        raise ValueError(f"vector width must be digits from 8 to 8192, got {text!r}")
    return int(text)


def dimensions(text: Column) -> Column:
    """The same for a column of texts; null where ``parse_dimensions`` refuses."""
    digits = F.when(text.rlike(r"\A0*[0-9]{1,4}\z"), F.regexp_extract(text, r"\A0*([0-9]{1,4})\z", 1).cast("int"))
    return F.when(digits.between(8, 8192), digits)
