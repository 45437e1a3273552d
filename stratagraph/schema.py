"""Fixed schemas and enumerations of the graph and profile tables."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

GRAPH_VERSION, PROFILE_VERSION = 1, 2


class NodeKind(StrEnum):
    MODULE = "module"
    CLASS = "class"
    FUNCTION = "function"
    METHOD = "method"
    PROPERTY = "property"
    VARIABLE = "variable"
    PARAMETER = "parameter"
    CONSTANT = "constant"
    TYPE_ALIAS = "type_alias"
    INTERFACE = "interface"
    ENUM = "enum"
    ENUM_MEMBER = "enum_member"
    IMPORT = "import"
    DECORATOR = "decorator"


class EdgeKind(StrEnum):
    CONTAINS = "contains"
    INHERITS = "inherits"
    IMPLEMENTS = "implements"
    CALLS = "calls"
    REFERENCES = "references"
    IMPORTS = "imports"
    INSTANTIATES = "instantiates"
    RETURNS = "returns"
    PARAMETER_TYPE = "parameter_type"
    TYPE_OF = "type_of"


class ProfileType(StrEnum):
    SAMPLED = "sampled"
    EVENTED = "evented"


class ValueUnit(StrEnum):
    NANOSECONDS = "nanoseconds"
    MICROSECONDS = "microseconds"
    MILLISECONDS = "milliseconds"
    SECONDS = "seconds"
    BYTES = "bytes"
    NONE = "none"


#: Edge kinds that count as a reference to their target.
REFERENCE_KINDS = tuple(str(k) for k in (EdgeKind.CALLS, EdgeKind.REFERENCES, EdgeKind.IMPORTS, EdgeKind.INSTANTIATES, EdgeKind.INHERITS, EdgeKind.IMPLEMENTS))

_S, _I, _L, _D, _T = StringType(), IntegerType(), LongType(), DoubleType(), TimestampType()


def _struct(must: dict, may: dict) -> StructType:
    return StructType([StructField(k, t, False) for k, t in must.items()] + [StructField(k, t, True) for k, t in may.items()])


NODES = _struct(
    {"id": _S, "repo_path": _S, "file_path": _S, "node_type": _S, "name": _S, "start_line": _I, "start_column": _I, "end_line": _I, "end_column": _I, "seq": _L},
    {"qualified_name": _S, "signature": _S, "docstring": _S, "metadata": _S, "created_at": _T},
)
EDGES = _struct(
    {"id": _L, "source_id": _S, "target_id": _S, "edge_type": _S},
    {"location_file": _S, "location_start_line": _I, "location_start_column": _I, "location_end_line": _I, "location_end_column": _I, "metadata": _S, "created_at": _T},
)
PROFILES = _struct(
    {"id": _S, "name": _S, "profile_type": _S, "unit": _S, "start_value": _D, "end_value": _D},
    {"repo_path": _S, "source_file": _S, "metadata": _S, "created_at": _T},
)
FRAMES = _struct({"profile_id": _S, "frame_index": _I, "name": _S}, {"file": _S, "line": _I, "col": _I})
FUNCTION_STATS = _struct(
    {"profile_id": _S, "frame_index": _I, "name": _S, "self_weight": _D, "total_weight": _D, "call_count": _L, "self_percentage": _D, "total_percentage": _D},
    {"file": _S, "line": _I, "symbol_id": _S},
)
MAPPINGS = _struct({"frame_name": _S, "confidence": _D}, {"symbol_id": _S, "last_updated": _T})
TABLES = {"nodes": NODES, "edges": EDGES, "profiles": PROFILES, "frames": FRAMES, "function_stats": FUNCTION_STATS, "frame_symbol_mappings": MAPPINGS}

#: What extractors return: a row for each symbol, relationship or error of a file.
EXTRACTED = _struct(
    {"file_path": _S, "record": _S, "ordinal": _I},
    {
        "node_type": _S, "name": _S, "qualified_name": _S, "signature": _S, "docstring": _S,
        "source_name": _S, "target_name": _S, "edge_type": _S, "target_module": _S,
        "start_line": _I, "start_column": _I, "end_line": _I, "end_column": _I, "metadata": _S, "message": _S,
    },
)

# --- fixed values: raw symbol kinds and the node kinds that they are stored as ---
NODE_KIND_OF = {
    "module": "module", "class": "class", "function": "function", "method": "method", "property": "property",
    "variable": "variable", "parameter": "parameter", "constant": "constant", "type_alias": "type_alias",
    "interface": "interface", "enum": "enum", "enum_member": "enum_member", "import": "import", "decorator": "decorator",
    "page": "class", "named_element": "variable", "resource": "constant",
}
#: Raw edge kinds that aren't stored as they are; unknown ones are references.
EDGE_KIND_OF = {str(k): str(k) for k in EdgeKind} | {"event_handler": "calls", "command": "calls", "binding": "references", "resource_ref": "references", "template_binding": "references"}
#: Symbol kinds of a language server.
SERVER_KIND_OF = {
    "class": "class", "struct": "class", "delegate": "class", "record": "class", "interface": "interface", "enum": "enum",
    "enummember": "enum_member", "method": "method", "constructor": "method", "destructor": "method", "operator": "method", "indexer": "method",
    "property": "property", "field": "variable", "event": "variable", "constant": "constant", "namespace": "module",
}


def node_kind(raw: str | None) -> str:
    """The node kind that a raw symbol kind is stored as; unknown ones are variables."""
    return NODE_KIND_OF.get((raw or "").lower(), "variable")


def edge_kind(raw: str | None) -> str:
    """The edge kind that a raw relationship is stored as; unknown ones are references."""
    return EDGE_KIND_OF.get((raw or "").lower(), "references")
