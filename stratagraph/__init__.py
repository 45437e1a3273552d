"""stratagraph: code-graph, profile and corpus analytics on Spark DataFrames."""

from .client import Client, IndexResult, IngestResult
from .codegraph import CodeGraph, from_code_graph, to_code_graph
from .functions.frames import FrameNormaliser, FrameParser
from .schema import EdgeKind, NodeKind, ProfileType, ValueUnit
from .sources.extract import Extractor, Registry, default_registry
from .store import Store

__version__ = "0.1.0"
__all__ = [
    "Client", "CodeGraph", "EdgeKind", "Extractor", "FrameNormaliser", "FrameParser", "IndexResult", "IngestResult", "NodeKind", "ProfileType", "Registry", "Store", "ValueUnit",
    "default_registry", "from_code_graph", "to_code_graph",
]
