"""Extractors: files to symbols and relationships."""

from .base import Extractor, Registry, extract_files, extractor_for_file, extractor_of, records, register, shared_registry
from .csharp import CSharpExtractor
from .go import GoExtractor
from .php import PhpExtractor
from .python_source import PythonExtractor
from .xaml import XamlExtractor

__all__ = ["Extractor", "Registry", "default_registry", "extract_files", "extractor_for_file", "extractor_of", "records", "register", "shared_registry"]


def default_registry() -> Registry:
    """A registry of all extractors of this package."""
    return Registry([PythonExtractor(), CSharpExtractor(), GoExtractor(), PhpExtractor(), XamlExtractor()])
