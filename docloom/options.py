"""Option records and the default settings of the data model."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024

# Default settings.
CONFIDENCE_THRESHOLD = 0.5
MAX_ENTITIES = 50
CHUNK_MAX_SIZE = 4 * MIB
CHUNK_OVERLAP_RATIO = 0.1
CHUNK_STRATEGY = "paragraph"
BATCH_CHUNK_OVERLAP = 200
TOOL_CHUNK_OVERLAP = 5000
SHELL_CHUNK_SIZE = 500_000
SHELL_CHUNK_OVERLAP = 5000
SHELL_CHUNK_STRATEGY = "size"
DEFAULT_CONTENT_TYPE = "text/plain"
MAX_FILE_SIZE = 100 * MIB
DEFAULT_LINK_RELEVANCE = 0.5
MIN_TEXT_LENGTH = 10
RETENTION_DAYS = 30
SEARCH_LIMIT = 50
LOG_RESULT_LIMIT = 100
RELATED_LIMIT = 10
RELATED_ENTITY_CAP = 100
PROFILE_TOP = 5
KEPT_VERSIONS = 5


@dataclass(frozen=True)
class ExtractOptions:
    """Options of one extraction run; ``None`` switches a filter off."""

    confidence_threshold: float | None = CONFIDENCE_THRESHOLD
    entity_types: tuple[str, ...] | None = None
    max_entities: int | None = MAX_ENTITIES
    extract_mentions: bool = True
    fallback: bool = True


@dataclass(frozen=True)
class ChunkOptions:
    """Chunking options; ``None`` means the default and an explicit 0 is kept."""

    strategy: str = CHUNK_STRATEGY
    max_size: int | None = None
    overlap: int | None = None

    def resolved(self) -> tuple[int, int]:
        size = CHUNK_MAX_SIZE if self.max_size is None else self.max_size
        overlap = int(size * CHUNK_OVERLAP_RATIO) if self.overlap is None else self.overlap
        return size, overlap
