"""Explicit schemas of every table of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TIMESTAMP, BOOLEAN = T.TimestampType(), T.BooleanType()

MENTION = _table(context=STRING, position=INT, relevance=DOUBLE)
ENTITY = _table(name=STRING, type=STRING, description=STRING, mentions=T.ArrayType(MENTION))
EXTRACT_RESULT = _table(
    entities=T.ArrayType(ENTITY), success=BOOLEAN, error=STRING, entity_count=INT
)

CONTENT = _table(
    content_id=STRING, content_type=STRING, kind=STRING, title=STRING, description=STRING,
    source=STRING, file_path=STRING, hash=STRING, size=LONG,
    metadata=T.MapType(STRING, STRING), created_at=TIMESTAMP, updated_at=TIMESTAMP,
)
CHUNKS = _table(content_id=STRING, chunk_index=INT, chunk_text=STRING)
CONTENT_TYPES = _table(name=STRING, description=STRING, mime_pattern=STRING)
TAGS = _table(tag_id=STRING, name=STRING)
CONTENT_TAGS = _table(content_id=STRING, tag_id=STRING)
CONTENT_FIELDS = _table(content_id=STRING, field_name=STRING, field_value=STRING, field_type=STRING)
CONTENT_RELATIONS = _table(source_id=STRING, target_id=STRING, relationship_type=STRING, strength=DOUBLE)
ENTITIES = _table(entity_id=STRING, name=STRING, entity_type=STRING, description=STRING,
                  metadata=T.MapType(STRING, STRING))
LINKS = _table(content_id=STRING, content_type=STRING, entity_id=STRING, relevance=DOUBLE, context=STRING)
ENTITY_RELATIONS = _table(relation_id=STRING, source_id=STRING, target_id=STRING,
                          relationship_type=STRING, strength=DOUBLE)
ALIASES = _table(entity_id=STRING, alias=STRING, confidence=DOUBLE)
SEARCH_LOG = _table(term=STRING, searched_at=TIMESTAMP)
RESULTS = _table(result_id=STRING, content_id=STRING, status=STRING, results=STRING, error=STRING,
                 started_at=TIMESTAMP, completed_at=TIMESTAMP)
BATCH_ITEMS = _table(batch_id=STRING, item_id=STRING, status=STRING, priority=INT,
                     duration_ms=LONG, started_at=TIMESTAMP, completed_at=TIMESTAMP)
PROFILES = _table(operation=STRING, duration_ms=LONG, epoch=LONG, mem_diff=LONG, cpu=DOUBLE)
LOG_RECORD = _table(
    timestamp=STRING, level=STRING, message=STRING,
    context=_table(module=STRING, function=STRING, line=INT),
)
JOB_EVENTS = _table(job_id=STRING, event=STRING, ts=TIMESTAMP)

# The entity types.
ENTITY_TYPES = ("person", "organization", "location", "date", "product", "technology", "event", "other")

# Content kinds with the MIME LIKE patterns that select them.
CONTENT_TYPE_ROWS = (
    ("text", "Plain text documents", "text/%"),
    ("image", "Image files", "image/%"),
    ("video", "Video files", "video/%"),
    ("document", "Document files", "application/pdf"),
    ("code", "Source code files", "text/x-%"),
    ("json", "JSON data files", "application/json"),
    ("xml", "XML data files", "application/xml"),
    ("generic", "Other file types", "%/%"),
)

# Processing event kinds, the job kinds included.
PROCESSING_EVENTS = (
    "processing:started", "processing:completed", "processing:failed", "entity:created",
    "batch:started", "batch:progress", "batch:completed", "batch:failed",
    "batch:item:started", "batch:item:completed", "batch:item:failed", "system:status",
    "job:started", "job:progress", "job:completed", "job:failed", "job:canceled",
)
