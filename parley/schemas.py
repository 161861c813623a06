"""Explicit schemas of the engine's base tables (SRC-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Logical table -> DDL of its columns.
SCHEMAS = {
    "meetings": "id string, title string, mode string, started_at bigint, duration_s double, headline string, summary string, my_notes string, summary_json string, duration_minutes int, meeting_type string",
    "utterances": "meeting_id string, idx int, speaker string, speaker_role string, text string, offset_s double, duration_s double, confidence double",
    "claims": "id bigint, meeting_id string, kind string, body string, edited_body string, offset_s double, quote string, gate string, gate_reason string, done int, source string, project_id int, person_id bigint, document_id bigint",
    "nodes": "id string, label string, kind string",
    "edges": "src string, dst string, kind string, meeting_id string",
    "runs": "id bigint, kind string, exit string, outcome string, meeting_id string, units_spent double, tokens_in bigint, tokens_out bigint, cost_usd double, started_at bigint, ended_at bigint",
    "projects": "id int, name string, description string",
    "meeting_projects": "meeting_id string, project_id int",
    "upcoming": "id bigint, title string, at_ms bigint, end_ms bigint, participants string, project_id int, source string",
    "entities": "id string, kind string, label string, created_at bigint, merged_into string, pinned int",
    "entity_aliases": "entity_id string, norm string, alias string, matcher string, score double, reason string",
    "entity_mentions": "entity_id string, meeting_id string, surface string, claim_id bigint, offset_s double, quote string, source string, matcher string, score double, gate string, gate_reason string",
    "chunks": "id bigint, meeting_id string, kind string, src_id bigint, start_offset_s double, end_offset_s double, speakers string, text string",
    "conversations": "id bigint, title string",
    "messages": "id bigint, conversation_id bigint, role string, content string, chunk_ids array<bigint>",
    "corrections": "id bigint, from_text string, to_text string, kind string, scope string",
    "correction_events": "id bigint, meeting_id string, from_text string, to_text string, payload string",
    "people": "id bigint, name string, team string, document_id bigint",
    "documents": "id bigint, project_id int, name string, text string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def open_tables(spark: SparkSession, path: str, names=tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """Read base tables with their schemas and register each as a temporary view of its name."""
    out = {}
    for name in names:
        out[name] = spark.read.schema(schema(name)).parquet(f"{path}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a base table: absent ones are null, others go (additive migrations)."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
