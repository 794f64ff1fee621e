"""Tables of the corpus: column types, domains and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables, columns, unique keys and parents as users know them. Column lists as Spark DDL. Embeddings are plain arrays; their length is a parameter and is checked.
TABLES = {
    "sources": "id string, name string, jurisdiction string, language string, base_url string, crawler_type string, cron_schedule string, config_json string, credentials_enc binary, enabled boolean, created_at timestamp, updated_at timestamp",
    "documents": "id string, source_id string, external_id string, url string, title string, content_md string, summary string, doc_type string, jurisdiction string, language string, published_at timestamp, effective_at timestamp, content_hash string, object_key string, metadata_json string, created_at timestamp, updated_at timestamp",
    "chunks": "id string, document_id string, chunk_index int, content string, embedding array<float>, token_count int, metadata_json string, created_at timestamp",
    "document_versions": "id string, document_id string, version_number int, content_hash string, content_md string, changed_at timestamp, change_summary string",
    "crawl_runs": "id string, source_id string, started_at timestamp, completed_at timestamp, status string, docs_discovered int, docs_new int, docs_updated int, docs_unchanged int, error_message string, metadata_json string",
    "api_keys": "id string, name string, key_hash string, key_prefix string, created_at timestamp, last_used_at timestamp, expires_at timestamp, enabled boolean",
    "laws": "id string, title string, abbreviation string, jurisdiction string, document_type string, source_url string, official_number string, publication_date date, last_modified_date date, valid_from date, valid_until date, full_text string, metadata string, created_at timestamp, updated_at timestamp",
    "law_chunks": "id string, law_id string, chunk_index int, section_reference string, content string, embedding array<float>, metadata string, created_at timestamp",
    "case_law": "id string, court string, court_level string, case_number string, decision_date date, title string, jurisdiction string, source_url string, ecli string, full_text string, summary string, keywords array<string>, referenced_laws array<string>, metadata string, created_at timestamp, updated_at timestamp",
    "case_law_chunks": "id string, case_law_id string, chunk_index int, content string, embedding array<float>, metadata string, created_at timestamp",
    "related_laws": "law_id string, related_law_id string, relation_type string, confidence_score double",
}
UNIQUE = {
    "sources": ["name"], "documents": ["source_id", "external_id"], "chunks": ["document_id", "chunk_index"], "document_versions": ["document_id", "version_number"],
    "api_keys": ["key_hash"], "laws": ["source_url"], "case_law": ["source_url"], "related_laws": ["law_id", "related_law_id"],
}
#: Child table, its column, and the parent table whose id it holds; deletes cascade along these.
PARENTS = (("documents", "source_id", "sources"), ("chunks", "document_id", "documents"), ("document_versions", "document_id", "documents"), ("crawl_runs", "source_id", "sources"), ("law_chunks", "law_id", "laws"), ("case_law_chunks", "case_law_id", "case_law"))
#: Names of domains and what they stand for.
JURISDICTIONS = {"federal": "German Federal Law (Bundesrecht)", "eu": "European Union Law", "bavaria": "Bavarian State Law (Bayerisches Landesrecht)", "other": "Other jurisdictions"}
DOCUMENT_TYPES = {"law": "Legislative acts (Gesetze)", "regulation": "Regulatory acts (Verordnungen)", "directive": "EU Directives", "decision": "EU Decisions", "other": "Other document types"}
COURT_LEVELS = {
    "bgh": "Bundesgerichtshof (Federal Court of Justice)", "bverwg": "Bundesverwaltungsgericht (Federal Administrative Court)", "bfh": "Bundesfinanzhof (Federal Fiscal Court)",
    "bsg": "Bundessozialgericht (Federal Social Court)", "bag": "Bundesarbeitsgericht (Federal Labour Court)", "lg": "Landgericht (Regional Court)", "ag": "Amtsgericht (Local Court)",
    "vg": "Verwaltungsgericht (Administrative Court)", "other": "Other courts",
}
RUN_STATUS = ("queued", "running", "completed", "failed")
DOMAINS = {"jurisdiction": JURISDICTIONS, "document_type": DOCUMENT_TYPES, "court_level": COURT_LEVELS}


class StatutaError(Exception):
    """An error with the status that a service would answer with."""

    status = 500


class NotFound(StatutaError):
    status = 404


class Invalid(StatutaError):
    status = 422


class Unauthorised(StatutaError):
    status = 401


def natural_id(*columns: str) -> Column:
    """An id that follows from the natural key, so a repeated run gives the same one."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def resources(spark) -> DataFrame:
    """The domains as a table: domain, name, description."""
    rows = [(domain, name, text) for domain, names in DOMAINS.items() for name, text in names.items()]
    return spark.createDataFrame(rows, "domain string, name string, description string")


def in_domain(column: str, domain: str) -> Column:
    return F.col(column).isNull() | F.col(column).isin(list(DOMAINS[domain]))
