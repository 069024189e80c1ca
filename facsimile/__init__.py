"""Synthetic tables on Spark: learn the shape of a table and make a look-alike of any size."""

from facsimile.operators.flatten import flatten
from facsimile.operators.ingest import Ingested, ingest
from facsimile.operators.kinds import column_profile, detect_kinds
from facsimile.operators.model import Model, fit
from facsimile.operators.sample import sample
from facsimile.operators.state import FitState, learn_state
from facsimile.operators.synthesize import Synthesizer, conform_sample, synthesize
from facsimile.operators.typed import conform
from facsimile.operators.unflatten import unflatten
from facsimile.plans.avro import format_paths, table_schema
from facsimile.plans.shape import Plan, array_groups, infer_plan, plan_from_names
from facsimile.sinks.document import sample_document, width_errors
from facsimile.sinks.fanout import overall_status, write_all
from facsimile.sinks.files import as_records, write_files
from facsimile.sinks.tables import write_table
from facsimile.sources.landing import check_payloads, split_payloads
from facsimile.sources.tables import json_records, read_table, require_rows
from facsimile.streaming.events import classify_changes, parse_events, regenerate_on_change, resolve_tables

__all__ = [
    "FitState", "Ingested", "Model", "Plan", "Synthesizer", "array_groups", "as_records", "check_payloads", "classify_changes",
    "column_profile", "conform", "conform_sample", "detect_kinds", "fit", "flatten", "format_paths",
    "infer_plan", "ingest", "json_records", "learn_state", "overall_status", "parse_events", "plan_from_names", "read_table",
    "regenerate_on_change", "require_rows", "resolve_tables", "sample", "sample_document", "split_payloads",
    "synthesize", "table_schema", "unflatten", "width_errors", "write_all", "write_files", "write_table",
]
