"""Spark-native history of route-origin authorizations."""

from originlake.model import FORMAT_VERSION, KEY, known_gaps, tal_catalog
from originlake.operators.history import append_days, build_history, counts, date_islands, fill_known_gaps, fix_history, latest_date, merge_history, rebuild_merge
from originlake.operators.index import prefix_roots, related_match, subtree_match, with_roots
from originlake.operators.query import health, lookup_prefix, page, search, search_page, validate_bulk, validate_one
from originlake.sources.dumps import list_dumps, parse_dumps
from originlake.sources.jsonl import export_jsonl, read_jsonl
from originlake.sources.store import bootstrap, open_store, publish, store_meta

__all__ = [
    "FORMAT_VERSION", "KEY", "append_days", "bootstrap", "build_history", "counts", "date_islands", "export_jsonl",
    "fill_known_gaps", "fix_history", "health", "known_gaps", "latest_date", "list_dumps", "lookup_prefix", "merge_history",
    "open_store", "page", "parse_dumps", "prefix_roots", "publish", "read_jsonl", "rebuild_merge", "related_match", "search",
    "search_page", "store_meta", "subtree_match", "tal_catalog", "validate_bulk", "validate_one", "with_roots",
]
