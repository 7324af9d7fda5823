"""Relations of the engine, and the grammar of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "org string, root string, rel_path string, dir string, name string, ext string, size_bytes long, content string, error string, seq long"
TYPES = (
    "file_seq long, type_seq int, file string, node_id string, name string, qualified_name string, kind string, parent_id string, is_test boolean, "
    "loc int, line int, extends array<string>, implements array<string>"
)
METHODS = (
    "file_seq long, type_seq int, method_seq int, method_id string, class_id string, name string, arity int, first_param_type string, is_override boolean, "
    "is_test boolean, entry_point_reason string, line int, loc int, file string"
)
# Node types, statuses, and the kinds of occurrences that may not be what runs.
CLASS, INTERFACE, TRIGGER, COMPONENT, METHOD = "apex_class", "apex_interface", "apex_trigger", "lwc_component", "apex_method"
MODIFIED, IDENTICAL, ONLY_A, ONLY_B = "modified", "identical", "only_in_org_a", "only_in_org_b"
SPECULATIVE = ("possible_override", "possible_implementation")
LOW_SIGNAL = ("type_reference", "apex_unused_import")
# Platform interface, its method, arity and first parameter's type.
PLATFORM_METHODS = (
    ("batchable", "start", 1, "batchablecontext"),
    ("batchable", "execute", 2, "batchablecontext"),
    ("batchable", "finish", 1, "batchablecontext"),
    ("schedulable", "execute", 1, "schedulablecontext"),
    ("queueable", "execute", 1, "queueablecontext"),
    ("inboundemailhandler", "handleinboundemail", 2, "inboundemail"),
)


def class_key(name: Column) -> Column:
    """The key of a class by file name: trimmed, lower-case, with its extension."""
    key = F.lower(F.trim(name))
    return F.when(key.endswith(".cls"), key).otherwise(F.concat(key, F.lit(".cls")))
