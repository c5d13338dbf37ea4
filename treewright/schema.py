"""The intermediate representation: five tables per snapshot side, and result schemas.

Symbols are strings; `side` is before or after; `ord` is the 0-based position of
a call in its caller's evaluation order.
"""

from __future__ import annotations

SPAN = "file string, sl int, sc int, el int, ec int"
FUNCTIONS = f"side string, sym string, language string, module array<string>, container string, name string, label string, label_typed string, public boolean, {SPAN}"
CALLS = (
    "side string, caller string, ord int, callsite string, syntax_tag string, syntax_parts array<string>, receiver string, method string, expr string, confirmed boolean,"
    f" target_tag string, target string, signature string, resolution string, evidence string, reasons array<string>, label string, label_typed string, {SPAN}"
)
CANDIDATES = "side string, caller string, ord int, cand_ord int, target string, label string, label_typed string"
FACTS = f"side string, subject string, namespace string, kind string, key string, value string, {SPAN}"
ROOTS = "side string, sym string"
SOURCE_FILES = "side string, file string"
TREE = "root string, side string, path array<int>, depth int, key string, label string, label_typed string, relation string, callsite string, ancestors array<string>"
DIFF = "root string, path array<int>, depth int, key string, label string, relation string, before_label string, before_relation string, status string"

#: The order in which unresolved reasons are listed.
REASONS = ("opaque-input", "external-code", "external-memory", "function-pointer", "cross-crate-boundary", "analysis-limit", "unsupported-construct")

MAX_DEPTH = 8
LABEL_LIMIT = 96
