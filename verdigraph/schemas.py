"""Schemas of the tables that stages read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


WARNING = _struct(
    ("warning_id", _S), ("project", _S), ("project_url", _S), ("commit_id", _S), ("file_path", _S), ("line_number", _S), ("code_line", _S),
    ("enclosing_function", _S), ("bug_type", T.ArrayType(_S)), ("fuzz_result", _S), ("sink_type", _S), ("SinkType", _S), ("label", _S),
)
CHECKOUT = _struct(("project", _S), ("url", _S), ("commit", _S), ("dest", _S), ("type", _S), ("checked_out_commit", _S), ("ok", _B), ("error", _S))
UNIT = _struct(("key", _S), ("project", _S), ("commit", _S), ("testcase_folder", _S), ("repo_root", _S), ("status", _S), ("n_functions", _I), ("error", _S))
SIGNATURE = _struct(("ftype", _S), ("name", _S), ("return_type", _S), ("is_static", _B), ("param_types", T.ArrayType(_S)))
OCCURRENCE = _struct(("name", _S), ("row", _I))
PARAMETER = _struct(("parameter", _S), ("param_type", _S), ("param_name", _S), ("function_ptr", _B))
DECL = _struct(
    ("unit", _S), ("file_key", _S), ("sig", SIGNATURE), ("start_row", _I), ("start_col", _I), ("end_row", _I), ("end_col", _I), ("is_function", _B),
    ("calls", T.ArrayType(OCCURRENCE)), ("types_used", T.ArrayType(OCCURRENCE)), ("expr_used", T.ArrayType(OCCURRENCE)), ("parameter", T.ArrayType(PARAMETER)), ("body", _S),
)
USAGE = _struct(("input_tokens", _I), ("output_tokens", _I), ("total_tokens", _I))
LEVEL = _struct(("level", _I), ("label", _S), ("response", _S), ("reasoning", _S), ("usage", USAGE), ("estimated_input_tokens", _I), ("error", _S))
CALLERS = T.MapType(_S, T.MapType(_S, T.ArrayType(_S)))

# Labels, and the columns of a warning that a verdict repeats (its label becomes gold_label).
VALID = ("TP", "FP", "UNKNOWN")
DECISIVE = ("TP", "FP")
METADATA = ("warning_id", "project", "file_path", "line_number", "bug_type", "sink_type", "SinkType", "code_line", "function", "enclosing_function", "enclosing_function_identifier", "resolve_status", "commit_id", "project_url", "repo_url")
