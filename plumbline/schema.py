"""The data model: tables, enumerations, the status machine."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the model.
CATEGORIES = ("RSV", "PCV", "SEV", "ECV", "COV", "CCV")
CATEGORY_LABELS = {"RSV": "Return Specification", "PCV": "Parameter Contract", "SEV": "Side Effect", "ECV": "Exception Contract", "COV": "Completeness Omission", "CCV": "Complexity Contract"}
CATEGORY_SEVERITY = {"RSV": "high", "PCV": "high", "SEV": "high", "ECV": "medium", "COV": "medium", "CCV": "low"}
#: The labels and severities of the codes that the exports look for; no category has such a code, so with them every
#: label is the bare category and every severity "low".
EXPORT_LABELS = {
    "B1": "Incorrect Return Value", "B2": "Missing Exception", "B3": "Wrong Exception Type", "B4": "Incorrect Side Effect", "B5": "Missing Side Effect",
    "C1": "Incorrect Precondition", "C2": "Missing Precondition", "C3": "Incorrect Postcondition", "C4": "Missing Postcondition",
    "V1": "Type Mismatch", "V2": "Range Violation", "V3": "Format Violation", "V4": "Constraint Violation",
}
EXPORT_SEVERITY = {"B1": "high", "B2": "high", "B3": "high", "C1": "high", "C3": "high", "B4": "medium", "B5": "medium", "C2": "medium", "C4": "medium", "V1": "medium"}
OUTCOMES = ("pass", "fail", "error", "undetermined")
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust"}
STATUSES = ("pending", "bce_running", "bce_complete", "dts_running", "dts_complete", "rv_running", "complete", "failed")
TERMINAL = ("complete", "failed")
TRANSITIONS = tuple(zip(STATUSES[:6], STATUSES[1:7])) + tuple((s, "failed") for s in STATUSES[:6])
MAX_FILES, MAX_BATCH_BYTES, MAX_FILE_BYTES = 50, 20 * 1024 * 1024, 1_048_576

PARAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("annotation", T.StringType()), T.StructField("default", T.StringType())])
RAISE = T.StructType([T.StructField("exception_class", T.StringType()), T.StructField("condition", T.StringType()), T.StructField("lineno", T.IntegerType())])
MUTATION = T.StructType([T.StructField("target", T.StringType()), T.StructField("method", T.StringType()), T.StructField("line", T.IntegerType())])
