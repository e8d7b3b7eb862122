"""File records for tests."""

from __future__ import annotations

from stratalens.schema import (
    DEPENDENCY_COLS, OPTIONAL_SIGNAL_COLS, SIGNAL_COLS, SIZE_COLS, file_schema,
)


def record(**given) -> dict:
    """A file record with quiet values wherever none is given."""
    row = {
        "project_id": 1, "file_seq": 0, "layer": "service", "architecture_pattern": "layered",
        "architecture_confidence": 0.9, "source_code": None,
        **{c: 1.0 for c in SIZE_COLS}, **{c: 0.0 for c in DEPENDENCY_COLS},
        **{c: False for c in (*SIGNAL_COLS, *OPTIONAL_SIGNAL_COLS)},
    }
    row.update(given)
    row.setdefault("file_name", f"F{row['file_seq']}.java")
    row.setdefault("file_path", f"src/{row['file_name']}")
    for c in (*SIZE_COLS, *DEPENDENCY_COLS):
        row[c] = float(row[c])
    return row


def files(spark, *records: dict):
    schema = file_schema()
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in records], schema)
