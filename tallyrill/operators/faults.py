"""What becomes of records with a missing or invalid field: they are skipped, or the query fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(value: Column, fault: Column, node: str, on_missing: str, on_invalid: str) -> Column:
    """The value; reading it fails the query where the policy for its fault says so. The check is part of the value, so no optimizer rule can drop it."""
    for kind, action in (("missing", on_missing), ("invalid", on_invalid)):
        if action == "error":
            value = F.when(fault == kind, F.raise_error(F.lit(f"{node}: a field is {kind}"))).otherwise(value)
    return value


def kept(fault: Column, on_missing: str, on_invalid: str) -> Column:
    """Records without a fault, and those whose policy is to fail: reading their value does."""
    skipped = [kind for kind, action in (("missing", on_missing), ("invalid", on_invalid)) if action == "skip"]
    return (fault.isNull() | ~fault.isin(skipped)) if skipped else F.lit(True)
