"""Account dimension and its required-field audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.functions.text import truthy_text

# The settings every account must carry.
REQUIRED_TEXT = ("account_name", "phone", "workspace_id", "base_url", "wa_config_id", "llm_provider")
REQUIRED_NUMBER = ("sse_timeout", "sse_read_timeout")


def audit_accounts(accounts: DataFrame, expected_phone: str | None = None) -> DataFrame:
    """One row per problem of an account: a missing field, malformed seller details, another phone."""
    found = [F.when(~truthy_text(c), F.lit(f"missing {c}")) for c in REQUIRED_TEXT]
    found += [F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.lit(f"missing {c}")) for c in REQUIRED_NUMBER]
    seller = F.col("seller_details")
    found.append(F.when(seller["firstName"].isNull() | seller["mobile"].isNull(), F.lit("seller_details malformed")))
    if expected_phone:
        found.append(F.when(~F.col("phone").eqNullSafe(F.lit(expected_phone)), F.lit("phone mismatch")))
    return accounts.select("account", F.explode(F.array_compact(F.array(*found))).alias("problem"))
