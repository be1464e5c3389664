"""Stable codes of refused queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, retry advice.
CODES = {
    "E_UNSUPPORTED_SYNTAX": "rewrite",
    "E_MULTI_STATEMENT": "rewrite",
    "E_FORBIDDEN_TOKEN": "rewrite",
    "E_STATEMENT_KIND": "rewrite",
    "E_INVALID_SQL": "rewrite",
    "E_UNKNOWN_NAME": "rewrite",
    "E_TOO_COMPLEX": "rewrite",
    "E_SIZE": "rewrite",
    "E_FORBIDDEN": "stop",
    "E_FUNCTION": "rewrite",
    "E_SYSTEM_OBJECT": "rewrite",
    "E_NO_LIMIT": "rewrite",
    "E_LIMIT_TOO_HIGH": "rewrite",
    "E_TIER": "ask_user",
    "E_DATABASE_NOT_SERVED": "ask_user",
    "E_UNMASK_OFF": "ask_user",
    "E_COST": "rewrite",
    "E_K_ANON": "stop",
    "E_ENGINE": "stop",
    "E_PLACEHOLDER": "rewrite",
    "E_MASKED_FILTER": "rewrite",
    "E_MASKED_EXPRESSION": "rewrite",
    "E_MASKED_ORDER": "rewrite",
    "E_MASKED_SET_OP": "rewrite",
    "E_MASK_UNCERTAIN": "rewrite",
    "E_MASKED_WRITE": "stop",
    "E_STALE": "rewrite",
    "E_GRANT_NEEDS_AGENT": "ask_user",
    "E_AUTO_DENY": "ask_user",
    "E_GRANTS_OFF": "ask_user",
    "E_POLICY": "stop",
}


class Refused(ValueError):
    """A query the usage rules do not allow."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason, self.retry = code, reason, CODES[code]


def refusal_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES.items()), "code string, retry string")
