from .chain import CHAIN_FIELDS, NO_ENTRY, NO_RECORD, NOT_LINKED, NOT_THE_END, chain_breaks, chain_of, chained, ends, kept_heads, seals
from .clean import ORDER_FIELDS, PROCESSED_AT, conform, contract, stamp, transform_orders
from .compare import bucket_digests, differing_rows, require_same_rows, table_difference, unequal_buckets
from .ledger import (
    LEDGER_FIELDS,
    LEDGER_SCHEMA,
    NO_APPROVER,
    append_attempt,
    blocked_keys,
    chain_table,
    current_outcomes,
    ledger_breaks,
    seal_ledger,
    tampered,
    with_approver_default,
    with_integrity,
)
from .quality import (
    VALID_ORDER_ID,
    FAILED_EXPECTATIONS,
    Expectation,
    broken_rows,
    column_report,
    contract_violations,
    expect_and_count,
    expect_or_drop,
    expectation_counts,
    null_count,
    require_contract,
)
from .requests import (
    COMPLETED,
    FAIL,
    FAILED,
    OUTCOME_UNKNOWN,
    REFRESH_KEY,
    RUN,
    SKIP,
    TRIGGERING,
    blocks,
    refresh_decision,
    refresh_eligible,
    refresh_unblocked,
    release_tags,
    requested_refreshes,
)

__all__ = [
    "CHAIN_FIELDS",
    "NOT_LINKED",
    "NOT_THE_END",
    "NO_ENTRY",
    "NO_RECORD",
    "chain_breaks",
    "chain_of",
    "chain_table",
    "chained",
    "ends",
    "kept_heads",
    "ledger_breaks",
    "seal_ledger",
    "seals",
    "COMPLETED",
    "FAIL",
    "FAILED",
    "LEDGER_FIELDS",
    "LEDGER_SCHEMA",
    "NO_APPROVER",
    "ORDER_FIELDS",
    "OUTCOME_UNKNOWN",
    "PROCESSED_AT",
    "REFRESH_KEY",
    "RUN",
    "SKIP",
    "TRIGGERING",
    "VALID_ORDER_ID",
    "FAILED_EXPECTATIONS",
    "Expectation",
    "append_attempt",
    "blocks",
    "broken_rows",
    "bucket_digests",
    "column_report",
    "conform",
    "contract",
    "contract_violations",
    "blocked_keys",
    "current_outcomes",
    "differing_rows",
    "expect_and_count",
    "expect_or_drop",
    "expectation_counts",
    "null_count",
    "refresh_decision",
    "refresh_eligible",
    "refresh_unblocked",
    "release_tags",
    "requested_refreshes",
    "require_contract",
    "require_same_rows",
    "stamp",
    "table_difference",
    "tampered",
    "transform_orders",
    "unequal_buckets",
    "with_approver_default",
    "with_integrity",
]
