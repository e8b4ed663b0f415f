from laneflow.functions.columns import (
    average_flow,
    double_of,
    http_timestamp,
    long_of,
    snapshot_name,
    vehicle_class,
)
from laneflow.functions.tokens import (
    field_count,
    has_fields,
    space_tokens,
    text_lines,
    token_count,
    whitespace_tokens,
)

__all__ = [
    "average_flow",
    "double_of",
    "field_count",
    "has_fields",
    "http_timestamp",
    "long_of",
    "snapshot_name",
    "space_tokens",
    "text_lines",
    "token_count",
    "vehicle_class",
    "whitespace_tokens",
]
