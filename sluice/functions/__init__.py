from .columns import (
    average_cost, iso_datetime, iso_time, java_hash, mask, percent, render_template, shard_of, total_cost, truncate_text,
)
from .numbering import number_rows

__all__ = [
    "average_cost", "iso_datetime", "iso_time", "java_hash", "mask", "number_rows", "percent", "render_template",
    "shard_of", "total_cost", "truncate_text",
]
