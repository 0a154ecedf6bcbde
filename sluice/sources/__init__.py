from .changes import include_tables, parse_change_events, snapshot_then_changes
from .paging import assign_pages, deep_page_query, page_query, scroll_pages, scroll_query
from .tables import (
    bucket_count, kafka_options, kafka_receive, load_tables, open_source, place_rows, place_texts, read_shards, read_stream_query, register_views,
    shard_route, sql_query, write_buckets, write_shards,
)
from .topics import publish, topic_receive

__all__ = [
    "assign_pages", "bucket_count", "include_tables", "kafka_options", "kafka_receive", "load_tables", "open_source",
    "page_query", "parse_change_events", "place_rows", "place_texts", "publish", "read_shards", "read_stream_query", "register_views", "scroll_pages",
    "scroll_query", "shard_route", "snapshot_then_changes", "sql_query", "topic_receive", "write_buckets", "write_shards",
]
