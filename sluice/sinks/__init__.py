from .payloads import kafka_payload, kafka_send
from .writers import KeyedTable, fan_out, jdbc_write_options, merge_into, merge_statement, with_retry, write_batch, write_table

__all__ = [
    "KeyedTable", "fan_out", "jdbc_write_options", "kafka_payload", "kafka_send", "merge_into", "merge_statement", "with_retry", "write_batch",
    "write_table",
]
