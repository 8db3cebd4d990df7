"""Message sources (Kafka, files), vendor documents, and tables in a database."""

from tickloom.sources.messages import kafka_options, read_files, read_kafka
from tickloom.sources.tables import jdbc_options, read_jdbc, read_table

__all__ = ["jdbc_options", "kafka_options", "read_files", "read_jdbc", "read_kafka", "read_table"]
