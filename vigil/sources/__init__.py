from vigil.sources.tables import TABLES, load, load_all, write_append, write_partitions

__all__ = ["TABLES", "load", "load_all", "write_append", "write_partitions"]
