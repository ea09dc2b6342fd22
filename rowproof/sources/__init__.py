from rowproof.sources.files import source_edges, weigh_files
from rowproof.sources.readers import lost_cells, read_parquet, read_source, spread
from rowproof.sources.sinks import export_bundle, export_csv, publish, write_output

__all__ = ["export_bundle", "export_csv", "publish", "lost_cells", "read_parquet", "read_source",
           "source_edges", "spread", "weigh_files", "write_output"]
