from .config import SourceConfig, load_config
from .readers import read_csv, read_series_files, read_table, register_view
from .sinks import profile_rows, write_profile, write_report, write_series, write_value_series, write_value_table

__all__ = ["SourceConfig", "load_config", "profile_rows", "read_csv", "read_series_files", "read_table", "register_view",
           "write_profile", "write_report", "write_series", "write_value_series", "write_value_table"]
