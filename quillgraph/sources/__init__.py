"""Sources and sinks: state files, rule files, staging tables and tables of the driver."""

from .files import read_json_state, read_rules, read_staged, write_json_state, write_state

__all__ = ["read_json_state", "read_rules", "read_staged", "write_json_state", "write_state"]
