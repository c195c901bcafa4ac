"""Sources and sinks: the log derived from an event table, the log table, raw log files."""
