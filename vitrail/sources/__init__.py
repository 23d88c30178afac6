"""Sources and sinks: captures in PNG files, word tables, drawings and reports."""
