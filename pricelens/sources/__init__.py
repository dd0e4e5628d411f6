"""Sources and sinks: driver-table views, wide-sheet scans, panel files."""
