"""Sources and sinks: file tables, snapshots, wire formats."""
