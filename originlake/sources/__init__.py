"""Sources and sinks: daily dumps, JSON lines, the stored history."""
