"""Sources and sinks: file readers, the views over the driver tables, writers."""
