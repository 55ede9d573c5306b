"""Sources and sinks: files of rows, documents, graphs and event logs."""
