"""Sources and sinks: directory walks, documents, archives, catalogs, exports."""
