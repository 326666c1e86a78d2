"""Sources: CSV, XLSX and ODS documents as frames."""
