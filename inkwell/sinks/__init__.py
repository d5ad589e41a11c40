"""Writers: tables, event logs, files with their descriptions, guarded deletes."""
