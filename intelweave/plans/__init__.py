"""Export plans: from merged tables to files."""
