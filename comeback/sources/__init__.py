"""Reading event logs, writing reports, tables and models."""
