"""Sources and sinks: CSV, JDBC, named tables, reports and the insight memory."""
