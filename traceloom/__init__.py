"""traceloom: program-analysis facts and audit event logs as PySpark DataFrames."""
