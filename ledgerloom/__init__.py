"""Statement reconciliation and audit over Spark DataFrames."""
