"""tidemark: event-ledger and interval analytics on Spark DataFrames."""
