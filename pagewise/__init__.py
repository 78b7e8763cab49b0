"""Page classification, document grouping and usage-ledger transforms on Spark DataFrames."""
