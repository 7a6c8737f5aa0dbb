"""Statement ledger engine on Spark: page text in, reconciled ledger and aggregate queries out."""
