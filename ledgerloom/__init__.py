"""ledgerloom: change-journal and code-graph analytics expressed as Spark plans."""
