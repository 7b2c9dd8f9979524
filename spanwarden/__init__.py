"""spanwarden: sensitive-data detection, policy and rewriting as Spark DataFrame operators."""
