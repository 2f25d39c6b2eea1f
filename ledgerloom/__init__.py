"""Evidence-grounded numeric facts on Spark: extraction, reconciliation and audit as DataFrame plans."""
