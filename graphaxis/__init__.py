"""graphaxis: configuration-evidence reconciliation and corpus preparation on Spark."""
