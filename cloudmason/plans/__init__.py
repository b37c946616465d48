"""cloudmason.plans: named queries over the test tables, with SQL for the same results."""
