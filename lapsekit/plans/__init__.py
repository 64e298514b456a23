"""Feature blocks, the customer feature table and the study built on it."""
