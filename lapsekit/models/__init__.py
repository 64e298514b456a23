"""Splitting, preparing, fitting, evaluating, tuning and scoring."""
