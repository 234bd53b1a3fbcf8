"""Estimators, robustness checks and decision rules."""
