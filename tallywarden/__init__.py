"""Detect unusual financial transactions and check financial records on Spark."""
