"""Whole analyses: the tables of each report and the registered queries."""
