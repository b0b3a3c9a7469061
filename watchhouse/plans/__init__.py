"""Whole analyses: rule evaluation, dashboards, compliance reports."""
