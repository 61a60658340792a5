"""Whole plans: the reporting marts, the reports on them, the build."""
