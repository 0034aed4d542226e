"""Forecast models fitted for every series in one job."""
