"""Operators: functions of DataFrames that declare plans."""
