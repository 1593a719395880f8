"""Readers and writers. Readers give DataFrames; what is small by nature (rule files) is read on the driver."""
