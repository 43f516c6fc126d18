"""Operators: functions of DataFrames, declarative unless their order of work is sequential by nature."""
