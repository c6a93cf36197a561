"""Operators: functions from DataFrame(s) to DataFrame, and fit/apply pairs around them."""
