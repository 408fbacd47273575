"""Column functions: null rules, rounding, calendar, text, statistics, bins."""
