"""Column functions: text keys, dates, money, geography, genres."""
