"""barloom: DataFrame operators for panels of daily and intraday price bars."""
