"""Column builders: scalar, time-series, statistical and text expressions."""
