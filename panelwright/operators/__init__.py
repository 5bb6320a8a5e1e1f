"""DataFrame operators: cross-sections, evaluation, portfolios, screening, catalog."""
