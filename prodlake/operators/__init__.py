"""Table operators: cleaning, KPIs, portfolio aggregates, quality checks, forecasts."""
