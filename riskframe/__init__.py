"""riskframe."""
