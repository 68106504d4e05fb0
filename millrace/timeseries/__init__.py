"""Time-series features, decomposition, diagnostics, forecasting and change points."""
