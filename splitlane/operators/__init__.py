"""DataFrame operators: marts, quality, metrics, readout, power and diagnostics."""
