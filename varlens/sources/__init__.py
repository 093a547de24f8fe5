"""Sources and sinks: numeric CSV import, synthetic benchmarks, saved models."""
