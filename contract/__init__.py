"""The driver's test tables bound to the canonical model, with SQL oracles to compare against."""
