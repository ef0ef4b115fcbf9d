"""Column functions: fact tables and attributes, clocks, policy conditions."""
